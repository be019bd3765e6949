"""The run log: append-only event rows, read by project in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id bigint, project_id string, ts timestamp, agent string, log_type string, "
    "target_agent string, message string, payload string"
)
# Log folders are fixed in number, so many projects do not mean many small
# files; within a folder rows are sorted by project for row-group pruning.
BUCKETS = 64


def bucket_of(project_id: Column) -> Column:
    return F.pmod(F.xxhash64(project_id.cast("string")), F.lit(BUCKETS)).cast("int")


def append_log(rows: DataFrame, path: str) -> None:
    """Append event rows; a struct or map payload is stored as JSON text.

    Rows are rebalanced by bucket: adaptive execution merges small buckets into
    one writer and splits the one a busy project is in.
    """
    payload = F.col("payload")
    if rows.schema["payload"].dataType.typeName() != "string":
        payload = F.to_json(payload)
    columns = [
        F.col("id").cast("bigint").alias("id"),
        F.col("project_id").cast("string").alias("project_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        *[F.col(c).cast("string").alias(c) for c in ("agent", "log_type", "target_agent", "message")],
        payload.alias("payload"),
    ]
    placed = rows.select(*columns).withColumn("bucket", bucket_of(F.col("project_id")))
    (
        placed.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "project_id", "ts", "id")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, project_id: object = None) -> DataFrame:
    """Event rows of one project (or all), ordered by time and id."""
    log = spark.read.schema(f"{SCHEMA}, bucket int").parquet(path)
    if project_id is not None:
        key = F.lit(str(project_id))
        log = log.where((F.col("bucket") == bucket_of(key)) & (F.col("project_id") == key))
    return log.drop("bucket").orderBy("project_id", "ts", "id")


def decode_payload(log: DataFrame, schema: str) -> DataFrame:
    return log.withColumn("payload", F.from_json("payload", schema))
