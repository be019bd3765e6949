"""Following the run log as a stream, in place of polling it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.sources.run_log import SCHEMA, bucket_of


def follow_log(
    spark: SparkSession, path: str, project_id: object = None, max_files: int = 1000
) -> DataFrame:
    """A stream of event rows as they are appended, for one project or all.

    Each trigger reads only files not seen before.  Rows keep no order across
    triggers; order by ``ts, id`` where it matters.
    """
    log = (
        spark.readStream.schema(f"{SCHEMA}, bucket int")
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )
    if project_id is not None:
        key = F.lit(str(project_id))
        log = log.where((F.col("bucket") == bucket_of(key)) & (F.col("project_id") == key))
    return log.drop("bucket")
