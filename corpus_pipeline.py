"""From raw documents to packed training sequences.

Each stage works on the documents that the one before it kept, is written as Parquet and
read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.staging import scratch_path, stage
from tabwise.llm import decontaminate, near_dedup, packing, quality
from tabwise.llm.common import table
from tabwise.llm.tokens import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Numbers the rows of a stage, as doc_id can be null or repeated.
ROW = "row_of_stage"
VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rule ensemble, learnt from the labels of these documents, rejects."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) one row:
    of those with the least id any one; one whose id is null only if no other has an id."""
    rows = stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = near_dedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    groups = rows.select(ROW, "doc_id").join(found.select(F.col("doc_id").alias(ROW), "component_id").hint("merge"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).getField(ROW)
    kept = groups.groupBy("component_id").agg(first.alias(ROW)).select(ROW)
    return rows.join(kept.hint("merge"), ROW, "left_semi").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(VOCABULARY), END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: A learnt model and a tokenizer's ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
