"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's.

    Where neither is set, a local session gets a temporary folder; on a cluster each node
    would have its own, and tables would come back with rows missing, so that raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {SETTING} to a folder that all nodes share")
        folder = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tabwise-"))
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and unlike a row checkpoint keeps
    column pruning and filter pushdown for the passes that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
