"""Binary files of our own formats in the shared folder, written and read by tasks.

Paths are URIs of any file system that Arrow knows (file, hdfs, s3, gs, ...).  A task
attempt writes under a name of its own and returns it as a row; the table of these rows,
committed by Spark, is what names the files that count.  What a lost or repeated attempt
leaves behind is named in no row and never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from tabwise.functions.staging import scratch_path


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder."""
    folder = scratch_path(spark, name)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return folder


def create_file(folder: str, suffix: str):
    """A new file in the folder: its URI and an open stream."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str):
    """A seekable reader."""
    fs, path = _open(uri)
    return fs.open_input_file(path)
