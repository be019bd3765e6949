"""Table readers: format gate, missing tokens, type inference."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.functions.columns import ref
from tabwise.functions.keywords import MISSING_TOKENS
from tabwise.functions.staging import stage

INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
# Narrower than a cast, which also takes type suffixes such as "1d".
NUMBER_SHAPE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
#: In this order; text where none accepts all values.
INFERRED = ("bigint", "decimal(38,0)", "double", "boolean")
#: Column metadata of types that were inferred from text.
INFERRED_MARK = "inferred_from_text"
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")


# A quoted field with the comma or the line's start before it.
QUOTED_FIELD = r'(^|,)[ \t]*"[^"]*+(?:""[^"]*+)*+"[ \t]*(?=,|$)'
OPEN_FIELD = r'(^|,)[ \t]*"'
BAD_RECORD = "_bad_record"


def _header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line).columns


def _faults(record: Column, width: int, multi_line: bool) -> tuple[Column, Column]:
    """How many fields a record has, and whether it ends within a quoted one."""
    plain = F.regexp_replace(record, QUOTED_FIELD, "$1")
    fields = F.length(F.regexp_replace(plain, "[^,]", "")) + 1
    return fields, plain.rlike(OPEN_FIELD) & F.lit(not multi_line)


def csv_rejects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(record, fields, open): the records that a read would lose data of.

    Those with more fields than the header, and lines that end within a quoted field,
    which only a read with ``multi_line`` joins to the next one.  Fewer fields are no
    fault; the rest are missing values.
    """
    records = csv_records(spark, path) if multi_line else spark.read.text(path).select(F.col("value").alias("record"))
    width = len(_header(spark, path, multi_line))
    fields, open_ = _faults(F.col("record"), width, multi_line)
    return records.select("record", fields.alias("fields"), open_.alias("open")).where(
        (F.col("fields") > width) | F.col("open")
    )


#: What a row of the fold is: a whole record, or the part of one that its split holds.
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def _fold_records(inside_at: dict[tuple[str, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of file splits, in order, as records; a line within quotes goes to the one before.

    ``inside_at`` names the splits that start within quotes.  The first record of a file is
    its header and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, started, header = None, False, True, False
        held: list[str] = []
        out: list[tuple[str, str, int, int]] = []

        def close() -> None:
            if split is not None and (held or not started):
                out.append(("\n".join(held), *split, TAIL if started else MIDDLE))

        for batch in batches:
            files, blocks, lines = (batch.column(i) for i in range(3))
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
            for file, block, line, q in zip(files.to_pylist(), blocks.to_pylist(), lines.to_pylist(), quotes.tolist(), strict=True):
                if split != (file, block):
                    close()
                    split, held = (file, block), []
                    inside = inside_at.get(split, False)
                    started, header = not inside, block == 0
                held.append(line)
                inside ^= q % 2 == 1
                if not inside:
                    record = "\n".join(held)
                    record = record[:-1] if record.endswith("\r") else record
                    if not header and (record or not started):
                        out.append((record, file, block, WHOLE if started else HEAD))
                    held, started, header = [], True, False
            if out:
                yield _records(out)
                out.clear()
        close()
        if out:
            yield _records(out)

    return run


def _records(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record", "file", "block", "kind"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records below the header, with the line breaks in their quoted fields.

    Files are split like any text.  Whether a split starts within quotes follows from the
    number of quotes before it, so one scan counts them by split and a second joins lines
    to records; what lies across splits is joined from one part for each split.  The
    records are written once.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path, lineSep="\n").select(*place, "value")
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2
    splits = lines.groupBy("file", "block").agg(F.sum(odd).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One entry at most for each split that starts within quotes.
    inside = splits.select("file", "block", (before % 2 == 1).alias("inside")).where("inside").collect()
    inside_at = {(r["file"], r["block"]): True for r in inside}
    folded = stage(lines.mapInArrow(_fold_records(inside_at), "record string, file string, block long, kind int"), "csv-records")
    parts = folded.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    number = parts.withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    across = number.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return folded.where(F.col("kind") == WHOLE).select("record").unionByName(across.select(joined.alias("record")))


def _parsed(record: Column, names: Sequence[str]) -> Column:
    """The fields of a record as texts, by place."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return F.from_csv(record, schema, {"quote": '"', "escape": '"'})


def _raise_fault(path: str, fault: Row | None) -> None:
    if fault is not None:
        reason = "ends within a quoted field (multi_line=True reads such)" if fault["open"] else "has more fields than the header"
        raise ValueError(f"{path}: a record {reason}: {fault['record'][:200]!r}")


def _csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header row, split between tasks.

    One pass over the text finds the types and any record that would lose fields, which
    raises; ``csv_rejects`` lists them all.  ``multi_line`` is for fields with line breaks:
    ``csv_records`` joins their lines, and the pass goes over these.
    """
    names = _header(spark, path, multi_line)
    if multi_line:
        records, header = csv_records(spark, path), None
    else:
        lines = spark.read.text(path)
        # Each file starts with the header line, which is no record.
        header = lines.where(F.col("_metadata.file_block_start") == 0).first()
        records = lines.select(F.col("value").alias("record"))
    is_header = F.lit(False) if header is None else F.col("record") == header["value"]
    record = F.when(~is_header, F.col("record"))
    width, (fields, open_) = len(names), _faults(record, len(names), multi_line)
    fault = F.first(F.when((fields > width) | open_, F.struct("record", open_.alias("open"))), ignorenulls=True)
    texts = records.where(F.col("record") != "").select("record", _parsed(record, names).alias("r"))
    texts = texts.select("record", *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    seen, types = _type_facts(texts, names, [fault.alias("fault"), F.count_if(is_header).alias("headers")])
    _raise_fault(path, seen["fault"])
    if multi_line:
        return _as_types(texts.drop("record"), types)
    text = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    if seen["headers"] != len(lines.inputFiles()):
        return infer_types(text)  # a row reads like the header: only the reader tells them apart
    return _as_types(text, types)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": _csv,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
}


def format_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a table by extension or explicit format.

    ValueError for a format without a reader, FileNotFoundError for a path that
    does not exist on its file system; also for CSV records that do not fit the header
    (``multi_line``: quoted fields may hold line breaks).  NaN in typed files is left as it is, so
    that filters on fractions reach the scan; the operators read it as missing.
    """
    fmt = fmt or format_of(path)
    if fmt not in READERS:
        raise ValueError(f"Unsupported file format: {fmt or path}")
    try:
        return _csv(spark, path, multi_line) if fmt == "csv" else READERS[fmt](spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def _present(name: str, tokens: Sequence[str]) -> Column:
    return F.when(~ref(name).isin(*tokens), ref(name))


def _typed(text: Column, type_name: str) -> Column:
    if type_name == "bigint":
        return F.when(text.rlike(INTEGER_SHAPE), F.trim(text)).try_cast("bigint")
    if type_name == "decimal(38,0)":
        return F.when(text.rlike(INTEGER_SHAPE), F.trim(text)).try_cast("decimal(38,0)")
    if type_name == "boolean":
        return F.when(text.isin(*BOOLEAN_WORDS), F.lower(text)).try_cast("boolean")
    if type_name == "double":
        return F.when(text.rlike(NUMBER_SHAPE), F.trim(text)).try_cast("double")
    return text


def infer_types(
    text: DataFrame, missing_tokens: Sequence[str] = MISSING_TOKENS
) -> DataFrame:
    """Type a table of text columns: bigint, decimal(38,0), double, boolean or string.

    One aggregate counts, for every column, how many present values each type
    accepts; a type is taken when it accepts all of them.  Integers beyond the decimal
    stay text, as a double would make different ones equal.  The columns are marked as
    inferred, and stay so through projections and Parquet.
    """
    return _as_types(text, _type_facts(text, text.columns, [], missing_tokens)[1], missing_tokens)


def _type_facts(
    text: DataFrame, names: Sequence[str], extra: Sequence[Column], missing_tokens: Sequence[str] = MISSING_TOKENS
) -> tuple[Row, list[str]]:
    """The row of ``extra`` aggregates, and the type of each column, from one pass."""
    aggs = list(extra)
    for i, c in enumerate(names):
        value = _present(c, missing_tokens)
        aggs.append(F.count(value).alias(f"present{i}"))
        aggs.append(F.count_if(value.rlike(INTEGER_SHAPE)).alias(f"integers{i}"))
        for t in INFERRED:
            aggs.append(F.count(_typed(value, t)).alias(f"{t}{i}"))
    seen = text.agg(*aggs).first()

    def chosen(i: int) -> str:
        present = seen[f"present{i}"]
        if present == 0:
            return "double"
        fits = (t for t in INFERRED if seen[f"{t}{i}"] == present)
        found = next(fits, "string")
        return "string" if found == "double" and seen[f"integers{i}"] == present else found

    return seen, [chosen(i) for i in range(len(names))]


def _as_types(text: DataFrame, types: Sequence[str], missing_tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    return text.select(
        *[
            _typed(_present(c, missing_tokens), t).alias(c, metadata={INFERRED_MARK: True})
            for c, t in zip(text.columns, types, strict=True)
        ]
    )
