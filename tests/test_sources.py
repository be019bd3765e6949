import datetime
import json

import random

import pytest
from pyspark.sql import functions as F

from tabwise.functions.columns import nan_to_null
from tabwise.operators.profile import null_counts
from tabwise.sources import run_log, samples, sinks
from tabwise.sources.readers import read_table
from tabwise.streaming.run_log import follow_log


def csv(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_inference_and_missing_tokens(spark, tmp_path, rows):
    path = csv(
        tmp_path,
        "i,f,b,s,gap,mixed,none\n"
        "1,1.5,True,x,1,True,\n"
        "-2,NaN,false,N/A,,1,NULL\n"
        "+3,1e3,TRUE,None,3,x,n/a\n",
    )
    df = read_table(spark, path)
    assert types(df) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "gap": "bigint",
        "mixed": "string", "none": "double",
    }
    assert rows(df, "i", "f", "s", "gap") == [(-2, None, None, None), (1, 1.5, "x", 1), (3, 1000.0, None, 3)]


def test_quoted_line_breaks_and_quotes(spark, tmp_path, rows):
    path = csv(tmp_path, 'a,b\n"one\ntwo",1\n"say ""hi"", ok",2\n')
    assert rows(read_table(spark, path, multi_line=True)) == [("one\ntwo", 1), ('say "hi", ok', 2)]
    with pytest.raises(ValueError, match="multi_line"):
        read_table(spark, path)


@pytest.mark.parametrize("multi_line", [False, True])
def test_surplus_fields_raise_and_are_listed(spark, tmp_path, rows, multi_line):
    from tabwise.sources.readers import csv_rejects

    path = csv(tmp_path, 'a,b\n1,2\n3,4,5\n"x, ""y"", z",6\n7\n8,"9",\n5" pipe,1\n')
    found = csv_rejects(spark, path, multi_line)
    assert rows(found) == [('3,4,5', 3, False), ('8,"9",', 3, False)]
    with pytest.raises(ValueError, match="more fields"):
        read_table(spark, path, multi_line=multi_line)
    short = csv(tmp_path, 'a,b\n1,2\n\n"x, ""y"", z",6\n7\n', "short.csv")
    assert rows(read_table(spark, short, multi_line=multi_line)) == [('1', 2), ('7', None), ('x, "y", z', 6)]


def test_type_suffixes_are_text(spark, tmp_path, rows):
    path = csv(tmp_path, "size,num,far\n1d,.5,inf\n2f,1.,-Infinity\n3D,-2E-3,1\n")
    df = read_table(spark, path)
    assert types(df) == {"size": "string", "num": "double", "far": "double"}
    assert rows(df, "num") == [(-0.002,), (0.5,), (1.0,)]


def test_huge_integers_stay_apart(spark, tmp_path):
    path = csv(tmp_path, f"n,m,d\n12345678901234567890,1,1\n12345678901234567891,{'9' * 50},1.5\n")
    df = read_table(spark, path)
    assert types(df) == {"n": "decimal(38,0)", "m": "string", "d": "double"}
    assert df.select("n").distinct().count() == 2


def test_format_gate(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, csv(tmp_path, "a\n1\n", "t.xlsx"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), str(tmp_path / "x"), "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_round_trip(spark, tmp_path, rows, fmt):
    df = spark.createDataFrame([(1, " a ", 1.5), (2, None, 2.5)], "i bigint, s string, v double")
    path = str(tmp_path / f"t.{fmt}")
    sinks.write_table(df, path, fmt)
    sinks.write_table(df, path, fmt)
    assert rows(read_table(spark, path), "i", "s", "v") == [(1, " a ", 1.5), (2, None, 2.5)]


def test_nan_is_missing_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").write.parquet(path)
    df = read_table(spark, path)
    assert null_counts(df).first()["nulls"] == 1
    assert nan_to_null(df).where("v IS NULL").count() == 1
    plan = df.where("v > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,0.5)" in plan


def test_chart_json(spark, tmp_path):
    batch = spark.createDataFrame(
        [("c", "pie", "primary", p, f"l{p}", None, None, float(p)) for p in (2, 0, 1)],
        "chart_id string, chart_type string, slot string, pos int, label string, series string, x double, value double",
    )
    path = tmp_path / "charts"
    sinks.write_chart_json(batch, str(path))
    lines = [line for f in path.glob("part-*") for line in f.read_text().splitlines()]
    charts = [json.loads(line) for line in lines]
    assert [p["label"] for p in charts[0]["points"]] == ["l0", "l1", "l2"]


def log_rows(spark, ids):
    start = datetime.datetime(2024, 1, 1)
    data = [
        (i, f"p{i % 3}", start + datetime.timedelta(seconds=100 - i), "agent", "system", None, f"m{i}", (i, "x"))
        for i in ids
    ]
    return spark.createDataFrame(
        data,
        "id bigint, project_id string, ts timestamp, agent string, log_type string, target_agent string, "
        "message string, payload struct<n:bigint,t:string>",
    )


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    run_log.append_log(log_rows(spark, range(20)), path)
    run_log.append_log(log_rows(spark, range(20, 30)), path)
    one = run_log.read_log(spark, path, "p1")
    assert [r["id"] for r in one.collect()] == sorted((i for i in range(30) if i % 3 == 1), reverse=True)
    assert run_log.read_log(spark, path).count() == 30
    decoded = run_log.decode_payload(one, "n bigint, t string").first()
    assert decoded["payload"]["n"] == decoded["id"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(project_id,p1)" in plan


def test_follow_log(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")

    def advance():
        follow_log(spark, path, "p1").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "offsets")
        ).trigger(availableNow=True).start(out).awaitTermination()
        return {r["id"] for r in spark.read.schema(run_log.SCHEMA).parquet(out).collect()}

    run_log.append_log(log_rows(spark, range(6)), path)
    assert advance() == {1, 4}
    run_log.append_log(log_rows(spark, range(6, 12)), path)
    assert advance() == {1, 4, 7, 10}


def test_samples(spark):
    sales = samples.sample_sales(spark)
    assert sales.count() == 150
    assert sales.where("Amount IS NULL").count() == 6 and sales.where("Amount = -250").count() == 1
    assert sales.where("Category IS NULL").count() == 3
    assert sales.where("Quantity NOT BETWEEN 1 AND 9").count() == 0
    assert sales.where("Date NOT BETWEEN '2025-01-01' AND '2025-04-30'").count() == 0
    assert sales.collect() == samples.sample_sales(spark).collect()
    hr = samples.sample_hr(spark)
    assert hr.select("Employee_ID").distinct().count() == 120
    assert hr.where("MonthlyIncome IS NULL").count() == 4 and hr.where("Age = -5").count() == 1
    big = samples.sample_hr(spark, rows=20_000)
    assert abs(big.where("Attrition = 'Yes'").count() / 20_000 - 0.15) < 0.01
    shares = {r[0]: r[1] / 20_000 for r in big.groupBy("Department").agg(F.count("*")).collect()}
    assert abs(shares["Research & Development"] - 0.35) < 0.02


def test_records_across_splits(spark, tmp_path, rows):
    """Line breaks, commas and quotes in quoted fields of files cut into many splits."""
    rng = random.Random(3)
    want, lines = [], []
    for i in range(400):
        text = "".join(rng.choice(['a', 'b,', '""', "\n", "\n\n", "7,x\n", " "]) for _ in range(rng.randrange(0, 30)))
        lines.append(f'{i},"{text}",z')
        want.append((i, text.replace('""', '"') or None, "z"))
    (tmp_path / "t").mkdir()
    for k in range(2):
        body = "\n".join(["k,note,w", *lines[k::2]]) + ("\n" if k else "")
        (tmp_path / "t" / f"{k}.csv").write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = read_table(spark, str(tmp_path / "t"), "csv", multi_line=True)
            assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_crlf_and_blank_lines(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    got = read_table(spark, str(tmp_path / "c.csv"), multi_line=True)
    assert rows(got) == [(1, "x\r\ny"), (2, "z")]


def test_a_row_that_reads_like_the_header(spark, tmp_path, rows):
    (tmp_path / "h.csv").write_text("a,b\n1,2\na,b\n3,4\n")
    assert rows(read_table(spark, str(tmp_path / "h.csv"))) == [("1", "2"), ("3", "4"), ("a", "b")]


def test_a_csv_is_read_twice(spark, tmp_path):
    """Once for types and rejects, once for the rows."""
    (tmp_path / "n.csv").write_text("a,b\n" + "\n".join(f"{i},x{i}" for i in range(50)))
    group = "csv-scans"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = read_table(spark, str(tmp_path / "n.csv"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string"]
    assert jobs <= 6  # two look at the first lines only
