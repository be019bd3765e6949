import datetime

import pytest
from pyspark.sql import functions as F

from tabwise.functions.dates import date_of, iso_day, looks_like_date, micros, parse_text_date
from tabwise.operators.timeseries import time_series_structure


@pytest.mark.parametrize(
    "text, day",
    [
        ("2025-04-13", "2025-04-13"),
        ("2025/4/3", "2025-04-03"),
        ("04/13/2025", "2025-04-13"),
        ("4-3-2025", "2025-04-03"),
        (" 2025-04-13 ", "2025-04-13"),
        ("20250413", "2025-04-13"),
        ("2025-04-13 10:11:12", "2025-04-13"),
        ("2025-04-13T10:11:12", "2025-04-13"),
        ("junk", None),
        ("2025-02-30", None),
        ("13/13/2025", None),
        ("Unknown", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_text_date(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(iso_day(parse_text_date(F.col("t")))).first()[0] == day


def test_date_shape(spark):
    texts = ["2025-4-3", "2025/04/03", "4/3/2025", "04-03-2025", "2025-4", "x2025-04-03", "25-04-03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(looks_like_date(F.col("t"))).collect()]
    assert got == [True, True, True, True, False, False, False]


def test_numbers_are_not_dates(spark):
    df = spark.createDataFrame([(2020,)], "Year int")
    assert df.select(date_of(df, "Year")).first()[0] is None


def test_micros(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:58.5' AS a, TIMESTAMP_NTZ'2024-02-29 01:02:03.000004' AS b")
    a, b = df.select(micros(F.col("a")), micros(F.col("b"))).first()
    moment = datetime.datetime(2024, 2, 29, 1, 2, 3, 4, tzinfo=datetime.timezone.utc)
    assert a == -1_500_000
    assert b == int(moment.timestamp()) * 1_000_000 + 4


def brute_force(pairs):
    """Steps in row order, by hand."""
    ordered = [d for _, d in sorted(pairs)]
    steps = {}
    for before, after in zip(ordered, ordered[1:]):
        step = (after - before) // datetime.timedelta(days=1)
        steps[step] = steps.get(step, 0) + 1
    modal = min(steps, key=lambda s: (-steps[s], s))
    return modal, all(a <= b for a, b in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("shape", ["daily", "weekly", "mixed", "hot", "constant", "descending"])
def test_structure_matches_brute_force(spark, shape):
    start = datetime.datetime(2024, 1, 1)
    day = datetime.timedelta(days=1)
    pairs = {
        "daily": [(i, start + i * day) for i in range(300)],
        "weekly": [(i, start + 7 * i * day) for i in range(300)],
        "mixed": [(i, start + (i * 37 % 101) * day / 3) for i in range(400)],
        "hot": [(5 if i % 3 else i, start + (i % 11) * day) for i in range(600)],
        "constant": [(i, start) for i in range(50)],
        "descending": [(i, start - i * day) for i in range(200)],
    }[shape]
    df = spark.createDataFrame(pairs, "k bigint, d timestamp_ntz").repartition(5)
    row = time_series_structure(df, "d", ["k"]).first()
    modal, in_order = brute_force(pairs)
    assert (row["modal_step"], row["is_chronologically_sorted"]) == (modal, in_order)
    assert row["min_date"] == str(min(d for _, d in pairs))[:10]
    assert row["max_date"] == str(max(d for _, d in pairs))[:10]


def test_half_a_day_back_is_minus_one(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-02 12:00:00'), (2, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(k, d)"
    )
    assert time_series_structure(df, "d", ["k"]).first()["modal_step"] == -1


def test_structure_does_not_depend_on_the_time_zone(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-03-09 00:30:00'), (2, TIMESTAMP_NTZ'2024-03-10 02:30:00'),"
        " (3, TIMESTAMP_NTZ'2024-03-11 23:30:00') AS t(k, d)"
    )
    expected = time_series_structure(df, "d", ["k"]).first()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = time_series_structure(df, "d", ["k"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == expected
    assert (found["min_date"], found["max_date"], found["modal_step"]) == ("2024-03-09", "2024-03-11", 1)


def test_without_order_the_flag_is_unknown(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2025-01-08",), ("bad",), ("2025-01-15",)], "d string")
    row = time_series_structure(df, "d").first()
    assert row["is_chronologically_sorted"] is None
    assert row["estimated_frequency"] == "Weekly"


def test_one_date_has_no_structure(spark):
    df = spark.createDataFrame([("2025-01-01",), ("bad",), (None,)], "d string")
    assert time_series_structure(df, "d").count() == 0
