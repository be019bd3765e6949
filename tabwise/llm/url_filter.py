"""URL rules by host suffix and path prefix, joined on short hash prefixes.

A rule is a host and the start of a path.  It fits the host itself and every
subdomain, where the URL's path starts with the rule's path.  Each distinct
(host, path) is expanded into its host suffixes with as many labels as some rule
has, times its path prefixes with as many characters as some rule has; any other
expression can equal no rule.  The expressions meet the rules in an equi-join on the
first 32 bits of their digest, the full digests confirm, and the longest rule wins.

Everything is DataFrame functions.  Equal (host, path) pairs are combined before the
join, so a host or URL in a third of all rows is expanded once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import table

#: (verdict, host, path)
Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Parts over which the rows of one URL are dealt.
SALTS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules],
        "verdict string, host string, path string",
    )


def _digest(host: Column, path: Column) -> Column:
    # Neither part can hold the separator's place of the other: a host has no "/".
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    ``rules`` has the columns verdict (allow or block), host, path.  Of the rules that
    fit, the one with the longest text (host and path together) wins; of equally long
    ones that with the longer host; of equal ones block.  ``default`` is the verdict
    where no rule fits.  A null URL, or one without ``://``, has empty host and path.
    Rules with a null or empty host fit nothing.  Rows with a null or repeated key are
    judged like any other, each once.  Other columns of ``pages`` are ignored.
    """
    rules = rules.select(
        F.col("verdict").alias("r_verdict"),
        F.translate("host", UPPER, LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
    ).where("r_host <> ''")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
    ).first()
    rows = pages.select(
        F.col(key).alias("k"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    if not shape["n"]:
        return rows.select(
            F.col("k").alias(key), "host", "path",
            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        )
    labels = F.array(*[F.lit(-n) for n in sorted(shape["labels"])])
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])])
    # A host with fewer labels than asked for gives itself again: array_distinct.
    suffixes = F.array_distinct(F.transform(labels, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), n)))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    wanted = (
        rows.where("host <> ''").select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", _short(F.col("digest")))
    )
    known = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "short", _short(F.col("r_digest"))
    )
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "block").alias("blocks"),
    )
    judged = (
        wanted.join(known, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("best"))
    )
    # A URL may be that of a third of all rows: they meet one of several copies of its verdict.
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return dealt.join(judged, ["host", "path", "salt"], "left").select(
        F.col("k").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, r_host, r_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT page_id, host, path, (
    SELECT max_by(r_host || r_path, length(r_host || r_path)) FROM rules
    WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  ) AS rule,
  coalesce((
    SELECT max_by(verdict, length(r_host || r_path)) FROM rules
    WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  ), 'allow') AS verdict
FROM parts
"""
