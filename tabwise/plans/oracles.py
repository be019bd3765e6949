"""The same results in SQL, for comparison with another engine."""

from __future__ import annotations

from collections.abc import Sequence

from tabwise.functions import keywords as kw

DIRTY = """dirty AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN -o_totalprice
         ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 53 = 0 THEN 'not a date' WHEN o_orderkey % 59 = 0 THEN NULL
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL
         WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderpriority || ' '
         ELSE o_orderpriority END AS o_orderpriority
  FROM orders, range(2) AS copies(copy)
  WHERE copy = 0 OR o_orderkey % 50 = 0
)"""

Columns = Sequence[tuple[str, str]]  # (name, kind)

TABLES: dict[str, Columns] = {
    "orders": (
        ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
        ("o_totalprice", "float"), ("o_orderdate", "date"), ("o_orderpriority", "string"),
    ),
    "dirty": (
        ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
        ("o_totalprice", "float"), ("o_orderdate", "string"), ("o_orderpriority", "string"),
    ),
    "lineitem": (
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
        ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
        ("l_tax", "float"), ("l_returnflag", "string"), ("l_linestatus", "string"),
        ("l_shipdate", "date"),
    ),
    "events": (
        ("event_id", "int"), ("ts", "date"), ("user_id", "int"), ("event_type", "string"),
        ("value", "float"), ("props", "string"),
    ),
    "customer": (
        ("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "float"),
        ("c_mktsegment", "string"),
    ),
    "documents": (
        ("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"),
        ("n_chars", "int"),
    ),
    "labels": (("doc_id", "int"), ("quality", "int"), ("toxic", "int")),
}

DATE_SHAPE = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})$"


def _each(columns: Sequence[str], one: str, separator: str = " UNION ALL ") -> str:
    return separator.join(one.replace("{c}", c) for c in columns)


def _stats(table: str, columns: Columns | None = None) -> str:
    """CTE body with one row of statistics per column."""
    parts = []
    for pos, (c, kind) in enumerate(columns or TABLES[table]):
        number, text = kind in ("int", "float"), kind == "string"
        values = (
            f"min(CAST({c} AS DOUBLE)) AS min_num, max(CAST({c} AS DOUBLE)) AS max_num, "
            f"avg(CAST({c} AS DOUBLE)) AS mean, median(CAST({c} AS DOUBLE)) AS median"
            if number
            else "NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num, NULL::DOUBLE AS mean, "
            "NULL::DOUBLE AS median"
        )
        texts = (
            f"avg(length({c})) AS avg_len, "
            f"coalesce(avg(CAST(regexp_matches({c}, '{DATE_SHAPE}') AS INT)), 0) AS date_like_ratio"
            if text
            else "NULL::DOUBLE AS avg_len, NULL::DOUBLE AS date_like_ratio"
        )
        token = (
            "FALSE"
            if kind == "date"
            else f"coalesce(bool_or(lower(CAST({c} AS VARCHAR)) IN "
            "('true', 'false', 'yes', 'no', '1', '0')), FALSE)"
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", {pos} AS pos, '{kind}' AS kind, count(*) AS \"rows\", "
            f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {values}, {texts}, "
            f"{token} AS any_bool_token FROM {table}"
        )
    return "\n  UNION ALL ".join(parts)


def _words(words: Sequence[str]) -> str:
    return "regexp_matches(lower(\"column\"), '" + "|".join(words) + "')"


ROLE = f"""CASE
    WHEN kind = 'date' THEN 'Date'
    WHEN ({_words(kw.ID_WORDS)} OR lower("column") IN ('uuid', 'index')) AND kind <> 'float'
      AND (unique_ratio > 0.8 OR kind = 'string' OR lower("column") IN
           ('employee_id', 'customerid', 'customer_id', 'id', 'index', 'uuid')) THEN 'Identifier'
    WHEN "distinct" = 2 AND any_bool_token THEN 'Boolean'
    WHEN {_words(kw.DATE_ROLE_WORDS)} OR (kind = 'string' AND date_like_ratio >= 0.8) THEN 'Date'
    WHEN kind IN ('int', 'float') THEN 'Numerical'
    WHEN kind = 'string' AND avg_len > 20 AND ("distinct" > 10 OR unique_ratio > 0.5) THEN 'Text'
    ELSE 'Categorical' END"""

IS_DATE = f"""(kind = 'date' OR (kind = 'string' AND date_like_ratio >= 0.8)
    OR ({_words(kw.DATE_LIST_WORDS)} AND NOT {_words(kw.NOT_DATE_WORDS)}))"""


def _roled(table: str, columns: Columns | None = None, before: str = "") -> str:
    """WITH clause ending in ``roled``: statistics, role and tags per column."""
    first = f"{before}, " if before else ""
    return f"""WITH {first}stats AS (
  {_stats(table, columns)}
), ratios AS (
  SELECT *, "distinct" / greatest(1, "rows") AS unique_ratio FROM stats
), dated AS (
  SELECT *, {ROLE} AS role, coalesce({IS_DATE}, FALSE) AS is_date FROM ratios
), listed AS (
  SELECT *, NOT is_date AND kind IN ('int', 'float') AS is_numeric FROM dated
), roled AS (
  SELECT *, NOT is_date AND NOT is_numeric AS is_categorical,
    {_words(kw.ID_WORDS)} AND unique_ratio > 0.95 AND "distinct" > 1 AS is_primary_key,
    {_words(kw.ID_WORDS)} AND NOT (unique_ratio > 0.95 AND "distinct" > 1) AS is_foreign_key,
    {_words(kw.CURRENCY_WORDS)} AND is_numeric AS is_currency,
    {_words(kw.PERCENTAGE_WORDS)} AND is_numeric AND coalesce(min_num >= 0 AND
      (max_num <= 1.05 OR (max_num <= 105 AND max_num > 1.5)), FALSE) AS is_percentage,
    {_words(kw.GEO_WORDS)} AS is_geo,
    {_words(kw.TARGET_WORDS)} AS is_target
  FROM listed
)"""


DUPLICATES = "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))"
DIRTY_NAMES = [c for c, _ in TABLES["dirty"]]
NULL_TOTAL = " + ".join(f"count(*) - count({c})" for c in DIRTY_NAMES)

SUMMARY = f"""{DIRTY}, counted AS (
  SELECT count(*) AS row_count, 6 AS column_count, CAST({NULL_TOTAL} AS BIGINT) AS total_nulls,
    {DUPLICATES} AS duplicate_count FROM dirty
), summary AS (
  SELECT *, CAST(greatest(50, least(100, 100 - trunc(
    total_nulls / (row_count * column_count) * 40 + duplicate_count / row_count * 30))) AS INT)
    AS quality_score FROM counted
)"""

STEPS = """, placed AS (
  SELECT {date} AS d, lag({date}) OVER (ORDER BY {order}) AS p FROM {table}
), step AS (
  SELECT CAST(floor((epoch_us(d) - epoch_us(p)) / 86400000000) AS BIGINT) AS step, count(*) AS n
  FROM placed WHERE p IS NOT NULL GROUP BY 1
), modal AS (SELECT step AS modal_step FROM step ORDER BY n DESC, step LIMIT 1)
SELECT '{date}' AS date_column, {sorted} AS is_chronologically_sorted,
  CASE WHEN modal_step = 1 THEN 'Daily' WHEN modal_step = 7 THEN 'Weekly'
       WHEN modal_step BETWEEN 28 AND 31 THEN 'Monthly' ELSE 'Irregular' END AS estimated_frequency,
  modal_step, strftime((SELECT min(d) FROM placed), '%Y-%m-%d') AS min_date,
  strftime((SELECT max(d) FROM placed), '%Y-%m-%d') AS max_date
FROM modal"""


def _structure(table: str, date: str, order: str, in_order: str) -> str:
    body = STEPS.format(table=table, date=date, order=order, sorted=in_order)
    return "WITH none AS (SELECT 1)" + body


NEGATIVE = "'Non-negative values constraint'"
OUTLIER = "'Statistical outlier threshold'"


def _negative(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", {NEGATIVE} AS rule,
  'Found ' || n || ' negative entries in ''{column}''. Values must be >= 0.' AS violation_desc,
  'WARNING' AS severity, n AS n_rows
FROM (SELECT count(*) AS n FROM {table} WHERE {column} < 0) WHERE n > 0"""


def _outlier(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", {OUTLIER} AS rule,
  'Found ' || n || ' entries in ''{column}'' exceeding 3 standard deviations (outliers).'
    AS violation_desc, 'INFO' AS severity, n AS n_rows
FROM (SELECT count(*) AS n FROM {table},
        (SELECT avg({column}) AS m, stddev_samp({column}) AS s, count({column}) AS c FROM {table})
      WHERE c > 5 AND s > 0 AND abs(({column} - m) / s) > 3) WHERE n > 0"""


VIOLATIONS = ", found AS (" + " UNION ALL ".join(
    [_negative("dirty", "o_totalprice")]
    + [_outlier("dirty", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
) + ")"
REPORT = VIOLATIONS + """, report AS (
  SELECT count(*) AS violation_entries,
    CAST(coalesce(sum(n_rows) FILTER (severity <> 'INFO'), 0) AS BIGINT) AS total_violations_count,
    count(*) FILTER (severity = 'ERROR') = 0 AS validation_passed FROM found
)"""
CERTIFICATE = REPORT + """, cert AS (
  SELECT CAST(100 - least(40, 5 * total_violations_count) AS INT) AS overall_confidence_score,
    CASE WHEN total_violations_count = 0 THEN 'APPROVED' ELSE 'APPROVED_WITH_WARNINGS' END AS status,
    'Governance QA' AS signoff_officer,
    'Audit complete. Data matches schema bounds. ' || total_violations_count
      || ' warning anomalies flagged during intake.' AS governance_verdict FROM report
)"""
AUDIT = """, sides AS (
  SELECT (SELECT count(*) FROM dirty) AS b, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS a
), audit AS (
  SELECT 0 AS pos, 'Intake Rows Count' AS metric, CAST(b AS VARCHAR) AS value FROM sides
  UNION ALL SELECT 1, 'Cleaned Rows Count', CAST(a AS VARCHAR) FROM sides
  UNION ALL SELECT 2, 'Deduplicated Rows Removed', CAST(b - a AS VARCHAR) FROM sides
  UNION ALL SELECT 3, 'Total Logical Violations Found', CAST(total_violations_count AS VARCHAR) FROM report
  UNION ALL SELECT 4, 'Audited Compliance Score', overall_confidence_score || '%' FROM cert
  UNION ALL SELECT 5, 'Signoff Audit Status', status FROM cert
  UNION ALL SELECT 6, 'Governance Officer', signoff_officer FROM cert
  UNION ALL SELECT 7, 'Governance Verdict', governance_verdict FROM cert
)"""

CLEANED = DIRTY + """, deduplicated AS (SELECT DISTINCT * FROM dirty),
middle AS (SELECT median(o_totalprice) AS m FROM deduplicated), cleaned AS (
  SELECT o_orderkey, o_custkey, regexp_replace(o_orderstatus, '^\\s+|\\s+$', '', 'g') AS o_orderstatus,
    round(coalesce(o_totalprice, m), 4) AS o_totalprice,
    strftime(try_strptime(coalesce(o_orderdate, 'Unknown'), '%Y-%m-%d'), '%Y-%m-%d') AS o_orderdate,
    regexp_replace(coalesce(o_orderpriority, 'Unknown'), '^\\s+|\\s+$', '', 'g') AS o_orderpriority
  FROM deduplicated, middle
)"""


def _sum_by(table: str, label: str, value: str, tail: str) -> str:
    return f"""SELECT {label} AS label,
  round(CAST(coalesce(sum(CAST({value} AS DECIMAL(18, 2))), 0) AS DOUBLE), 2) AS value
FROM {table} WHERE {label} IS NOT NULL GROUP BY 1 {tail}"""


def _correlations(table: str, columns: Sequence[str]) -> str:
    cells = [
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"round(coalesce(corr({a}, {b}), 0), 6) AS r FROM {table}"
        for a in columns
        for b in columns
    ]
    return " UNION ALL ".join(cells)


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]

BATCH = """trend AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1
), bars AS (
  SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 10
), shares AS (
  SELECT o_orderstatus AS label, count(*) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6
), points AS (
  SELECT * FROM (SELECT o_custkey AS x, o_totalprice AS value,
    row_number() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice) - 1 AS pos FROM orders
    WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL) WHERE pos < 150
), r AS (SELECT corr(o_custkey, o_totalprice) AS r FROM orders), batch AS (
  SELECT 'chart_o_orderdate_o_totalprice_line' AS chart_id, 'line' AS chart_type, 'primary' AS slot,
    CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS pos, label, NULL::VARCHAR AS series,
    NULL::DOUBLE AS x, round(value, 4) AS value FROM trend
  UNION ALL SELECT 'chart_o_orderpriority_o_totalprice_bar', 'bar', 'primary',
    row_number() OVER (ORDER BY value DESC, label) - 1, label, NULL, NULL, round(value, 4) FROM bars
  UNION ALL SELECT 'chart_o_orderstatus_None_pie', 'pie', 'primary',
    row_number() OVER (ORDER BY value DESC, label) - 1, label, NULL, NULL, value FROM shares
  UNION ALL SELECT 'chart_o_custkey_o_totalprice_scatter', 'scatter', 'primary', pos,
    'Rec ' || pos, NULL, x, round(value, 4) FROM points
  UNION ALL SELECT 'chart_None_None_heatmap', 'heatmap', 'supporting', pos, a, b, NULL,
    CASE WHEN a = b THEN 1.0 ELSE round(r, 4) END FROM r, (VALUES
      (0, 'o_custkey', 'o_custkey'), (1, 'o_custkey', 'o_totalprice'),
      (2, 'o_totalprice', 'o_custkey'), (3, 'o_totalprice', 'o_totalprice')) AS cell(pos, a, b)
)"""

CANDIDATES = """, d AS (
  SELECT "column" AS x, row_number() OVER (ORDER BY pos) AS i FROM roled WHERE role = 'Date'
), n AS (
  SELECT "column" AS y, row_number() OVER (ORDER BY pos) AS j FROM roled WHERE role = 'Numerical'
), c AS (
  SELECT "column" AS x, row_number() OVER (ORDER BY pos) AS i FROM roled WHERE role = 'Categorical'
), s AS (
  SELECT "column" AS x, "distinct", row_number() OVER (ORDER BY role DESC, pos) AS i FROM roled
  WHERE role IN ('Categorical', 'Boolean')
), every AS (
  SELECT 1 AS g, i, j, 'trend_' || x || '_' || y AS chart_id, 'line' AS chart_type, x AS x_col,
    y AS y_col, y || ' Trend Over Time' AS title,
    'Analysis of ' || y || ' trends chronologically across ' || x || '.' AS description
    FROM d, n WHERE j <= 2
  UNION ALL SELECT 2, i, j, 'bar_' || x || '_' || y, 'bar', x, y, 'Total ' || y || ' by ' || x,
    'Comparison of cumulative ' || y || ' performance across ' || x || ' segments.'
    FROM c, n WHERE i <= 2 AND j <= 2
  UNION ALL SELECT 3, i, 0, 'pie_' || x, 'pie', x, NULL, 'Distribution by ' || x,
    'Segment share breakdown for ' || x || ' categories.' FROM s
    WHERE i <= 2 AND "distinct" BETWEEN 2 AND 10
  UNION ALL SELECT 4, 0, 0, 'scatter_' || a.y || '_' || b.y, 'scatter', a.y, b.y,
    a.y || ' vs ' || b.y || ' Correlation',
    'Statistical dispersion mapping of ' || a.y || ' against ' || b.y || '.'
    FROM n a, n b WHERE a.j = 1 AND b.j = 2
  UNION ALL SELECT 5, 0, 0, 'correlation_heatmap', 'heatmap', NULL, NULL, 'Variable Correlation Matrix',
    'Pearson correlation coefficient heatmap showing relationships between all numeric variables.'
    FROM n WHERE j = 3
)
SELECT CAST(row_number() OVER (ORDER BY g, i, j) - 1 AS INT) AS pos, chart_id, chart_type, x_col,
  y_col, title, description
FROM every QUALIFY pos < 4"""


def _kpis(table: str, lines: Sequence[tuple[str, str, str, str]]) -> str:
    """Lines are (title, value SQL, display SQL over v, description)."""
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, '{title}' AS title, round(CAST(v AS DOUBLE), 4) AS value, "
        f"{shown} AS display, '{text}' AS description FROM (SELECT {value} AS v FROM {table})"
        for i, (title, value, shown, text) in enumerate(lines)
    )


MONEY, COUNT = "'$' || format('{:,.2f}', CAST(v AS DOUBLE))", "format('{:,}', CAST(v AS BIGINT))"
DIGITS = "CAST(v AS VARCHAR)"
CENTS = "sum(CAST({} AS DECIMAL(18, 2)))"

SALES_LINES = [
    ("Total Revenue", CENTS.format("l_extendedprice"), MONEY,
     "Cumulative revenue from l_extendedprice column"),
    ("Total Volume", "sum(l_quantity)", "format('{:,.1f}', v)", "Sum of transaction items/records"),
    ("Average Ticket Size", "avg(l_extendedprice)", MONEY, "Average transaction value"),
]

DOMAIN_SQL = """WITH names AS (
  SELECT table_name, column_name AS c FROM (VALUES {values}) AS v(table_name, column_name)
), present AS (
  SELECT names.* FROM names, (SELECT count(*) AS n FROM orders) WHERE n > 0
)
SELECT table_name, 'substring' AS mode,
  CASE WHEN bool_or(regexp_matches(c, 'sales|revenue|amount|price')) THEN 'Sales & Revenue'
       WHEN bool_or(regexp_matches(c, 'employee|salary|attrition')) THEN 'Human Resources'
       WHEN bool_or(regexp_matches(c, 'churn|customer|charges')) THEN 'Customer Churn'
       ELSE 'Operations Performance' END AS domain
FROM present GROUP BY table_name
UNION ALL SELECT table_name, 'exact',
  CASE WHEN bool_or(c IN ('sales', 'revenue', 'amount', 'price')) THEN 'Sales'
       WHEN bool_or(c IN ('employee', 'salary', 'attrition', 'tenure')) THEN 'HR'
       WHEN bool_or(c IN ('budget', 'ebitda', 'profit', 'charges')) THEN 'Finance'
       WHEN bool_or(c IN ('conversion', 'clicks', 'cac', 'roas')) THEN 'Marketing'
       ELSE 'General Operations' END
FROM present GROUP BY table_name"""


def _domain_sql() -> str:
    values = ", ".join(
        f"('{t}', '{c}')" for t in ("orders", "customer", "events") for c, _ in TABLES[t]
    )
    return DOMAIN_SQL.format(values=values)


PRICED: Columns = (
    ("discount_rate", "float"), ("tax_pct", "float"), ("quantity_share", "float"),
    ("price_ratio", "float"),
)
PRICED_VIEW = """priced AS (
  SELECT l_discount AS discount_rate, l_tax * 100 AS tax_pct, l_quantity AS quantity_share,
    l_extendedprice AS price_ratio FROM lineitem
)"""
SUGGESTED: Columns = tuple(
    ("Quantity" if c == "l_quantity" else c, k) for c, k in TABLES["lineitem"]
)

BEST = "(SELECT o_orderpriority AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"
CHOSEN = (
    ("o_orderdate", "o_totalprice", "How do sales develop?"),
    ("o_orderpriority", "o_totalprice", "Which priority sells most?"),
    ("o_orderstatus", None, "How are orders spread over states?"),
    ("o_custkey", "o_totalprice", "Do customers differ?"),
    (None, None, "What moves together?"),
)


def _chart_insights() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, 'Significant variance or pattern detected in {title}.' AS finding, "
        f"'Analyzed ' || count(*) || ' records across {x} and {y or 'distribution'}.' AS evidence, "
        f"'Understanding relationships between {x} and {y or 'distribution'} enables key margin "
        "improvements.' AS business_impact, 'High' AS confidence FROM orders"
        for i, (x, y, title) in enumerate(CHOSEN)
    )


LOG = (
    "SELECT turn AS id, CAST(conv_id AS VARCHAR) AS project_id, role AS log_type, text AS message, "
    "CAST(length(text) AS INT) AS n_chars FROM conversations"
)


BIG_MONEY = """big AS (
  SELECT l_suppkey, l_orderkey, l_returnflag, l_tax, CAST(CAST(l_extendedprice AS DECIMAL(15, 2))
    * 1000000000::DECIMAL(10, 0) + 0.01::DECIMAL(3, 2) AS DECIMAL(28, 2)) AS price FROM lineitem
)"""

SAMPLED = (
    "SELECT '{c}' AS \"column\", round(coalesce(avg(CAST(regexp_matches(v, '" + DATE_SHAPE
    + "') AS INT)), 0), 6) AS date_like_ratio FROM (SELECT arg_min({c}, md5({c})) AS v FROM dirty "
    "WHERE {c} IS NOT NULL GROUP BY CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT) % 10)"
)

LEFT_OUT = """, asked AS (
  SELECT * FROM (VALUES (0, 'o_orderdate', 'o_totalprice'), (1, 'o_orderpriority', 'o_totalprice'),
    (2, 'o_orderstatus', NULL), (3, 'o_orderkey', 'o_totalprice'), (4, 'o_orderstatus', NULL),
    (5, 'o_missing', 'o_totalprice'), (6, 'o_custkey', 'o_totalprice'), (7, NULL, NULL)) AS a(pos, x_col, y_col)
), judged AS (
  SELECT a.*, x.role AS x_role, y.role AS y_role,
    (x_col IS NULL OR coalesce(x.role <> 'Identifier', FALSE))
      AND (y_col IS NULL OR coalesce(y.role <> 'Identifier', FALSE)) AS fit
  FROM asked a LEFT JOIN roled x ON x."column" = a.x_col LEFT JOIN roled y ON y."column" = a.y_col
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY x_col, y_col, fit ORDER BY pos) AS repeat FROM judged
), drawn AS (
  SELECT *, count(*) FILTER (fit AND repeat = 1) OVER (ORDER BY pos) AS drawn FROM numbered
)
SELECT CAST(pos AS INT) AS pos, x_col, y_col, CASE
    WHEN (x_col IS NOT NULL AND x_role IS NULL) OR (y_col IS NOT NULL AND y_role IS NULL) THEN 'no such column'
    WHEN NOT fit THEN 'identifier' WHEN repeat > 1 THEN 'asked before' ELSE 'beyond the limit' END AS reason
FROM drawn WHERE NOT fit OR repeat > 1 OR drawn > 4"""


def _correlation_wide(n: int = 60) -> str:
    """All pairs of sixty columns in one aggregate."""
    columns = ", ".join(
        f"CASE WHEN {'(l_orderkey + %d) %% 11 <> 0' % i if i % 2 else 'TRUE'} THEN "
        f"CAST(l_quantity * {i % 13} + l_extendedprice / 100 * {i * 7 % 5} + l_partkey * {i * 3 % 4} "
        f"+ l_linenumber * {i + 1} AS DOUBLE) END AS c{i}"
        for i in range(n)
    )
    cells = ", ".join(
        f"{{'col_a': 'c{a}', 'col_b': 'c{b}', 'r': round(coalesce(corr(c{a}, c{b}), 0), 6)}}"
        for a in range(n)
        for b in range(n)
    )
    return f"SELECT cell.* FROM (SELECT unnest([{cells}]) AS cell FROM (SELECT {columns} FROM lineitem))"


def _batch_all() -> str:
    def months(value: str) -> str:
        return f"SELECT strftime(o_orderdate, '%Y-%m') AS label, sum({value}) AS value FROM orders GROUP BY 1"

    def by(label: str, value: str, limit: str = "") -> str:
        return f"SELECT {label} AS label, {value} AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 {limit}"

    series = [
        ("o_orderdate", "o_totalprice", "line", "Sales by month", months("o_totalprice"), "label"),
        ("o_orderpriority", "o_totalprice", "bar", "Sales by priority", by("o_orderpriority", "sum(o_totalprice)", "LIMIT 3"), "value DESC, label"),
        ("o_orderstatus", None, "pie", "Orders by state", by("o_orderstatus", "count(*)"), "value DESC, label"),
        ("o_orderpriority", None, "pie", "Orders by priority", by("o_orderpriority", "count(*)"), "value DESC, label"),
        ("o_orderstatus", "o_totalprice", "bar", "Sales by state", by("o_orderstatus", "sum(o_totalprice)", "LIMIT 3"), "value DESC, label"),
        ("o_orderdate", "o_custkey", "line", "Customer numbers by month", months("o_custkey"), "label"),
    ]
    parts = [
        f"SELECT 'chart_{x}_{y}_{kind}' AS chart_id, '{kind}' AS chart_type, "
        f"'{'primary' if i < 4 else 'supporting'}' AS slot, '{title}' AS title, "
        f"CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS pos, label, NULL::VARCHAR AS series, "
        f"NULL::DOUBLE AS x, round(CAST(value AS DOUBLE), 4) AS value FROM ({body})"
        for i, (x, y, kind, title, body, order) in enumerate(series)
    ]
    parts.append(
        "SELECT 'chart_o_custkey_o_totalprice_scatter', 'scatter', 'supporting', 'Sales over customers', pos, "
        "'Rec ' || pos, NULL, x, round(value, 4) FROM (SELECT o_custkey AS x, o_totalprice AS value, "
        "row_number() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice) - 1 AS pos FROM orders) WHERE pos < 200"
    )
    parts.append(
        "SELECT 'chart_None_None_heatmap', 'heatmap', 'supporting', 'Correlations', pos, a, b, NULL, "
        "CASE WHEN a = b THEN 1.0 ELSE round(r, 4) END FROM (SELECT corr(o_custkey, o_totalprice) AS r FROM orders), "
        "(VALUES (0, 'o_custkey', 'o_custkey'), (1, 'o_custkey', 'o_totalprice'), (2, 'o_totalprice', 'o_custkey'), "
        "(3, 'o_totalprice', 'o_totalprice')) AS cell(pos, a, b)"
    )
    return " UNION ALL ".join(f"({p})" if "LIMIT" in p else p for p in parts)


def all_oracles() -> dict[str, str]:
    lineitem = [c for c, _ in TABLES["lineitem"]]
    numbers = [c for c, k in TABLES["lineitem"] if k in ("int", "float")]
    digits = ("unique_ratio", "mean", "min_num", "max_num", "median", "avg_len", "date_like_ratio")
    found = {
        "table_shape": f"WITH {DIRTY} SELECT count(*) AS row_count, 6 AS column_count FROM dirty",
        "table_summary": f"WITH {SUMMARY} SELECT * FROM summary",
        "quality_score": f"WITH {SUMMARY} SELECT quality_score FROM summary",
        "duplicate_count": f"WITH {DIRTY} SELECT {DUPLICATES} AS duplicate_count",
        "null_counts": f"WITH {DIRTY} "
        + _each(DIRTY_NAMES, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM dirty"),
        "distinct_counts": _each(
            lineitem, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM lineitem"
        ),
        "distinct_counts_text": _each(
            [c for c, _ in TABLES["documents"]],
            "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM documents",
        ),
        "numeric_summary": _each(
            numbers,
            "SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, "
            "round(CAST(min({c}) AS DOUBLE), 6) AS min_num, "
            "round(CAST(max({c}) AS DOUBLE), 6) AS max_num, "
            "round(median({c}), 6) AS median FROM lineitem",
        ),
        "string_lengths": _each(
            ["text", "lang", "source"],
            "SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_len FROM documents",
        ),
        "date_likeness": f"WITH {DIRTY} "
        + _each(
            ["o_orderstatus", "o_orderdate", "o_orderpriority"],
            "SELECT '{c}' AS \"column\", round(avg(CAST(regexp_matches({c}, '"
            + DATE_SHAPE
            + "') AS INT)), 6) AS date_like_ratio FROM dirty",
        ),
        "column_profile": _roled("dirty", before=DIRTY)
        + " SELECT \"column\", pos, CASE kind WHEN 'int' THEN 'bigint' WHEN 'float' THEN 'double' "
        "ELSE 'string' END AS spark_type, kind, \"rows\", nulls, \"distinct\", "
        + ", ".join(f"round({d}, 6) AS {d}" for d in digits)
        + ", any_bool_token FROM roled",
        "time_series_structure_by_key": _structure(
            "orders", "o_orderdate", "o_orderkey, o_orderdate",
            "(SELECT count(*) = 0 FROM placed WHERE d < p)",
        ),
        "time_series_structure_by_date": _structure("events", "ts", "ts", "NULL::BOOLEAN"),
        "derived_unit_price": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, "
        "l_extendedprice, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem",
        "derived_suggestions": _roled(
            "renamed",
            SUGGESTED,
            "renamed AS (SELECT *, l_quantity AS Quantity FROM lineitem)",
        )
        + """, money AS (SELECT count(*) AS n, min_by("column", pos) AS first FROM roled WHERE is_currency)
SELECT 'Cost-to-Revenue Ratio' AS metric_name, 'Cost / Revenue' AS formula,
  'Financial performance ratio analysis.' AS rationale FROM money WHERE n >= 2
UNION ALL SELECT 'Average Unit Price', first || ' / Quantity', 'Unit economics calculation.'
FROM money WHERE n >= 1""",
        "column_roles_fast": _roled("lineitem") + ' SELECT "column", kind, role FROM roled',
        "column_roles_stored": _roled("lineitem") + ' SELECT "column", kind, role FROM roled',
        "role_tags": _roled("lineitem")
        + ' SELECT "column", is_date, is_numeric, is_categorical, is_primary_key, is_foreign_key, '
        "is_currency, is_percentage, is_geo, is_target FROM roled",
        "percentage_fields": _roled("priced", PRICED, PRICED_VIEW)
        + ' SELECT "column" FROM roled WHERE is_percentage',
        "bi_mapping": _roled("orders")
        + """ SELECT 'metrics' AS concept, "column" FROM roled
  WHERE is_currency OR is_percentage OR (is_numeric AND NOT is_primary_key)
UNION ALL SELECT 'dimensions', "column" FROM roled WHERE is_categorical AND NOT is_geo AND NOT is_target
UNION ALL SELECT 'date_columns', "column" FROM roled WHERE is_date
UNION ALL SELECT 'geographic_columns', "column" FROM roled WHERE is_geo
UNION ALL SELECT 'financial_columns', "column" FROM roled WHERE is_currency
UNION ALL SELECT 'customer_columns', "column" FROM roled
  WHERE is_target OR regexp_matches("column", 'cust|client|emp')""",
        "relationships": _roled("lineitem")
        + """ SELECT x."column" AS x_col, y."column" AS y_col, x.role AS x_type, y.role AS y_type,
  x."distinct" AS unique_x_count FROM roled x, roled y
WHERE x.role IN ('Date', 'Categorical', 'Boolean') AND y.role = 'Numerical'""",
        "domain": _domain_sql(),
        "chart_candidates": _roled("orders") + CANDIDATES,
        "drop_duplicates": f"WITH {DIRTY} SELECT DISTINCT * FROM dirty",
        "impute_median": f"WITH {DIRTY} SELECT * REPLACE (round(coalesce(o_totalprice, "
        "(SELECT median(o_totalprice) FROM dirty)), 4) AS o_totalprice) FROM dirty",
        "fill_unknown": f"WITH {DIRTY} SELECT * REPLACE (coalesce(o_orderdate, 'Unknown') AS o_orderdate, "
        "coalesce(o_orderpriority, 'Unknown') AS o_orderpriority) FROM dirty",
        "trim_text": f"WITH {DIRTY} SELECT * REPLACE (trim(o_orderstatus) AS o_orderstatus, "
        "trim(o_orderpriority) AS o_orderpriority) FROM dirty",
        "standardize_dates": f"WITH {DIRTY} SELECT * REPLACE (strftime(try_strptime(o_orderdate, "
        "'%Y-%m-%d'), '%Y-%m-%d') AS o_orderdate) FROM dirty",
        "mixed_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL "
        "ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate FROM orders",
        "clean_table": f"WITH {CLEANED} SELECT * FROM cleaned",
        "clean_reconciliation": f"WITH {DIRTY}, sides AS (SELECT (SELECT count(*) FROM dirty) AS b, "
        "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS a) SELECT b AS before_rows, "
        "a AS after_rows, b - a AS rows_dropped, round(a / b * 100, 6) AS retention_pct FROM sides",
        "negative_rule": f"WITH {DIRTY} {_negative('dirty', 'o_totalprice')} "
        f"UNION ALL {_negative('dirty', 'o_custkey')}",
        "negative_rule_balances": f"{_negative('customer', 'c_acctbal')} "
        f"UNION ALL {_negative('supplier', 's_acctbal')}",
        "outlier_rule": " UNION ALL ".join(
            [_outlier("events", "value"), _outlier("events", "user_id"),
             _outlier("documents", "n_chars")]
        ),
        "outlier_rows": "SELECT event_id, event_type, 'value' AS \"column\", value AS outlier_value, "
        "round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, "
        "stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) > 3",
        "violations": f"WITH {DIRTY}{VIOLATIONS} SELECT * FROM found",
        "violation_report": f"WITH {DIRTY}{REPORT} SELECT * FROM report",
        "governance_score": f"WITH {DIRTY}{CERTIFICATE} SELECT * FROM cert",
        "live_certificate": f"WITH {SUMMARY} SELECT quality_score AS overall_confidence_score, "
        "'APPROVED' AS status, 'Reporting' AS signoff_officer, "
        "'Data validation check completed successfully.' AS governance_verdict FROM summary",
        "governance_audit": f"WITH {DIRTY}{CERTIFICATE}{AUDIT} SELECT * FROM audit",
        "monthly_trend": _sum_by("orders", "strftime(o_orderdate, '%Y-%m')", "o_totalprice", ""),
        "monthly_trend_lineitem": _sum_by(
            "lineitem", "strftime(l_shipdate, '%Y-%m')", "l_extendedprice", ""
        ),
        "top_categories": _sum_by(
            "lineitem", "CAST(l_suppkey AS VARCHAR)", "l_extendedprice",
            "ORDER BY value DESC, label LIMIT 10",
        ),
        "top_priorities": _sum_by(
            "orders", "o_orderpriority", "o_totalprice", "ORDER BY value DESC, label LIMIT 10"
        ),
        "bottom_categories": _sum_by(
            "lineitem", "CAST(l_suppkey AS VARCHAR)", "l_extendedprice",
            "ORDER BY value, label LIMIT 10",
        ),
        "value_counts": "SELECT event_type AS label, count(*) AS value FROM events "
        "WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
        "frequent_values_even": "SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS value FROM lineitem "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
        "frequent_values_skewed": "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 's' || l_orderkey % 7 "
        "ELSE l_orderkey || '-' || l_linenumber || '-' || l_partkey END AS label, count(*) AS value FROM lineitem "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "value_share": "WITH shown AS (SELECT event_type AS label, count(*) AS value FROM events "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6) SELECT label, value, "
        "round(value * 100 / sum(value) OVER (), 1) AS share FROM shown",
        "scatter_points": "SELECT CAST(pos AS INT) AS pos, 'Rec ' || pos AS label, x, y FROM ("
        "SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY l_orderkey, "
        "l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem) WHERE pos < 150",
        "scatter_all_points": f"WITH {DIRTY} SELECT CAST(o_custkey AS DOUBLE) AS x, "
        "o_totalprice AS y FROM dirty WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL",
        "correlation_matrix": _correlations("lineitem", LINE_NUMBERS),
        "correlation_with_nulls": f"WITH {DIRTY} "
        + _correlations("dirty", ["o_orderkey", "o_custkey", "o_totalprice"]),
        "chart_type_choice": "SELECT * FROM (VALUES "
        "(0, 'o_orderdate', 'o_totalprice', 'How do sales develop?', 'line'), "
        "(1, 'o_orderpriority', 'o_totalprice', 'Which priority sells most?', 'bar'), "
        "(2, 'o_orderstatus', NULL, 'How are orders spread over states?', 'pie'), "
        "(6, 'o_custkey', 'o_totalprice', 'Do customers differ?', 'scatter'), "
        "(7, NULL, NULL, 'What moves together?', 'heatmap')) "
        "AS t(pos, x_col, y_col, title, chart_type) WHERE (SELECT count(*) FROM orders) > 0",
        "chart_batch": f"WITH {BATCH} SELECT * FROM batch",
        "chart_export": f"WITH {BATCH} SELECT * FROM batch",
        "segment_means": "SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS value "
        "FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "segment_insights": f"""SELECT 0 AS pos, 'The segment ''' || s || ''' displays the highest metric average at '
  || format('{{:,.2f}}', m) || '.' AS finding,
  'Concentration of performance in a single category creates structural dependency risks.' AS risk,
  'Scale operations in this high-performing segment to capture market share.' AS opportunity,
  'Allocate 15% more budget/resources to this category in Q3.' AS action, 96 AS confidence_score
FROM {BEST}
UNION ALL SELECT 1, 'Total volume across all ' || count(*)
  || ' records is distributed unevenly across secondary cohorts.',
  'Underperforming cohorts drain capital without returning positive margins.',
  'Optimize low-yielding cohorts by standardizing operations.',
  'Conduct a performance review of the bottom-quartile segments.', 90 FROM orders""",
        "chart_insights": _chart_insights(),
        "kpi_sales": _kpis("lineitem", SALES_LINES),
        "kpi_scorecard": "SELECT pos, title AS kpi_metric, display AS value, "
        f"description AS strategic_description FROM ({_kpis('lineitem', SALES_LINES)})",
        "kpi_rate_hr": _kpis(
            "labels",
            [
                ("Total Headcount", "count(*)", COUNT, "Active employee database record count"),
                ("Attrition Rate", "100.0 * count(*) FILTER (toxic = 1) / count(*)",
                 "format('{:.1f}', v) || '%'",
                 "Percentage of employees left based on attrition"),
                ("Average Monthly Income", "avg(doc_id * 3 % 1000)", MONEY,
                 "Average base monthly salary"),
            ],
        ),
        "kpi_rate_churn": _kpis(
            "events",
            [
                ("Total Customer Pool", "count(*)", COUNT, "Subscriber record count"),
                ("Customer Churn Rate",
                 "100.0 * count(*) FILTER (event_type = ''error'') / count(*)".replace("''", "'"),
                 "format('{:.1f}', v) || '%'",
                 "Percentage of subscribers churned based on churn_state"),
                ("Avg Monthly Charges", "avg(value)", MONEY,
                 "Average monthly billing per customer"),
            ],
        ),
        "kpi_generic": _kpis(
            "events",
            [
                ("Total Row Count", "count(*)", COUNT, "Total observations scanned"),
                ("Average Value", "avg(user_id)", "format('{:,.2f}', v)", "Average of user_id"),
                ("Data Integrity Score", "100 + 0 * count(*)", "v || '/100'",
                 "Deduplication and rule validations score"),
            ],
        ),
        "kpi_spec": _kpis(
            "lineitem",
            [
                ("Gross", CENTS.format("l_extendedprice"), MONEY, "sum"),
                ("Ticket", "avg(l_extendedprice)", MONEY, "mean as money"),
                ("Rows", "count(*)", COUNT, "row count"),
                ("Quantity", "avg(l_quantity)", "format('{:.2f}', v)", "plain mean"),
                ("Absent", "min(NULL::DOUBLE)", "'N/A'", "missing column"),
                ("Returned", "count(*) FILTER (l_returnflag = 'R')", DIGITS, "flag count"),
            ],
        ),
        "kpi_spec_decimal": f"WITH {BIG_MONEY} SELECT 'Gross' AS title, "
        "CAST(sum(price) AS VARCHAR) AS digits, 'decimal' AS description FROM big "
        "UNION ALL SELECT 'Keys', CAST(sum(l_orderkey) AS VARCHAR) || '.00', 'long' FROM big",
        "kpi_spec_flags": f"WITH {BIG_MONEY} "
        + _kpis(
            "big",
            [
                ("Taxed", "count(*) FILTER (l_tax > 0.04)", MONEY, "sum"),
                ("Share", "avg(CAST(l_tax > 0.04 AS INT))", MONEY, "mean as money"),
                ("Plain", "avg(CAST(l_tax > 0.04 AS INT))", "format('{:.2f}', v)", "plain mean"),
                ("Returned", "count(*) FILTER (l_returnflag = 'R')", DIGITS, "flag count"),
                ("Text", "min(NULL::DOUBLE)", "'N/A'", "no number"),
            ],
        ),
        "kpi_default_specs": _kpis(
            "orders",
            [
                ("Total Gross Sales", CENTS.format("o_totalprice"), MONEY,
                 "Cumulative total billing revenue across segments."),
                ("Average Transaction Value", "avg(o_totalprice)", MONEY,
                 "Mean value generated per billing invoice."),
                ("Total Order Volume", "count(*)", COUNT,
                 "Aggregate volume of invoices processed."),
            ],
        ),
        "date_likeness_sampled": f"WITH {DIRTY} "
        + _each(["o_orderstatus", "o_orderdate", "o_orderpriority"], SAMPLED),
        "duplicate_count_nan": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderkey, "
        "o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END FROM orders)) "
        "AS duplicate_count FROM orders, range(2)",
        "numeric_summary_extreme": "WITH e AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END "
        "* CAST('1e' || (o_orderkey % 61 - 30) AS DOUBLE) AS magnitudes, "
        "CASE WHEN o_orderkey % 100 = 0 THEN 1e300 ELSE 1.0::DOUBLE + (o_orderkey % 9) * "
        "2.220446049250313e-16::DOUBLE END AS neighbours, (o_orderkey % 5) * 5e-324::DOUBLE AS denormals, "
        "1e308::DOUBLE + (o_orderkey % 7) * 1e307::DOUBLE AS huge FROM orders) "
        + _each(
            ["magnitudes", "neighbours", "denormals", "huge"],
            "SELECT '{c}' AS \"column\", min({c}) AS min_num, max({c}) AS max_num, median({c}) AS median FROM e",
        ),
        "derived_totals": "SELECT 'unit_price' AS metric_name, round(n, 4) AS numerator, "
        "round(d, 4) AS denominator, round(n / d, 4) AS value FROM (SELECT CAST("
        + CENTS.format("l_extendedprice") + " AS DOUBLE) AS n, sum(l_quantity) AS d FROM lineitem) "
        "UNION ALL SELECT 'tax_share', round(n, 4), round(d, 4), round(n / d, 4) FROM (SELECT CAST("
        + CENTS.format("l_tax") + " AS DOUBLE) AS n, CAST(" + CENTS.format("l_discount")
        + " AS DOUBLE) AS d FROM lineitem)",
        "outlier_rule_inf": _outlier("events", "value") + " UNION ALL " + _outlier("events", "user_id")
        + " UNION ALL " + _negative("events", "value") + " UNION ALL "
        + _negative("(SELECT CASE WHEN event_id % 1000 = 0 THEN 1 ELSE value END AS spiked FROM events)", "spiked"),
        "top_categories_decimal": f"WITH {BIG_MONEY} SELECT CAST(l_suppkey AS VARCHAR) AS label, "
        "CAST(sum(price) AS VARCHAR) AS value FROM big GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10",
        "correlation_inf": "SELECT a AS col_a, b AS col_b, CASE WHEN a = b THEN 1.0 WHEN a = 'l_tax' OR b = 'l_tax' "
        "THEN 0.0 ELSE r END AS r FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax')) x(a), "
        "(VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax')) y(b), "
        "(SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem)",
        "correlation_wide": _correlation_wide(),
        "chart_left_out": _roled("orders") + LEFT_OUT,
        "chart_batch_all": _batch_all(),
        "csv_types": "SELECT CAST(o_orderkey AS VARCHAR) AS whole, "
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 2 AS VARCHAR) END AS gappy, "
        "'1234567890' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS long_number, "
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey || '.5' END AS fraction, "
        "CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS flag, "
        "CASE WHEN o_orderkey % 11 <> 0 THEN 'x' || o_orderkey END AS word, "
        "'bigint,bigint,decimal(38,0),double,boolean,string' AS types FROM orders",
        "csv_rejects": "SELECT o_orderkey || ',' || o_orderstatus || CASE WHEN o_orderkey % 97 = 0 "
        "THEN ',surplus,' || o_orderkey ELSE ',\"open ' || o_orderkey END AS record, "
        "CASE WHEN o_orderkey % 97 = 0 THEN 4 ELSE 3 END AS fields, o_orderkey % 97 <> 0 AS open "
        "FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0",
        "csv_multiline": "SELECT o_orderkey AS key, o_orderstatus AS state, CASE WHEN o_orderkey % 3 = 0 "
        "THEN 'first' || chr(10) || '7,F,second ' || o_orderkey || chr(10) || chr(10) || '\"third\"' "
        "ELSE 'plain ' || o_orderkey END AS note FROM orders",
        "cleaned_gaps": f"WITH {CLEANED} "
        + _each(DIRTY_NAMES, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM cleaned"),
        "csv_roundtrip": f"WITH {DIRTY} SELECT * FROM dirty",
        "json_roundtrip": "SELECT * FROM customer",
        "report_tables": f"WITH {CLEANED.replace('cleaned AS', 'cleaned_rows AS')}"
        + """, checked AS (SELECT * FROM cleaned_rows)
SELECT 'cleaned' AS section, 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM checked
UNION ALL SELECT 'kpi', 'Total Revenue', '$' || format('{:,.2f}', CAST(sum(CAST(o_totalprice AS DECIMAL(18, 3))) AS DOUBLE)) FROM checked
UNION ALL SELECT 'kpi', 'Total Volume', format('{:,}', count(*)) FROM checked
UNION ALL SELECT 'kpi', 'Average Ticket Size', '$' || format('{:,.2f}', avg(o_totalprice)) FROM checked
UNION ALL SELECT 'audit', metric, value FROM ("""
        + "WITH dirty AS (SELECT * FROM checked)"
        + CERTIFICATE
        + """, sides AS (SELECT (SELECT count(*) FROM orders, range(2) AS copies(copy)
    WHERE copy = 0 OR o_orderkey % 50 = 0) AS b, (SELECT count(*) FROM checked) AS a)"""
        + AUDIT[AUDIT.index(", audit AS"):]
        + " SELECT * FROM audit)",
        "run_log_read": LOG,
        "run_log_project": LOG + " WHERE conv_id = 1",
        "run_log_follow": LOG,
    }
    for name in ("orders", "lineitem", "events", "customer", "documents", "labels"):
        found[f"column_roles_{name}"] = (
            _roled(name) + ' SELECT "column", kind, "distinct", role FROM roled'
        )
    return found
