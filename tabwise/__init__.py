"""tabwise: business analytics over Spark tables of any size.

Profile a table, give each column a role, clean it, check business rules and
compute KPIs, chart series and segment insights.  Every operator takes and
returns DataFrames, so it composes with ``DataFrame.transform``.
"""

from tabwise.operators.charts import (
    Limits,
    bottom_categories,
    chart_batch,
    correlation_matrix,
    frequent_values,
    left_out,
    monthly_trend,
    plan_charts,
    scatter_points,
    segment_means,
    top_categories,
    value_counts,
    value_share,
)
from tabwise.operators.clean import (
    clean,
    drop_duplicates,
    fill_unknown,
    impute_median,
    reconcile,
    standardize_dates,
    trim_text,
)
from tabwise.operators.governance import governance_audit, governance_score, live_certificate
from tabwise.operators.insights import chart_insights, segment_insights
from tabwise.operators.kpi import default_kpi_specs, domain_kpis, evaluate_kpis, kpi_scorecard
from tabwise.operators.profile import (
    column_profile,
    date_likeness,
    derived_metrics,
    derived_suggestions,
    derived_totals,
    distinct_counts,
    duplicate_count,
    null_counts,
    numeric_summary,
    quality_score,
    table_shape,
    table_summary,
)
from tabwise.operators.roles import (
    assign_roles,
    bi_mapping,
    chart_candidates,
    detect_domain,
    relationships,
    schema_columns,
)
from tabwise.operators.rules import (
    negative_rule,
    outlier_rows,
    outlier_rule,
    violation_report,
    violations,
)
from tabwise.operators.sketches import (
    append_sketches,
    column_sketches,
    merged_counts,
    read_sketches,
)
from tabwise.operators.timeseries import time_series_structure
from tabwise.plans.analysis import discover, execute, ingest
from tabwise.sources.readers import csv_records, csv_rejects, infer_types, read_table
from tabwise.sources.run_log import append_log, read_log
from tabwise.sources.sinks import (
    write_chart_json,
    write_measured,
    write_report_tables,
    write_table,
)

__all__ = [name for name in dir() if not name.startswith("_")]
