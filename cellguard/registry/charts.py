"""Registered chart and histogram queries on the test cohort (subjects derived from orders/lineitem/customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ChartConfig
from ..operators import histogram as H
from ..plans import chart as C
from ..sources import testdata as T
from . import sqlparts as S

# Fixed parameters of the registered queries.
CFG = ChartConfig(age_min=35, age_max=75, age_step=5, mask=60, jitter_salt=None)
CFG_JIT = ChartConfig(age_min=35, age_max=75, age_step=5, mask=60, jitter_salt="cohort-salt")
CFG_CHART = ChartConfig(
    age_min=35, age_max=75, age_step=5, mask=110, jitter_salt="cohort-salt", cohort_title="Orders",
    update_date="August 2001",
)
CFG_RETAIN = CFG_CHART.with_(enrollment_retain=("Building", "MACHINERY"))
SEX_LABELS = ["Female", "Male", "Other"]


def _subjects(spark, sf):
    return T.subjects(spark, sf)


def sex_by_age_bl(spark, sf):
    m = H.censored_histogram(_subjects(spark, sf), "sex", "age_bl", CFG)
    return m.select("label", "bin", "bucket", "raw", "value", "masked")


def sex_by_age_fu(spark, sf):
    m = H.censored_histogram(_subjects(spark, sf), "sex", "age_fu", CFG)
    return m.select("label", "bin", "bucket", "raw", "value", "masked")


def sex_by_age_jittered(spark, sf):
    m = H.censored_histogram(_subjects(spark, sf), "sex", "age_bl", CFG_JIT)
    return m.select("label", "bin", "bucket", "raw", "value", "masked")


def sex_totals_fu(spark, sf):
    _, totals = H.sex_by_age(_subjects(spark, sf), "age_fu", CFG_JIT)
    return totals.select("label", F.col("value").cast("long").alias("value"))


def excluded_cases_fu(spark, sf):
    return H.excluded_cases(_subjects(spark, sf), "sex", "age_fu", CFG_JIT)


def excluded_cases_bl(spark, sf):
    return H.excluded_cases(_subjects(spark, sf), "sex", "age_bl", CFG_JIT)


def chart_incremental(spark, sf):
    """S10 as a mergeable state: half the subjects first, the others appended; the unfiltered chart of both."""
    import uuid

    from ..plans.precompute import append_state, chart_from_state
    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    s = _subjects(spark, sf)
    append_state(s.where("`case` % 2 = 0"), CFG_CHART, path)
    append_state(s.where("`case` % 2 = 1"), CFG_CHART, path)
    return chart_from_state(spark, CFG_CHART, path).subject_counts


def enrollment_by_age_shared_jitter(spark, sf):
    """A3: one jitter offset per label for every bin (the reference's older histogram variant)."""
    m = H.censored_histogram(_subjects(spark, sf), "enrollment", "age_fu", CFG_JIT, jitter_per_bin=False)
    return m.select("label", "bin", "raw", "value")


def histogram_bins(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return H.histogram(li, "l_quantity", 0, 50, bins=10)


def histogram_step_top(spark, sf):
    o = T.table(spark, sf, "orders")
    return H.histogram(o, "o_totalprice", 0, 300000, step=25000, top_overflow=True, by=["o_orderstatus"])


def chart_unfiltered_counts(spark, sf):
    return C.filter_chart(_subjects(spark, sf), CFG_CHART).subject_counts


def chart_unfiltered_age_fu(spark, sf):
    return C.filter_chart(_subjects(spark, sf), CFG_CHART).age_fu


def chart_subjects_jittered_counts(spark, sf):
    """Q1 over every subject as one selection (no shortcut): jittered cells, exclusion, enrolment, mean."""
    subj = _subjects(spark, sf)
    cells = C.cell_table(subj, CFG_CHART)
    parts = C.chart_parts(cells.drop("sel"), CFG_CHART, jitter=True)
    pop = subj.agg(F.count(F.lit(1)).alias("population"))
    return C.subject_counts(parts, pop, CFG_CHART)


def chart_retained_enrollment(spark, sf):
    subj = _subjects(spark, sf)
    cells = C.cell_table(subj, CFG_RETAIN)
    parts = C.chart_parts(cells.drop("sel"), CFG_RETAIN, jitter=True)
    pop = subj.agg(F.count(F.lit(1)).alias("population"))
    return C.subject_counts(parts, pop, CFG_RETAIN)


def chart_age_bl_pivot(spark, sf):
    return C.filter_chart(_subjects(spark, sf), CFG_CHART).pivot("age_bl", SEX_LABELS)


QUERIES = {
    "sex_by_age_bl": sex_by_age_bl,
    "sex_by_age_fu": sex_by_age_fu,
    "sex_by_age_jittered": sex_by_age_jittered,
    "sex_totals_fu": sex_totals_fu,
    "excluded_cases_fu": excluded_cases_fu,
    "excluded_cases_bl": excluded_cases_bl,
    "chart_incremental": chart_incremental,
    "histogram_shared_jitter": enrollment_by_age_shared_jitter,
    "histogram_bins": histogram_bins,
    "histogram_step_top": histogram_step_top,
    "chart_unfiltered_counts": chart_unfiltered_counts,
    "chart_unfiltered_age_fu": chart_unfiltered_age_fu,
    "chart_jittered_counts": chart_subjects_jittered_counts,
    "chart_retained_enrollment": chart_retained_enrollment,
    "chart_age_bl_pivot": chart_age_bl_pivot,
}


def _matrix_sql(age: str, cfg: ChartConfig) -> str:
    return S.with_(S.SUBJECTS_CTE, S.matrix_ctes("x", "subjects", age, cfg, True)) + (
        "\nSELECT label, bin, bucket, raw, value, masked FROM x_m"
    )


def _shared_jitter_sql() -> str:
    cfg = CFG_JIT
    n = cfg.n_bins
    val = S.sql_jitter_and_mask("coalesce(c.raw, 0)", S.cap("d.enrollment"), cfg, True)
    return S.with_(
        S.SUBJECTS_CTE,
        f"""b AS (SELECT enrollment, {S.age_bin('age_fu', cfg)} AS bin FROM subjects WHERE enrollment IS NOT NULL),
c AS (SELECT enrollment, bin, count(*) AS raw FROM b WHERE bin IS NOT NULL GROUP BY ALL),
d AS (SELECT enrollment, CAST(unnest(range(0, {n})) AS INTEGER) AS bin FROM (SELECT DISTINCT enrollment FROM b))""",
    ) + f"""
SELECT {S.cap('d.enrollment')} AS label, d.bin, CAST(coalesce(c.raw, 0) AS BIGINT) AS raw, {val} AS value
FROM d LEFT JOIN c ON d.enrollment = c.enrollment AND d.bin = c.bin"""


def _hist_sql(table, col, low, step, bins, top, by):
    b = f"floor((CAST({col} AS DOUBLE) - {float(low)}) / {float(step)})"
    if top:
        b = f"(CASE WHEN {b} >= {bins} THEN {bins - 1} ELSE {b} END)"
    by_sel = "".join(f"{c}, " for c in by)
    keys = f"(SELECT DISTINCT {', '.join(by)} FROM {table})" if by else "(SELECT 1 AS _one)"
    on = " AND ".join([f"k.{c} IS NOT DISTINCT FROM c.{c}" for c in by] + ["k.bin = c.bin"])
    kcols = "".join(f"k.{c}, " for c in by)
    return f"""WITH bb AS (SELECT {by_sel}CAST({b} AS INTEGER) AS bin FROM {table}),
c AS (SELECT {by_sel}bin, count(*) AS n FROM bb WHERE bin >= 0 AND bin < {bins} GROUP BY ALL),
k AS (SELECT *, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM {keys})
SELECT {kcols}k.bin, CAST({float(low)} + k.bin * {float(step)} AS DOUBLE) AS bin_lo, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM k LEFT JOIN c ON {on}"""


def _chart_sql(select: str, cfg: ChartConfig, jitter: bool) -> str:
    return S.with_(S.SUBJECTS_CTE, S.chart_ctes("q", "subjects", cfg, jitter)) + "\n" + select


_M_BL = S.with_(S.SUBJECTS_CTE, S.matrix_ctes("x", "subjects", "age_bl", CFG_JIT, True))
_M_FU = S.with_(S.SUBJECTS_CTE, S.matrix_ctes("x", "subjects", "age_fu", CFG_JIT, True))

SQL = {
    "sex_by_age_bl": _matrix_sql("age_bl", CFG),
    "sex_by_age_fu": _matrix_sql("age_fu", CFG),
    "sex_by_age_jittered": _matrix_sql("age_bl", CFG_JIT),
    "sex_totals_fu": _M_FU + "\nSELECT label, CAST(sum(value) AS BIGINT) AS value FROM x_m GROUP BY label",
    "excluded_cases_fu": _M_FU
    + '\nSELECT b."case" FROM x_b b JOIN x_m m ON b.sex = m.sex AND b.bin = m.bin WHERE m.masked',
    "excluded_cases_bl": _M_BL
    + '\nSELECT b."case" FROM x_b b JOIN x_m m ON b.sex = m.sex AND b.bin = m.bin WHERE m.masked',
    "histogram_shared_jitter": _shared_jitter_sql(),
    "histogram_bins": _hist_sql("lineitem", "l_quantity", 0, 5.0, 10, False, []),
    "histogram_step_top": _hist_sql("orders", "o_totalprice", 0, 25000.0, 12, True, ["o_orderstatus"]),
    "chart_unfiltered_counts": _chart_sql("SELECT * FROM q_counts", CFG_CHART, False),
    "chart_incremental": _chart_sql("SELECT * FROM q_counts", CFG_CHART, False),
    "chart_unfiltered_age_fu": _chart_sql(
        "SELECT bin, bucket, label, value FROM q_fu_m", CFG_CHART, False
    ),
    "chart_jittered_counts": _chart_sql("SELECT * FROM q_counts", CFG_CHART, True),
    "chart_retained_enrollment": _chart_sql("SELECT * FROM q_counts", CFG_RETAIN, True),
    "chart_age_bl_pivot": _chart_sql(
        "SELECT bin, bucket, "
        + ", ".join(f"max(CASE WHEN label = '{x}' THEN value END) AS \"{x}\"" for x in SEX_LABELS)
        + " FROM q_bl_m GROUP BY bin, bucket",
        CFG_CHART,
        False,
    ),
}
