"""DuckDB SQL fragments shared by the oracle queries.

The oracles deliberately compute things the straightforward, row-level way (e.g. the chart excludes *cases* with
an anti join, as the reference does) so that they also check the Spark plans' shortcuts (the cell table).
"""

from __future__ import annotations

from ..config import ChartConfig

# Fixed values, stated here on their own: display substitutions, in order.
SUBSTITUTIONS = [("”", '"'), ("“", '"'), ("’", "'"), ("‘", "'"), ("||||", "\n"), ("||", "\n"), ("≥", ">="), ("≤", "<=")]


def sql_jitter_and_mask(value: str, label: str, cfg: ChartConfig, jitter: bool) -> str:
    """A count with its weekly noise (the first 32 bits of an md5, spread over the jitter range), masked."""
    if jitter and cfg.jitter_salt is not None:
        year, week, _ = cfg.as_of.isocalendar()
        seed = f"md5('{year}-W{week}_' || {label} || '_{cfg.jitter_salt}')"
        width = cfg.jitter_max - cfg.jitter_min + 1
        value = f"({value} + CAST('0x' || left({seed}, 8) AS BIGINT) % {width} + {cfg.jitter_min})"
    return f"CAST(CASE WHEN {value} > {cfg.mask} THEN {value} ELSE 0 END AS BIGINT)"

SUBJECTS_CTE = """
_lines AS (SELECT l_orderkey, min(l_quantity) AS q_min, max(l_quantity) AS q_max FROM lineitem GROUP BY l_orderkey),
subjects AS (
  SELECT o_orderkey AS "case",
         CAST(trunc(30 + q_min) AS INTEGER) AS age_bl,
         CAST(trunc(30 + q_max) AS INTEGER) AS age_fu,
         CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' WHEN 'P' THEN 'other' END AS sex,
         lower(c_mktsegment) AS enrollment,
         CAST(trunc(30 + q_max) AS INTEGER) - CAST(trunc(30 + q_min) AS INTEGER) AS followup_years
  FROM orders LEFT JOIN _lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
)"""


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def age_bin(age: str, cfg: ChartConfig) -> str:
    n = cfg.n_bins
    return (
        f"(CASE WHEN {age} IS NULL OR {age} < {cfg.age_min} THEN NULL WHEN {age} >= {cfg.age_max} THEN {n - 1} "
        f"ELSE CAST(least(greatest(floor(({age} - {cfg.age_min}) / {cfg.age_step}), 0), {n - 1}) AS INTEGER) END)"
    )


def bucket(bin_sql: str, cfg: ChartConfig) -> str:
    lo = f"({cfg.age_min} + {bin_sql} * {cfg.age_step})"
    top = cfg.age_max - cfg.age_step
    return (
        f"(CASE WHEN {lo} >= {top} THEN CAST({lo} AS VARCHAR) || '+' "
        f"ELSE CAST({lo} AS VARCHAR) || '-' || CAST({lo} + {cfg.age_step - 1} AS VARCHAR) END)"
    )


def matrix_ctes(prefix: str, src: str, age: str, cfg: ChartConfig, jitter: bool) -> str:
    """CTEs {prefix}_m(sex, label, bin, bucket, raw, value, masked) from a subjects-shaped relation ``src``."""
    n = cfg.n_bins
    lab = cap("d.sex")
    val = sql_jitter_and_mask("coalesce(c.raw, 0)", f"{lab} || CAST(d.bin AS VARCHAR)", cfg, jitter)
    return f"""
{prefix}_b AS (SELECT "case", sex, {age_bin(age, cfg)} AS bin FROM {src} WHERE sex IS NOT NULL),
{prefix}_c AS (SELECT sex, bin, count(*) AS raw FROM {prefix}_b WHERE bin IS NOT NULL GROUP BY sex, bin),
{prefix}_d AS (SELECT sex, CAST(unnest(range(0, {n})) AS INTEGER) AS bin FROM (SELECT DISTINCT sex FROM {prefix}_b)),
{prefix}_m AS (
  SELECT d.sex, {lab} AS label, d.bin, {bucket('d.bin', cfg)} AS bucket,
         CAST(coalesce(c.raw, 0) AS BIGINT) AS raw, {val} AS value,
         (coalesce(c.raw, 0) > 0 AND {val} = 0) AS masked
  FROM {prefix}_d d LEFT JOIN {prefix}_c c ON d.sex = c.sex AND d.bin = c.bin
)"""


def chart_ctes(p: str, src: str, cfg: ChartConfig, jitter: bool) -> str:
    """The reference's chart, case level, over subjects-shaped ``src``; defines {p}_counts and {p}_bl_m/{p}_fu_m."""
    upd = cfg.update_text()
    title = cfg.cohort_title
    retain = ""
    if cfg.enrollment_retain:
        lst = ", ".join("'" + r.lower() + "'" for r in cfg.enrollment_retain)
        retain = f"WHERE lower({cap('enrollment')}) IN ({lst})"
    enr_val = sql_jitter_and_mask("total", cap("enrollment"), cfg, jitter)
    hdr_total = f"Total {title} Population {upd}".strip().replace("'", "''")
    hdr_fu = f"{title} Follow-up {upd} (mean years)".strip().replace("'", "''")
    return f"""
{matrix_ctes(p + '_bl', src, 'age_bl', cfg, jitter)},
{matrix_ctes(p + '_fu', src, 'age_fu', cfg, jitter)},
{p}_choice AS (
  SELECT s_bl, s_fu, s_bl > s_fu AS use_bl, CASE WHEN s_bl > s_fu THEN s_bl ELSE s_fu END AS selected
  FROM (SELECT coalesce(sum(value), 0) AS s_bl FROM {p}_bl_m), (SELECT coalesce(sum(value), 0) AS s_fu FROM {p}_fu_m)
),
{p}_excl AS (
  SELECT b."case" FROM {p}_bl_b b JOIN {p}_bl_m m ON b.sex = m.sex AND b.bin = m.bin AND m.masked
  WHERE (SELECT use_bl FROM {p}_choice)
  UNION ALL
  SELECT b."case" FROM {p}_fu_b b JOIN {p}_fu_m m ON b.sex = m.sex AND b.bin = m.bin AND m.masked
  WHERE NOT (SELECT use_bl FROM {p}_choice)
),
{p}_rest AS (
  SELECT *, CASE WHEN (SELECT use_bl FROM {p}_choice) THEN {age_bin('age_bl', cfg)} ELSE {age_bin('age_fu', cfg)} END
           AS chosen_bin
  FROM {src} WHERE "case" NOT IN (SELECT "case" FROM {p}_excl)
),
{p}_enr AS (
  SELECT enrollment, {cap('enrollment')} AS label, total, {enr_val} AS value FROM (
    SELECT enrollment, count(chosen_bin) AS total FROM {p}_rest WHERE enrollment IS NOT NULL GROUP BY enrollment
  ) {retain}
),
{p}_follow AS (SELECT sum(followup_years) AS fsum, count(followup_years) AS fcnt FROM {p}_rest),
{p}_sex AS (
  SELECT sex, label, sum(value) AS value FROM (
    SELECT * FROM {p}_bl_m WHERE (SELECT use_bl FROM {p}_choice)
    UNION ALL SELECT * FROM {p}_fu_m WHERE NOT (SELECT use_bl FROM {p}_choice)
  ) GROUP BY sex, label
),
{p}_head AS (
  SELECT c.selected, c.selected > {cfg.mask} AND f.fcnt > 0 AS ok, f.fsum, f.fcnt,
         (SELECT count(*) FROM subjects) AS population
  FROM {p}_choice c, {p}_follow f
),
{p}_counts AS (
  SELECT 0 AS section, 1 AS pos, 'total-count' AS id, '{hdr_total}' AS header,
         CAST(population AS DOUBLE) AS value FROM {p}_head
  UNION ALL
  SELECT 1, 1, 'selected-count', 'Current Selection',
         CAST(CASE WHEN selected > {cfg.mask} THEN least(selected, population) ELSE 0 END AS DOUBLE) FROM {p}_head
  UNION ALL
  SELECT 2, CAST(row_number() OVER (ORDER BY enrollment) AS INTEGER), lower('enroll-' || label || '-count'),
         '- ' || label || ' {upd}', CAST(value AS DOUBLE) FROM {p}_enr
  UNION ALL
  SELECT 3, CAST(row_number() OVER (ORDER BY sex) AS INTEGER), lower('sex-' || label || '-count'),
         '- ' || label, CAST(value AS DOUBLE) FROM {p}_sex
  UNION ALL
  SELECT 4, 1, 'followup-years', '{hdr_fu}',
         CASE WHEN ok THEN (100 * fsum // fcnt + CASE
           WHEN 2 * (100 * fsum % fcnt) > fcnt THEN 1
           WHEN 2 * (100 * fsum % fcnt) = fcnt AND (100 * fsum // fcnt) % 2 = 1 THEN 1 ELSE 0 END) / 100.0 ELSE 0.0 END FROM {p}_head
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


def clean_text(x: str) -> str:
    """F1 in DuckDB SQL (same substitutions, same order)."""
    out = x
    for src, dst in SUBSTITUTIONS:
        d = "chr(10)" if dst == "\n" else "'" + dst.replace("'", "''") + "'"
        out = f"replace({out}, '{src.replace(chr(39), chr(39) * 2)}', {d})"
    return out
