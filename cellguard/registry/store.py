"""Registered loader, filter and filtered-chart queries on the store loaded from the test cohort."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import ChartConfig, LoadConfig
from ..operators import filters as FL
from ..plans import chart as C
from ..plans.load import load_cohort
from ..sources import testdata as T
from . import sqlparts as S
from . import store_sql as Q

LCFG = LoadConfig(datamodel_vars=T.DATAMODEL_VARS, case_col="subject_id", age_min=35, age_max=75, age_step=5)
CFG_F = ChartConfig(age_min=35, age_max=75, age_step=5, mask=5, jitter_salt="cohort-salt", cohort_title="Orders")

# item ids of the test dictionary (row position + 1)
SEX, ENROLL, PRICE, ORDER_DT, PRIORITY, QTY, BALANCE = 1, 4, 6, 7, 8, 10, 11


def vid(varname: str, name: str) -> int:
    """The store's value id, computed on the driver for writing filters by name."""
    return int(hashlib.md5(f"{varname}|{name}".encode()).hexdigest()[:15], 16)


F_RANGE = [FL.RangeFilter(PRICE, "100", "200")]
F_OPEN = [FL.RangeFilter(QTY, "30", None)]
F_UPPER = [FL.RangeFilter(ORDER_DT, None, "1997")]
F_EXISTS = [FL.RangeFilter(BALANCE)]
F_VALUES = [FL.ValueFilter(PRIORITY, (vid("priority", "urgent"), vid("priority", "high")))]
F_AND = [
    FL.RangeFilter(PRICE, "100", "300"),
    FL.ValueFilter(PRIORITY, (vid("priority", "urgent"), vid("priority", "high"))),
    FL.RangeFilter(BALANCE),
    FL.ValueFilter(SEX, (vid("gender", "female"),)),
]
F_EMPTY = [FL.RangeFilter(PRICE, "1000", None), FL.RangeFilter(BALANCE)]
F_ALL = [FL.RangeFilter(SEX)]
F_EXPORT = FL.parse_filters(
    [(PRICE, "100~300"), (QTY, "~40"), (ORDER_DT, "1996~"), (BALANCE, "~"), (PRICE, "1~2"),
     (PRIORITY, f"{vid('priority', 'high')}_{vid('priority', 'urgent')}"), (SEX, f"{vid('gender', 'male')}")]
)


LCFG_PRIORITY = replace(LCFG, min_priority=1)
LCFG_DICT_ONLY = replace(LCFG, dictionary_only=True)
LCFG_MAPPED = replace(LCFG, enrollment_mapping="building==construction&machinery==heavy_industry",
                      gender_mapping="female==F&male==M")


def coded_categories(spark, sf):
    """W4 on a dictionary whose codes come from the tables: the categories that hold coded items."""
    from ..functions.codes import is_categorical
    from ..plans.load import _categories, prepare_dictionary

    d = prepare_dictionary(T.dictionary(spark, sf), LCFG)
    return _categories(d.where(is_categorical(F.col("values"))))


def store(spark, sf, cfg: LoadConfig = LCFG):
    return load_cohort(T.cohort_wide(spark, sf), T.dictionary(spark), cfg)


def subjects_from_csv(spark, sf):
    """S8 then S1: the cohort written as CSV into the checkpoint folder, scanned back as text, then loaded."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.files import scan_cohort, write_rows_csv

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohort-csv-{uuid.uuid4().hex}"
    write_rows_csv(T.cohort_wide(spark, sf), path)
    return load_cohort(scan_cohort(spark, path), T.dictionary(spark), LCFG).subjects


def precomputed_chart(spark, sf):
    """The unfiltered chart written once with the catalogue and population, read back from the files."""
    import uuid

    from ..plans.precompute import precompute, read_precomputed
    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/precomputed-{uuid.uuid4().hex}"
    precompute(store(spark, sf), CFG_F, path)
    return read_precomputed(spark, path)["chart_subject_counts"]


def column_rules_query(spark, sf):
    from ..plans.load import column_rules, prepare_dictionary

    w = T.cohort_wide(spark, sf)
    cols = [c for c in w.columns if c != "subject_id"]
    d = prepare_dictionary(T.dictionary(spark, sf), LCFG)
    return column_rules(spark, cols, d, LCFG).select("col", "role", "kind", "item_id")


def _sel(fs):
    def run(spark, sf):
        s = store(spark, sf)
        return FL.select_cases(s.variable, s.value, fs)

    return run


def _coded(spark, sf):
    """The store's variable table by value codes, written and read back, and the codes."""
    import uuid

    from ..operators import cohort_index as X
    from ..session import cut_lineage, ensure_checkpoint_dir

    s = store(spark, sf)
    codes = cut_lineage(X.value_codes(s.value), "value-codes")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/coded-{uuid.uuid4().hex}"
    return s, codes, X.write_coded(X.coded_variable(s.variable, codes), path)


def _sel_codes(fs):
    def run(spark, sf):
        from ..operators import cohort_index as X

        _, codes, coded = _coded(spark, sf)
        return X.select_cases_coded(coded, codes, fs)

    return run


def _bitmaps(spark, sf, fs):
    from ..operators import cohort_index as X
    from ..session import cut_lineage

    s, codes, coded = _coded(spark, sf)
    numbers = cut_lineage(X.case_numbers(s.subjects), "case-numbers")
    index = cut_lineage(X.case_bitmaps(coded, numbers), "case-bitmaps")
    return X.select_bitmaps(index, codes, fs), numbers


def filter_bitmaps(spark, sf):
    """P5, U1 on bitmaps: the cases of the four-filter conjunction."""
    from ..operators import cohort_index as X

    return X.cases_of(*_bitmaps(spark, sf, F_AND))


def filter_bitmap_count(spark, sf):
    """U2 on bitmaps: how many cases the conjunction selects, without naming one."""
    from ..operators import cohort_index as X

    return X.count_cases(_bitmaps(spark, sf, F_AND)[0])


def value_codes(spark, sf):
    """Every value's place in its item's order."""
    from ..operators import cohort_index as X

    return X.value_codes(store(spark, sf).value).select("item", "value", "code")


def filter_intersect(spark, sf):
    s = store(spark, sf)
    return FL.intersect_cases(s.variable, s.value, F_AND)


def filter_export(spark, sf):
    s = store(spark, sf)
    return FL.export_filters(spark, s.item, s.value, F_EXPORT)


def filter_export_quoted(spark, sf):
    """P13 with SQL texts for the value names."""
    s = store(spark, sf)
    return FL.export_filters(spark, s.item, s.value, F_EXPORT, quote=True)


def _chart(fs, part):
    def run(spark, sf):
        s = store(spark, sf)
        sel = FL.select_cases(s.variable, s.value, fs) if fs is not None else None
        return getattr(C.filter_chart(s.subjects, CFG_F, sel), part)

    return run


def text_id_subjects(spark, sf):
    """Q7 with ids that are not numbers: one subject per order, none merged."""
    w = T.cohort_wide(spark, sf)
    named = w.withColumn("subject_id", F.concat(F.lit("S-"), F.col("subject_id")))
    return load_cohort(named, T.dictionary(spark), LCFG).subjects


def numbered_subjects(spark, sf):
    """Q7 without an id column: subjects are numbered by row; counted, as the row order is the input's."""
    s = load_cohort(T.cohort_wide(spark, sf).drop("subject_id"), T.dictionary(spark), replace(LCFG, case_col=None))
    return s.subjects.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case").alias("cases"),
                          F.min(F.col("case").cast("long")).alias("lowest"),
                          F.max(F.col("case").cast("long")).alias("highest"))


def load_report(spark, sf):
    """What the load could not use: dates made unreadable in every seventh order, statuses missing in every ninth."""
    key = F.col("subject_id").cast("long")
    w = (T.cohort_wide(spark, sf)
         .withColumn("order_dt", F.when(key % 7 == 0, F.lit("some day")).otherwise(F.col("order_dt")))
         .withColumn("current_status", F.when(key % 9 == 0, F.lit("NA")).otherwise(F.col("current_status"))))
    r = load_cohort(w, T.dictionary(spark), LCFG).report
    return r.where(F.col("col").isin("order_dt", "current_status", "enrollment"))


QUERIES = {
    "load_subjects_text_id": text_id_subjects,
    "load_subjects_numbered": numbered_subjects,
    "load_report": load_report,
    "load_variable": lambda spark, sf: store(spark, sf).variable,
    "load_values": lambda spark, sf: store(spark, sf).value,
    "load_items": lambda spark, sf: store(spark, sf).item,
    "load_categories": lambda spark, sf: store(spark, sf).category,
    "load_subjects": lambda spark, sf: store(spark, sf).subjects,
    "column_rules": column_rules_query,
    "coded_categories": coded_categories,
    "precomputed_chart": precomputed_chart,
    "load_subjects_from_csv": subjects_from_csv,
    "load_items_priority": lambda spark, sf: store(spark, sf, LCFG_PRIORITY).item,
    "load_categories_priority": lambda spark, sf: store(spark, sf, LCFG_PRIORITY).category,
    "load_items_dictionary_only": lambda spark, sf: store(spark, sf, LCFG_DICT_ONLY).item,
    "load_subjects_mapped": lambda spark, sf: store(spark, sf, LCFG_MAPPED).subjects,
    "filter_range": _sel(F_RANGE),
    "filter_range_open": _sel(F_OPEN),
    "filter_range_upper": _sel(F_UPPER),
    "filter_exists": _sel(F_EXISTS),
    "filter_values": _sel(F_VALUES),
    "filter_conjunction": _sel(F_AND),
    "filter_intersect": filter_intersect,
    "value_codes": value_codes,
    "filter_codes_range": _sel_codes(F_RANGE),
    "filter_codes_open": _sel_codes(F_OPEN),
    "filter_codes_conjunction": _sel_codes(F_AND),
    "filter_codes_empty": _sel_codes(F_EMPTY),
    "filter_bitmaps": filter_bitmaps,
    "filter_bitmap_count": filter_bitmap_count,
    "filter_empty": _sel(F_EMPTY),
    "filter_export": filter_export,
    "filter_export_quoted": filter_export_quoted,
    "chart_filtered_counts": _chart(F_AND, "subject_counts"),
    "chart_filtered_age_bl": _chart(F_AND, "age_bl"),
    "chart_filtered_age_fu": _chart(F_AND, "age_fu"),
    "chart_null_result": _chart(F_EMPTY, "subject_counts"),
    "chart_null_result_age_fu": _chart(F_EMPTY, "age_fu"),
    "chart_full_selection": _chart(F_ALL, "subject_counts"),
    "chart_store_unfiltered": _chart(None, "subject_counts"),
}


# ---------------------------------------------------------------- oracle SQL

def _cases_sql(f) -> str:
    if isinstance(f, FL.ValueFilter):
        ids = ", ".join(str(x) for x in f.values)
        return f'SELECT DISTINCT "case" FROM s_variable WHERE item = {f.item} AND value IN ({ids})'
    cond = ""
    if f.lo is not None:
        cond += f" AND x.name_numeric >= {float(f.lo)}"
    if f.hi is not None:
        cond += f" AND x.name_numeric <= {float(f.hi)}"
    return (f'SELECT DISTINCT v."case" FROM s_variable v JOIN s_value x ON x.id = v.value AND x.item = v.item '
            f"WHERE v.item = {f.item}{cond}")


def _sel_sql(fs) -> str:
    return " INTERSECT ".join(f"({_cases_sql(f)})" for f in fs)


BASE = S.with_(Q.store_ctes(LCFG))


def _store_sql(select: str) -> str:
    return BASE + "\n" + select


def _export_sql(fs, quote: str = "") -> str:
    parts = []
    for pos, f in enumerate(fs):
        var = f"(SELECT varname FROM s_item WHERE id = {f.item})"
        if isinstance(f, FL.RangeFilter):
            if f.exists_only:
                continue
            if f.lo is not None and f.hi is not None:
                t = f"'(' || {var} || ' >= {f.lo} AND ' || {var} || ' <= {f.hi})'"
            elif f.hi is not None:
                t = f"'(' || {var} || ' <= {f.hi})'"
            else:
                t = f"'(' || {var} || ' >= {f.lo})'"
        else:
            mark = f"'{quote}'"
            names = " || ', ' || ".join(f"{mark} || (SELECT name FROM s_value WHERE id = {v} AND item = {f.item}) || {mark}" for v in f.values)
            t = (f"'(' || {var} || ' IN (' || {names} || '))'" if len(f.values) > 1
                 else f"'(' || {var} || ' = ' || {names} || ')'")
        parts.append(t)
    return " || ' AND ' || ".join(parts) or "''"


def _chart_sel_sql(fs, cte: str) -> str:
    """The chart for a selection with the reference's shortcuts, computed case-level in SQL."""
    if fs is None:
        return S.with_(Q.store_ctes(LCFG), "subjects AS (SELECT * FROM s_subjects)",
                       S.chart_ctes("b", "subjects", CFG_F, False)) + f"\nSELECT * FROM b_{cte}"
    sel = f'sel_subj AS (SELECT * FROM s_subjects WHERE "case" IN ({_sel_sql(fs)}))'
    mode = ("mode AS (SELECT CASE WHEN n = 0 THEN 'empty' WHEN n >= (SELECT count(*) FROM subjects) THEN 'all' "
            "ELSE 'filtered' END AS m FROM (SELECT count(*) AS n FROM sel_subj))")
    body = S.with_(Q.store_ctes(LCFG), "subjects AS (SELECT * FROM s_subjects)", sel, mode,
                   S.chart_ctes("q", "sel_subj", CFG_F, True), S.chart_ctes("b", "subjects", CFG_F, False))
    if cte == "counts":
        cols, zero = "section, pos, id, header, value", "section, pos, id, header, 0.0 AS value"
        src_q, src_b = "q_counts", "b_counts"
    else:
        cols = "bin, bucket, label, value"
        zero = "bin, bucket, label, CAST(0 AS BIGINT) AS value"
        src_q, src_b = f"q_{cte}_m", f"b_{cte}_m"
    return body + f"""
SELECT {cols} FROM {src_q} WHERE (SELECT m FROM mode) = 'filtered'
UNION ALL SELECT {cols} FROM {src_b} WHERE (SELECT m FROM mode) = 'all'
UNION ALL SELECT {zero} FROM {src_b} WHERE (SELECT m FROM mode) = 'empty'"""


SQL = {
    "load_subjects_text_id": _store_sql("""SELECT 'S-' || "case" AS "case", * EXCLUDE ("case") FROM s_subjects"""),
    "load_subjects_numbered": """SELECT count(*) AS n, count(*) AS cases, CAST(0 AS BIGINT) AS lowest,
  count(*) - 1 AS highest FROM orders""",
    "load_report": """SELECT 'order_dt' AS col, 'unreadable' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'current_status', 'missing', count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  WHERE o_orderkey % 9 = 0 OR c_mktsegment IS NULL
UNION ALL SELECT 'enrollment', 'subject without it', count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  WHERE o_orderkey % 9 = 0 OR c_mktsegment IS NULL""",
    "load_variable": _store_sql("SELECT * FROM s_variable"),
    "load_values": _store_sql("SELECT * FROM s_value"),
    "load_items": _store_sql("SELECT * FROM s_item"),
    "load_categories": _store_sql("SELECT * FROM s_category"),
    "load_subjects": _store_sql("SELECT * FROM s_subjects"),
    "load_subjects_from_csv": _store_sql("SELECT * FROM s_subjects"),
    "precomputed_chart": _chart_sel_sql(None, "counts"),
    "coded_categories": BASE + """, coded_dict AS (
  SELECT seq, domain FROM dict WHERE name NOT IN ('current_status', 'priority')
    AND regexp_matches(trim(vals), '^\\w{1,3}\\s*=')
  UNION ALL SELECT seq, domain FROM dict WHERE name = 'current_status'
    AND EXISTS (SELECT * FROM customer WHERE c_mktsegment IS NOT NULL)
  UNION ALL SELECT seq, domain FROM dict WHERE name = 'priority'
    AND EXISTS (SELECT * FROM orders WHERE o_orderpriority IS NOT NULL))
SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS id, domain AS name, CAST(NULL AS VARCHAR) AS description,
       CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS "order"
FROM (SELECT domain, min(seq) AS f FROM coded_dict GROUP BY domain)""",
    "column_rules": _store_sql("SELECT col, role, kind, item_id FROM rules"),
    "load_items_priority": S.with_(Q.store_ctes(LCFG_PRIORITY)) + "\nSELECT * FROM s_item",
    "load_categories_priority": S.with_(Q.store_ctes(LCFG_PRIORITY)) + "\nSELECT * FROM s_category",
    "load_items_dictionary_only": S.with_(Q.store_ctes(LCFG_DICT_ONLY)) + "\nSELECT * FROM s_item",
    "load_subjects_mapped": S.with_(Q.store_ctes(LCFG_MAPPED)) + "\nSELECT * FROM s_subjects",
    "filter_range": _store_sql(_sel_sql(F_RANGE)),
    "filter_range_open": _store_sql(_sel_sql(F_OPEN)),
    "filter_range_upper": _store_sql(_sel_sql(F_UPPER)),
    "filter_exists": _store_sql(_sel_sql(F_EXISTS)),
    "filter_values": _store_sql(_sel_sql(F_VALUES)),
    "filter_conjunction": _store_sql(_sel_sql(F_AND)),
    "value_codes": _store_sql("""SELECT item, id AS value, CAST(row_number() OVER (
  PARTITION BY item ORDER BY name_numeric IS NULL, name_numeric, name, id) - 1 AS INTEGER) AS code FROM s_value"""),
    "filter_codes_range": _store_sql(_sel_sql(F_RANGE)),
    "filter_codes_open": _store_sql(_sel_sql(F_OPEN)),
    "filter_codes_conjunction": _store_sql(_sel_sql(F_AND)),
    "filter_codes_empty": _store_sql(_sel_sql(F_EMPTY)),
    "filter_bitmaps": _store_sql(_sel_sql(F_AND)),
    "filter_bitmap_count": _store_sql(f"SELECT count(*) AS n FROM ({_sel_sql(F_AND)})"),
    "filter_intersect": _store_sql(_sel_sql(F_AND)),
    "filter_empty": _store_sql(_sel_sql(F_EMPTY)),
    "filter_export": _store_sql(f"SELECT {_export_sql(F_EXPORT)} AS filterstring"),
    "filter_export_quoted": _store_sql(f"""SELECT {_export_sql(F_EXPORT, "''")} AS filterstring"""),
    "chart_filtered_counts": _chart_sel_sql(F_AND, "counts"),
    "chart_filtered_age_bl": _chart_sel_sql(F_AND, "bl"),
    "chart_filtered_age_fu": _chart_sel_sql(F_AND, "fu"),
    "chart_null_result": _chart_sel_sql(F_EMPTY, "counts"),
    "chart_null_result_age_fu": _chart_sel_sql(F_EMPTY, "fu"),
    "chart_full_selection": _chart_sel_sql(F_ALL, "counts"),
    "chart_store_unfiltered": _chart_sel_sql(None, "counts"),
}
