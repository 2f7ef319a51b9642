"""Invariants: the cell-table chart equals the case-level path, one-pass selection equals intersected sets,
histogram totals equal eligible subjects, no published cell lies in 1..mask, results do not depend on the number
of shuffle partitions, and the hot-key-split consecutive grouping equals the plain one."""

from pyspark.sql import functions as F

from cellguard.config import ChartConfig
from cellguard.operators import filters as FL
from cellguard.operators.groups import consecutive_groups, consecutive_groups_bucketed
from cellguard.operators.histogram import age_bin, censored_histogram, excluded_cases
from cellguard.plans import chart as C
from cellguard.registry import store as RS
from cellguard.sources import testdata as T
from conftest import SF_MID, SF_SMALL

CFG = ChartConfig(age_min=35, age_max=75, age_step=5, mask=5, jitter_salt="t")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cell_path_equals_case_level_exclusion(spark):
    subj = T.subjects(spark, SF_SMALL)
    cells = C.cell_table(subj, CFG).drop("sel")
    parts = C.chart_parts(cells, CFG, jitter=True)
    # case-level: drop excluded cases of the chosen age, then count enrolment and mean follow-up directly
    use_bl = parts["choice"].collect()[0].use_bl
    age = "age_bl" if use_bl else "age_fu"
    excl = excluded_cases(subj, "sex", age, CFG)
    rest = subj.join(excl, "case", "left_anti")
    direct_enr = rest.where(F.col("enrollment").isNotNull()).groupBy("enrollment").agg(
        F.count(age_bin(F.col(age), CFG)).alias("raw"))
    assert _rows(direct_enr) == _rows(parts["enrollment"].select("enrollment", "raw"))
    direct_follow = rest.agg(F.sum("followup_years").cast("long"), F.count("followup_years")).collect()[0]
    f = parts["follow"].collect()[0]
    assert (f.fsum, f.fcnt) == tuple(direct_follow)


def test_one_pass_selection_equals_intersection(spark):
    st = RS.store(spark, SF_SMALL)
    a = FL.select_cases(st.variable, st.value, RS.F_AND)
    b = FL.intersect_cases(st.variable, st.value, RS.F_AND)
    assert _rows(a) == _rows(b)


def test_uncensored_total_is_eligible_subjects(spark):
    subj = T.subjects(spark, SF_MID)
    h = censored_histogram(subj, "sex", "age_fu", CFG, censor=False)
    total = h.agg(F.sum("raw")).collect()[0][0]
    eligible = subj.where(F.col("sex").isNotNull() & (F.col("age_fu") >= CFG.age_min)).count()
    assert total == eligible


def test_no_published_cell_within_mask(spark):
    subj = T.subjects(spark, SF_SMALL)
    for age in ("age_bl", "age_fu"):
        h = censored_histogram(subj, "sex", age, CFG)
        assert h.where((F.col("value") >= 1) & (F.col("value") <= CFG.mask)).count() == 0
    st = RS.store(spark, SF_SMALL)
    sel = FL.select_cases(st.variable, st.value, RS.F_AND)
    r = C.filter_chart(st.subjects, CFG, sel)
    for df in (r.age_bl, r.age_fu):
        assert df.where((F.col("value") >= 1) & (F.col("value") <= CFG.mask)).count() == 0


def test_independent_of_partition_count(spark):
    subj = T.subjects(spark, SF_SMALL)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = _rows(C.filter_chart(subj, CFG).subject_counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = _rows(C.filter_chart(subj.repartition(7), CFG).subject_counts)
    assert one == eight


def test_split_grouping_equals_plain_with_a_hot_key(spark):
    e = T.table(spark, SF_MID, "events")
    # make one user hold a third of all events
    hot = e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    plain = consecutive_groups(hot, ["ts", "event_id"], "event_type", ["user_id"])
    split = consecutive_groups_bucketed(hot, ["ts", "event_id"], "event_type", ["user_id"], F.to_date("ts"))
    cols = ["event_id", "user_id", "group_no"]
    assert _rows(plain.select(cols)) == _rows(split.select(cols))


def test_smallest_gaps_split_equals_brute_force(spark):
    from cellguard.operators.ranges import smallest_gaps

    li = T.table(spark, SF_SMALL, "lineitem").select(
        "l_returnflag", (F.floor(F.col("l_extendedprice") / 7) - 3).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.l_returnflag: (r.vmin, r.vmax, r.gap, r.nvals)
               for r in smallest_gaps(li, "l_returnflag", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {}
    for k, vals in _group(li.collect()).items():
        vs = sorted(set(vals))
        gaps = [b - a for a, b in zip(vs, vs[1:]) if a != 0]
        want[k] = (vs[0], vs[-1], min(gaps) if gaps else None, len(vs))
    assert got == want


def _group(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(float(v))
    return out


def test_load_independent_of_partition_count(spark):
    def snapshot():
        st = RS.store(spark, SF_SMALL)
        return {n: sorted(map(str, getattr(st, n).collect())) for n in ("value", "item", "subjects")}

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = snapshot()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == snapshot()
