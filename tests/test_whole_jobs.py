"""Queries do their whole job on rows built here."""

import datetime

from cellguard.registry import charts


def _write_tables(spark, folder, orders, lines, customers):
    day = datetime.datetime(1997, 5, 1)
    spark.createDataFrame([(k, c, s, 1000.0 * k, day, "1-URGENT") for k, c, s in orders],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, q, 0.05) for k, q in lines],
                          "l_orderkey long, l_quantity double, l_discount double").write.parquet(
        f"{folder}/lineitem.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(
        f"{folder}/customer.parquet")


def test_excluded_cases_bl_reads_every_subject(spark, tmp_path):
    # thin cells of every sex are excluded, whatever the case numbers
    orders = [(1, 1, "P"), (2, 1, "P"), (3, 1, "O"), (50, 1, "P")]
    _write_tables(spark, tmp_path, orders, [(k, 20.0) for k, _, _ in orders], [(1, 10.0, "BUILDING")])
    got = sorted(r["case"] for r in charts.excluded_cases_bl(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 50]


def test_load_parses_a_cell_as_its_own_kind_only(spark, tmp_path, monkeypatch):
    # dates are not tried on numbers, and value ids are hashed per cell for raw texts only
    import cellguard.plans.load as L
    from cellguard.registry import store as RS

    orders = [(k, 1, "FOP"[k % 3]) for k in range(1, 9)]
    _write_tables(spark, tmp_path, orders, [(k, 10.0 + 3 * k) for k, _, _ in orders], [(1, 10.0, "BUILDING")])
    plans, cut = [], L.cut_lineage

    def seen(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().lower()))
        return cut(df, name)

    monkeypatch.setattr(L, "cut_lineage", seen)
    st = RS.store(spark, str(tmp_path))
    dated = [p.count("gettimestamp") for name, p in plans if name == "numbers"]
    assert sorted(dated) == [0, 1]
    assert [p.count("md5(") for name, p in plans if name == "eav"] == [1]
    names = {(r["item"], r["name"]) for r in st.value.where("listed").collect()}
    assert {(RS.ORDER_DT, "1995"), (RS.PRIORITY, "urgent"), (RS.SEX, "male"), (RS.PRICE, "3")} <= names


def test_catalogue_and_value_lookup_do_not_shuffle_the_variable_table(spark, tmp_path):
    from cellguard.plans import catalogue as CT
    from cellguard.registry import store as RS

    orders = [(k, 1, "FOP"[k % 3]) for k in range(1, 9)]
    _write_tables(spark, tmp_path, orders, [(k, 10.0 + 3 * k) for k, _, _ in orders], [(1, 10.0, "BUILDING")])
    st = RS.store(spark, str(tmp_path))
    male = RS.vid("gender", "male")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CT.categories_of_values(st, [male])
        text = plan._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [item" in text and "LeftSemi" in text.split("BroadcastHashJoin [item", 1)[1][:80]
        assert [r["item_id"] for r in plan.collect()] == [RS.SEX]
        assert "LeftSemi, BuildRight" in CT.catalogue(st)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_load_parses_a_distinct_cell_once_and_any_join_gives_the_same_store(spark, monkeypatch):
    import cellguard.plans.load as L
    from cellguard.config import LoadConfig

    rows = [(str(k), ["5/1/1997", "5/1/1997", "NA", "some day"][k % 4], ["40", "41", " 41", "Missing"][k % 4],
             ["1", "female", "Other", "nan", None, "x||y"][k % 6], ["2.57", "1.0", "1", "Free Text", "none", "."][k % 6])
            for k in range(24)]
    cohort = spark.createDataFrame(rows, "subject_id string, order_dt string, age_bl string, gender string, note string")
    entries = [("order_dt", ""), ("age_bl", ""), ("gender", "1 = female||2 = male"), ("note", "")]
    d = spark.createDataFrame([(i, n, n, n, v, "D", 0) for i, (n, v) in enumerate(entries)],
                              "seq long, name string, label string, description string, values string, domain string, "
                              "priority int")
    cfg = LoadConfig(datamodel_vars={"age_bl": "age_bl", "gender": "gender"}, case_col="subject_id", age_min=35,
                     age_max=75, age_step=5)
    parsed, cut = [], L.cut_lineage

    def counted(df, name="cut"):
        out = cut(df, name)
        if name == "numbers":
            parsed.append(out.count())
        return out

    def rows_of(store):
        tables = store.tables() | {"report": store.report}
        return {n: sorted(map(str, (r.asDict() for r in t.collect()))) for n, t in tables.items()}

    monkeypatch.setattr(L, "cut_lineage", counted)
    by_broadcast = rows_of(L.load_cohort(cohort, d, cfg))
    assert parsed == [2, 3]  # distinct cells that say something, of 18 dates and 18 ages
    monkeypatch.setattr(L, "FEW_CELLS", 0)
    assert rows_of(L.load_cohort(cohort, d, cfg)) == by_broadcast
    assert all(any(f"'item': {i}, 'name': '{n}'" in r for r in by_broadcast["value"])
               for i, n in [(1, "1995"), (3, "female"), (3, "other"), (4, "2.5"), (4, "free text"), (4, "none")])
    for col, reason, count in [("order_dt", "missing", 6), ("order_dt", "unreadable", 6), ("gender", "missing", 8),
                               ("age_bl", "missing", 6), ("note", "missing", 4)]:
        assert str({"col": col, "reason": reason, "n": count}) in by_broadcast["report"]
    assert not any("'age_bl', 'reason': 'unreadable'" in r for r in by_broadcast["report"])


def test_stored_rows_hold_ids_only_and_subjects_get_their_names(spark, monkeypatch):
    import cellguard.plans.load as L
    from cellguard.config import LoadConfig

    rows = [("a", "1", "41", "x"), ("b", "2", None, "y"), ("c", None, "77", "y")]
    cohort = spark.createDataFrame(rows, "subject_id string, gender string, age_bl string, note string")
    entries = [("gender", "1 = female||2 = male"), ("note", "")]  # the age is a chart variable only
    d = spark.createDataFrame([(i, n, n, n, v, "D", 0) for i, (n, v) in enumerate(entries)],
                              "seq long, name string, label string, description string, values string, domain string, "
                              "priority int")
    cfg = LoadConfig(datamodel_vars={"age_bl": "age_bl", "gender": "gender"}, case_col="subject_id", age_min=35,
                     age_max=75, age_step=5)
    stored, cut = [], L.cut_lineage

    def seen(df, name="cut"):
        if name == "eav":
            stored.append(df.columns)
        return cut(df, name)

    monkeypatch.setattr(L, "cut_lineage", seen)
    for few in (100_000, 0):
        monkeypatch.setattr(L, "FEW_CELLS", few)
        st = L.load_cohort(cohort, d, cfg)
        got = {r["case"]: (r["sex"], r["age_bl"]) for r in st.subjects.collect()}
        assert got == {"a": ("female", 40), "b": ("male", None), "c": (None, 70)}
        assert sorted((r["case"], r["item"]) for r in st.variable.collect()) == [
            ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)]
    assert stored == [["case", "item", "value"]] * 2


def test_two_decimals_are_cast_and_read_as_formatted(spark):
    from pyspark.sql import functions as F

    from cellguard.sources import testdata as T

    odd = [0.0, -0.0, 0.004, -0.004, 0.005, -0.005, 0.0099, 2.675, 1.005, -1.005, 25.125, 1e12, 1e300, float("nan"),
           float("inf"), 999999999999.995, None]
    x = spark.createDataFrame([(v,) for v in [*odd, *[k / 1000 for k in range(-3000, 3000)]]], "x double")
    told = x.select(T._fmt2("x").alias("new"), F.when(F.col("x").isNotNull(), F.format_string("%.2f", "x")).alias("old"))
    assert told.where("not (new <=> old)").count() == 0
    assert "decimal(18,2)" in told._jdf.queryExecution().optimizedPlan().toString().lower()
