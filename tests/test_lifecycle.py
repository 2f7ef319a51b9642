"""Store versions: append, replace, delete, recreate, failure, and visits that outlive the store."""

import pytest
from pyspark.sql import functions as F

from cellguard.plans.load import Store
from cellguard.sources import lifecycle as L


def make(spark, cases, items=(1, 2), first=1):
    variable = [(f"c{c}", i, 100 * i + c % 3) for c in cases for i in items]
    value = [(100 * i + v, i, str(v), float(v), None, v, True) for i in items for v in range(3)]
    return Store(
        spark.createDataFrame(variable, "case string, item int, value long"),
        spark.createDataFrame(value, "id long, item int, name string, name_numeric double, description string, order int, listed boolean"),
        spark.createDataFrame([(i, f"item {i}", 1) for i in items], "id int, name string, category int"),
        spark.createDataFrame([(1, "all", None, 0)], "id int, name string, description string, order int"),
        spark.createDataFrame([(f"c{c}", 40 + c, None, "Female", "in", 3) for c in cases],
                              "case string, age_bl int, age_fu int, sex string, enrollment string, followup_years int"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(a, b):
    assert a.tables().keys() == b.tables().keys()
    for name, df in a.tables().items():
        assert rows(df) == rows(b.tables()[name].select(*df.columns)), name


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert L.parts_of(spark, root) == (0, []) and L.read_version(spark, root) is None
    a = make(spark, range(5))
    assert L.create_store(a, root) == 1
    same(a, L.read_version(spark, root))
    visits = spark.createDataFrame([("10.0.0.1", "t")], "address string, token string")
    L.append_visits(visits, root)
    L.append_visits(visits, root)
    assert L.append_cases(make(spark, range(5, 9), (1, 2)), root) == 4
    both = make(spark, range(9))
    same(both, L.read_version(spark, root))
    same(a, L.read_version(spark, root, 1))  # earlier versions stay readable
    with pytest.raises(ValueError, match="in the store already"):
        L.append_cases(make(spark, [3, 77]), root)
    same(both, L.read_version(spark, root))
    # one item replaced, with new values; the other's files are the same
    before = {r["path"] for r in L.parts_of(spark, root)[1] if r["item"] == 2}
    new = spark.createDataFrame([("c1", 1, 7)], "case string, item int, value long")
    value = both.value.where("item = 1").limit(1).withColumn("id", F.lit(7).cast("long"))
    L.replace_item(root, 1, new, value)
    now = L.read_version(spark, root)
    assert rows(now.variable.where("item = 1")) == [("c1", 1, 7)] and rows(now.value.where("item = 1").select("id")) == [(7,)]
    assert {r["path"] for r in L.parts_of(spark, root)[1] if r["item"] == 2} == before
    L.replace_item(root, 2, None)
    now = L.read_version(spark, root)
    assert rows(now.variable) == [("c1", 1, 7)] and now.value.where("item = 2").count() == 0
    L.empty_store(spark, root)
    assert L.read_version(spark, root) is None and L.read_visits(spark, root).count() == 2
    c = make(spark, range(20, 23), (4,))
    L.create_store(c, root)
    same(c, L.read_version(spark, root))
    assert rows(L.read_visits(spark, root)) == [("10.0.0.1", "t")] * 2


def test_a_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    a = make(spark, range(4))
    L.create_store(a, root)
    b = make(spark, range(4))
    b.subjects = b.subjects.withColumn("age_bl", F.when(F.col("case") != "c2", F.col("age_bl")).otherwise(
        F.raise_error(F.lit("torn")).cast("int")))
    with pytest.raises(Exception, match="torn"):
        L.create_store(b, root)
    assert L.parts_of(spark, root)[0] == 1
    same(a, L.read_version(spark, root))


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    L.create_store(make(spark, range(2)), root)
    base, parts = L.parts_of(spark, root)
    kept = L._kept(parts)
    names = iter(["bbbb", "aaaa", "cccc"])
    monkeypatch.setattr(L.uuid, "uuid4", lambda: type("U", (), {"hex": next(names)}))
    assert L._commit(spark, root, base, kept) == 2
    assert L._commit(spark, root, base, kept[:-1]) == 2  # the smaller name counts
    with pytest.raises(L.ConflictError):
        L._commit(spark, root, base, kept)
    assert len(L.parts_of(spark, root)[1]) == len(kept) - 1
