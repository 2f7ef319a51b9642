"""Small operator tests: JSON rows (S9), description cut (F20), row index (W6), filter parsing (P4), F24."""

import json

from pyspark.sql import functions as F

from cellguard.functions.text import not_empty, truncate_description
from cellguard.operators.filters import RangeFilter, ValueFilter, parse_filters
from cellguard.operators.rows import with_row_index
from cellguard.sources.files import to_json_rows


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "a", None)], "id long, name string, v double")
    out = [json.loads(r.value) for r in to_json_rows(df).collect()]
    assert out == [{"id": 1, "name": "a", "v": None}]


def test_truncate_description(spark):
    rows = [("x" * 499,), ("y" * 500,)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(truncate_description(F.col("d"))).collect()]
    assert got[0] == "x" * 499
    assert got[1] == "y" * 496 + "..." and len(got[1]) == 499


def test_row_index_is_consecutive_in_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("v"))
    rows = with_row_index(df, "i").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(1000))
    assert [r.v for r in rows] == [3 * k for k in range(1000)]


def test_parse_filters_first_value_wins():
    fs = parse_filters([(6, "100~300"), (8, "1_2_3"), (6, "1~2"), (11, "~"), (7, "~1997"), (9, "5~")])
    assert fs == [RangeFilter(6, "100", "300"), ValueFilter(8, (1, 2, 3)), RangeFilter(11), RangeFilter(7, None, "1997"),
                  RangeFilter(9, "5", None)]
    assert fs[2].exists_only


def test_not_empty(spark):
    got = [r[0] for r in spark.createDataFrame([("a",), ("",), (None,)], "s string").select(
        not_empty(F.col("s"))).collect()]
    assert got == [True, False, False]


def test_search_relevance_modes(spark):
    from cellguard.operators.search import search

    df = spark.createDataFrame(
        [(1, "red bolt", "x"), (2, "red red", "bolt"), (3, "blue", "nut"), (4, "bolt", "red"), (5, "redbolt", "")],
        "id long, name string, kind string")
    all_rows = [(r.id, r.score) for r in search(df, "id", ["name", "kind"], "red bolt").collect()]
    assert all_rows == [(1, 2), (2, 2), (4, 2), (5, 2)]
    top = [r.id for r in search(df, "id", ["name", "kind"], "red bolt", limit=2).collect()]
    assert top == [1, 2]
    part = [r.id for r in search(df, "id", ["name", "kind"], "bolt red*", order_by_relevance=1).collect()]
    assert part[0] == 1 and sorted(part) == [1, 2, 4, 5]
    assert sorted(r.id for r in search(df, "id", ["name"], "blu", order_by_relevance=0).collect()) == [3]


def test_line_not_empty(spark):
    from cellguard.sources.files import line_not_empty

    df = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "first string, n int")
    assert [r.n for r in line_not_empty(df, "first").collect()] == [1]
