"""Ranks, runs and pages spread over partitions equal their plain definitions, also for a key with a third of the rows."""

import random
from itertools import groupby

import pytest

from cellguard.operators.ranks import grouped_rank, last_start, paged, runs


def made(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, "d"])
        rows.append((key, i, rng.choice(["x", "x", "x", "y", None]) if key != "b" else "same", rng.randint(0, 9)))
    rng.shuffle(rows)
    return rows


SCHEMA = "key string, at int, value string, w int"


def by_key(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    return {k: list(g) for k, g in groupby(order, key=lambda r: r[0])}


@pytest.fixture(scope="module", params=[3, 40])
def spread(spark, request):
    """Few partitions, and more than any key has runs of rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_grouped_rank(spread):
    rows = made()
    got = grouped_rank(spread.createDataFrame(rows, SCHEMA), ["key"], ["at"], "r").collect()
    want = [(*row, i) for own in by_key(rows).values() for i, row in enumerate(own)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = grouped_rank(spread.createDataFrame(rows, SCHEMA), [], ["at"], "r").collect()
    assert all(r["r"] == r["at"] for r in whole) and len(whole) == len(rows)


def plain_runs(rows):
    out = []
    for key, own in by_key(rows).items():
        for no, (value, run) in enumerate(groupby(own, key=lambda r: r[2]), 1):
            run = list(run)
            out.append((key, no, value, run[0][1], len(run), run[0][1], run[-1][1], sum(r[3] for r in run)))
    return sorted(out, key=str)


def test_runs(spread):
    import pyspark.sql.functions as F

    rows = made(seed=5)
    got = runs(spread.createDataFrame(rows, SCHEMA), ["at"], "value", ["key"], sums={"w": F.col("w")}).collect()
    assert sorted(map(tuple, got), key=str) == plain_runs(rows)
    one = runs(spread.createDataFrame([("k", i, "v", 1) for i in range(500)], SCHEMA), ["at"], "value").collect()
    assert [(r["group_no"], r["n"], r["first"], r["last"]) for r in one] == [(1, 500, 0, 499)]  # a run over all borders
    assert runs(spread.createDataFrame([], SCHEMA), ["at"], "value", ["key"]).collect() == []


def test_pages_and_starts(spread):
    rows = made(400, seed=9)
    got = paged(spread.createDataFrame(rows, SCHEMA), ["key"], ["at"], 7).collect()
    want = [(key, i // 7, [r[1] for r in own[i:i + 7]]) for key, own in by_key(rows).items() for i in range(0, len(own), 7)]
    assert sorted(((r["key"], r["page"], [x["at"] for x in r["rows"]]) for r in got), key=str) == sorted(want, key=str)
    starts = [5, 17, 18, 300]
    found = last_start(spread.createDataFrame(rows, SCHEMA), "at", spread.createDataFrame([(s,) for s in starts], "s int"), "s")
    assert {(r["at"], r["s"]) for r in found.collect()} == {
        (i, max((s for s in starts if s <= i), default=None)) for i in range(400)}
