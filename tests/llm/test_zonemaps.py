"""Integer k-means over zone maps against plain Python, and the bounds of the boxes."""

import hashlib
import math
import random

import numpy as np

from cellguard.llm import registry, zonemaps

SCHEMA = "vec_id long, embedding array<double>, cluster int, v int, at int, ids int"


def plain(rows, size, k, rounds):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, hash) by comparing every pair in whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), b in zip(kept, best) if b[1] == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    best = assign()
    sums = [sum(d for d, j in best if j == c) for c in range(len(centroids))]
    most = (1 << 63) - 1
    return sorted(((i, j, min(d, most), min(sums[j], most), min(sum(sums), most), hashlib.sha256(
        ",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best)), key=str)


def made(rng, n, size):
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.04) for x in centres[i % 6]]) for i in range(n)]
    rows += [(i, rows[5][1]) for i in range(n, n + n // 2)]  # one vector a third of all rows share
    return rows


ODD = [(None, None), (None, [0.5] * 6), (7, [0.5] * 5), (8, [0.5] * 5 + [None]), (9, [float("nan")] * 6), (5, []),
       (10, [float("inf")] + [0.0] * 5), (3, [0.25] * 6), (3, [0.25] * 6), (11, [-1 / 512] * 6), (12, [0.0] * 6)]


def got(df, **how):
    return sorted((tuple(r) for r in zonemaps.cluster(df, **how).collect()), key=str)


def test_clusters_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(zonemaps, "BLOCK", 16)
    rows = made(random.Random(1), 300, 6) + ODD
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    assert got(df, size=6, k=12, rounds=3) == plain(rows, 6, 12, 3)
    left = zonemaps.pruning(df.where("vec_id < 300"), size=6, k=12).collect()  # equal centroids cannot be told apart
    assert len(left) > 15 and sum(r["n"] * r["candidates"] for r in left) < 0.5 * 12 * sum(r["n"] for r in left)


def test_large_components_few_vectors_and_empty_table(spark):
    rng = random.Random(4)
    for scale in (1e5, 1e9, 1e15):  # exact in doubles, in 64 bits, beyond them
        rows = [(i, [rng.uniform(-scale, scale) for _ in range(6)]) for i in range(60)]
        assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=6, k=5, rounds=2) == plain(
            rows, 6, 5, 2)
    rows = [(1, [1.0] * 6), (2, [2.0] * 6)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=6) == plain(rows, 6, 40, 5)
    none = zonemaps.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    assert none.count() == 0 and none.columns[0] == "vec_id"


def test_no_nearest_centroid_is_left_out():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.integers(-50, 50, (20, 3)) + rng.integers(-200, 200, 3)
        c = rng.integers(-250, 250, (15, 3))
        among, d = zonemaps.nearest(v, np.stack([v.min(axis=0), v.max(axis=0)]), c)
        every = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (among == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain([tuple(r) for r in rows[:]], 64, 40, 5)
    assert sorted((tuple(r) for r in registry.op12_zone_maps(spark, "/root/testdata/sf0.001").collect()), key=str) == want
