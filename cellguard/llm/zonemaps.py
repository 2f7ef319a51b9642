"""Exact integer k-means over Hilbert-ordered blocks with zone maps.

Vectors become integers ``floor(256 * x)``, are sorted by the Hilbert index of a few of their components and cut into
blocks, each with the least and greatest value of every component. For a block, a centroid can only be nearest to one
of its vectors if its least distance to the box is at most the smallest greatest distance of any centroid to the box;
the vectors are then compared exactly with those centroids alone. Blocks are written once and read every round; a
round sends at most one row of sums a task and centroid to the next.

The starting centroids are the vectors with the smallest SHA-256 of ``seed:id``, a sample by hash; the curve uses the
components in which they spread most, over the range they span. That choice only moves vectors between blocks.

Defined results. Vectors of another length, or with a null or non-finite component, are left out, and so are those
with a component beyond 2**62 / 256, which no 64-bit number holds; a null id hashes as the empty text; repeated rows
count as often as they stand. Equal hashes are ordered by components. Distances above 2**63 - 1 are given as that
number (comparisons stay exact). With fewer kept vectors than centroids there are fewer centroids; an empty table gives
an empty result. Other columns are ignored. Equal vectors are dealt by a hash of their id too, so a vector that a third
of all rows share spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .hilbert import curve_index

SCALE = 256
BLOCK = 1024
CURVE_DIMS, CURVE_BITS = 8, 5
LONGEST = (1 << 63) - 1


def kept_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(vec_id, v): whole vectors as integers; see the module for what is left out."""
    x = F.col(vector)
    scaled = F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")))
    fits = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(2.0 ** 62 / SCALE), F.lit(False)))
    return df.where((F.size(x) == size) & fits).select(F.col("vec_id").cast("long"), scaled.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def curve(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``kept`` with the Hilbert index over the components in which the centroids spread most."""
    spread = centroids.astype(np.float64).std(axis=0)
    dims = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
    low = centroids[:, dims].min(axis=0).astype(np.float64)
    width = np.maximum(centroids[:, dims].max(axis=0) - low, 1.0)
    top = (1 << CURVE_BITS) - 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), centroids.shape[1])[:, dims]
            cells = np.clip((v - low) / width * (top + 1), 0, top).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(curve_index(cells, CURVE_BITS), pa.int64())],
                names=["vec_id", "v", "at"])

    return kept.mapInArrow(index, "vec_id long, v array<long>, at long")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def zone_blocks(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(ids, n, width, data, box): blocks of vectors in curve order, in the narrowest integers that hold them."""
    size = centroids.shape[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, n
            every, v = pa.concat_arrays(ids), np.concatenate(parts)
            end = n if last else n - n % BLOCK
            for at in range(0, end, BLOCK):
                one = v[at:at + BLOCK]
                box = np.stack([one.min(axis=0), one.max(axis=0)])
                most = max(-int(box[0].min()), int(box[1].max()) + 1)
                width = next(w for w in (2, 4, 8) if most <= 1 << (8 * w - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([every[at:at + BLOCK].to_pylist()], pa.list_(pa.int64())), pa.array([len(one)], pa.int64()),
                     pa.array([width], pa.int64()), pa.array([one.astype(f"<i{width}").tobytes()], pa.binary()),
                     pa.array([box.astype("<i8").tobytes()], pa.binary())], names=["ids", "n", "width", "data", "box"])
            ids, parts, n = [every[end:]], [v[end:]], n - end

        for batch in batches:
            ids.append(batch.column(0))
            parts.append(matrix(batch.column(1), size))
            n += batch.num_rows
            if n >= 8 * BLOCK:
                yield from blocks(False)
        if n:
            yield from blocks(True)

    order = [F.col("at"), F.xxhash64("vec_id"), F.col("vec_id")]
    laid = curve(kept, centroids).repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")
    return cut_lineage(laid.mapInArrow(cut, "ids array<long>, n long, width long, data binary, box binary"), "zones")


def candidates(box: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector inside the box."""
    if max(abs(int(box.min())), abs(int(box.max())), abs(int(centroids.min())), abs(int(centroids.max()))) >= 1 << 27:
        box, centroids = box.astype(object), centroids.astype(object)
    below, above = box[0] - centroids, centroids - box[1]
    least = np.maximum(np.maximum(below, above), 0)
    most = np.maximum(np.abs(below), np.abs(above))
    return np.nonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())[0]


def nearest(v: np.ndarray, box: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector of a block; ties go to the smaller number."""
    among = candidates(box, centroids)
    c = centroids[among]
    most = max(abs(int(box.min())), abs(int(box.max())), abs(int(c.min())), abs(int(c.max())))
    if v.shape[1] * (2 * most) ** 2 < 1 << 53:  # every product and sum is a whole number that a double holds
        x, y = v.astype(np.float64), c.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)
        best = d.argmin(axis=1)
        return among[best], d[np.arange(len(v)), best].astype(np.int64)
    if v.shape[1] * (2 * most) ** 2 >= 1 << 63:
        v, c = v.astype(object), c.astype(object)
    d = np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)
    best = d.argmin(axis=1)
    return among[best], d[np.arange(len(v)), best]


def read_block(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, size).astype(np.int64)
    return v, np.frombuffer(row["box"], "<i8").reshape(2, size)


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the exact floored means of the vectors nearest to each centroid."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), dtype=object)  # sums and, last, the count, as whole Python numbers
        for batch in batches:
            for row in batch.to_pylist():
                v, box = read_block(row, size)
                cluster, _ = nearest(v, box, centroids)
                if max(abs(int(box.min())), abs(int(box.max()))) >= 1 << 52:
                    v = v.astype(object)  # a block's sum may leave 64 bits
                for j in np.unique(cluster):
                    own = v[cluster == j]
                    total[j, :size] += own.sum(axis=0).astype(object)
                    total[j, size] += len(own)
        found = [j for j in range(k) if total[j, size]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(
            [[str(x) for x in total[j]] for j in found], pa.list_(pa.string()))], names=["cluster", "sums"])

    merged = (blocks.select("width", "data", "box").mapInArrow(sums, "cluster int, sums array<string>")
              .select("cluster", F.posexplode("sums")).groupBy("cluster", "pos")
              .agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")))
    total: dict[int, dict[int, int]] = {}
    for r in merged.collect():  # centroids x (components + 1) rows
        total.setdefault(r["cluster"], {})[r["pos"]] = int(r["s"])
    return np.array([[total[j][i] // total[j][size] for i in range(size)] if j in total else centroids[j].tolist()
                     for j in range(k)], dtype=np.int64)


def centroid_sha256(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(df: DataFrame, vector: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5,
            seed: int = 2) -> DataFrame:
    """Every kept vector's cluster, squared distance and inertias after ``rounds`` rounds and a last assignment."""
    kept = kept_vectors(df, vector, size)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], RESULT)
    blocks = zone_blocks(kept, centroids)
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, d = nearest(*read_block(row, size), centroids)
                if d.dtype == object:
                    d = np.array([min(x, LONGEST) for x in d], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(c.astype(np.int32)), pa.array(d, pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    told = cut_lineage(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)

    each = [min(inertia.get(j, 0), LONGEST) for j in range(len(centroids))]
    return told.select(
        "vec_id", "cluster", "distance", by_cluster(each).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LONGEST)).cast("long").alias("inertia"),
        by_cluster([centroid_sha256(c) for c in centroids]).alias("centroid_sha256"))


def pruning(df: DataFrame, vector: str = "embedding", size: int = 64, k: int = 40, seed: int = 2) -> DataFrame:
    """(n, candidates): per block, its vectors and how many of the starting centroids its box leaves to compare."""
    kept = kept_vectors(df, vector, size)
    centroids = first_centroids(kept, k, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            left = [len(candidates(read_block(row, size)[1], centroids)) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["n"] for r in rows], pa.int64()), pa.array(left, pa.int64())],
                                             names=["n", "candidates"])

    return zone_blocks(kept, centroids).mapInArrow(count, "n long, candidates long")
