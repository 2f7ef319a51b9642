"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits, the cell's index on the Hilbert curve is computed, rows are sorted by
it, and the order is cut into runs of (nearly) equal row counts: every shard then covers a compact box in all
dimensions at once, so min/max file statistics prune on any of them.

Cells follow the order of the values, which is what min/max statistics test, and hold about equally many rows: the
borders between cells are quantiles, so one value far off does not squeeze the others into one cell. A category takes
the cell in which the middle of its rows lies. A dimension with ``lead`` bits gives these before the curve: the curve
then runs inside each of its 2**lead slabs, which favours that dimension's readers over the others'.

Rows with null dimensions take cell 0 of that dimension; a null text counts as empty; repeated rows are kept and
ordered next to each other; ties on the curve are ordered by the tie columns, which also lets range partitioning
split one hot cell over many tasks. An empty table gives an empty result. Input columns named hilbert, shard or slot
come back as hilbert_in, shard_in or slot_in (one more _in where that is taken).
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import global_rank

ADDED = ("hilbert", "shard", "slot")


@dataclass(frozen=True)
class Dimension:
    """One metadata column: a ``number`` or a ``category`` (text); its first ``lead`` bits go before the curve."""

    column: str
    kind: str = "number"
    lead: int = 0


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x dimensions, each below 2**bits), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the highest bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave the transposed bits
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def number_borders(df: DataFrame, columns: list[str], cells: int) -> dict[str, np.ndarray]:
    """For each column the values at which its 2nd, 3rd, ... cell starts: quantiles over all rows, in one aggregation."""
    if not columns:
        return {}
    shares = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10_000).alias(f"q{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: np.unique(np.array(row[i] or [], dtype=float)) for i, c in enumerate(columns)}


def category_borders(df: DataFrame, column: str, cells: int) -> list[tuple[str, int]]:
    """(first value, cell) of each cell in use, in value order; at most ``cells`` entries, however many values occur.

    Running row counts over the sorted distinct values come from range partitions and one offset a partition.
    """
    value = F.col(f"`{column}`").cast("string").alias("value")
    counts = df.select(value).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    laid = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    laid = cut_lineage(laid, "values")
    sums = laid.groupBy("part").agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    total = sums.agg(F.sum("all")).first()[0]
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    middle = F.col("start") + F.col("upto") - F.col("n") / 2
    cell = F.least(F.lit(cells - 1), F.floor(middle * F.lit(cells) / F.lit(total))).cast("int")
    placed = laid.withColumn("upto", upto).join(starts, "part").select(cell.alias("cell"), "value")
    firsts = placed.groupBy("cell").agg(F.min("value").alias("value")).orderBy("cell")
    return [(r["value"], r["cell"]) for r in firsts.collect()]


def hilbert_index(df: DataFrame, dims: list[Dimension], bits: int):
    """The index column: leading bits of the dimensions that have some, then the curve over what is left of each."""
    size = 1 << bits
    numbers = number_borders(df, [d.column for d in dims if d.kind == "number"], size)
    words = {d.column: category_borders(df, d.column, size) for d in dims if d.kind == "category"}

    def cells(d: Dimension, values: pd.Series) -> np.ndarray:
        if d.kind == "number":
            x = values.to_numpy(dtype=float, na_value=np.nan)
            # a value's rows start at its border; nulls and NaN take cell 0
            return np.where(np.isnan(x), 0, np.searchsorted(numbers[d.column], x, side="right"))
        firsts, own = [v for v, _ in words[d.column]], [c for _, c in words[d.column]]
        known = {v: own[bisect_right(firsts, v) - 1] for v in values.dropna().unique()}
        return values.map(known).fillna(0).to_numpy(dtype=np.int64)

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        placed = np.stack([cells(d, v) for d, v in zip(dims, columns)], axis=1).astype(np.int64)
        slab = np.zeros(len(placed), dtype=np.int64)
        for i, d in enumerate(dims):
            slab = (slab << d.lead) | (placed[:, i] >> (bits - d.lead))
            placed[:, i] = (placed[:, i] << d.lead) & (size - 1)
        return pd.Series((slab << bits * len(dims)) | curve_index(placed, bits))

    kinds = {"number": "double", "category": "string"}
    return index(*[F.col(f"`{d.column}`").cast(kinds[d.kind]) for d in dims])


def hilbert_shards(df: DataFrame, dims: list[Dimension], shards: int, ties: list[str], bits: int = 8) -> DataFrame:
    """``df`` with hilbert (curve index), shard (0..shards-1) and slot (gapless position in the shard).

    Row counts of shards differ by one at most. ``ties`` order rows of one cell.
    """
    if bits * len(dims) + sum(d.lead for d in dims) > 62:
        raise ValueError("dimensions x bits and leading bits must stay within 62 bits")
    named, taken = {}, {c.lower() for c in df.columns} | set(ADDED)
    for c in df.columns:
        new = c
        while new != c and new.lower() in taken or new.lower() in ADDED:
            new += "_in"
        named[c] = new
        taken.add(new.lower())
    order = [f"t{i}" for i in range(len(ties))]
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       hilbert_index(df, dims, bits).alias("hilbert"),
                       *[F.col(f"`{c}`").alias(t) for t, c in zip(order, ties)])
    ranked = global_rank(placed, ["hilbert", *order])
    n = ranked.count()
    rank, base, extra = F.col("rank"), n // shards, n % shards  # the first `extra` shards hold one row more
    edge = extra * (base + 1)
    if base:
        shard = F.when(rank < edge, F.floor(rank / F.lit(base + 1))).otherwise(
            F.lit(extra) + F.floor((rank - F.lit(edge)) / F.lit(base)))
    else:
        shard = rank
    first = F.when(shard <= extra, shard * (base + 1)).otherwise(F.lit(edge) + (shard - extra) * base)
    return ranked.select(*[F.col(f"row.`{c}`").alias(new) for c, new in named.items()], "hilbert",
                         shard.cast("int").alias("shard"), (rank - first).cast("long").alias("slot"))


def shard_ranges(sharded: DataFrame, dims: list[Dimension]) -> DataFrame:
    """Per shard the min and max of each dimension: what a file-pruning reader tests."""
    return sharded.groupBy("shard").agg(*[f(d.column).alias(f"{n}_{d.column}") for d in dims
                                          for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order inside each file."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
