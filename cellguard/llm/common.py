"""Helpers shared by the training-data operators: input shaping, global ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def id_bucket(c: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``: keeps Catalyst from inlining it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Gapless 0-based rank of every row in ``order``, without a one-task window.

    Rows are range-partitioned and sorted, written once, and numbered as (rows of earlier partitions + position in
    the partition). ``order`` should name every column that can tell rows apart; rows equal in all of them are
    interchangeable. The only table that meets in one task has one row per partition.
    """
    laid = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("__at", F.monotonically_increasing_id()))
    frozen = cut_lineage(laid, "rank").withColumn("__part", F.shiftright("__at", 33))
    sizes = frozen.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    position = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (frozen.join(starts, "__part")
            .withColumn(name, F.col("__start") + position).drop("__part", "__start", "__at"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a LONG, b LONG): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two narrow aggregations and
    joins over the edges, hot stars are split by AQE, and the edge list shrinks to stars around the roots. Each
    round is written to the checkpoint folder, so a lost executor repeats one round at most.
    """
    now = cut_lineage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct(), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = cut_lineage(down.groupBy("a").agg(F.min("b").alias("m")), "star")
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
                          "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(state)
    raise RuntimeError("components did not settle")
