"""Consecutive row numbers in file order without funnelling rows through one task.

The rows are written once with their place (input partition and position in it); numbering then reads only that table,
so both sides of the join below see the same partitions whatever AQE coalesces. The one step that is not
row-parallel is a running sum over a table with one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

POSITION_BITS = 33  # monotonically_increasing_id keeps the position in the partition in its low bits


def with_row_index(df: DataFrame, name: str = "row_index", start: int = 0) -> DataFrame:
    """``df`` with ``name`` = ``start``, ``start`` + 1, ... in the order of its rows; no row is lost or repeated."""
    placed = cut_lineage(df.withColumn("__place", F.monotonically_increasing_id()), "rows")
    placed = placed.withColumn("__part", F.shiftright("__place", POSITION_BITS))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    position = F.col("__place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    index = (F.col("__before") + position + F.lit(start)).cast("long")
    return placed.join(starts, "__part").withColumn(name, index).drop("__place", "__part", "__before")
