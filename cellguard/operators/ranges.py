"""Facet range inference (A13), smallest adjacent gap (W3) and age-axis inference.

A13 runs on *distinct* (item, value) pairs: the row count collapses to the value domain before the per-item window,
so a hot item costs one row per distinct value, never one per subject. The branchy arithmetic is one chain of
Column expressions; ``*_f`` columns carry whether the reference would hold that number as a float (that decides
how it is stored), because Spark columns have one type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDEAL_BUCKETS = 20  # fixed value: target number of facet buckets


def _ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _frac_zeros(x: Column) -> Column:
    """Number of '0' characters after the decimal point in the shortest text of a double."""
    s = x.cast("string")
    frac = F.substring_index(s, ".", -1)
    return F.length(frac) - F.length(F.replace(frac, F.lit("0"), F.lit("")))


def smallest_gaps(values: DataFrame, key: str, v: str, skip_zero: bool = True) -> DataFrame:
    """Per key, min / max / count of distinct values and the smallest gap between sorted neighbours.

    With ``skip_zero`` a predecessor equal to 0 does not start a gap (the reference tests the predecessor's truth).
    The distinct values are range-partitioned on (key, value), so one key with very many distinct values spreads
    over many tasks: gaps are taken inside each range partition, and the gap across a partition boundary comes
    from a small table with one row per (key, partition).
    """
    d = values.select(key, F.col(v).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct()
    d = d.repartitionByRange(key, "v").withColumn("_b", F.spark_partition_id())
    prev = F.lag("v").over(Window.partitionBy(key, "_b").orderBy("v"))
    gap_ok = prev.isNotNull() & (prev != 0) if skip_zero else prev.isNotNull()
    per_b = d.withColumn("gap", F.when(gap_ok, F.col("v") - prev)).groupBy(key, "_b").agg(
        F.min("v").alias("bmin"), F.max("v").alias("bmax"), F.min("gap").alias("gap"), F.count("v").alias("n")
    )
    pmax = F.lag("bmax").over(Window.partitionBy(key).orderBy("_b"))
    cross_ok = pmax.isNotNull() & (pmax != 0) if skip_zero else pmax.isNotNull()
    per_b = per_b.withColumn("cross", F.when(cross_ok, F.col("bmin") - pmax))
    return per_b.groupBy(key).agg(
        F.min("bmin").alias("vmin"), F.max("bmax").alias("vmax"),
        F.least(F.min("gap"), F.min("cross")).alias("gap"), F.sum("n").alias("nvals"),
    )


def infer_ranges(values: DataFrame, key: str = "item", v: str = "v", ideal: int = IDEAL_BUCKETS) -> DataFrame:
    """(key, start, end, step, is_float) for keys with at least two distinct values and one usable gap.

    Unit steps over more than 20 and steps of a tenth get ends on multiples of 5. If the steps then make more than
    ``ideal`` buckets, the step becomes a multiple of twice itself that makes about ``ideal``, and the ends move
    outwards to multiples of it.
    """
    gaps = smallest_gaps(values, key, v).where((F.col("nvals") > 1) & F.col("gap").isNotNull())
    high = F.col("vmax") + F.when(F.floor("vmax") != F.col("vmax"), F.lit(0.1)).otherwise(F.lit(0.0))
    gaps = gaps.select(key, "gap", F.col("vmin").alias("low"), high.alias("high"))
    low, high, gap = F.col("low"), F.col("high"), F.col("gap")
    units = (gap == 1.0) & (high - low > 20)
    tenths = ~units & (F.abs(gap - 0.1) <= 1e-9 * F.greatest(F.abs(gap), F.lit(0.1)))
    fives = units | tenths
    ends = gaps.select(
        key,
        F.when(fives, F.floor(low / 5) * 5.0).otherwise(low).alias("low"),
        F.when(fives, F.ceil(high / 5) * 5.0).otherwise(high).alias("high"),
        F.when(units, 5.0).when(tenths & (high - low > 10), 1.0).when(tenths, 0.1).otherwise(gap).alias("step"),
        (~tenths).alias("ends_float"),
        F.when(fives, tenths & (high - low <= 10)).otherwise(True).alias("step_float"),
    )
    low, high, step = F.col("low"), F.col("high"), F.col("step")
    small = F.col("step_float") & (step * 2 <= 1)
    coarse = F.when(F.col("step_float") & ~small, _trunc(step * 2)).otherwise(step * 2)
    scale = F.when(small, (_frac_zeros(step) + 1).cast("double") * 10).otherwise(F.lit(1.0))
    times = _ceil((high * scale - low * scale) / float(ideal) / (coarse * scale))
    wide = ends.withColumn("many", (high - low) / step > ideal).withColumn(
        "wider", _trunc(times * coarse * scale) / scale).withColumn("wider_float", small)
    wider = F.col("wider")
    many = F.col("many") & (wider > 0)  # a step too fine to widen stays
    out = wide.select(
        key,
        F.when(many, F.floor(low / wider) * wider).otherwise(low).alias("start"),
        F.when(many, F.ceil(high / wider) * wider).otherwise(high).alias("end"),
        F.when(many, wider).otherwise(step).alias("step"),
        F.when(many, F.col("wider_float")).otherwise(F.col("ends_float")).alias("is_float"),
    )
    shown = {c: F.when(F.col("is_float"), _trunc(F.col(c) * 10) / 10) for c in ("start", "end", "step")}
    return out.select(key, shown["start"].otherwise(_trunc(F.col("start"))).alias("start"),
                      shown["end"].otherwise(_trunc(F.col("end"))).alias("end"),
                      shown["step"].otherwise(F.col("step")).alias("step"), "is_float")


def age_axis(subjects: DataFrame, age_min=None, age_max=None, age_step=None, age: str = "age_bl") -> DataFrame:
    """One row (age_min, age_max, age_step); missing settings come from the distinct ages.

    Step = smallest gap between sorted distinct ages (a predecessor of 0 skipped); max is raised and min lowered to
    a multiple of the step (a value of 0 is left alone, as in the reference).
    """
    g = smallest_gaps(subjects.withColumn("_all", F.lit(1)), "_all", age)
    step = F.lit(age_step).cast("double") if age_step else F.col("gap")
    vmax, vmin = F.col("vmax"), F.col("vmin")
    up = F.pmod(vmax, step)
    down = F.pmod(vmin, step)
    amax = F.lit(age_max).cast("double") if age_max else F.when((vmax != 0) & (up != 0), vmax + step - up).otherwise(vmax)
    amin = F.lit(age_min).cast("double") if age_min else F.when((vmin != 0) & (down != 0), vmin - down).otherwise(vmin)
    return g.select(
        amin.cast("int").alias("age_min"), amax.cast("int").alias("age_max"), step.cast("int").alias("age_step")
    )
