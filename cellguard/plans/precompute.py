"""Results the reference keeps across restarts, written once as parquet and read back.

Population size, the catalogue, the unfiltered chart (masked, not jittered) and its zeroed copy (A16): the chart
answers "no filter" and "no result" from these files instead of scanning the subjects again.

The chart's cell table is also kept as a state that grows: counts and sums of cells add up, so new subjects are read
alone, their cells appended, and the chart is taken from the sums. An append is a few rows a batch; ``compact_state``
folds them into a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChartConfig
from .catalogue import catalogue
from .chart import ChartResult, cell_table, filter_chart


def precompute(store, cfg: ChartConfig, path: str) -> None:
    chart = filter_chart(store.subjects, cfg, None, jitter=False)
    store.subjects.agg(F.count(F.lit(1)).alias("population")).write.mode("overwrite").parquet(f"{path}/population")
    catalogue(store).write.mode("overwrite").parquet(f"{path}/catalogue")
    for name in ("subject_counts", "age_bl", "age_fu"):
        df = getattr(chart, name)
        df.write.mode("overwrite").parquet(f"{path}/chart_{name}")
        df.withColumn("value", (F.col("value") * 0).cast(df.schema["value"].dataType)).write.mode(
            "overwrite").parquet(f"{path}/null_{name}")


def read_precomputed(spark: SparkSession, path: str) -> dict:
    names = ["population", "catalogue"] + [f"{p}_{n}" for p in ("chart", "null")
                                           for n in ("subject_counts", "age_bl", "age_fu")]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


CELL = ["sel", "sex", "enrollment", "bl_bin", "fu_bin"]


def append_state(subjects: DataFrame, cfg: ChartConfig, path: str) -> None:
    """Add subjects that the state does not hold yet (the first call starts it)."""
    cell_table(subjects, cfg).write.mode("append").parquet(f"{path}/cells")


def state_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all subjects appended so far."""
    held = spark.read.parquet(f"{path}/cells")
    return held.groupBy(*CELL).agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "fsum", "fcnt")])


def compact_state(spark: SparkSession, path: str, new_path: str) -> None:
    state_cells(spark, path).write.parquet(f"{new_path}/cells")


def chart_from_state(spark: SparkSession, cfg: ChartConfig, path: str) -> ChartResult:
    """The chart over everyone, from the cells (their axis must be that of ``cfg``)."""
    cells = state_cells(spark, path)
    return filter_chart(cells, cfg, cells=cells)
