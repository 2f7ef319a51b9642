"""Spark session helpers.

Cluster settings (executor sizes, shuffle partitions, checkpoint folder) belong to whoever launches the job; the
helpers here only fill in defaults that are unset, which is what local runs and tests need.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "cellguard", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    scratch = os.environ.get("CELLGUARD_SCRATCH", "/tmp")
    warehouse = {"spark.sql.warehouse.dir": f"{scratch}/cellguard-warehouse-{os.getpid()}"}
    for key, value in {**LOCAL_DEFAULTS, "spark.driver.memory": "16g", **warehouse, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session; set a scratch one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, object store); it is read, never
    overridden, and a cluster without one is refused. Only a local session falls back to a fresh folder. Recording the fallback in the
    session is best effort: ``cut_lineage`` only needs the returned path.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 - sessions without a SparkContext handle (e.g. Spark Connect)
            current = None
    if current:
        return current
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="cellguard-ckpt-", dir=os.environ.get("CELLGUARD_SCRATCH", "/tmp"))
    for record in (lambda: spark.conf.set("spark.checkpoint.dir", path),
                   lambda: spark.sparkContext.setCheckpointDir(path)):
        try:
            record()
        except Exception:  # noqa: BLE001 - a session may refuse to change core settings at run time
            pass
    return path


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, name: str = "cut", free: bool = False):
    """Write ``df`` as parquet into the session's checkpoint folder and return a DataFrame reading it back.

    Used where one intermediate feeds many branches of a plan (the EAV rows of a load, the chart's cell table):
    the plan below it runs once (one job; ``Dataset.checkpoint`` would run it twice unless cached), later plans
    stay small and get parquet column pruning and filter pushdown, and the files live in the shared checkpoint
    folder so a lost executor does not lose them.

    ``free``: the shuffle files of the write go at its end instead of when the driver collects garbage. Only for a
    ``df`` that is not executed again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.parquet(path)
