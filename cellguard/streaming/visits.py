"""R1 on streams: visits are answered batch by batch against what earlier batches left.

Arrival order defines "before": everything of an earlier micro-batch, then (ts, id) within one. A batch is an ordinary
Spark job: the first visit of each of its keys is a partial aggregation, and joins (which split hot keys) bring it
back to the visits, so a user with a third of the visits is no single task's work; no Python state per key.

What a batch writes is named by the batch's number and overwritten if the batch is run again, and a batch reads only
what smaller numbers wrote. So a restarted query neither repeats nor forgets a visit. Keys and tokens are text of any
kind; a visit without a key shares one with its like, and a token that is not set is never handed out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.visits import answer_visits, logged

FIRST = "key string, ts timestamp, id long, token string"
MARKED = "key string, ts timestamp, id long, returning boolean, first_token string"
ANSWER = ("kind string, address string, ts timestamp, id long, returning boolean, token string, accepted boolean, "
          "error string, logged boolean")


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame | None:
    """What the batches before ``batch`` wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # any store that Spark reaches
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < batch)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MARKED}, batch long").parquet(f"{path}/visits").drop("batch")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ANSWER}, batch long").parquet(f"{path}/answers").drop("batch")


def mark_returning_stream(visits: DataFrame, key: str, ts: str, id_col: str, path: str, token: str | None = None,
                          **trigger) -> StreamingQuery:
    """Start marking a stream's visits: (key, ts, id, returning, first_token) in ``path``, see ``read_marked``.

    ``first_token`` is the token of the key's first visit that has one set at its first batch (or the visit's id,
    without a token column).
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        v = df.selectExpr(f"CAST({key} AS STRING) AS key", f"CAST({ts} AS TIMESTAMP) AS ts",
                          f"CAST({id_col} AS BIGINT) AS id", f"CAST({token or id_col} AS STRING) AS token")
        here = v.groupBy("key").agg(F.min(F.struct("ts", "id", "token")).alias("f"))
        old = _earlier(spark, f"{path}/first", FIRST, n)
        old = old if old is not None else spark.createDataFrame([], FIRST)
        known = old.select(F.col("key").alias("o_key"), F.struct("ts", "id", "token").alias("o"))
        both = here.join(known, F.col("key").eqNullSafe(F.col("o_key")), "left")
        first = both.select(F.col("key").alias("f_key"), F.coalesce("o", "f").alias("f"), F.col("o").isNotNull().alias("old"))
        marked = v.join(first, F.col("key").eqNullSafe(F.col("f_key"))).select(
            "key", "ts", "id", (F.col("old") | (F.struct("ts", "id") > F.struct("f.ts", "f.id"))).alias("returning"),
            F.col("f.token").alias("first_token"))
        _write(marked, f"{path}/visits", n)
        _write(both.where("o_key is null and o is null").select("key", "f.ts", "f.id", "f.token"), f"{path}/first", n)

    return _start(visits, batch, path, trigger)


def answer_stream(visits: DataFrame, path: str, secret: str, **trigger) -> StreamingQuery:
    """Start answering a stream of visits by the rules of ``answer_visits``; answers and the log lie in ``path``."""

    def batch(df: DataFrame, n: int) -> None:
        log = _earlier(df.sparkSession, f"{path}/log", "address string, token string, ts timestamp, id long", n)
        _write(answer_visits(df, log, secret), f"{path}/answers", n)
        done = df.sparkSession.read.schema(ANSWER).parquet(f"{path}/answers/batch={n}")
        _write(logged(done), f"{path}/log", n)

    return _start(visits, batch, path, trigger)


def _start(visits: DataFrame, batch, path: str, trigger: dict) -> StreamingQuery:
    stream = visits.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/progress")
    return (stream.trigger(**trigger) if trigger else stream).start()
