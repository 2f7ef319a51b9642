"""R1 returning visits and the visit log.

``mark_returning``: a visit is *returning* when its key (address, user) was seen at an earlier visit; it reuses the
token of the key's first visit. The first visit per key is an aggregation (``min`` of (ts, id), partial aggregation
map-side), joined back on the key; no per-key window, so a key holding a third of all visits is not funnelled through
one task (AQE's skew-join handling splits its partition of the join).

``answer_visits`` follows the visitor rules over an append-only log of (address, token):

* ``submit``: a form; always logged, with a new token;
* ``check``: an address is returning if the log holds it before; it reuses the token of the address's first log row if
  that is set, else gets a new one, and the visit is logged. An unknown address, a NULL one and ``untrackable`` are
  answered as new and not logged;
* ``token``: a token is accepted and logged if the log holds it before; a missing token and one that nobody was given
  are refused, with different errors, and not logged.

"Before" is the order of (ts, id) within the batch, and everything already in the log. New tokens are made from a secret,
the address and the visit, so a repeated run makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNTRACKABLE = "untrackable"  # fixed value: the address of a visitor whose address is unknown
MISSING, UNKNOWN = "unknown", "unrecognized"
LOG = "address string, token string, ts timestamp, id long"


def mark_returning(visits: DataFrame, key: str, ts: str, id_col: str, token: str | None = None) -> DataFrame:
    """Visits with ``returning`` (bool) and ``first_token`` (the token of the key's first visit, or its id)."""
    tok = token or id_col
    first = visits.groupBy(key).agg(F.min(F.struct(ts, id_col, F.col(tok).alias("_tok"))).alias("_first"))
    first = first.withColumnRenamed(key, "_key")
    j = visits.join(first, F.col(key).eqNullSafe(F.col("_key")))  # visits without a key share one
    me = F.struct(F.col(ts), F.col(id_col))
    first_key = F.struct(F.col("_first")[ts], F.col("_first")[id_col])
    return j.select(
        *visits.columns,
        (me > first_key).alias("returning"),
        F.col("_first")["_tok"].alias("first_token"),
    )


def new_token(secret: str) -> Column:
    """Ten letters and digits from the secret, the address and the visit's id, and the day of the visit."""
    made = F.md5(F.concat_ws("|", F.lit(secret), F.coalesce("address", F.lit("")), F.col("id").cast("string")))
    return F.concat(F.substring(made, 1, 10), F.date_format("ts", "yyyyMMdd"))


def answer_visits(visits: DataFrame, log: DataFrame | None, secret: str) -> DataFrame:
    """(kind, address, ts, id, returning, token, accepted, error, logged) for visits (kind, address, token, ts, id).

    ``logged`` rows are what the log gains: (address, token, ts, id). ``log`` is the log so far, or None.
    """
    spark = visits.sparkSession
    log = log if log is not None else spark.createDataFrame([], LOG)
    at = F.struct("ts", "id")
    order = [c for c in ("batch", "ts", "id") if c in log.columns]  # a stream's log also knows when a row arrived
    v = visits.select("kind", F.col("address").cast("string").alias("address"), F.col("token").cast("string").alias(
        "given"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    v = v.withColumn("made", new_token(secret))
    known = F.col("address").isNotNull() & (F.col("address") != UNTRACKABLE)

    # the first log row of each address: of the log if it has one, else of this batch's forms (checks of unknown
    # addresses log nothing, so only a form can be an address's first row)
    old = log.where(known).groupBy("address").agg(F.min(F.struct(*order, "token")).alias("f")).select(
        "address", F.struct(F.lit(0).alias("batch"), "f.ts", "f.id", "f.token").alias("f"))
    fresh = v.where((F.col("kind") == "submit") & known).groupBy("address").agg(
        F.min(F.struct("ts", "id", "made")).alias("f")).select(
        "address", F.struct(F.lit(1).alias("batch"), "f.ts", "f.id", F.col("f.made").alias("token")).alias("f"))
    first = old.unionByName(fresh).groupBy("address").agg(F.min("f").alias("f"))
    asked = v.where(F.col("kind") == "check").join(first, "address", "left")
    seen = known & F.col("f").isNotNull() & ((F.col("f.batch") == 0) | (F.struct("f.ts", "f.id") < at))
    back = F.coalesce(seen, F.lit(False))
    reply = F.when(back, F.coalesce(F.when(F.col("f.token") != "", F.col("f.token")), F.col("made")))
    none = F.lit(None).cast("string")
    checks = asked.select("kind", "address", "ts", "id", back.alias("returning"), reply.alias("token"),
                          F.lit(None).cast("boolean").alias("accepted"), none.alias("error"), back.alias("logged"))
    forms = v.where(F.col("kind") == "submit").select(
        "kind", "address", "ts", "id", F.lit(None).cast("boolean").alias("returning"), F.col("made").alias("token"),
        F.lit(True).alias("accepted"), none.alias("error"), F.lit(True).alias("logged"))

    # tokens that someone was given: in the log, or in this batch by a form or a check before the visit
    given = log.where("token is not null and token <> ''").select(
        F.col("token").alias("given"), F.struct(F.lit(0).alias("batch"), "ts", "id").alias("g"))
    now = forms.unionByName(checks.where("returning")).select(
        F.col("token").alias("given"), F.struct(F.lit(1).alias("batch"), "ts", "id").alias("g"))
    issued = given.unionByName(now).groupBy("given").agg(F.min("g").alias("g"))
    shown = v.where(F.col("kind") == "token").join(issued, "given", "left")
    good = F.coalesce(F.col("g").isNotNull() & ((F.col("g.batch") == 0) | (F.struct("g.ts", "g.id") < at)), F.lit(False))
    tokens = shown.select(
        "kind", F.lit(None).cast("string").alias("address"), "ts", "id", F.lit(None).cast("boolean").alias("returning"),
        F.when(good, F.col("given")).alias("token"), good.alias("accepted"),
        F.when(F.coalesce(F.col("given"), F.lit("")) == "", F.lit(MISSING)).when(~good, F.lit(UNKNOWN)).alias("error"),
        good.alias("logged"))
    return forms.unionByName(checks).unionByName(tokens)


def logged(answers: DataFrame) -> DataFrame:
    """The rows that answers add to the log."""
    return answers.where("logged").select("address", "token", "ts", "id")
