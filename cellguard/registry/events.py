"""Registered event queries: consecutive runs (W1) per user, plain and hot-key-split; returning visits (R1);
scalar rounding functions (F4-F10) over line quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions.privacy import mask
from ..operators.groups import group_runs
from ..operators.rows import with_row_index
from ..operators.visits import UNTRACKABLE, answer_visits, mark_returning, new_token
from ..plans.load import drop_missing
from ..sources.testdata import table
from ..streaming.visits import answer_stream, mark_returning_stream, read_answers, read_marked
from .files import _folder


def event_runs(spark, sf):
    """Per user, runs of the same event type in (ts, event_id) order."""
    e = table(spark, sf, "events")
    return group_runs(e, ["ts", "event_id"], "event_type", ["user_id"], id_col="event_id")


def event_runs_bucketed(spark, sf):
    """W1 split by day inside each user (a hot user spreads over many tasks); equal to ``event_runs``."""
    e = table(spark, sf, "events")
    return group_runs(e, ["ts", "event_id"], "event_type", ["user_id"], bucket=F.to_date("ts"), id_col="event_id")


def returning_visits(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return mark_returning(e, "user_id", "ts", "event_id")


def _events_stream(spark, sf):
    """The events table as a file stream (which reads a folder: the events file of the tables folder)."""
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def returning_visits_stream(spark, sf):
    """R1 as a Structured Streaming job over the events table: run to completion (availableNow) into the checkpoint
    folder (progress beside it), then read the output back."""
    path = _folder(spark, "visits-stream")
    mark_returning_stream(_events_stream(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", path,
                          availableNow=True).awaitTermination()
    return read_marked(spark, path).select(
        F.col("id").alias("event_id"), F.col("key").cast("long").alias("user_id"), "returning",
        F.col("first_token").cast("long").alias("first_token"))


SECRET = "visits"
KINDS = {"purchase": "submit", "view": "check", "click": "check", "signup": "token", "error": "token"}


def visitors(spark, events, sf):
    """Events as visits: purchases are forms, views and clicks checks, the others show tokens: none, or the one that an
    earlier event's address would have been given (which holds only if that event was given one)."""
    address = (F.when(F.col("user_id") % 11 == 0, UNTRACKABLE).when(F.col("user_id") % 13 == 0, None)
               .otherwise(F.concat(F.lit("10.0."), F.col("user_id").cast("string"))))
    kind = F.lit(None).cast("string")
    for name, k in KINDS.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    v = events.select(kind.alias("kind"), address.alias("address"), "ts", F.col("event_id").alias("id"))
    source = table(spark, sf, "events").select(address.alias("address"), "ts", F.col("event_id").alias("id"))
    given = source.select(F.col("id").alias("s_id"), new_token(SECRET).alias("s_token"))
    shows = F.when((F.col("kind") == "token") & (F.col("id") % 3 != 0), F.col("id") - F.when(F.col("id") % 3 == 1, 5).otherwise(50))
    return v.join(given, shows == F.col("s_id"), "left").select(
        "kind", F.when(F.col("kind") != "token", F.col("address")).alias("address"), F.col("s_token").alias("token"), "ts", "id")


def visit_answers(spark, sf):
    """R1 by the visitor rules: reuse, new tokens, refusals, and what is logged."""
    return answer_visits(visitors(spark, table(spark, sf, "events"), sf), None, SECRET)


def visit_answers_stream(spark, sf):
    """The same over a stream."""
    path = _folder(spark, "visit-log")
    answer_stream(visitors(spark, _events_stream(spark, sf), sf), path, SECRET, availableNow=True).awaitTermination()
    return read_answers(spark, path)


def scalar_rounding(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    quarter = q / 4
    return li.select(
        "l_orderkey", "l_linenumber", q.alias("x"),
        R.int_round(q, 5).alias("int_round5"),
        R.int_only(quarter).alias("int_only_q"),
        R.int_ceil(q, 5).alias("int_ceil5"),
        R.int_floor(q, 5).alias("int_floor5"),
        R.int_mid(q, 5).alias("int_mid5"),
        R.round_to(quarter, 0.5, 1, 1).alias("round_up_half"),
        R.round_to(quarter, 2, 0, 0).alias("round_down_2"),
        R.floor1(quarter).cast("double").alias("floor1_q"),
        mask(q.cast("long"), 25).alias("masked25"),
    )


def with_gaps(spark, sf):
    """Events whose user and day are sometimes unknown."""
    return table(spark, sf, "events").withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))


def event_runs_null(spark, sf):
    """W1 with NULL partition keys: users unknown to the log form one group of their own."""
    return group_runs(with_gaps(spark, sf), ["ts", "event_id"], "event_type", ["user_id"], id_col="event_id")


def event_runs_null_split(spark, sf):
    return group_runs(with_gaps(spark, sf), ["ts", "event_id"], "event_type", ["user_id"], bucket=F.to_date("ts"),
                      id_col="event_id")


def returning_null(spark, sf):
    """R1 with NULL keys: visits without a user share one key."""
    return mark_returning(with_gaps(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


def row_index(spark, sf):
    """W6 on a shuffled join: every row keeps its place in the sorted order."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = j.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return with_row_index(ordered.select("l_orderkey", "l_linenumber", "o_custkey"))


# Cell texts that readers get wrong, mixed into a column of real ones.
ODD_CELLS = ["none", "NA", "None", "nan", "Missing", "007", "1.0", "12345678901234567890123", "1e40", "2.79", "."]
# The layouts in which order dates are written, as Spark patterns and as DuckDB formats.
DATE_LAYOUTS = {"M/d/yy": "%-m/%-d/%y", "yyyy/MM/dd": "%Y/%m/%d", "ddMMMyyyy": "%d%b%Y", "MMMM d, yyyy": "%B %-d, %Y",
                "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "MM/dd/yyyy": "%m/%d/%Y", "yyyy": "%Y", "yyyy'.0'": "%Y.0"}


def typed_values(spark, sf):
    """P6, F11, F12 on every order: a cell that is a price as it stands, cut, whole or odd, and its date in one of many
    layouts; which cells stay, and how they read."""
    o = table(spark, sf, "orders")
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    cell = (F.when(k % 17 == 0, F.get(F.array(*map(F.lit, ODD_CELLS)), (F.floor(k / 17) % len(ODD_CELLS)).cast("int")))
            .when(k % 4 == 0, F.floor(price).cast("long").cast("string"))
            .when(k % 4 == 1, F.concat(F.lit("00"), F.floor(price).cast("long").cast("string")))
            .when(k % 4 == 2, F.col("o_orderpriority"))
            .otherwise(F.format_string("%.2f", price)))
    date = F.col("o_orderdate").cast("timestamp")
    said = None
    for i, layout in enumerate(DATE_LAYOUTS):
        one = F.date_format(date, layout)
        said = one if said is None else F.when(k % len(DATE_LAYOUTS) == i, one).otherwise(said)
    cells = o.select("o_orderkey", cell.alias("raw"), F.lower(said).alias("said"))
    kept = drop_missing(cells, "raw")
    return kept.select("o_orderkey", F.col("raw").alias("text"), R.typed_name(F.col("raw")).alias("name"),
                       R.to_year(F.col("said")).cast("long").alias("year"))


QUERIES = {
    "row_index": row_index,
    "consecutive_groups_null_keys": event_runs_null,
    "consecutive_groups_null_keys_split": event_runs_null_split,
    "returning_visits_null_keys": returning_null,
    "typed_values": typed_values,
    "consecutive_groups": event_runs,
    "consecutive_groups_split": event_runs_bucketed,
    "returning_visits": returning_visits,
    "returning_visits_stream": returning_visits_stream,
    "visit_answers": visit_answers,
    "visit_answers_stream": visit_answers_stream,
    "scalar_rounding": scalar_rounding,
}

_RUNS = """WITH g AS (
  SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_no FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1
                    AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type
               THEN 0 ELSE 1 END AS s
    FROM events))
SELECT user_id, CAST(group_no AS BIGINT) AS group_no, arg_min(event_type, (ts, event_id)) AS event_type,
       arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS n, min(ts) AS first, max(ts) AS last
FROM g GROUP BY user_id, group_no"""


_RUNS_NULL = _RUNS.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id) "
                           "FROM events)")
def _pmod(x, n):
    return f"((({x}) % {n} + {n}) % {n})"


_MADE = """substr(md5(concat_ws('|', 'visits', coalesce(address, ''), CAST(id AS VARCHAR))), 1, 10)
  || strftime(ts, '%Y%m%d')"""
_ANSWERS = f"""WITH e AS (
  SELECT CASE event_type WHEN 'purchase' THEN 'submit' WHEN 'view' THEN 'check' WHEN 'click' THEN 'check' ELSE 'token' END
           AS kind,
         CASE WHEN user_id % 11 = 0 THEN 'untrackable' WHEN user_id % 13 <> 0 THEN '10.0.' || user_id END AS address,
         ts, event_id AS id FROM events),
m AS (SELECT *, {_MADE} AS made FROM e),
t AS (SELECT m.kind, m.ts, m.id, s.made AS shown FROM m LEFT JOIN m s
      ON s.id = m.id - CASE m.id % 3 WHEN 1 THEN 5 WHEN 2 THEN 50 END WHERE m.kind = 'token'),
forms AS (SELECT * FROM m WHERE kind = 'submit'),
checks AS (
  SELECT c.*, address IS NOT NULL AND address <> 'untrackable' AND EXISTS (
           SELECT 1 FROM forms f WHERE f.address = c.address AND (f.ts, f.id) < (c.ts, c.id)) AS back,
         (SELECT arg_min(f.made, (f.ts, f.id)) FROM forms f WHERE f.address = c.address) AS first_made
  FROM m c WHERE kind = 'check'),
judged AS (SELECT t.*, EXISTS (SELECT 1 FROM forms f WHERE f.made = shown AND (f.ts, f.id) < (t.ts, t.id)) AS good FROM t)
SELECT kind, address, ts, id, CAST(NULL AS BOOLEAN) AS "returning", made AS token, true AS accepted,
       CAST(NULL AS VARCHAR) AS error, true AS logged FROM forms
UNION ALL SELECT kind, address, ts, id, back, CASE WHEN back THEN first_made END, NULL, NULL, back FROM checks
UNION ALL SELECT kind, NULL, ts, id, NULL, CASE WHEN good THEN shown END, good,
       CASE WHEN shown IS NULL THEN 'unknown' WHEN NOT good THEN 'unrecognized' END, good FROM judged"""
_Q4 = "(l_quantity / 4)"
SQL = {
    "consecutive_groups": _RUNS,
    "consecutive_groups_split": _RUNS,
    "returning_visits": """SELECT e.event_id, e.user_id, e.ts, (e.ts, e.event_id) > (f.ts, f.event_id) AS returning,
  f.event_id AS first_token
FROM events e JOIN (SELECT user_id, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id
                    FROM events GROUP BY user_id) f ON f.user_id = e.user_id""",
    "returning_visits_stream": """SELECT e.event_id, e.user_id, (e.ts, e.event_id) > (f.ts, f.event_id) AS returning,
  f.event_id AS first_token
FROM events e JOIN (SELECT user_id, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id
                    FROM events GROUP BY user_id) f ON f.user_id = e.user_id""",
    "scalar_rounding": f"""SELECT l_orderkey, l_linenumber, l_quantity AS x,
  CAST(round_even(l_quantity / 5.0, 0) * 5 AS INTEGER) AS int_round5,
  CAST(round_even({_Q4}, 0) AS INTEGER) AS int_only_q,
  CAST(trunc(l_quantity + {_pmod('5.0 - ' + _pmod('l_quantity', '5.0'), '5.0')}) AS INTEGER) AS int_ceil5,
  CAST(trunc(l_quantity - {_pmod('l_quantity', '5.0')}) AS INTEGER) AS int_floor5,
  CAST(trunc(l_quantity - {_pmod('l_quantity', '5.0')}) AS INTEGER)
    + CASE WHEN trunc(l_quantity - {_pmod('l_quantity', '5.0')}) != l_quantity THEN 2 ELSE 0 END AS int_mid5,
  CAST(CASE WHEN round_even({_Q4} - {_pmod(_Q4, '0.5')}, 1) != {_Q4}
            THEN round_even({_Q4} - {_pmod(_Q4, '0.5')}, 1) + 0.5
            ELSE round_even({_Q4} - {_pmod(_Q4, '0.5')}, 1) END AS DOUBLE) AS round_up_half,
  CAST(round_even({_Q4} - {_pmod(_Q4, '2.0')}, 0) AS DOUBLE) AS round_down_2,
  CAST(floor({_Q4} * 10) / 10 AS DOUBLE) AS floor1_q,
  CAST(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS BIGINT) AS masked25
FROM lineitem""",
    "row_index": """SELECT l_orderkey, l_linenumber, o_custkey,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "consecutive_groups_null_keys": _RUNS_NULL,
    "consecutive_groups_null_keys_split": _RUNS_NULL,
    "returning_visits_null_keys": """WITH e AS (
  SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id FROM events)
SELECT e.event_id, e.user_id, e.ts, (e.ts, e.event_id) > (f.ts, f.event_id) AS returning, f.event_id AS first_token
FROM e JOIN (SELECT user_id, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id
             FROM e GROUP BY user_id) f ON f.user_id IS NOT DISTINCT FROM e.user_id""",
    "typed_values": f"""WITH c AS (
  SELECT o_orderkey, o_orderdate AS d, CASE
    WHEN o_orderkey % 17 = 0 THEN list_extract({ODD_CELLS!r}, CAST((o_orderkey // 17) % {len(ODD_CELLS)} AS INTEGER) + 1)
    WHEN o_orderkey % 4 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
    WHEN o_orderkey % 4 = 1 THEN '00' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
    WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE printf('%.2f', o_totalprice) END AS raw FROM orders)
SELECT o_orderkey, lower(raw) AS text, CASE
    WHEN raw = '007' THEN '7' WHEN raw = '2.79' THEN '2.7' WHEN o_orderkey % 17 = 0 THEN lower(raw)
    WHEN o_orderkey % 4 IN (0, 1) THEN ltrim(raw, '0') WHEN o_orderkey % 4 = 3 THEN regexp_replace(raw, '[0-9]$', '')
    ELSE lower(raw) END AS name,
  CAST(CASE WHEN o_orderkey % 8 <> 7 THEN year(d) END AS BIGINT) AS year  -- a decimal is no date
FROM c WHERE raw NOT IN ('NA', 'None', 'nan') AND lower(raw) NOT IN ('.', 'missing')""",
    "visit_answers": _ANSWERS,
    "visit_answers_stream": _ANSWERS,
}
