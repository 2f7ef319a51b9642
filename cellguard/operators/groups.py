"""W1/W2 consecutive grouping (gaps and islands) and Q5 dictionary view.

A new group starts whenever ``key`` differs from the previous row's (in ``order`` within ``partition``); a key
may recur later as a new group. The plain form is a ``lag`` + running ``sum`` window per partition.

``group_runs`` without a bucket and ``dictionary_pages`` need no hint: see ``ranks``.

``consecutive_groups_bucketed`` splits each partition further by an order-compatible ``bucket`` (e.g. the day of a
timestamp) so one hot partition key is spread over many tasks: island starts are counted inside each
(partition, bucket), and a small per-(partition, bucket) table (one row per bucket) supplies the offsets and
whether a bucket's first row continues the previous bucket's last key. The result equals the plain form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import last_start, paged, runs


def _eq_null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def consecutive_groups(df: DataFrame, order: list[str], key: str, partition: list[str] | None = None,
                       group_col: str = "group_no") -> DataFrame:
    """Rows with ``group_no``: 1, 2, ... per partition, a new number whenever the key changes."""
    partition = partition or []
    w = Window.partitionBy(*partition).orderBy(*order)
    prev = F.lag(key).over(w)
    start = F.when((F.row_number().over(w) > 1) & _eq_null_safe(prev, F.col(key)), 0).otherwise(1)
    return df.withColumn("_start", start).withColumn(
        group_col, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_start")


def consecutive_groups_bucketed(df: DataFrame, order: list[str], key: str, partition: list[str], bucket: Column,
                                group_col: str = "group_no") -> DataFrame:
    """Same numbering as ``consecutive_groups``; ``bucket`` must be non-decreasing along ``order``."""
    b = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*partition, "_bucket").orderBy(*order)
    prev = F.lag(key).over(inner)
    rn = F.row_number().over(inner)
    b = b.withColumn("_rn", rn).withColumn("_local_start", F.when((rn > 1) & _eq_null_safe(prev, F.col(key)), 0)
                                           .otherwise(1))
    b = b.withColumn("_local", F.sum("_local_start").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per (partition, bucket): its first key, last key and number of local starts
    first_last = b.groupBy(*partition, "_bucket").agg(
        F.min_by(key, F.struct(*order)).alias("_first"),
        F.max_by(key, F.struct(*order)).alias("_last"),
        F.max("_local").alias("_n"),
    )
    pw = Window.partitionBy(*partition).orderBy("_bucket")
    has_prev = F.row_number().over(pw) > 1
    continues = has_prev & _eq_null_safe(F.lag("_last").over(pw), F.col("_first"))
    offs = first_last.withColumn("_adj", F.col("_n") - F.when(continues, 1).otherwise(0)).withColumn(
        "_off", F.coalesce(F.sum("_adj").over(pw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_cont", continues).select(*partition, "_bucket", "_off", "_cont")
    # null-safe: rows without a partition key or a bucket form groups of their own
    keys = [*partition, "_bucket"]
    offs = offs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_off", "_cont")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & _eq_null_safe(F.col(c), F.col(f"_k{i}"))
    out = b.join(offs, same).drop(*[f"_k{i}" for i in range(len(keys))])
    g = F.col("_off") + F.col("_local") - F.when(F.col("_cont"), 1).otherwise(0)
    return out.withColumn(group_col, g).drop("_bucket", "_rn", "_local_start", "_local", "_off", "_cont")


def group_runs(df: DataFrame, order: list[str], key: str, partition: list[str], bucket: Column | None = None,
               id_col: str | None = None) -> DataFrame:
    """One row per consecutive run: (partition..., group_no, key, first_id, n, first, last).

    Without a ``bucket`` the rows are range-partitioned and runs carried over the borders (``ranks.runs``), so a
    partition key of any size spreads over many tasks.
    """
    if bucket is None:
        return runs(df, order, key, partition, id_col)
    g = consecutive_groups_bucketed(df, order, key, partition, bucket)
    first_col = id_col or order[0]
    return g.groupBy(*partition, "group_no").agg(
        F.min_by(key, F.struct(*order)).alias(key),
        F.min_by(first_col, F.struct(*order)).alias("first_id"),
        F.count(F.lit(1)).alias("n"),
        F.min(order[0]).alias("first"),
        F.max(order[0]).alias("last"),
    )


def dictionary_view(entries: DataFrame, seq: str = "id", key: str = "category",
                    bucket: Column | None = None) -> DataFrame:
    """Q5: consecutive dictionary rows of one category form a group, its id the group's first row id; members keep
    their order and NULL values become ''. A ``bucket`` of the sequence (non-decreasing along it) splits the global
    ordering over many tasks for large dictionaries."""
    g = (consecutive_groups_bucketed(entries, [seq], key, [], bucket) if bucket is not None
         else consecutive_groups(entries, [seq], key))
    member = F.struct(
        F.col(seq).alias("seq"), F.col("label"), F.col("variable").alias("category"), F.col("description"),
        F.coalesce(F.col("values"), F.lit("")).alias("values"),
    )
    return g.groupBy("group_no").agg(
        F.min(seq).alias("id"), F.min_by(key, F.col(seq)).alias("name"),
        F.sort_array(F.collect_list(member)).alias("data"),
    )


def dictionary_pages(entries: DataFrame, size: int, seq: str = "id", key: str = "category") -> DataFrame:
    """Q5 for groups of any length: (group_no, id, name, page, data), each run's members in pages of ``size`` rows.

    A run's place is its first sequence number; members find their run by a join on the range of sequence numbers
    turned into an equality: every member takes the start of the last run that begins at or before it.
    """
    found = runs(entries, [seq], key).select("group_no", F.col("first").alias("id"), F.col(key).alias("name"))
    member = entries.select(
        F.col(seq).alias("seq"), "label", F.col("variable").alias("category"), "description",
        F.coalesce(F.col("values"), F.lit("")).alias("values"))
    placed = last_start(member, "seq", found.select("id"), "id")
    pages = paged(placed, ["id"], ["seq"], size, "data")
    return found.join(pages, "id").select("group_no", "id", "name", "page", "data")
