"""Ranks, runs and pages over sorted rows without a window whose group is one task.

Rows are range-partitioned by (keys, order), sorted inside each partition and written once with their place. What a
partition must know of the ones before it (how many rows of the current key they hold, which run they ended in) is
carried by a table of one row per partition and key that reaches over its border. A key that holds a third of all
rows spreads over as many partitions as its share, and nothing is asked of the caller but the order.

NULL keys are a key of their own and NULL order values come first, as in Spark's sort. Rows equal in all of ``keys`` and
``order`` are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART, PLACE = "__part", "__place"


def laid_out(df: DataFrame, order: list[str], name: str = "sorted") -> DataFrame:
    """``df`` sorted over all its partitions and written once: ``__part`` orders the partitions, ``__place`` all rows."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    frozen = cut_lineage(laid.withColumn(PLACE, F.monotonically_increasing_id()), name)
    return frozen.withColumn(PART, F.shiftright(PLACE, 33))


def _before(parts: DataFrame, keys: list[str], count: str, start: str) -> DataFrame:
    """Per (partition, key): the sum of ``count`` over the same key's earlier partitions.

    ``parts`` has a row per partition and key; a key has at most as many rows as there are partitions.
    """
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(start, F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def _same(a: str, b: str, columns: list[str]) -> Column:
    both = F.lit(True)
    for c in columns:
        both = both & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return both


def grouped_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """0-based gapless rank of every row within its key, in ``order``; without keys, over all rows.

    A row's rank is its place in its partition, less where its key starts there, plus what earlier partitions hold of
    the key.
    """
    rows = laid_out(df, [*keys, *order], "ranked")
    parts = rows.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__least"))
    parts = cut_lineage(parts, "rank-parts")
    if keys:
        # only keys that reach over a border need the sum over partitions; the others start at 0 where they stand
        over = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__parts")).where("__parts > 1").drop("__parts")
        wide = _before(parts.alias("a").join(over.alias("b"), _same("a", "b", keys), "left_semi"), keys, "__n", "__start")
        starts = parts.alias("a").join(
            wide.select(PART, *keys, "__start").alias("b"), _same("a", "b", [PART, *keys]), "left").select(
            "a.*", F.coalesce("b.__start", F.lit(0)).alias("__start"))
    else:
        starts = _before(parts.withColumn("__all", F.lit(0)), ["__all"], "__n", "__start")
    joined = rows.alias("a").join(starts.alias("b"), _same("a", "b", [PART, *keys]))
    rank = F.col(f"a.{PLACE}") - F.col("b.__least") + F.col("b.__start")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], rank.alias(name))


def runs(df: DataFrame, order: list[str], value: str, keys: list[str] | None = None, id_col: str | None = None,
         sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., group_no, value, first_id, n, first, last, sums...): maximal runs of equal ``value`` within each key.

    Every partition cuts its own runs by comparing neighbours; a run that reaches over a border is joined by the table
    of the partitions' first and last runs. ``group_no`` counts a key's runs from 1. ``first`` and ``last`` are the first
    column of ``order`` at a run's ends, ``first_id`` is ``id_col`` (else that column) at its start, and ``sums`` are added
    up over it.
    """
    keys, sums = list(keys or []), dict(sums or {})
    first_col = id_col or order[0]
    narrow = df.select(*dict.fromkeys([*keys, *order, value, first_col]), *[c.alias(name) for name, c in sums.items()])
    rows = laid_out(narrow, [*keys, *order], "runs")
    inside = Window.partitionBy(PART).orderBy(PLACE)
    mark = F.struct(*keys, value)
    begins = F.when(F.row_number().over(inside) == 1, True).otherwise(~F.lag(mark).over(inside).eqNullSafe(mark))
    cut = rows.withColumn("__run", F.sum(begins.cast("long")).over(inside)).groupBy(PART, "__run").agg(
        *[F.any_value(k).alias(k) for k in keys], F.any_value(value).alias(value),
        F.min_by(first_col, PLACE).alias("first_id"), F.count(F.lit(1)).alias("n"),
        F.min_by(order[0], PLACE).alias("first"), F.max_by(order[0], PLACE).alias("last"),
        *[F.sum(c).alias(c) for c in sums])
    cut = cut_lineage(cut, "cut-runs")
    # a partition's last run goes on in the next one's first if key and value agree: the border table has one row a
    # partition, and says for each first run at which run it really began
    ends = cut.groupBy(PART).agg(F.max("__run").alias("__runs"), F.min_by(mark, "__run").alias("__head"),
                                 F.max_by(mark, "__run").alias("__tail"))
    along = Window.orderBy(PART)
    joins = F.lag("__tail").over(along).eqNullSafe(F.col("__head")) & F.lag(PART).over(along).isNotNull()
    ends = ends.withColumn("__joins", joins)
    # the run that a first run belongs to began in the last earlier partition that did not only pass it on
    passes = F.col("__joins") & (F.col("__runs") == 1)
    home = F.last(F.when(~passes, F.struct(PART, "__runs")), ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, -1))
    homes = ends.withColumn("__home", home).where("__joins").select(
        PART, F.lit(1).cast("long").alias("__run"), F.col(f"__home.{PART}").alias("__from"),
        F.col("__home.__runs").alias("__from_run"))
    placed = cut.join(homes, [PART, "__run"], "left").select(
        *cut.columns, F.coalesce("__from", PART).alias("__at"), F.coalesce("__from_run", "__run").alias("__at_run"))
    here = F.struct(PART, "__run")
    whole = placed.groupBy("__at", "__at_run").agg(
        *[F.any_value(k).alias(k) for k in keys], F.any_value(value).alias(value),
        F.min_by("first_id", here).alias("first_id"), F.sum("n").alias("n"),
        F.min_by("first", here).alias("first"), F.max_by("last", here).alias("last"),
        *[F.sum(c).alias(c) for c in sums])
    numbered = grouped_rank(whole, keys, ["__at", "__at_run"], "__rank")
    return numbered.select(*keys, (F.col("__rank") + 1).alias("group_no"), value, "first_id", "n", "first", "last", *sums)


def paged(df: DataFrame, keys: list[str], order: list[str], size: int, into: str = "rows") -> DataFrame:
    """(keys..., page, rows): every key's rows in ``order``, cut into pages of at most ``size``.

    However many rows a key has, no list is longer than a page; pages are numbered from 0.
    """
    ranked = grouped_rank(df, keys, order, "__rank")
    rest = [c for c in df.columns if c not in keys]
    entry = F.struct("__rank", F.struct(*rest).alias("row"))
    pages = ranked.groupBy(*keys, F.floor(F.col("__rank") / size).alias("page")).agg(
        F.sort_array(F.collect_list(entry)).alias("__rows"))
    return pages.select(*keys, "page", F.transform("__rows", lambda e: e["row"]).alias(into))


def last_start(df: DataFrame, at: str, starts: DataFrame, name: str) -> DataFrame:
    """``df`` with the greatest ``starts[name]`` that is not above its ``at`` (NULL if there is none).

    Rows and starts are sorted together over all partitions; inside a partition the last start is a running maximum,
    and what earlier partitions ended with comes from a table of one row a partition.
    """
    both = df.select(F.struct(*df.columns).alias("__row"), F.col(at).alias("__at"), F.lit(None).cast(
        starts.schema[name].dataType).alias(name)).unionByName(starts.select(
            F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType).alias("__row"),
            F.col(name).alias("__at"), F.col(name)))
    both = both.withColumn("__is_row", F.col("__row").isNotNull())
    rows = laid_out(both, ["__at", "__is_row"], "starts")
    inside = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(PART).agg(F.max(name).alias("__most")).select(PART, F.max("__most").over(along).alias("__before"))
    told = rows.select("__row", PART, F.max(name).over(inside).alias("__own")).where("__row is not null")
    return told.join(ends, PART).select("__row.*", F.coalesce("__own", "__before").alias(name))
