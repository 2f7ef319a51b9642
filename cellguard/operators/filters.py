"""Cohort filters on the EAV store: range (P1), existence (P2), value list (P3), parsing (P4), the conjunctive
selection (P5, U1, U2) and the filter export text (P13).

``select_cases`` reads only the variable rows of the filtered items (a pushed-down ``item IN (...)`` predicate;
with the store partitioned by ``item`` that is partition pruning) and answers every filter in one ``groupBy(case)``
with a ``bool_or`` per filter, so k filters cost one shuffle instead of k scans and k-1 intersections. Range
filters join the value rows of their own items only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RangeFilter:
    """``lo~hi`` on the numeric value; an open end is None; both None means 'has any value' (P2)."""

    item: int
    lo: str | None = None
    hi: str | None = None

    @property
    def exists_only(self) -> bool:
        return self.lo is None and self.hi is None


@dataclass(frozen=True)
class ValueFilter:
    """``id_id_id``: the subject's value of the item is one of these value ids."""

    item: int
    values: tuple = field(default_factory=tuple)


def parse_filters(pairs) -> list:
    """(item, text) pairs -> filters; a repeated item keeps its first text only."""
    seen, out = set(), []
    for item, text in pairs:
        item = int(item)
        if item in seen:
            continue
        seen.add(item)
        if "~" in text:
            lo, hi = text.split("~", 1)
            out.append(RangeFilter(item, lo or None, hi or None))
        else:
            out.append(ValueFilter(item, tuple(int(v) for v in text.split("_") if v != "")))
    return out


def _pred(f, i: int) -> Column:
    if isinstance(f, ValueFilter):
        return (F.col("item") == f.item) & F.col("value").isin(list(f.values))
    p = F.col("item") == f.item  # an unresolved value has no number, so it meets no bound
    if f.lo is not None:
        p = p & (F.col("name_numeric") >= F.lit(float(f.lo)))
    if f.hi is not None:
        p = p & (F.col("name_numeric") <= F.lit(float(f.hi)))
    return p


def select_cases(variable: DataFrame, value: DataFrame, filters: list) -> DataFrame:
    """P5: DataFrame[case] of subjects meeting every filter (no filter: every case in the store, D14)."""
    if not filters:
        return variable.select("case").distinct()
    items = sorted({f.item for f in filters})
    v = variable.where(F.col("item").isin(items)).select("case", "item", "value")
    tests = [_pred(f, i) for i, f in enumerate(filters)]
    meets = tests[0]
    for t in tests[1:]:
        meets = meets | t
    ranged = [f for f in filters if isinstance(f, RangeFilter)]
    bounded = [f for f in ranged if not f.exists_only]
    if bounded:
        # ranges become values first: the value table is cut to those a range admits, and only rows that meet some
        # filter reach the exchange on case
        admits = _pred(bounded[0], 0)
        for f in bounded[1:]:
            admits = admits | _pred(f, 0)
        wanted = value.where(admits).select("item", F.col("id").alias("value"), "name_numeric")
        v = v.join(wanted, ["item", "value"], "left")
    else:
        v = v.withColumn("name_numeric", F.lit(None).cast("double"))
    v = v.where(meets)
    flags = [F.bool_or(t).alias(f"f{i}") for i, t in enumerate(tests)]
    g = v.groupBy("case").agg(*flags)
    cond = F.lit(True)
    for i in range(len(filters)):
        cond = cond & F.col(f"f{i}")
    return g.where(cond).select("case")


def cases_for(variable: DataFrame, value: DataFrame, f) -> DataFrame:
    """The distinct cases meeting one filter."""
    v = variable.where(F.col("item") == f.item)
    if isinstance(f, ValueFilter):
        return v.where(F.col("value").isin(list(f.values))).select("case").distinct()
    vals = value.where(F.col("item") == f.item).select("item", F.col("id").alias("value"), "name_numeric")
    if f.exists_only:
        return v.select("case").distinct()
    j = v.join(vals, ["item", "value"])
    if f.lo is not None:
        j = j.where(F.col("name_numeric") >= F.lit(float(f.lo)))
    if f.hi is not None:
        j = j.where(F.col("name_numeric") <= F.lit(float(f.hi)))
    return j.select("case").distinct()


def intersect_cases(variable: DataFrame, value: DataFrame, filters: list) -> DataFrame:
    """The same answer as ``select_cases`` by intersecting per-filter case sets (a chain of semi joins)."""
    if not filters:
        return variable.select("case").distinct()
    out = cases_for(variable, value, filters[0])
    for f in filters[1:]:
        out = out.intersect(cases_for(variable, value, f))
    return out


def export_filters(spark, item: DataFrame, value: DataFrame, filters: list, quote: bool = False) -> DataFrame:
    """One row ``filterstring`` such as ``(price_k >= 100 AND price_k <= 200) AND (priority IN (urgent, high))``.

    The filter list is user input (a handful of rows); it is joined with the item and value tables so names come
    from the store. Value names stay in input order, and unquoted unless ``quote`` asks for SQL texts (decision D22).
    """
    said = F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'")) if quote else F.col("name")
    rows = []
    for pos, f in enumerate(filters):
        if isinstance(f, RangeFilter):
            if f.exists_only:
                continue
            rows.append((pos, f.item, f.lo, f.hi, None))
        else:
            rows.append((pos, f.item, None, None, [int(x) for x in f.values]))
    spec = spark.createDataFrame(rows, "pos int, item int, lo string, hi string, ids array<long>")
    named = spec.join(item.select(F.col("id").alias("item"), "varname"), "item", "left")
    ranges = named.where(F.col("ids").isNull()).select(
        "pos",
        F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(),
               F.format_string("(%s >= %s AND %s <= %s)", "varname", "lo", "varname", "hi"))
        .when(F.col("hi").isNotNull(), F.format_string("(%s <= %s)", "varname", "hi"))
        .otherwise(F.format_string("(%s >= %s)", "varname", "lo"))
        .alias("text"),
    )
    ex = named.where(F.col("ids").isNotNull()).select("pos", "item", "varname", F.posexplode("ids").alias("k", "vid"))
    ex = ex.join(value.select("item", F.col("id").alias("vid"), said.alias("name")), ["item", "vid"], "left")
    lists = ex.groupBy("pos", "varname").agg(
        F.sort_array(F.collect_list(F.struct("k", "name"))).alias("vs"), F.count("vid").alias("n")
    ).select(
        "pos",
        F.when(F.col("n") > 1, F.format_string("(%s IN (%s))", "varname",
                                               F.array_join(F.transform("vs", lambda s: s["name"]), ", ")))
        .otherwise(F.format_string("(%s = %s)", "varname", F.col("vs")[0]["name"]))
        .alias("text"),
    )
    parts = ranges.unionByName(lists)
    return parts.agg(
        F.coalesce(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]),
                         " AND "),
            F.lit(""),
        ).alias("filterstring")
    )
