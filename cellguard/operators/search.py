"""Q4 substring search with relevance ordering (L4), over the facet tables or any text table.

A row matches when any term occurs (case-insensitive substring) in any searched field; its score is the number of
(term, field) pairs that occur (decision D17). Matching is a per-row expression, so the scan is fully parallel;
ordering is a distributed sort, and a result limit is a top-k (``TakeOrderedAndProject``), never a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..session import cut_lineage


def score(fields: list[str], terms: list[str]) -> Column:
    """Number of (term, field) pairs where the term occurs in the lower-cased field."""
    total = F.lit(0)
    for f in fields:
        low = F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))
        for t in terms:
            total = total + F.when(low.contains(t.lower()), F.lit(1)).otherwise(F.lit(0))
    return total


def _lowered(df: DataFrame, fields: list[str]) -> tuple[DataFrame, list[str]]:
    """Each searched field lower-cased once, as its own column (a long text is not lowered once per term)."""
    names = [f"__low{i}" for i in range(len(fields))]
    return df.select("*", *[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(n)
                            for f, n in zip(fields, names)]), names


def search(
    df: DataFrame,
    id_col: str,
    fields: list[str],
    query: str,
    limit: int | None = None,
    order_by_relevance: int = -1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` matching ``query``: (id_col, keep..., score).

    ``order_by_relevance`` < 0 sorts every hit by (score desc, id); > 0 ranks only the best N that way and puts
    the rest after them by id; 0 leaves hits unordered. ``limit`` keeps the best ``limit`` hits.
    """
    terms = search_terms(query)
    keep = [c for c in (keep if keep is not None else fields) if c != id_col]
    low, names = _lowered(df.select(id_col, *sorted(set(keep) | set(fields))), fields)
    hits = low.select(id_col, *keep, score(names, terms).alias("score")).where(F.col("score") > 0)
    by_rel = [F.col("score").desc(), F.col(id_col).asc()]
    if limit is not None:
        return hits.orderBy(*by_rel).limit(limit)
    if order_by_relevance != 0:
        # sorting reads its input twice (a sample for the ranges first): the texts are scanned once, for the hits
        hits = cut_lineage(hits, "hits")
    if order_by_relevance < 0:
        return hits.orderBy(*by_rel)
    if order_by_relevance > 0:
        # the N-th best (score, id) as scalar subqueries, then one sort key for "top N first"
        nth = hits.orderBy(*by_rel).limit(order_by_relevance).select(
            F.col("score").alias("t_score"), F.col(id_col).alias("t_id")
        ).orderBy(F.col("t_score").asc(), F.col("t_id").desc()).limit(1)
        t_score = nth.select("t_score").scalar()
        t_id = nth.select("t_id").scalar()
        in_top = (F.col("score") > t_score) | ((F.col("score") == t_score) & (F.col(id_col) <= t_id))
        return (
            hits.withColumn("top", F.coalesce(in_top, F.lit(False)))
            .orderBy(F.col("top").desc(), F.when(F.col("top"), -F.col("score")), F.col(id_col))
            .drop("top")
        )
    return hits


def search_facets(category: DataFrame, item: DataFrame, query: str) -> DataFrame:
    """Q4 over the catalogue: categories first, then items, each by relevance.

    Returns (seq_type, type, id, name, description, categoryId, itemId, score); ``seq_type`` is 0 for categories.
    """
    terms = search_terms(query)
    fields = ["name", "description"]
    cats = category.select(
        F.lit(0).alias("seq_type"), F.lit("category").alias("type"), F.col("id").cast("long").alias("id"), "name",
        "description", F.col("id").cast("long").alias("categoryId"), F.lit(None).cast("long").alias("itemId"),
        score(fields, terms).alias("score"),
    )
    items = item.select(
        F.lit(1).alias("seq_type"), F.lit("item").alias("type"), F.col("id").cast("long").alias("id"), "name",
        "description", F.col("category").cast("long").alias("categoryId"), F.col("id").cast("long").alias("itemId"),
        score(fields, terms).alias("score"),
    )
    return (
        cats.unionByName(items)
        .where(F.col("score") > 0)
        .orderBy("seq_type", F.col("score").desc(), "id")
    )
