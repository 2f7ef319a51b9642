"""Q2 facet catalogue (A19), one category, and the category of an item or value.

``catalogue`` is long-form: one row per (category, item, value) or per ranged item, so no row holds an unbounded
list; ``catalogue_nested`` builds the nested shape from it for items whose value list was precomputed at load
(bounded by the loader's list limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.load import Store

DEFAULT_ORDER = 100  # fixed value: sort position of values without an order


def range_text(x: Column, is_float: Column) -> Column:
    """Range ends as the reference prints them: float text for float ranges, integer text otherwise."""
    whole = F.floor(x).cast("double") == x
    return F.when(is_float | ~whole, x.cast("string")).otherwise(x.cast("long").cast("string"))


def item_values(store: Store) -> DataFrame:
    """J8 + J9: (item, value id, name, description, order) for items listed by value.

    Loaded items without a range read their listed values (J8), as rows, however many; items without metadata fall
    back to the distinct values the variable table uses (J9), read only for those items.
    """
    it = store.item
    listing = it.where(F.col("is_loaded") & F.col("range_start").isNull()).select(F.col("id").alias("item"))
    listed = store.value.where("listed").join(listing, "item", "left_semi").select("item", F.col("id").alias("vid"))
    fallback_items = it.where(~F.col("is_loaded") & F.col("range_start").isNull()).select(F.col("id").alias("item"))
    # a row an item at most: broadcast, so that the variable table is never shuffled for it
    used = store.variable.join(F.broadcast(fallback_items), "item", "left_semi").select(
        "item", F.col("value").alias("vid")
    ).distinct()
    ids = listed.unionByName(used)
    v = store.value.select("item", F.col("id").alias("vid"), "name", "description", "order")
    return ids.join(v, ["item", "vid"]).select(
        "item", F.col("vid").alias("value_id"), F.col("name").alias("value_name"),
        F.col("description").alias("value_description"),
        F.coalesce(F.col("order"), F.lit(DEFAULT_ORDER)).cast("int").alias("value_order"),
    )


def catalogue(store: Store) -> DataFrame:
    """A19 long form: (category_id, category_order, category_name, category_description, item_id, item_name,
    item_description, range_start, range_end, range_step, value_id, value_name, value_description, value_order)."""
    cat = store.category.select(
        F.col("id").alias("category_id"), F.col("order").alias("category_order"),
        F.col("name").alias("category_name"), F.col("description").alias("category_description"),
    )
    it = store.item.select(
        F.col("id").alias("item_id"), F.col("category").alias("category_id"), F.col("name").alias("item_name"),
        F.col("description").alias("item_description"), "is_loaded",
        F.when(F.col("range_start").isNotNull(), range_text(F.col("range_start"), F.col("is_float")))
        .alias("range_start"),
        F.when(F.col("range_end").isNotNull(), range_text(F.col("range_end"), F.col("is_float"))).alias("range_end"),
        F.when(F.col("range_step").isNotNull(), range_text(F.col("range_step"), F.col("is_float")))
        .alias("range_step"),
    )
    vals = item_values(store).withColumnRenamed("item", "item_id")
    ranged = F.col("range_start").isNotNull()
    rows = it.join(vals, "item_id", "left").where(ranged | F.col("value_id").isNotNull())
    return cat.join(rows, "category_id").select(
        "category_id", "category_order", "category_name", "category_description", "item_id", "item_name",
        "item_description", "range_start", "range_end", "range_step",
        F.when(~ranged, F.col("value_id")).alias("value_id"), F.when(~ranged, F.col("value_name")).alias("value_name"),
        F.when(~ranged, F.col("value_description")).alias("value_description"),
        F.when(~ranged, F.col("value_order")).alias("value_order"),
    )


def catalogue_nested(store: Store) -> DataFrame:
    """A19 nested: one row per category with its items, each with a sorted value list or a range triple (L1, L2)."""
    rows = catalogue(store)
    val = F.struct(F.col("value_order").alias("order"), F.col("value_name").alias("name"),
                   F.col("value_id").alias("id"), F.col("value_description").alias("description"))
    per_item = rows.groupBy(
        "category_id", "category_order", "category_name", "category_description", "item_id", "item_name",
        "item_description", "range_start", "range_end", "range_step",
    ).agg(F.sort_array(F.collect_list(F.when(F.col("value_id").isNotNull(), val))).alias("values"))
    item = F.struct(
        F.col("item_id").alias("id"), F.col("item_name").alias("name"), F.col("item_description").alias("description"),
        F.when(F.col("range_start").isNull(), F.col("values")).alias("values"),
        F.when(F.col("range_start").isNotNull(), F.array("range_start", "range_end", "range_step")).alias("range"),
    )
    return per_item.groupBy("category_id", "category_order", "category_name", "category_description").agg(
        F.sort_array(F.collect_list(item)).alias("items")
    ).orderBy("category_order")


def category(store: Store, category_id: int) -> DataFrame:
    """Q2: the catalogue rows of one category."""
    return catalogue(store).where(F.col("category_id") == category_id)


def categories_of_items(store: Store, item_ids: list[int]) -> DataFrame:
    """Item id -> its category id."""
    return store.item.where(F.col("id").isin(item_ids)).select(
        F.col("id").alias("item_id"), F.col("category").alias("category_id")
    )


def categories_of_values(store: Store, value_ids: list[int]) -> DataFrame:
    """Value id -> the item a subject holds it under -> that item's category."""
    # the value table names each value's item: joining on (item, value) lets the variable scan prune its item
    # partitions at run time instead of reading every partition for a value filter
    vals = store.value.where(F.col("id").isin(value_ids)).select(F.col("id").alias("value_id"),
                                                                  F.col("item").alias("item_id"))
    v = store.variable.where(F.col("value").isin(value_ids))
    used = v.join(F.broadcast(vals), (v.item == vals.item_id) & (v.value == vals.value_id), "left_semi").select(
        F.col("value").alias("value_id"), F.col("item").alias("item_id")
    ).distinct()
    return used.join(store.item.select(F.col("id").alias("item_id"), F.col("category").alias("category_id")),
                     "item_id")
