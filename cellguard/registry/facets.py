"""Registered facet queries: catalogue (A19), one category (Q2), J4 lookups, age axis (A14), facet search (Q4)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.ranges import age_axis
from ..operators.search import search_facets
from ..plans import catalogue as CT
from . import store_sql as Q
from .store import BALANCE, LCFG, PRICE, QTY, SEX, store, vid
from . import sqlparts as S

VALUE_IDS = [vid("priority", "high"), vid("gender", "male"), vid("balance_band", "0-2,500")]
FACET_QUERY = "order  age*"


def catalogue(spark, sf):
    return CT.catalogue(store(spark, sf))


def catalogue_fallback(spark, sf):
    """A store whose item metadata was lost lists its items from the variable table."""
    s = store(spark, sf)
    return CT.catalogue(replace(s, item=s.item.withColumn("is_loaded", F.lit(False))))


def catalogue_nested(spark, sf):
    return CT.catalogue_nested(store(spark, sf)).select(
        "category_id", "category_name", F.size("items").alias("n_items"),
        F.aggregate(F.transform("items", lambda i: F.coalesce(F.size(i["values"]), F.lit(0))), F.lit(0),
                    lambda a, b: a + b).alias("n_values"),
        F.array_join(F.transform("items", lambda i: F.concat_ws(
            ":", i["id"].cast("string"), F.coalesce(F.array_join(F.transform(i["values"], lambda v: v["name"]), "|"),
                                                    F.array_join(i["range"], "~")))), ";").alias("members"),
    )


def one_category(spark, sf):
    return CT.category(store(spark, sf), 3)


def category_of_item(spark, sf):
    return CT.categories_of_items(store(spark, sf), [SEX, PRICE, QTY, BALANCE])


def category_of_value(spark, sf):
    return CT.categories_of_values(store(spark, sf), VALUE_IDS)


def age_axis_inferred(spark, sf):
    return age_axis(store(spark, sf).subjects)


def age_axis_partial(spark, sf):
    return age_axis(store(spark, sf).subjects, age_min=30, age_step=5, age="age_fu")


def facet_search(spark, sf):
    s = store(spark, sf)
    return search_facets(s.category, s.item, FACET_QUERY)


QUERIES = {
    "catalogue": catalogue,
    "catalogue_nested": catalogue_nested,
    "catalogue_fallback": catalogue_fallback,
    "category": one_category,
    "category_of_item": category_of_item,
    "category_of_value": category_of_value,
    "age_axis": age_axis_inferred,
    "age_axis_partial": age_axis_partial,
    "search_facets": facet_search,
}


def _range_text(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN is_float OR floor({x}) != {x} THEN CAST({x} AS VARCHAR) "
            f"ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END)")


CAT_CTES = """
_iv AS (
  SELECT item, id AS vid FROM s_value WHERE listed
    AND item IN (SELECT id FROM s_item WHERE is_loaded AND range_start IS NULL)
  UNION ALL
  SELECT DISTINCT item, value FROM s_variable WHERE item IN (SELECT id FROM s_item WHERE NOT is_loaded)
),
_vals AS (
  SELECT _iv.item, x.id AS value_id, x.name AS value_name, x.description AS value_description,
         CAST(coalesce(x."order", 100) AS INTEGER) AS value_order
  FROM _iv JOIN s_value x ON x.id = _iv.vid AND x.item = _iv.item
),
_it AS (
  SELECT id AS item_id, category AS category_id, name AS item_name, description AS item_description,
    """ + f"""{_range_text('range_start')} AS range_start, {_range_text('range_end')} AS range_end,
    {_range_text('range_step')} AS range_step
  FROM s_item
),
cat_rows AS (
  SELECT c.id AS category_id, c."order" AS category_order, c.name AS category_name,
         c.description AS category_description, t.item_id, t.item_name, t.item_description,
         t.range_start, t.range_end, t.range_step,
         CASE WHEN t.range_start IS NULL THEN v.value_id END AS value_id,
         CASE WHEN t.range_start IS NULL THEN v.value_name END AS value_name,
         CASE WHEN t.range_start IS NULL THEN v.value_description END AS value_description,
         CASE WHEN t.range_start IS NULL THEN v.value_order END AS value_order
  FROM _it t LEFT JOIN _vals v ON v.item = t.item_id JOIN s_category c ON c.id = t.category_id
  WHERE t.range_start IS NOT NULL OR v.value_id IS NOT NULL
)"""

BASE = S.with_(Q.store_ctes(LCFG), CAT_CTES)


def _axis_sql(age: str, amin=None, amax=None, astep=None) -> str:
    step = f"{float(astep)}" if astep else "gap"
    mx = f"{float(amax)}" if amax else f"CASE WHEN vmax != 0 AND ((vmax % {step}) + {step}) % {step} != 0 THEN vmax + {step} - ((vmax % {step}) + {step}) % {step} ELSE vmax END"
    mn = f"{float(amin)}" if amin else f"CASE WHEN vmin != 0 AND ((vmin % {step}) + {step}) % {step} != 0 THEN vmin - ((vmin % {step}) + {step}) % {step} ELSE vmin END"
    return S.with_(Q.store_ctes(LCFG)) + f"""
SELECT CAST(trunc({mn}) AS INTEGER) AS age_min, CAST(trunc({mx}) AS INTEGER) AS age_max,
       CAST(trunc({step}) AS INTEGER) AS age_step
FROM (SELECT min(v) AS vmin, max(v) AS vmax, min(CASE WHEN prev IS NOT NULL AND prev != 0 THEN v - prev END) AS gap
      FROM (SELECT v, lag(v) OVER (ORDER BY v) AS prev
            FROM (SELECT DISTINCT CAST({age} AS DOUBLE) AS v FROM s_subjects WHERE {age} IS NOT NULL)))"""


def _facet_search_sql() -> str:
    terms = [t.lower() for t in FACET_QUERY.replace("*", "").split()]

    def sc(cols):
        return " + ".join(f"(CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN 1 ELSE 0 END)"
                          for c in cols for t in terms)

    return S.with_(Q.store_ctes(LCFG)) + f"""
SELECT * FROM (
  SELECT 0 AS seq_type, 'category' AS type, CAST(id AS BIGINT) AS id, name, description,
         CAST(id AS BIGINT) AS categoryId, CAST(NULL AS BIGINT) AS itemId, {sc(['name', 'description'])} AS score
  FROM s_category
  UNION ALL
  SELECT 1, 'item', CAST(id AS BIGINT), name, description, CAST(category AS BIGINT), CAST(id AS BIGINT),
         {sc(['name', 'description'])}
  FROM s_item
) WHERE score > 0"""


SQL = {
    "catalogue": BASE + "\nSELECT * FROM cat_rows",
    "catalogue_fallback": BASE + "\nSELECT * FROM cat_rows",
    "catalogue_nested": BASE + """
SELECT category_id, category_name, CAST(count(*) AS INTEGER) AS n_items, CAST(sum(nv) AS INTEGER) AS n_values,
       string_agg(item_id || ':' || listed, ';' ORDER BY item_id) AS members
FROM (SELECT category_id, category_name, item_id, count(value_id) AS nv,
             coalesce(string_agg(value_name, '|' ORDER BY value_order, value_name),
                      min(range_start || '~' || range_end || '~' || range_step)) AS listed
      FROM cat_rows GROUP BY category_id, category_name, item_id) GROUP BY category_id, category_name""",
    "category": BASE + "\nSELECT * FROM cat_rows WHERE category_id = 3",
    "category_of_item": S.with_(Q.store_ctes(LCFG))
    + f"\nSELECT id AS item_id, category AS category_id FROM s_item WHERE id IN ({SEX}, {PRICE}, {QTY}, {BALANCE})",
    "category_of_value": S.with_(Q.store_ctes(LCFG)) + f"""
SELECT u.value_id, u.item_id, i.category AS category_id
FROM (SELECT DISTINCT value AS value_id, item AS item_id FROM s_variable
      WHERE value IN ({', '.join(str(v) for v in VALUE_IDS)})) u JOIN s_item i ON i.id = u.item_id""",
    "age_axis": _axis_sql("age_bl"),
    "age_axis_partial": _axis_sql("age_fu", amin=30, astep=5),
    "search_facets": _facet_search_sql(),
}
