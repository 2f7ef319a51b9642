"""Registered queries over files written from the given tables: dictionary scan (S2), checksums (S6, L3), store versions
(S7), JSON rows (S9), field tests (F24), letter codes (F15), range inference over plain columns (A13)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.codes import base36
from ..operators.ranges import infer_ranges
from ..session import ensure_checkpoint_dir
from ..sources.files import (
    file_checksums, latest_checksum, line_not_empty, nested_rows, scan_dictionary, scan_sheet_folder, to_json_rows,
    write_rows_csv,
)
from ..sources.lifecycle import append_cases, create_store, read_version, replace_item
from ..sources.testdata import table
from . import sqlparts as S
from . import store_sql as Q
from .store import BALANCE, LCFG, PRICE, SQL as TABLE_SQL, store


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dictionary_file(spark, sf):
    """The part table as a dictionary file with headers that only contain the field words; long texts stay whole."""
    path = _folder(spark, "dictionary")
    table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Variable Name"), F.col("p_name").alias("Label"),
        F.repeat("p_name", 40).alias("Long Description"), F.col("p_brand").alias("Values"),
        F.col("p_type").alias("Domain of it"),
    ).write.option("header", True).csv(path)
    return scan_dictionary(spark, path).select("name", "label", "description", "values", "domain", "priority")


LINES_A_FILE = 4096


def checksum(spark, sf):
    """The checksums of files written from lineitem, each order's lines in the file of its block of orders."""
    path = _folder(spark, "lines")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    block = F.floor(F.col("l_orderkey") / LINES_A_FILE)
    (table(spark, sf, "lineitem").select(block.alias("block"), "l_orderkey", "l_linenumber", "l_partkey", line.alias("value"))
     .repartition("block").sortWithinPartitions("block", "l_orderkey", "l_linenumber", "l_partkey")
     .select("block", "value").write.partitionBy("block").text(path))
    found = file_checksums(spark, f"{path}/block=*/part-*")
    return found.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("long").alias("block"), "length", "md5")


def newest_checksum(spark, sf):
    """L3: the checksum of the last of those files, by name."""
    made = checksum(spark, sf).select(F.col("block").alias("modificationTime"), F.col("block").alias("path"), "md5")
    return latest_checksum(made)


def _read_back(name: str):
    """The store written as a version and read back, one of its five tables."""
    def run(spark, sf):
        path = _folder(spark, "store")
        create_store(store(spark, sf), path)
        back = getattr(read_version(spark, path), name)
        return back.select("case", F.col("item").cast("int").alias("item"), "value") if name == "variable" else back

    return run


def _halves(spark, sf):
    """The store's cases dealt over two stores by their number."""
    s = store(spark, sf)
    odd = F.col("case").cast("long") % 2 == 1
    return [replace(s, variable=s.variable.where(t), subjects=s.subjects.where(t)) for t in (odd, ~odd)]


def store_appended(spark, sf):
    """Half the cases written, the others appended; the subjects of both."""
    path = _folder(spark, "store")
    first, second = _halves(spark, sf)
    create_store(first, path)
    append_cases(second, path)
    return read_version(spark, path).subjects


def store_item_replaced(spark, sf):
    """One item's rows replaced by those of the odd cases, another item deleted; the variable table."""
    path = _folder(spark, "store")
    s = store(spark, sf)
    create_store(s, path)
    replace_item(path, PRICE, s.variable.where((F.col("item") == PRICE) & (F.col("case").cast("long") % 2 == 1)))
    replace_item(path, BALANCE, None)
    return read_version(spark, path).variable


def json_rows(spark, sf):
    """Suppliers as JSON, NULL fields included."""
    s = table(spark, sf, "supplier")
    return to_json_rows(s.select("s_suppkey", "s_name", F.expr("nullif(s_nationkey % 3, 0)").alias("third")))


HEADERS = ["c_custkey,c_name,", "number,name,balance", "c_custkey,c_name,"]


def sheet_files(spark, sf):
    """S3: one file a market segment with three header rows, and a data row that reads like a header."""
    path = _folder(spark, "sheets")
    c = table(spark, sf, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
    rows = c.select("c_mktsegment", F.col("c_custkey").alias("at"), line.alias("value"))
    few = c.select("c_mktsegment").distinct()
    head = few.select("c_mktsegment", F.posexplode(F.array(*map(F.lit, HEADERS)))).select(
        "c_mktsegment", (F.col("pos") - 9).alias("at"), F.col("col").alias("value"))
    again = few.select("c_mktsegment", F.lit(1 << 40).alias("at"), F.lit(HEADERS[0]).alias("value"))
    (rows.unionByName(head).unionByName(again).repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "at")
     .select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path))
    return scan_sheet_folder(spark, f"{path}/*/part-*", header_rows=3, keep=["C_NAME", 0, "balance"],
                             sheet_name="c_mktsegment=([^/]+)/").select(
        F.col("C_NAME").alias("name"), F.col("c_custkey").alias("number"), "balance", F.col("SheetName").alias("sheet"))


def nested_csv(spark, sf):
    """Customers by nation as lists of structs, written as rows and read back."""
    path = _folder(spark, "nested")
    c = table(spark, sf, "customer")
    lists = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("block")).agg(F.collect_list(F.struct(
        F.col("c_custkey").alias("number"), F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("who"))).alias("cells"))
    write_rows_csv(nested_rows(lists, "block", "cells"), path, join_multiline=" / ")
    return spark.read.option("header", True).csv(path)


def json_options(spark, sf):
    """A map cell's named entries as columns."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("cells"))
    return nested_rows(e, "event_id", "cells", ["k", "absent"])


def not_empty_rows(spark, sf):
    """customers whose segment, with one segment blanked and one removed, is still a text."""
    c = table(spark, sf, "customer").select("c_custkey", F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END").alias("segment"))
    return line_not_empty(c, "segment")


def letter_codes(spark, sf):
    """the first letter of each part name as a base-36 number."""
    return table(spark, sf, "part").select("p_partkey", base36(F.lower(F.substring("p_name", 1, 1))).alias("code"))


RANGED = {  # table and numeric expression of each item: unit, tenth, small, large and negative steps
    1: ("lineitem", "l_quantity"), 2: ("lineitem", "l_discount"), 3: ("lineitem", "round(l_discount * 10, 1)"),
    4: ("part", "CAST(p_size AS DOUBLE)"), 5: ("customer", "floor(c_acctbal)"),
    6: ("orders", "floor(o_totalprice / 100) * 100.0"), 7: ("lineitem", "floor(l_quantity / 4) / 2.0"),
    8: ("supplier", "CAST(s_nationkey AS DOUBLE)"), 9: ("lineitem", "floor(l_quantity) / 10.0"),
    10: ("customer", "round(c_acctbal, 1)"),
}


def ranges_of_columns(spark, sf):
    """A13 over numeric columns of the given tables."""
    rows = None
    for item, (name, expr) in RANGED.items():
        part = table(spark, sf, name).select(F.lit(item).alias("item"), F.expr(expr).cast("double").alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return infer_ranges(rows)


QUERIES = {
    "dictionary_file": dictionary_file,
    "file_checksum": checksum,
    "latest_checksum": newest_checksum,
    "store_round_trip": _read_back("variable"),
    "store_round_trip_values": _read_back("value"),
    "store_round_trip_items": _read_back("item"),
    "store_round_trip_categories": _read_back("category"),
    "store_round_trip_subjects": _read_back("subjects"),
    "store_appended": store_appended,
    "store_item_replaced": store_item_replaced,
    "json_rows": json_rows,
    "sheet_files": sheet_files,
    "nested_csv": nested_csv,
    "nested_map": json_options,
    "not_empty_rows": not_empty_rows,
    "letter_codes": letter_codes,
    "infer_ranges": ranges_of_columns,
}

_NORM = "\nUNION ALL ".join(
    f"SELECT {item} AS item_id, CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS name, false AS categorical FROM {name}"
    for item, (name, expr) in RANGED.items())

_CHECKSUMS = f"""SELECT l_orderkey // {LINES_A_FILE} AS block, CAST(sum(length(line) + 1) AS BIGINT) AS length,
  md5(string_agg(line || chr(10), '' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS md5
FROM (SELECT *, concat_ws(',', l_orderkey, l_linenumber, l_partkey) AS line FROM lineitem) GROUP BY 1"""

SQL = {
    "dictionary_file": """SELECT lower('P' || p_partkey) AS name, p_name AS label, repeat(p_name, 40) AS description,
  p_brand AS "values", p_type AS domain, 0 AS priority FROM part""",
    "file_checksum": f"SELECT * FROM ({_CHECKSUMS})",
    "latest_checksum": f"SELECT 'md5' AS type, arg_max(md5, block) AS value FROM ({_CHECKSUMS})",
    "store_round_trip": S.with_(Q.store_ctes(LCFG)) + "\nSELECT * FROM s_variable",
    "store_round_trip_values": TABLE_SQL["load_values"],
    "store_round_trip_items": TABLE_SQL["load_items"],
    "store_round_trip_categories": TABLE_SQL["load_categories"],
    "store_round_trip_subjects": TABLE_SQL["load_subjects"],
    "store_appended": TABLE_SQL["load_subjects"],
    "store_item_replaced": S.with_(Q.store_ctes(LCFG)) + f"""
SELECT * FROM s_variable WHERE item <> {BALANCE} AND (item <> {PRICE} OR CAST("case" AS BIGINT) % 2 = 1)""",
    "json_rows": """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","third":'
  || coalesce(CAST(nullif(s_nationkey % 3, 0) AS VARCHAR), 'null') || '}' AS value FROM supplier""",
    "sheet_files": """SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS number, CAST(c_acctbal AS VARCHAR) AS balance,
  c_mktsegment AS sheet FROM customer
UNION ALL SELECT 'c_name', 'c_custkey', NULL, c_mktsegment FROM customer GROUP BY c_mktsegment""",
    "nested_csv": """SELECT CAST(c_custkey // 100 AS VARCHAR) AS block, CAST(c_custkey AS VARCHAR) AS number,
  c_name || ' / ' || c_mktsegment AS who FROM customer""",
    "nested_map": """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events""",
    "not_empty_rows": """SELECT c_custkey, c_mktsegment AS segment FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
    "letter_codes": """SELECT p_partkey, CAST(ascii(lower(p_name[1])) - 87 AS BIGINT) AS code FROM part""",
    "infer_ranges": f"""WITH norm AS ({_NORM}),
{Q.ranges_ctes()}
SELECT item_id AS item, start, "end", step, is_float FROM _irange""",
}
