"""Sources and sinks: cohort CSV (S1), dictionary CSV (S2), sheet stacking (S3), sectioned text (S4, P14), file
checksums (S6, L3), store and result sinks (S7, S8, S9)."""

from __future__ import annotations

import csv
import io
import itertools
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import clean_text, not_empty
from ..operators.rows import with_row_index

STORE_TABLES = ("variable", "value", "item", "category", "subjects")
SLICES = 8  # tasks that share the writing of one item
DICTIONARY_FIELDS = ["name", "label", "domain", "description", "priority", "values"]


def scan_cohort(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One subject per row, every column text, names lower-cased; optional column subset."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    if columns:
        df = df.select(*[c.lower() for c in columns])
    return df


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary CSV -> (seq, name, label, description, values, domain, priority).

    A header *containing* one of the field words maps to that field (first match wins); name, label, domain and
    description are required; priority defaults to 0. Descriptions are kept whole (``truncate_description`` is for
    display).
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found: dict[str, str] = {}
    for col in raw.columns:
        for field in DICTIONARY_FIELDS:
            if field not in found and field in col.lower():
                found[field] = col
    for req in ("name", "label", "domain", "description"):
        if req not in found:
            raise ValueError(f"Column {req} is required.")
    seq = with_row_index(raw, "seq")

    def get(field, default=None):
        return F.col(f"`{found[field]}`") if field in found else F.lit(default)

    return seq.select(
        "seq",
        clean_text(F.lower(get("name"))).alias("name"),
        clean_text(get("label")).alias("label"),
        clean_text(get("description")).alias("description"),
        F.coalesce(get("values"), F.lit("")).alias("values"),
        get("domain").alias("domain"),
        F.coalesce(get("priority", 0).cast("int"), F.lit(0)).alias("priority"),
    )


def _picks(columns: list[str], keep: list | None, ignore: list | None, ignore_case: bool) -> list[Column]:
    """The kept columns: ``keep`` in its order (named as it names them), else all but ``ignore``; both list names or
    0-based positions, which may also come as text."""
    fold = str.lower if ignore_case else str

    def at(spec) -> int | None:
        named = [i for i, c in enumerate(columns) if fold(c) == fold(str(spec))]
        if named:
            return named[0]
        return int(spec) if str(spec).isdigit() and int(spec) < len(columns) else None

    if keep:
        found = [(at(s), s) for s in keep]
        return [F.col(f"`{columns[i]}`").alias(columns[i] if str(s).isdigit() else s) for i, s in found if i is not None]
    gone = {at(s) for s in ignore or []}
    return [F.col(f"`{c}`") for i, c in enumerate(columns) if i not in gone]


def sheet_rows(df: DataFrame, keep: list | None = None, ignore: list | None = None, sheet: Column | None = None,
               sheet_col: str | None = "SheetName", drop_empty: bool = False, ignore_case: bool = True) -> DataFrame:
    """S3 for rows that carry their sheet's name (an expression, e.g. the input file): one pass for all sheets."""
    picks = _picks(df.columns, keep, ignore, ignore_case)
    if drop_empty:
        filled = [F.length(F.trim(p.cast("string"))) > 0 for p in picks]
        df = df.where(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in filled]))
    return df.select(*picks, *([sheet.alias(sheet_col)] if sheet_col and sheet is not None else []))


def stack_sheets(sheets: dict[str, DataFrame], keep: list | None = None, ignore: list | None = None,
                 sheet_col: str | None = "SheetName", drop_empty: bool = False, ignore_case: bool = True) -> DataFrame:
    """S3: union of per-sheet tables with the sheet name as a column. Sheets lacking a column get NULL there."""
    parts = [sheet_rows(df, keep, ignore, F.lit(name), sheet_col, drop_empty, ignore_case)
             for name, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


FILE_STEM = r"([^/]+?)([.][^./]*)?$"


def scan_sheet_folder(spark: SparkSession, path: str, header_rows: int = 1, keep: list | None = None,
                      ignore: list | None = None, sheet_col: str | None = "SheetName", drop_empty: bool = False,
                      ignore_case: bool = True, sheet_name: str = FILE_STEM) -> DataFrame:
    """S3 over a folder of CSV sheets: each file is a sheet, named by ``sheet_name`` in its path.

    The first ``header_rows`` rows of a file, by position, are headers: a column goes by its name in any of them (the
    last one that tells) or by its 0-based position. Files may have different headers; a sheet that lacks a column has
    NULL there. ``keep`` gives the columns and their order, else all but ``ignore`` come in order of appearance. A file
    is read by one task, as its rows only have a position within it; its rows leave the task in batches.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fold = str.lower if ignore_case else str

    def rows(content: bytes):
        return csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))

    def places(headers: list[list[str]]) -> dict[int, str]:
        """Position -> the column's name in the result."""
        found: dict[int, str] = {}
        wanted = {fold(str(k)): str(k) for k in keep or []}
        gone = {fold(str(k)) for k in ignore or []}
        for row in headers:
            for j, name in enumerate(row):
                if keep and (fold(name) in wanted or str(j) in wanted):
                    found[j] = wanted.get(fold(name)) or found.get(j) or name
                elif not keep and name and fold(name) not in gone and str(j) not in gone:
                    found[j] = name
        return {j: name for j, name in found.items() if name}

    def headers(frames):
        for frame in frames:
            for file, content in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                named = places(list(itertools.islice(rows(content), header_rows)))
                yield pa.RecordBatch.from_pylist([{"path": file, "at": j, "name": n} for j, n in named.items()], pa.schema(
                    [("path", pa.string()), ("at", pa.int64()), ("name", pa.string())]))

    def body(frames):
        kind = pa.schema([("path", pa.string()), ("cells", pa.map_(pa.string(), pa.string()))])
        for frame in frames:
            for file, content in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                left = rows(content)
                named = places(list(itertools.islice(left, header_rows)))
                while found := list(itertools.islice(left, 4096)):
                    cells = [{"path": file, "cells": [(fold(n), row[j] or None) for j, n in named.items() if j < len(row)]}
                             for row in found if row]
                    yield pa.RecordBatch.from_pylist(cells, kind)

    said = files.mapInArrow(headers, "path string, at long, name string")
    first = said.groupBy(F.lower("name") if ignore_case else F.col("name")).agg(
        F.min(F.struct("path", "at", "name")).alias("f"))
    seen = {fold(r["f"]["name"]): r["f"]["name"] for r in sorted(first.collect(), key=lambda r: r["f"][:2])}  # the columns
    if keep:
        seen = {fold(str(k)): str(k) for k in keep if fold(str(k)) in seen} | {
            k: v for k, v in seen.items() if k not in {fold(str(x)) for x in keep}}
    cells = files.mapInArrow(body, "path string, cells map<string,string>")
    picks = [F.col("cells")[k].alias(name) for k, name in seen.items()]
    if drop_empty and seen:
        filled = [F.length(F.trim(F.col("cells")[k])) > 0 for k in seen]
        cells = cells.where(reduce(lambda x, y: x | y, [F.coalesce(f, F.lit(False)) for f in filled]))
    name = [F.regexp_extract("path", sheet_name, 1).alias(sheet_col)] if sheet_col else []
    return cells.select(*picks, *name)


def parse_sections(lines: DataFrame, n_fields: int, names: list[str], sep: str = "==") -> DataFrame:
    """S4 core: (line, value) text lines -> the first ``n_fields`` fields plus the remainder re-joined with ``sep``.

    Blank lines and lines starting with '#' are skipped (after trimming); the line number is kept.
    """
    v = F.trim(F.col("value"))
    kept = lines.where((F.length(v) > 0) & ~v.startswith("#")).select("line", v.alias("value"))
    parts = F.split(F.col("value"), sep.replace("|", "\\|"), n_fields + 1)
    out = [F.col("line")]
    for i, nm in enumerate(names[:n_fields]):
        out.append(F.element_at(parts, i + 1).alias(nm))
    out.append(clean_text(F.coalesce(F.element_at(parts, n_fields + 1), F.lit(""))).alias(names[n_fields]))
    return kept.select(*out)


def scan_sections(spark: SparkSession, path: str, kind: str = "tabs") -> DataFrame:
    """``TAB==ORDER==STYLE==TEXT`` (tabs) or ``LOCATION==LINE==TEXT`` (comments) files."""
    lines = with_row_index(spark.read.text(path), "line")
    if kind == "tabs":
        p = parse_sections(lines, 3, ["header", "order", "text_type", "text"])
        return p.select(clean_text(F.col("header")).alias("header"), "line", "text_type", "text",
                        F.col("order").cast("int").alias("order"))
    p = parse_sections(lines, 2, ["location", "line_no", "comment"])
    return p.select("location", F.col("line_no").cast("int").alias("line"), "comment")


def comments_for(comments: DataFrame, location: str) -> DataFrame:
    """The comment lines of one location, ordered by line."""
    return comments.where(F.col("location") == location).orderBy("location", "line")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, md5) of every file under ``path``; the bytes never reach the driver."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "modificationTime", "length", F.md5("content").alias("md5")
    )


def latest_checksum(files: DataFrame, order_col: str = "modificationTime") -> DataFrame:
    """L3: the md5 of the most recent file, or 'Unavailable' when there is none (one row: type, value)."""
    latest = files.agg(F.max_by("md5", F.struct(order_col, "path")).alias("md5"))
    return latest.select(F.lit("md5").alias("type"), F.coalesce(F.col("md5"), F.lit("Unavailable")).alias("value"))


def write_store(store, path: str, mode: str = "overwrite") -> None:
    """Every store table as parquet; the variable table partitioned by item (a filter on an item prunes).

    The variable rows are dealt by item and a slice of the cases first, so an item is written by ``SLICES`` tasks at
    most: few files each, and no task holds a whole item.
    """
    for name, df in store.tables().items():
        if name == "variable":
            df = df.repartition("item", F.pmod(F.xxhash64("case"), F.lit(SLICES)))
            df.write.mode(mode).partitionBy("item").parquet(f"{path}/{name}")
        else:
            df.write.mode(mode).parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str):
    from ..plans.load import Store

    return Store(**{n: spark.read.parquet(f"{path}/{n}") for n in STORE_TABLES})


def save_store_tables(store, prefix: str, buckets: int, mode: str = "overwrite") -> None:
    """S7 as catalog tables with the subject-level tables bucketed by case.

    ``variable`` (partitioned by item) and ``subjects`` share ``buckets`` buckets on ``case``: the filter's
    ``groupBy(case)`` and the chart's join of subjects with the selected cases then need no exchange.
    """
    for name, df in store.tables().items():
        bucket = F.pmod(F.hash("case"), F.lit(buckets)) if name in ("variable", "subjects") else None
        if name == "variable":  # one file per item and bucket
            w = df.repartition("item", bucket).write.partitionBy("item").bucketBy(buckets, "case")
        elif name == "subjects":
            w = df.repartition(buckets, bucket).write.bucketBy(buckets, "case")
        else:
            w = df.write
        w.mode(mode).format("parquet").saveAsTable(f"{prefix}_{name}")


def drop_store_tables(spark: SparkSession, prefix: str) -> None:
    """S7 lifecycle: drop the store's tables (those that exist)."""
    for name in STORE_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def read_store_tables(spark: SparkSession, prefix: str):
    from ..plans.load import Store

    return Store(**{n: spark.table(f"{prefix}_{n}") for n in STORE_TABLES})


def write_rows_csv(df: DataFrame, path: str, cols: list[str] | None = None, join_multiline: str | None = None,
                   mode: str = "overwrite") -> None:
    """CSV with header in the given column order; newlines replaced by ``join_multiline``, NULL written ''."""
    out = df.select(*(cols or df.columns))
    if join_multiline is not None:
        out = out.select(*[F.coalesce(F.regexp_replace(F.col(c).cast("string"), "\n", join_multiline), F.lit(""))
                           .alias(c) for c in out.columns])
    out.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def nested_rows(df: DataFrame, key: str, value: str, order: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Rows of a table whose ``value`` holds a map, a struct, or a list, ready for ``write_rows_csv``.

    A map gives a row: the key and the entries named by ``order``; a struct its fields (or those of ``order``). A list
    gives a row an element: the key and the element, or the fields of a struct element, or the first ``width`` cells
    of a list element. An empty list gives none.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, ArrayType):
        df = df.select(key, F.explode(value).alias("__cell"))
        kind = kind.elementType
    else:
        df = df.select(key, F.col(value).alias("__cell"))
    cell = F.col("__cell")
    if isinstance(kind, MapType):
        if not order:
            raise ValueError("a map's columns need an order")
        return df.select(key, *[F.element_at(cell, F.lit(c)).alias(c) for c in order])
    if isinstance(kind, StructType):
        return df.select(key, *[cell[c].alias(c) for c in order or kind.fieldNames()])
    if isinstance(kind, ArrayType):
        if not width:
            raise ValueError("lists in a list need a width")
        return df.select(key, *[F.get(cell, i).alias(f"c{i + 1}") for i in range(width)])
    return df.select(key, cell.alias(value))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text (``value``)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def line_not_empty(df: DataFrame, col: str) -> DataFrame:
    """F24 as a filter."""
    return df.where(not_empty(F.col(col)))


def ingest_dictionary(stacked: DataFrame, label: str, name: str, description: str, values: str,
                      category: str | None = None, sheet_col: str = "SheetName", seq: str | None = None) -> DataFrame:
    """Q8: data-dictionary entries (id, label, variable, values, category, description) from stacked sheets.

    One entry per row that names a variable (nameless rows are skipped); the category comes from ``category`` or,
    without one, from the sheet name column. ``seq`` orders the entries (else the row index, W6).
    """
    df = stacked if seq else with_row_index(stacked, "__seq")
    order = F.col(seq) if seq else F.col("__seq")
    cat = F.col(category) if category else F.col(sheet_col)
    return df.where(not_empty(F.col(name))).select(
        order.alias("id"), F.col(label).alias("label"), F.col(name).cast("string").alias("variable"),
        F.col(values).alias("values"), cat.alias("category"), F.col(description).alias("description"),
    )
