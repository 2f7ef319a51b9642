"""S7 lifecycle: a versioned store folder that is created, appended to, edited by item, emptied and recreated.

Every change writes new data folders and then one manifest row per table part; nothing that an earlier version reads is
touched. The manifest of a version is a single file committed by Spark, so a change is visible whole or not at all: a
write that fails leaves no manifest and the old store stays readable. Two writers of one version leave two manifest
files; the smaller commit name counts, and the other writer is told.

The variable table has a part per item, so an item is replaced or deleted without writing the others. Visits
(``VISITS``) are kept by every change of the store, also when it is emptied or recreated.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.load import Store

TABLES = ("variable", "value", "item", "category", "subjects")
VISITS = "visits"
MANIFEST = "v long, commit string, name string, item int, path string, ddl string"


class ConflictError(RuntimeError):
    """Another writer made this version first."""


def _manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}/manifest"


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(_manifest_path(root))  # any store that Spark reaches
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MANIFEST).parquet(_manifest_path(root))


def parts_of(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list]:
    """(version, manifest rows) of the current version, or of an earlier one; (0, []) for a new folder.

    A manifest has a row per table part: as many as the store has items, and a few.
    """
    rows = _versions(spark, root)
    if rows is None:
        return 0, []
    at = version if version is not None else rows.agg(F.max("v")).first()[0]
    if at is None:
        return 0, []
    now = rows.where(F.col("v") == at)
    first = now.agg(F.min("commit")).first()[0]
    if first is None:
        raise ValueError(f"no version {at} in {root}")
    return at, [r for r in now.where(F.col("commit") == first).collect() if r["name"] != ""]


def _commit(spark: SparkSession, root: str, base: int, parts: list[tuple]) -> int:
    """Publish ``parts`` (name, item, path, ddl) as the version after ``base``."""
    v, commit = base + 1, uuid.uuid4().hex
    rows = [(v, commit, *p) for p in parts] or [(v, commit, "", None, "", "")]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(_manifest_path(root))
    if _versions(spark, root).where(F.col("v") == v).agg(F.min("commit")).first()[0] != commit:
        raise ConflictError(f"version {v} of {root} was made by another writer")
    return v


def _write(df: DataFrame, root: str, name: str, item: int | None = None) -> tuple:
    path = f"{root.rstrip('/')}/data/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return name, item, path, ddl


def _write_variable(variable: DataFrame, root: str) -> list[tuple]:
    """One part per item, all written by one job."""
    folder = f"{root.rstrip('/')}/data/variable-{uuid.uuid4().hex}"
    rows = variable.select("case", "item", "value")
    dealt = rows.repartition("item", F.pmod(F.xxhash64("case"), F.lit(8)))
    dealt.write.partitionBy("item").parquet(folder)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    items = variable.sparkSession.read.schema(
        f"`case` {kinds['case']}, value {kinds['value']}, item int").parquet(folder).select("item").distinct().collect()
    return [("variable", r["item"], f"{folder}/item={r['item']}", f"`case` {kinds['case']}, value {kinds['value']}")
            for r in items]  # a row an item


def _write_all(store: Store, root: str) -> list[tuple]:
    tables = store.tables()
    return _write_variable(tables.pop("variable"), root) + [_write(df, root, name) for name, df in tables.items()]


def _kept(rows: list, but: tuple[str, ...] = (), items: tuple = ()) -> list[tuple]:
    return [(r["name"], r["item"], r["path"], r["ddl"]) for r in rows
            if r["name"] not in but and not (r["name"] == "variable" and r["item"] in items)]


def create_store(store: Store, root: str) -> int:
    """Write a store, or recreate one from new data: its tables are replaced, its visits stay. Returns the version."""
    spark = store.subjects.sparkSession
    base, rows = parts_of(spark, root)
    return _commit(spark, root, base, _kept(rows, but=TABLES) + _write_all(store, root))


def empty_store(spark: SparkSession, root: str) -> int:
    """Drop every table but the visits."""
    base, rows = parts_of(spark, root)
    return _commit(spark, root, base, _kept(rows, but=TABLES))


def append_cases(store: Store, root: str) -> int:
    """Add the cases of another load of the same dictionary: their variable and subject rows, and values not yet known."""
    spark = store.subjects.sparkSession
    base, rows = parts_of(spark, root)
    old = read_version(spark, root)
    again = store.subjects.join(old.subjects, "case", "left_semi").agg(F.count(F.lit(1))).first()[0]
    if again:
        raise ValueError(f"{again} cases are in the store already")
    new = store.value.join(old.value.select("item", "id"), ["item", "id"], "left_anti").select(*old.value.columns)
    parts = _write_variable(store.variable, root)
    parts += [_write(new, root, "value"), _write(store.subjects.select(*old.subjects.columns), root, "subjects")]
    return _commit(spark, root, base, _kept(rows) + parts)


def replace_item(root: str, item: int, variable: DataFrame | None, value: DataFrame | None = None) -> int:
    """Replace one item's rows (None: delete them), and its values where given; other items' files are not touched."""
    some = variable if variable is not None else value
    spark = some.sparkSession if some is not None else SparkSession.getActiveSession()
    base, rows = parts_of(spark, root)
    parts = _kept(rows, items=(item,))
    if variable is not None:
        parts += _write_variable(variable.where(F.col("item") == item), root)
    if variable is None or value is not None:
        old = read_version(spark, root).value
        values = old.where(F.col("item") != item)
        if value is not None:
            values = values.unionByName(value.where(F.col("item") == item).select(*old.columns))
        parts = [p for p in parts if p[0] != "value"] + [_write(values, root, "value")]
    return _commit(spark, root, base, parts)


def append_visits(visits: DataFrame, root: str) -> int:
    """Add rows to the visit log."""
    spark = visits.sparkSession
    base, rows = parts_of(spark, root)
    return _commit(spark, root, base, _kept(rows) + [_write(visits, root, VISITS)])


def _read(spark: SparkSession, rows: list, name: str) -> DataFrame | None:
    own = [r for r in rows if r["name"] == name]
    if not own:
        return None
    if name == "variable":  # the parts of one write lie in one folder: one read for each, its items as a partition filter
        folders: dict[str, list[int]] = {}
        for r in own:
            folders.setdefault(r["path"].rsplit("/", 1)[0], []).append(r["item"])
        frames = [spark.read.option("basePath", folder).schema(own[0]["ddl"] + ", item int").parquet(
            *[f"{folder}/item={i}" for i in items]) for folder, items in folders.items()]
    else:
        frames = [spark.read.schema(r["ddl"]).parquet(r["path"]) for r in own]
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> Store | None:
    """The store as of a version (the current one by default); None where it holds no tables."""
    _, rows = parts_of(spark, root, version)
    found = {name: _read(spark, rows, name) for name in TABLES}
    if found["subjects"] is None:
        return None
    if found["variable"] is None:  # every item deleted
        found["variable"] = spark.createDataFrame([], "`case` string, item int, value long")
    found["variable"] = found["variable"].select("case", "item", "value")
    return Store(**found)


def read_visits(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    return _read(spark, parts_of(spark, root, version)[1], VISITS)
