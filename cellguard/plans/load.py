"""Q6/Q7 cohort load: wide subject-per-row table + data dictionary -> EAV store.

Plan: unpivot the wide table to its distinct (col, cell) -> drop missing ones (P6) -> attach the per-column rule (one
row per column: a broadcast whose size is the schema width) -> one expression per rule kind, on distinct cells:

* date: year, 5-year mid-bin, edge-rounded (W5); age: mid-bin with the axis clamp; other years: mid-bin,
  edge-rounded; skip-rounding columns: nearest integer;
* coded (dictionary values): exact code, then label, then labelled range (lowest order wins), then a new value;
* raw: integer text, else decimal floored to 0.1, else the text.

The per-column min/max for edge rounding (A12) is a groupBy on ``col`` over the distinct rounded numbers. What the cells
say is joined back to the unpivoted table: by a broadcast for columns of few distinct cells, by a shuffle join for the
others; raw texts of the others are parsed cell by cell. Value ids are an md5-derived 60-bit number of (variable, name), so they need no global numbering and are equal in every engine; they
are always looked up together with their item. Cases keep their id as text; a missing or repeated id is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LoadConfig
from ..functions import codes as K
from ..functions.rounding import (
    floor1, int_ceil, int_floor, int_mid, int_only, int_text, is_int_text, to_double, to_long, to_year, typed_name,
)
from ..functions.text import clean_number, clean_text
from ..operators.ranges import infer_ranges
from ..operators.ranks import grouped_rank
from ..operators.rows import with_row_index
from ..session import cut_lineage

# Cell texts that a reader of CSV files takes for missing, exactly as written here.
UNREAD = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Cell texts that mean missing after lower-casing.
MISSING = ["", ".", "missing"]

ROLES = ["age_bl", "age_fu", "gender", "enrollment", "followup_years"]
UNSEEN_ORDER_BASE = 123  # fixed value: an unseen label of a variable without codes gets order 124, 125, ...
NUMERIC_KINDS = ["date", "date_int", "age", "year", "int_only"]
FEW_CELLS = 100_000  # fixed value: distinct cells of all columns together whose meaning is broadcast


@dataclass
class Store:
    variable: DataFrame  # (case STRING, item INT, value LONG)
    value: DataFrame  # (id LONG, item INT, name, name_numeric DOUBLE, description, order INT, listed BOOLEAN)
    item: DataFrame  # (id, name, varname, description, category, is_numeric, is_loaded, is_float,
    #                   range_start, range_end, range_step, rounded); an item's list is its listed values
    category: DataFrame  # (id INT, name, description, order INT)
    subjects: DataFrame  # (case STRING, age_bl INT, age_fu INT, sex, enrollment, followup_years INT)
    report: DataFrame | None = None  # (col, reason, n): cells and chart variables the load could not use

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("variable", "value", "item", "category", "subjects")}


def value_id(varname: Column, name: Column) -> Column:
    """Id of a value of a variable: the first 15 hex digits of md5('varname|name'), '1.0' counting as '1'.

    Ids are looked up together with their item, so equal ids of two items never meet; two names of one item with
    one id would be merged, and ``load_cohort`` refuses them.
    """
    return F.conv(F.substring(F.md5(F.concat_ws("|", varname, same_number(name))), 1, 15), 16, 10).cast("long")


def same_number(name: Column) -> Column:
    """Names that read as one number get one text: '1.0' becomes '1'."""
    whole = F.regexp_replace(name, r"^(-?[0-9]+)\.0$", "$1")
    return F.when(F.contains(name, F.lit(".0")), whole).otherwise(name)


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """Drop cells that say missing, the reader's tokens as written and the others in any case; lower-case the rest."""
    raw = F.col(col)
    return df.where(raw.isNotNull() & ~raw.isin(UNREAD)).withColumn(col, F.lower(raw)).where(~F.col(col).isin(MISSING))


def prepare_dictionary(dictionary: DataFrame, cfg: LoadConfig) -> DataFrame:
    """Priority and target filters; names lower-cased and cleaned."""
    d = dictionary.withColumn("name", clean_text(F.lower(F.col("name")))).withColumn(
        "priority", F.coalesce(F.col("priority"), F.lit(0))
    )
    d = d.where(F.col("priority") >= F.lit(cfg.min_priority))
    if cfg.target_columns:
        t = list(cfg.target_columns) + list(cfg.datamodel_vars)
        d = d.where(F.col("name").isin(t) | F.col("label").isin(t))
    return d


def column_rules(spark, columns: list[str], dictionary: DataFrame, cfg: LoadConfig) -> DataFrame:
    """P7 + F16: one row per cohort column: (col, varname, role, kind, included, item_id, coded).

    Name flags and roles come from column names (driver-side schema); dictionary facts come from a join.
    """
    skip = cfg.all_skip_rounding
    names = set(columns)
    rows = []
    for pos, c in enumerate(columns):
        var = c
        if c.endswith("_desc"):
            if not cfg.use_desc:
                rows.append((pos, c, var, None, "excluded", False))
                continue
            var = c[:-5]
        elif cfg.use_desc and f"{c}_desc" in names:
            rows.append((pos, c, var, None, "excluded", False))
            continue
        f = K.name_flags(var)
        if f["has_date"]:
            kind = "date_int" if var in skip else "date"
        elif f["has_age_year"] or f["has_years"]:
            whole = var in skip or (cfg.round_years == 1 and not f["has_age"])
            kind = "int_only" if whole else ("age" if f["has_age"] else "year")
        else:
            kind = None  # coded or raw, decided by the dictionary
        rows.append((pos, c, var, cfg.datamodel_vars.get(var), kind, True))
    schema = "pos int, col string, varname string, role string, kind string, named boolean"
    r = spark.createDataFrame(rows, schema)
    d = dictionary.select(
        F.col("name").alias("varname"),
        (F.col("seq") + 1).cast("int").alias("item_id"),
        K.is_categorical(F.col("values")).alias("coded"),
    )
    r = r.join(d, "varname", "left")
    in_dict = F.col("item_id").isNotNull()
    included = F.col("named") & (in_dict | F.col("role").isNotNull())
    kind = (
        F.when(~included, F.lit("excluded"))
        .when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.coalesce(F.col("coded"), F.lit(False)), F.lit("coded"))
        .when(F.lit(cfg.dictionary_only), F.lit("excluded"))
        .otherwise(F.lit("raw"))
    )
    return r.select("pos", "col", "varname", "role", kind.alias("kind"), "item_id", "coded")


def _resolve_codes(coded: DataFrame, options: DataFrame) -> DataFrame:
    """J5 + J6 + W7 on distinct (col, raw) of coded columns -> (col, varname, raw, name, order, categorical).

    The distinct cells are read once: they are left-joined with three lookups built from the dictionary options
    (exact code, label, labelled ranges; Spark broadcasts those whose size it knows to be small), and one ``groupBy``
    picks the lowest-order match of each kind. Unseen labels are numbered after the largest code (W7) by a rank over
    range partitions, so a free-text column with very many labels spreads over many tasks.
    """
    o = options.select(F.col("name").alias("varname"), "code_key", "order", "label", "lo", "lo_incl", "hi",
                       "hi_incl", "rng_float")
    exact = o.groupBy("varname", F.col("code_key").alias("key")).agg(
        F.min_by(F.struct(F.col("order").alias("o"), F.col("label").alias("n")), "order").alias("e"))
    by_label = o.groupBy("varname", F.col("label").alias("raw")).agg(
        F.min_by(F.struct(F.col("order").alias("o"), F.col("label").alias("n")), "order").alias("l"))
    ranges = o.where(F.col("lo").isNotNull() | F.col("hi").isNotNull()).select(
        F.col("varname").alias("r_var"), F.struct(F.col("order").alias("o"), F.col("label").alias("n")).alias("r"),
        "lo", "lo_incl", "hi", "hi_incl", "rng_float")
    top = o.groupBy(F.col("varname").alias("t_var")).agg(F.max("code_key").alias("top"))
    d = (
        coded.select("col", "varname", "raw").distinct()
        .withColumn("key", K.numeric_key(F.col("raw")))
        .withColumn("x", to_double(clean_number(F.col("raw"))))
    )
    cand = (
        d.join(exact, ["varname", "key"], "left")
        .join(by_label, ["varname", "raw"], "left")
        .join(ranges, (F.col("varname") == F.col("r_var")) & K.in_range(F.col("x")), "left")
        .join(top, F.col("varname") == F.col("t_var"), "left")
    )
    best = cand.groupBy("col", "varname", "raw", "key").agg(
        F.first("e", ignorenulls=True).alias("e"), F.first("l", ignorenulls=True).alias("l"),
        F.min("r").alias("r"), F.max("top").alias("top"),
    )
    m_name = F.coalesce(F.col("e.n"), F.col("l.n"), F.col("r.n"))
    m_order = F.coalesce(F.col("e.o"), F.col("l.o"), F.col("r.o"))
    unseen = m_name.isNull() & F.col("key").isNull()
    name = F.coalesce(m_name, F.when(F.col("key").isNotNull(), typed_name(F.col("raw"))), clean_text(F.col("raw")))
    best = cut_lineage(best.select("col", "varname", "raw", name.alias("name"), m_order.alias("m_order"), unseen.alias("unseen"),
                                   m_name.isNotNull().alias("categorical"), "top"), "codes")
    numbered = grouped_rank(best.where("unseen"), ["col"], ["raw"], "place")
    n_order = F.floor(F.coalesce(F.col("top"), F.lit(float(UNSEEN_ORDER_BASE)))) + F.col("place") + 1
    return (best.where("not unseen").select("col", "varname", "raw", "name", F.col("m_order").cast("int").alias("order"),
                                            "categorical")
            .unionByName(numbered.select("col", "varname", "raw", "name",
                                         F.coalesce("m_order", n_order).cast("int").alias("order"), "categorical")))


ROW = ["col", "cell", "varname", "role", "item_id"]
NORMAL = ["name", "order", "categorical", "num", "value"]
EAV = ["case", "item_id as item", "value"]
CHARTED = ["case", "role", "name"]


def cells_of(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns' cells, as (case, col, cell)."""
    long = wide.unpivot(["__case"], columns, "col", "cell").withColumnRenamed("__case", "case")
    return long.where(F.col("cell").isNotNull())


def distinct_cells(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(col, cell, raw, n): the distinct cells that say something, as written and lower-cased, and how often each occurs.

    Equal cells of a task meet before the exchange, so missing ones (P6) are told from the rest once each."""
    n = cells_of(wide, columns).groupBy("col", "cell").agg(F.count(F.lit(1)).alias("n"))
    return drop_missing(n.withColumn("raw", F.col("cell")), "raw")


def few_columns(cells: DataFrame) -> set[str]:
    """The columns with the fewest distinct cells, as many as have ``FEW_CELLS`` together."""
    few, total = set(), 0
    sizes = cells.groupBy("col").agg(F.count(F.lit(1)).alias("size")).collect()  # a row a column
    for r in sorted(sizes, key=lambda r: (r["size"], r["col"])):
        total += r["size"]
        if total > FEW_CELLS:
            break
        few.add(r["col"])
    return few


def rows_saying(wide: DataFrame, columns: list[str], said: DataFrame, few: bool, what: list[str]) -> DataFrame:
    """The named columns' cells with what they say: ``EAV`` for items, or ``CHARTED`` for the chart variables."""
    t = said.where(F.col("col").isin(columns) & F.col("item_id" if what == EAV else "role").isNotNull())
    t = t.selectExpr("col", "cell", *what[1:])
    return cells_of(wide, columns).join(F.broadcast(t) if few else t, ["col", "cell"]).drop("col", "cell")


def parse_numbers(cells: DataFrame, dates: bool) -> DataFrame:
    """Distinct cells of date columns, or of age and year columns, with their first rounding as ``v0`` (NULL: not readable)."""
    x = cells.withColumn("_num", to_year(F.col("raw")).cast("double") if dates else to_double(F.col("raw")))
    whole = F.col("kind").isin("date_int", "int_only")
    return x.withColumn("v0", F.when(whole, int_only(F.col("_num"))).otherwise(int_mid(F.col("_num")))).select(*ROW, "kind", "n", "v0")


def normal_numbers(x: DataFrame, cfg: LoadConfig, cut) -> DataFrame:
    """Parsed number cells -> what they say; their columns' ends are rounded.

    What a first rounding becomes is worked out once per column and rounded number, and joined back (Spark/AQE broadcasts
    that table when its measured size allows, else a shuffle join).
    """
    k = F.col("kind")
    seen = cut(x.where(F.col("v0").isNotNull()).select("col", "varname", "kind", "v0").distinct(), "roundings")
    # per column: min / max of the first rounding pass and the maximum after the minimum is floored
    amin, amax, astep = cfg.age_min, cfg.age_max, cfg.age_step
    m, mx = F.col("m"), F.col("mx")
    a_m2 = F.when(mx == m, int_floor(m)).otherwise(mx)
    if amin is not None:
        a_m2 = F.when(mx <= F.lit(amin), F.lit(amin)).otherwise(a_m2)
    stats = seen.groupBy("col").agg(F.min("v0").alias("m"), F.max("v0").alias("mx")).select(
        "col", "m", F.when(mx == m, int_floor(m)).otherwise(mx).alias("e_m2"), a_m2.alias("a_m2"))
    v0 = F.col("v0")
    edge_kind = k.isin("date", "year", "age")
    first = F.when(edge_kind & (v0 == F.col("m")), int_floor(v0)).otherwise(v0)
    if amin is not None:
        first = F.when((k == "age") & (v0 <= F.lit(amin)), F.lit(amin)).otherwise(first)
    j = (
        seen.join(F.broadcast(stats), "col")
        .withColumn("_p1", first)
        .withColumn("_m2", F.when(k == "age", F.col("a_m2")).otherwise(F.col("e_m2")))
    )
    p1 = F.col("_p1")
    edged = F.when(edge_kind & (p1 == F.col("_m2")), int_ceil(p1)).otherwise(p1)
    if amax is not None and astep is not None:
        edged = F.when((k == "age") & (p1 >= F.lit(amax - astep)), F.lit(amax - astep)).otherwise(edged)
    name = F.col("_edged").cast("string")
    names = j.withColumn("_edged", edged).select(
        "col", "v0", name.alias("name"), F.lit(None).cast("int").alias("order"), F.lit(False).alias("categorical"),
        F.col("_edged").cast("double").alias("num"), value_id(F.col("varname"), name).alias("value"))
    return x.join(names, ["col", "v0"]).select(*ROW, *NORMAL)


def normal_raw(x: DataFrame, keep: list[str] = ROW) -> DataFrame:
    """Cells of columns without codes -> what they say: integer text, else decimal floored to 0.1, else the text."""
    x = x.withColumn("_isint", is_int_text(F.col("raw"))).withColumn("_num", to_double(F.col("raw")))
    x = x.withColumn("_dec", floor1(F.when(~F.col("_isint"), F.col("_num"))))
    named = x.select(
        *keep,
        F.coalesce(F.when(F.col("_isint"), int_text(F.col("raw"))), F.col("_dec").cast("string"),
                   clean_text(F.col("raw"))).alias("name"),
        F.lit(None).cast("int").alias("order"),
        F.lit(False).alias("categorical"),
        F.coalesce(F.col("_dec").cast("double"), F.col("_num")).alias("num"),
    )
    return named.withColumn("value", value_id(F.col("varname"), F.col("name")))


def normal_coded(x: DataFrame, options: DataFrame) -> DataFrame:
    """Distinct coded cells -> what they say: they join the resolved codes (Spark/AQE broadcasts them when their measured
    size allows, else a shuffle join)."""
    name = F.col("name")
    resolved = _resolve_codes(x.select("col", "varname", "raw"), options).select(
        "col", "raw", "varname", "name", F.col("order").cast("int").alias("order"), "categorical",
        to_double(name).alias("num"), value_id(F.col("varname"), name).alias("value"))
    return x.join(resolved.drop("varname"), ["col", "raw"]).select(*ROW, *NORMAL)


def load_cohort(cohort: DataFrame, dictionary: DataFrame, cfg: LoadConfig, materialize: bool = True) -> Store:
    """Q6: normalise once, then derive the five store tables from the normalised rows.

    Every distinct cell of a column is parsed once, numbers, codes and raw texts apart, and the rows of the EAV table join
    what their cells say. With ``materialize`` the cohort's texts, the distinct cells, what they say and the EAV rows are
    written to the checkpoint folder first, so the five tables and everything queried from them read those files. The EAV
    rows hold ids only: the subjects' names are joined to the few columns that a chart needs.
    """
    spark = cohort.sparkSession
    cut = cut_lineage if materialize else lambda df, name: df
    cohort = cohort.toDF(*[c.lower() for c in cohort.columns])
    case_col = cfg.case_col.lower() if cfg.case_col else None
    if case_col:
        cohort = cohort.withColumn("__case", F.col(case_col).cast("string"))
    else:
        cohort = with_row_index(cohort, "__case").withColumn("__case", F.col("__case").cast("string"))
    columns = [c for c in cohort.columns if c not in ("__case", case_col)]
    dm = [c for c in cfg.datamodel_vars if c in columns]
    if cfg.target_columns:
        columns = dm + [c for c in cfg.target_columns if c not in dm and c in columns]
    # every table below reads the dictionary and the rules: both are worked out once
    d = cut(prepare_dictionary(dictionary, cfg), "dictionary")
    rules = cut(column_rules(spark, columns, d, cfg), "rules")
    kinds: dict[str, list[str]] = {}
    items, charted = set(), set()
    facts = rules.groupBy("pos", "col", "kind").agg(F.count("item_id").alias("items"), F.count("role").alias("roles"))
    for r in facts.collect():  # a row a column
        kinds.setdefault(r["kind"], []).append(r["col"])
        items |= {r["col"]} if r["items"] else set()
        charted |= {r["col"]} if r["roles"] else set()
    used = list(dict.fromkeys(c for kind, cols in kinds.items() if kind != "excluded" for c in cols))
    wide = cut(cohort.select("__case", *[F.col(c).cast("string") for c in used]), "cohort")
    cases = wide.select(F.col("__case").alias("case"))
    if case_col:
        check_cases(cases)
    options = K.value_options(d)
    distinct = cut(distinct_cells(wide, used), "cells") if used else None
    few = few_columns(distinct) if materialize and used else set()

    def cells(*names: str) -> DataFrame | None:
        cols = [c for name in names for c in kinds.get(name, [])]
        return distinct.join(F.broadcast(rules.where(F.col("kind").isin(*names))), "col") if cols else None

    # a number's column ends are known after all its distinct cells are parsed: these are stored rows
    parsed = [cut(parse_numbers(c, dates), "numbers")
              for c, dates in ((cells("date", "date_int"), True), (cells("age", "year", "int_only"), False)) if c is not None]
    joined = [normal_numbers(reduce(DataFrame.unionByName, parsed), cfg, cut)] if parsed else []
    if (coded := cells("coded")) is not None:
        joined.append(normal_coded(coded, options))
    said = [cut(reduce(DataFrame.unionByName, joined), "said")] if joined else []
    named = list(dict.fromkeys(c for kind in [*NUMERIC_KINDS, "coded"] for c in kinds.get(kind, [])))
    texts = list(dict.fromkeys(kinds.get("raw", [])))
    if (raw := cells("raw")) is not None:
        said.append(normal_raw(raw))

    def saying(what: list[str], of: set[str], empty: str) -> DataFrame:
        rows = []
        for small in (True, False):
            if cols := [c for c in named if c in of and (c in few) == small]:
                rows.append(rows_saying(wide, cols, said[0], small, what))
        if cols := [c for c in texts if c in of and c in few]:
            rows.append(rows_saying(wide, cols, said[-1], True, what))
        if cols := [c for c in texts if c in of and c not in few]:  # no join: nearly every cell may say something else
            own = drop_missing(cells_of(wide, cols).withColumnRenamed("cell", "raw"), "raw").join(
                F.broadcast(rules.where((F.col("kind") == "raw") & F.col("item_id" if what == EAV else "role").isNotNull())),
                "col")
            rows.append(normal_raw(own, ["case", "varname", "role", "item_id"]).selectExpr(*what))
        return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], empty)

    none = "varname string, item_id int, name string, `order` int, categorical boolean, num double"
    # ids are stored with the rows: filters on values then reach the scan, and no query hashes names again
    variable = cut(saying(EAV, items, "`case` string, item int, value long"), "eav")
    dv = cut(distinct_values(reduce(DataFrame.unionByName, said) if said else spark.createDataFrame([], none)), "values")
    check_value_ids(dv)
    values = _values(dv, options, rules)
    item = _items(dv, d, rules, cfg)
    category = _categories(d)
    subjects = _subjects(cases, saying(CHARTED, charted, "`case` string, role string, name string"), cfg)
    present = cells(*[k for k in kinds if k != "excluded"])
    return Store(variable, values, item, category, subjects, load_report(spark, present, parsed, rules, subjects))


def check_cases(cases: DataFrame) -> None:
    """Refuse a cohort whose case column does not tell its rows apart."""
    n, known, apart = cases.agg(F.count(F.lit(1)), F.count("case"), F.count_distinct("case")).first()
    if known < n or apart < n:
        raise ValueError(f"case column: {n - known} of {n} rows have no id, {known - apart} repeat one")


def check_value_ids(dv: DataFrame) -> None:
    """Refuse two names of one item that would get one id, and so be taken for one value."""
    ids = dv.groupBy("item_id", value_id(F.col("varname"), F.col("name")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    met = ids.where("n > 1").orderBy("item_id", "id").first()
    if met:
        raise ValueError(f"item {met['item_id']}: {met['n']} values have the id {met['id']}")


def load_report(spark, cells: DataFrame | None, parsed: list[DataFrame], rules: DataFrame,
                subjects: DataFrame) -> DataFrame:
    """(col, reason, n): per loaded column the missing cells and those that could not be read as the column's kind,
    and per chart variable the subjects without it. Counts come with the distinct cells."""
    rows = subjects.agg(F.count(F.lit(1))).scalar()
    none = spark.createDataFrame([], "col string, present long, unreadable long")
    seen = none if cells is None else cells.groupBy("col").agg(
        F.sum("n").alias("present"), F.lit(0).cast("long").alias("unreadable"))
    for x in parsed:
        seen = seen.unionByName(x.where(F.col("v0").isNull()).groupBy("col").agg(
            F.lit(0).cast("long").alias("present"), F.sum("n").alias("unreadable")))
    seen = seen.groupBy("col").agg(F.sum("present").alias("present"), F.sum("unreadable").alias("unreadable"))
    per = rules.where(F.col("kind") != "excluded").select("col").join(seen, "col", "left").select(
        "col", F.posexplode(F.array(rows - F.coalesce("present", F.lit(0)), F.coalesce("unreadable", F.lit(0))))
        .alias("which", "n"))
    cell_rows = per.select("col", F.when(F.col("which") == 0, "missing").otherwise("unreadable").alias("reason"), "n")
    charted = ["age_bl", "age_fu", "sex", "enrollment", "followup_years"]
    counts = subjects.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in charted])
    lacking = counts.unpivot([], charted, "col", "n").select("col", F.lit("subject without it").alias("reason"), "n")
    return cell_rows.unionByName(lacking).where(F.col("n") > 0)


def distinct_values(said: DataFrame) -> DataFrame:
    """One row per (variable, item, value name) seen in the data, with its order, number and kind.

    Reads what the distinct cells say, never the EAV rows. The value table and the item metadata both read this table.
    Names are grouped by hashing first; the least of equal numbers' names, which takes a sort, is then found among distinct
    names only."""
    number = F.col("same")
    seen = said.where(F.col("item_id").isNotNull()).groupBy("varname", "item_id", "name").agg(
        F.min("order").alias("order"), F.first("num").alias("num"), F.bool_or("categorical").alias("categorical"))
    return seen.withColumn("same", same_number(F.col("name"))).groupBy(
        "varname", "item_id", number).agg(
        F.min("name").alias("name"), F.min("order").alias("order"), F.first("num").alias("num"),
        F.bool_or("categorical").alias("categorical")).drop("same")


def _values(dv: DataFrame, options: DataFrame, rules: DataFrame) -> DataFrame:
    """Value table: every value seen in the data plus every dictionary option of a loaded coded column."""
    seen = dv.select("varname", "item_id", "name", "order", F.lit(True).alias("listed"))
    opts = options.join(
        F.broadcast(rules.where(F.col("kind") == "coded").select("varname", "item_id")),
        options.name == F.col("varname"),
    ).select("varname", "item_id", F.col("label").alias("name"), "order", F.lit(False).alias("listed"))
    allv = seen.unionByName(opts).withColumn("same", same_number(F.col("name"))).groupBy(
        "varname", "item_id", "same").agg(
        F.min("name").alias("name"), F.min("order").alias("order"), F.bool_or("listed").alias("listed"))
    return allv.select(
        value_id(F.col("varname"), F.col("name")).alias("id"),
        F.col("item_id").alias("item"),
        "name",
        to_double(F.col("name")).alias("name_numeric"),
        F.lit(None).cast("string").alias("description"),
        F.col("order").cast("int").alias("order"),
        "listed",
    )


def _items(dv: DataFrame, d: DataFrame, rules: DataFrame, cfg: LoadConfig) -> DataFrame:
    """Per item a numeric range (fixed for date/age/year columns, inferred A13 otherwise), or none: the item is
    listed by its values in the value table, however many they are.

    Reads the distinct values (one row per item and value name), never the normalised rows."""
    per = dv
    kinds = rules.where(F.col("item_id").isNotNull() & (F.col("kind") != "excluded")).select("item_id", "kind")
    stats = per.groupBy("item_id").agg(
        F.min("num").alias("vmin"),
        F.max("num").alias("vmax"),
        F.count_if(F.col("num").isNull()).alias("n_text"),
        F.bool_or("categorical").alias("any_cat"),
        F.count("name").alias("n_vals"),
    )
    inferred = infer_ranges(
        per.select(F.col("item_id"), F.col("num").alias("v")), key="item_id", v="v"
    ).select("item_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.col("step").alias("i_step"),
             F.col("is_float").alias("i_float"))
    k = F.col("kind")
    fixed = k.isin("date", "year", "age")
    amin = F.lit(cfg.age_min).cast("double") if cfg.age_min else F.col("vmin")
    amax = F.lit(cfg.age_max - cfg.age_step).cast("double") if (cfg.age_max and cfg.age_step) else F.col("vmax")
    astep = F.lit(float(cfg.age_step or 5))
    f_start = F.when(k == "age", amin).otherwise(F.col("vmin"))
    f_end = F.when(k == "age", amax).otherwise(F.col("vmax"))
    f_step = F.when(k == "age", astep).otherwise(F.lit(5.0))
    valid_range = (F.col("n_text") == 0) & ~F.col("any_cat")
    has_range = fixed | (valid_range & F.col("i_start").isNotNull())
    base = d.select(
        (F.col("seq") + 1).cast("int").alias("item_id"),
        clean_text(F.col("label")).alias("name"),
        F.col("name").alias("varname"),
        clean_text(F.col("description")).alias("description"),
        "domain",
        (F.coalesce(F.col("values"), F.lit("")) != "").alias("has_values"),
        (~K.is_categorical(F.col("values")) & (F.coalesce(F.col("values"), F.lit("")) != "")).alias("is_numeric"),
    )
    cats = _categories(d).select(F.col("id").alias("category"), F.col("name").alias("domain"))
    it = (
        base.join(kinds, "item_id", "left")
        .where(F.col("has_values") | F.col("kind").isNotNull())
        .join(cats, "domain", "left")
        .join(stats, "item_id", "left")
        .join(inferred, "item_id", "left")
    )
    rounded = F.when(k.isin("date", "year", "age"), F.lit(5)).when(k.isin("date_int", "int_only"), F.lit(1))
    is_float = F.when(fixed, F.lit(False)).otherwise(F.coalesce(F.col("i_float"), F.lit(False)))
    return it.select(
        F.col("item_id").alias("id"),
        "name",
        "varname",
        "description",
        "category",
        "is_numeric",
        (F.col("kind").isNotNull() & (has_range | (F.coalesce("n_vals", F.lit(0)) > 0))).alias("is_loaded"),
        F.when(has_range, is_float).otherwise(F.lit(False)).alias("is_float"),
        F.when(has_range, F.when(fixed, f_start).otherwise(F.col("i_start"))).alias("range_start"),
        F.when(has_range, F.when(fixed, f_end).otherwise(F.col("i_end"))).alias("range_end"),
        F.when(has_range, F.when(fixed, f_step).otherwise(F.col("i_step"))).alias("range_step"),
        rounded.alias("rounded"),
    )


def _categories(d: DataFrame) -> DataFrame:
    """One category per domain, ordered by the first dictionary row that names it."""
    first = d.groupBy(F.col("domain").alias("name")).agg(F.min("seq").alias("first"))
    order = F.row_number().over(Window.orderBy("first")) - 1
    return first.select(
        (order + 1).cast("int").alias("id"), "name", F.lit(None).cast("string").alias("description"),
        order.cast("int").alias("order"),
    )


def _subjects(cases: DataFrame, roles: DataFrame, cfg: LoadConfig) -> DataFrame:
    """Q7: one row per case with the five chart variables (NULL when missing, decision D7), one groupBy on case."""
    allc = cases.select("case", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("name"))
    g = roles.unionByName(allc).groupBy("case").agg(
        *[F.max(F.when(F.col("role") == r, F.col("name"))).alias(r) for r in ROLES]
    )
    gm = K.read_mapping(cfg.gender_mapping)
    em = K.read_mapping(cfg.enrollment_mapping)
    return g.select(
        "case",
        to_long(F.col("age_bl")).cast("int").alias("age_bl"),
        to_long(F.col("age_fu")).cast("int").alias("age_fu"),
        K.apply_mapping(F.col("gender"), gm).alias("sex"),
        K.apply_mapping(F.col("enrollment"), em).alias("enrollment"),
        to_long(F.col("followup_years")).cast("int").alias("followup_years"),
    )
