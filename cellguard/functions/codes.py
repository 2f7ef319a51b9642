"""Dictionary value codes: option parsing (F13), categorical test (F14), base-36 letters (F15), name flags (F16),
range labels (P12) and inline mappings (J7). All Column expressions except the name flags, which read column
names (schema metadata) on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_number, clean_text

NUM = r"[+-]?\d+(?:\.\d+)?"
UNUM = r"\d+(?:\.\d+)?"
OPTION = r"^([^=\s]+)[=\s]+(.*)$"


def is_categorical(values: Column) -> Column:
    """a values text like '1 = male||2 = female' (a code of 1-3 word characters, then '=')."""
    return F.coalesce(F.trim(values).rlike(r"^\w{1,3}\s*="), F.lit(False))


def base36(c: Column) -> Column:
    """a single letter a-z as its base-36 number (a -> 10)."""
    return F.conv(c, 36, 10).cast("long")


#: The parts of a variable name that raise each flag (anywhere in it, so 'dosage' counts as an age).
NAME_PARTS = {
    "has_age": ("age",),
    "has_age_year": ("age", "year", "yr"),
    "has_date": ("date", "dt"),
    "has_years": ("years", "yrs"),
}


def name_flags(name: str) -> dict:
    """F16: which flags a variable name raises."""
    return {flag: any(part in name for part in parts) for flag, parts in NAME_PARTS.items()}


def numeric_key(raw: Column) -> Column:
    """Numeric reading of a cell for code lookup: decimals as doubles, one letter as base 36, integers as-is."""
    return (
        F.when(F.instr(raw, ".") > 0, F.when(raw.rlike(r"^\s*" + NUM + r"\s*$"), F.trim(raw).cast("double")))
        .when(raw.rlike("^[a-z]$"), base36(raw).cast("double"))
        .when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).cast("double"))
    )


def range_bounds(label: Column) -> dict[str, Column]:
    """(lo, lo_incl, hi, hi_incl, is_float) of a range label such as '5,000+', '<0', '0-2,500' (end exclusive).

    Labels that are not a numeric range ('non-hispanic') give NULL bounds and match nothing.
    """
    s = clean_number(label)
    is_float = F.instr(s, ".") > 0

    def grab(pattern: str, group: int = 1) -> Column:
        return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group).cast("double"))

    plus = rf"^({NUM})\+$"
    minus = rf"^({NUM})-$"
    ge, le, gt, lt = rf"^>=\s*({NUM})$", rf"^<=\s*({NUM})$", rf"^>\s*({NUM})$", rf"^<\s*({NUM})$"
    between = rf"^({UNUM})\s*-\s*({UNUM})$"
    lo = F.coalesce(grab(plus), grab(ge), grab(gt), grab(between, 1))
    hi = F.coalesce(grab(minus), grab(le), grab(lt), grab(between, 2))
    lo_incl = ~s.rlike(gt)
    hi_incl = s.rlike(minus) | s.rlike(le)
    return {"lo": lo, "lo_incl": lo_incl, "hi": hi, "hi_incl": hi_incl, "rng_float": is_float}


def in_range(x: Column) -> Column:
    """Membership of a number in the (lo, lo_incl, hi, hi_incl, rng_float) columns; integer labels compare the
    number truncated toward zero."""
    v = F.when(F.col("rng_float"), x).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))
    lo_ok = F.col("lo").isNull() | F.when(F.col("lo_incl"), v >= F.col("lo")).otherwise(v > F.col("lo"))
    hi_ok = F.col("hi").isNull() | F.when(F.col("hi_incl"), v <= F.col("hi")).otherwise(v < F.col("hi"))
    return (F.col("lo").isNotNull() | F.col("hi").isNotNull()) & lo_ok & hi_ok


def value_options(dictionary: DataFrame) -> DataFrame:
    """one row per coded option of each categorical dictionary row.

    Returns (name, pos, code_text, code_key DOUBLE, order INT, label, lo, lo_incl, hi, hi_incl, rng_float).
    'code = label' splits once on the first run of '=' or spaces; the label is trimmed and lower-cased; '.' codes
    and 'missing' labels are dropped; a decimal code keeps its exact value as the lookup key and its integer part
    as the order; a one-letter code counts in base 36 (decision D10).
    """
    d = dictionary.where(is_categorical(F.col("values")))
    ex = d.select("name", F.posexplode(F.split(F.col("values"), r"\|\|")).alias("pos", "opt"))
    code = F.regexp_extract("opt", OPTION, 1)
    label = F.lower(F.trim(F.regexp_extract("opt", OPTION, 2)))
    parsed = ex.select("name", "pos", code.alias("code_text"), label.alias("label")).where(
        (F.col("code_text") != ".") & (F.col("label") != "missing") & (F.col("code_text") != "")
    )
    code_key = (
        F.when(F.col("code_text").rlike(r"^[A-Za-z]$"), base36(F.lower("code_text")).cast("double"))
        .when(F.col("code_text").rlike(rf"^{NUM}$"), F.col("code_text").cast("double"))
    )
    order = F.when(F.instr("code_text", ".") > 0, code_key.cast("int")).otherwise(
        code_key.cast("int")
    )
    is_range = (
        F.col("label").endswith("+") | F.col("label").endswith("-") | F.col("label").startswith("<")
        | F.col("label").startswith(">") | F.col("label").contains("-")
    )
    bounds = range_bounds(F.col("label"))
    return parsed.select(
        "name",
        "pos",
        "code_text",
        code_key.alias("code_key"),
        order.alias("order"),
        clean_text(F.col("label")).alias("label"),
        *[F.when(is_range, c).alias(n) for n, c in bounds.items()],
    )


def read_mapping(mapping: str | None) -> dict:
    """J7 (driver side, a short literal): 'k==v&k==v' with '_' as a space."""
    if not mapping:
        return {}
    out = {}
    for m in mapping.replace("_", " ").split("&"):
        k, v = m.split("==")
        out[k] = v
    return out


def apply_mapping(c: Column, mapping: dict) -> Column:
    """Mapped value when the key is known, the value itself otherwise."""
    if not mapping:
        return c
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, c), c)
