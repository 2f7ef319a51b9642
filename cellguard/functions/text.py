"""Text scalars (F1-F3, F19-F24) as Column expressions; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text substitutions applied for display, in this order.
TEXT_SUBS = [
    ("”", '"'),
    ("“", '"'),
    ("’", "'"),
    ("‘", "'"),
    ("||||", "\n"),
    ("||", "\n"),
    ("≥", ">="),
    ("≤", "<="),
]


def clean_text(c: Column) -> Column:
    """typographic quotes to ASCII, double pipes to newlines, >= / <= signs to ASCII."""
    for src, dst in TEXT_SUBS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def clean_number(c: Column) -> Column:
    """drop thousands separators and dollar signs, trim."""
    return F.trim(F.translate(c, ",$", ""))


def trunc_decimal(c: Column) -> Column:
    """the text of a number cut after the first decimal digit ('2.57' -> '2.5', '10' -> '10')."""
    s = c.cast("string")
    return F.when(F.instr(s, ".") > 0, F.substring(s, F.lit(1), F.instr(s, ".") + 1)).otherwise(s)


def capitalize(c: Column) -> Column:
    """first character upper, the rest lower (like str.capitalize, not initcap)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def truncate_description(c: Column, limit: int = 499, keep: int = 496) -> Column:
    """descriptions longer than ``limit`` characters become ``keep`` characters plus '...'."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def not_empty(c: Column) -> Column:
    """the field is present and non-empty."""
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def bucket_label(lo: Column, step: int, top_lo: int) -> Column:
    """age bucket text 'a-(a+step-1)', the top bucket '(max-step)+'."""
    return F.when(lo >= F.lit(top_lo), F.concat(lo.cast("string"), F.lit("+"))).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), (lo + F.lit(step - 1)).cast("string"))
    )


def search_terms(query: str, min_len: int = 3) -> list[str]:
    """trim, drop '*', require ``min_len`` characters, split on whitespace (driver side, tiny input)."""
    s = query.strip().replace("*", "")
    if len(s) < min_len:
        raise ValueError(f"search text is shorter than {min_len} characters")
    return s.split()
