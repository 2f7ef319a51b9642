"""Rounding scalars (F4-F12) as Column expressions.

Python's ``%`` floors (the sign follows the divisor), so every modulo here is ``pmod``; Python's ``round`` is
half-even, so rounding uses ``bround``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_TEXT = r"^\s*[+-]?\d+\s*$"
NUM_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _num(c: Column) -> Column:
    return c.cast("double")


def int_round(x: Column, base: int = 5) -> Column:
    """base * round-half-even(x / base)."""
    return (F.bround(_num(x) / F.lit(float(base))) * F.lit(base)).try_cast("int")


def int_only(x: Column) -> Column:
    """nearest integer, half to even."""
    return int_round(x, 1)


def int_ceil(x: Column, base: int = 5) -> Column:
    """x + (base - x mod base) mod 5, truncated to int."""
    v = _num(x)
    return (v + F.pmod(F.lit(float(base)) - F.pmod(v, F.lit(float(base))), F.lit(5.0))).try_cast("int")


def int_floor(x: Column, base: int = 5) -> Column:
    """x - x mod base, truncated to int."""
    v = _num(x)
    return (v - F.pmod(v, F.lit(float(base)))).try_cast("int")


def int_mid(x: Column, base: int = 5) -> Column:
    """F8: the floor, plus base // 2 when x was not on an edge (14->12, 10->10, 8->7, 5->5)."""
    fl = int_floor(x, base)
    return F.when(fl.cast("double") != _num(x), fl + F.lit(base // 2)).otherwise(fl)


def round_to(val: Column, r: float, decimals: int = 1, direction: int = 1) -> Column:
    """round(val - val mod r, decimals); moving up by r when direction is 1 and that changed the value.

    Computed in decimal arithmetic so that 0.3 floors to 0.3 (decision D5).
    """
    d = val.cast("decimal(38,10)")
    rr = F.lit(r).cast("decimal(38,10)")
    res = F.bround(d - F.pmod(d, rr), decimals)
    if direction == 1:
        res = F.when(res != d, res + rr).otherwise(res)
    return res.cast("double")


def floor1(x: Column) -> Column:
    """floor to one decimal, exactly (decimal(38,1)); NULL from 10^26 on, where a double has no tenths."""
    d = F.when(F.abs(x) < F.lit(1e26), x).try_cast("decimal(38,10)")
    return (F.floor(d * F.lit(10)) / F.lit(10)).cast("decimal(38,1)")


def is_int_text(s: Column) -> Column:
    return s.rlike(INT_TEXT)


def is_num_text(s: Column) -> Column:
    return s.rlike(NUM_TEXT)


def to_long(s: Column) -> Column:
    """Integer value of integer text, else NULL (no engine-specific rounding of '1.5'); NULL beyond 64 bits."""
    return F.when(is_int_text(s), F.trim(s).try_cast("long"))


def int_text(s: Column) -> Column:
    """Integer text without sign and zeros that say nothing; NULL beyond 38 digits."""
    return F.trim(s).try_cast("decimal(38,0)").cast("string")


def to_double(s: Column) -> Column:
    return F.when(is_num_text(s), F.trim(s).cast("double"))


def typed_name(s: Column) -> Column:
    """the text of int(s), else of floor1(float(s)), else s itself."""
    return F.coalesce(F.when(is_int_text(s), int_text(s)),
                      floor1(F.when(~is_int_text(s), to_double(s))).cast("string"), s)


# Accepted date layouts and the text shape that selects each (a parse is tried only on text of
# the right shape, so no row pays for failed parses). A time of day after the date is ignored.
DATE_FORMATS = [
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("dMMMyyyy", r"^\d{1,2}[A-Za-z]{3}\d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{4,} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy", r"^\d{4}$"),
]
SHORT_DATE = ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$")
PIVOT = 69  # fixed value: two-digit years from 69 on are 19yy, earlier ones 20yy
TIME_OF_DAY = r"(?<=\d)[Tt ]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?$"


def to_year(s: Column, formats: list[tuple[str, str]] | None = None) -> Column:
    """the year of date text in any accepted layout (NULL when none fits)."""
    t = F.regexp_replace(F.trim(s), TIME_OF_DAY, "")
    # one shape at most fits a text: the layout is picked first and one date is parsed, which keeps the code small
    layouts = list(formats or DATE_FORMATS) + ([SHORT_DATE] if formats is None else [])
    layout = F.coalesce(*[F.when(t.rlike(shape), F.lit(fmt)) for fmt, shape in layouts])
    year = F.year(F.call_function("try_to_date", t, layout))
    if formats is None:
        year = year - F.when((layout == SHORT_DATE[0]) & (F.substring(t, -2, 2) >= str(PIVOT)), 100).otherwise(0)
    return year
