"""Random cohorts for trying the tool, generated in parallel from a subject spine.

Values are drawn from deterministic per-row hashes of (seed, subject, field), so every partition generates its own
rows independently and re-running gives the same cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sample cohort's categories.
SEXES = ["male", "female"]
RACES = ["white", "black", "asian", "hp/pi", "other"]
YES_NO = ["yes", "no"]
STATUS = ["alive", "dead"]


def _u(case: Column, seed: int, field: str) -> Column:
    """A uniform [0, 1) number from (seed, case, field)."""
    h = F.xxhash64(F.lit(seed), case, F.lit(field))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def _pick(case: Column, seed: int, field: str, options: list[str]) -> Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(_u(case, seed, field) * len(options)) + 1).cast("int"))


def _int(case: Column, seed: int, field: str, lo: int, hi: int) -> Column:
    """Integer in [lo, hi]."""
    return (F.floor(_u(case, seed, field) * (hi - lo + 1)) + lo).cast("int")


def synth_cohort(spine: DataFrame, case_col: str = "case", seed: int = 0) -> DataFrame:
    """One random subject per spine row: ages 65-101, sex, race, hispanic, CASI baseline/follow-up 0-100,
    any AD / any dementia, current status, and the three enrolment-year integers."""
    c = F.col(case_col)
    to_fu = _int(c, seed, "to_fu", 0, 29)
    follow = (F.floor(_u(c, seed, "follow") * (to_fu + 1)) + 2).cast("int")
    return spine.select(
        c.alias("case"),
        _int(c, seed, "age_bl", 65, 101).alias("age_bl"),
        _int(c, seed, "age_fu", 65, 101).alias("age_fu"),
        _pick(c, seed, "sex", SEXES).alias("sex"),
        _pick(c, seed, "race", RACES).alias("race"),
        _pick(c, seed, "hispanic", YES_NO).alias("hispanic"),
        _int(c, seed, "casi_bl", 0, 100).alias("casi_bl"),
        _int(c, seed, "casi_fu", 0, 100).alias("casi_fu"),
        _pick(c, seed, "any_ad", YES_NO).alias("any_ad"),
        _pick(c, seed, "any_dementia", YES_NO).alias("any_dementia"),
        _pick(c, seed, "status", STATUS).alias("enrollment"),
        _int(c, seed, "before_bl", 0, 29).alias("enroll_before_baseline"),
        to_fu.alias("enroll_to_followup"),
        follow.alias("followup_years"),
    )
