"""Small-cell protection: stable weekly jitter (F17) and masking (F18), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ChartConfig


def mask(value: Column, m: int) -> Column:
    """keep the value only when it is larger than the mask, else 0."""
    return F.when(value > F.lit(m), value).otherwise(F.lit(0).cast("long"))


def noise(label: Column, cfg: ChartConfig) -> Column:
    """Stable integer noise in [jitter_min, jitter_max] seeded by ISO year-week of ``as_of``, label and salt.

    The seed text is ``{isoyear}-W{week}_{label}_{salt}``; its md5 (first 8 hex digits) picks the offset, so the
    same cell gets the same noise on every executor, every run, all week.
    """
    seed = F.concat(F.lit(cfg.jitter_prefix()), label, F.lit(f"_{cfg.jitter_salt}"))
    span = cfg.jitter_max - cfg.jitter_min + 1
    h = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(span)) + F.lit(cfg.jitter_min)


def jitter_and_mask(value: Column, label: Column, cfg: ChartConfig, jitter: bool = True) -> Column:
    """F17 then F18; with ``jitter=False`` or no salt configured only the mask applies."""
    if jitter and cfg.jitter_salt is not None:
        value = value + noise(label, cfg)
    return mask(value.cast("long"), cfg.mask)
