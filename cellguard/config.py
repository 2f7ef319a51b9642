"""Chart and load settings (the reference keeps these in a config module)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ChartConfig:
    """Axis, privacy and wording settings of the filter chart.

    ``as_of`` seeds the weekly jitter; it is always explicit so that a result never depends on the wall clock.
    ``jitter_salt=None`` switches jitter off (masking still applies).
    """

    age_min: int | None = 35
    age_max: int | None = 75
    age_step: int | None = 5
    mask: int = 5
    jitter_salt: str | None = "DEFAULT"
    jitter_min: int = -2
    jitter_max: int = 2
    as_of: _dt.date = _dt.date(2024, 12, 30)
    enrollment_retain: tuple[str, ...] = ()
    cohort_title: str = ""
    update_date: str | None = None

    def with_(self, **kw) -> "ChartConfig":
        return replace(self, **kw)

    @property
    def n_bins(self) -> int:
        return -(-(self.age_max - self.age_min) // self.age_step)

    def check_axis(self) -> None:
        if None in (self.age_min, self.age_max, self.age_step):
            raise ValueError("age axis incomplete: infer it with operators.ranges.age_axis first")
        if (self.age_max - self.age_min) % self.age_step:
            # the top bucket label `(max-step)+` only matches the bin edges on a whole number of steps
            raise ValueError("age_max - age_min must be a multiple of age_step")

    def jitter_prefix(self) -> str:
        year, week, _ = self.as_of.isocalendar()
        return f"{year}-W{week}_"

    def update_text(self) -> str:
        return f"through {self.update_date}" if self.update_date else ""


@dataclass(frozen=True)
class LoadConfig:
    """Cohort load settings: chart-variable roles, rounding and axis bounds."""

    # cohort column -> chart role (age_bl, age_fu, gender, enrollment, followup_years)
    datamodel_vars: dict = field(default_factory=dict)
    case_col: str | None = None
    skip_rounding: frozenset = frozenset()
    age_min: int | None = None
    age_max: int | None = None
    age_step: int | None = None
    dictionary_only: bool = False
    use_desc: bool = False
    enrollment_mapping: str | None = None
    gender_mapping: str | None = None
    min_priority: int = 0
    target_columns: tuple[str, ...] | None = None
    round_years: int = 5  # 1 keeps columns of years (not ages) at whole years instead of 5-year bins (decision D16)

    @property
    def followup_column(self) -> str | None:
        for col, role in self.datamodel_vars.items():
            if role == "followup_years":
                return col
        return None

    @property
    def all_skip_rounding(self) -> frozenset:
        fu = self.followup_column
        return frozenset(self.skip_rounding) | ({fu} if fu else set())
