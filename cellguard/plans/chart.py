"""Q1 filter chart on the cell table.

Exclusion is decided per (sex, age-bin) cell, so the chart never needs the excluded subjects themselves:

1. ``cell_table``: subjects (left-joined with the selected cases) -> one ``groupBy`` over
   (sel, sex, enrollment, bl_bin, fu_bin) with count / sum / count of follow-up years. This is the only pass over
   subject rows and the only shuffle whose input grows with the data; partial aggregation runs map-side, so a hot
   (sex, bin) cell is pre-aggregated in every task before the exchange.
2. Everything after that reads the cell table, whose size is bounded by |sex| * |enrollment| * (bins+1)^2.

The reference's shortcuts are kept: no filter or a selection covering the population returns the un-jittered
(masked) answer over everyone; an empty selection returns that answer with every number zeroed (A16).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChartConfig
from ..functions.privacy import jitter_and_mask
from ..functions.text import capitalize
from ..operators.histogram import age_bin, bucket_of
from ..session import cut_lineage

AGES = ("age_bl", "age_fu")


@dataclass
class ChartResult:
    subject_counts: DataFrame  # (section, pos, id, header, value)
    age_bl: DataFrame  # (bin, bucket, label, value)
    age_fu: DataFrame

    def pivot(self, which: str, labels: list[str]) -> DataFrame:
        """One row per age bucket, one column per label (the chart's table shape)."""
        return pivot_chart(getattr(self, which), labels)


def cell_table(subjects: DataFrame, cfg: ChartConfig, selected: DataFrame | None = None) -> DataFrame:
    """Step 1: (sel, sex, enrollment, bl_bin, fu_bin, n, fsum, fcnt)."""
    cfg.check_axis()
    s = subjects.select("case", "age_bl", "age_fu", "sex", "enrollment", "followup_years")
    if selected is None:
        s = s.withColumn("sel", F.lit(True))
    else:
        marks = selected.select("case").withColumn("hit", F.lit(True))
        s = s.join(marks, "case", "left").withColumn("sel", F.coalesce(F.col("hit"), F.lit(False)))
    return s.groupBy(
        "sel",
        "sex",
        "enrollment",
        age_bin(F.col("age_bl"), cfg).alias("bl_bin"),
        age_bin(F.col("age_fu"), cfg).alias("fu_bin"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("followup_years").cast("long").alias("fsum"),
        F.count("followup_years").alias("fcnt"),
    )


def _matrices(cells: DataFrame, cfg: ChartConfig, jitter: bool) -> DataFrame:
    """Both sex-by-age matrices from the cells in one aggregation: (age, sex, label, bin, bucket, raw, value, masked).

    One ``groupBy(sex)`` gathers each sex's cells (at most |enrollment| x (bins+1)^2 of them); the dense grid of
    (age, bin) is then filled with higher-order functions inside that row, so no label ``distinct`` and no join of
    counts back onto a grid is needed.
    """
    per_sex = cells.where(F.col("sex").isNotNull()).groupBy("sex").agg(
        F.collect_list(F.struct("bl_bin", "fu_bin", "n")).alias("cs")
    )
    grid = F.array(*[F.struct(F.lit(a).alias("age"), F.lit(b).alias("bin")) for a in AGES for b in range(cfg.n_bins)])
    g = per_sex.select("sex", "cs", F.explode(grid).alias("g")).select(
        "sex", "cs", F.col("g.age").alias("age"), F.col("g.bin").alias("bin"))
    in_cell = F.filter("cs", lambda c: F.when(F.col("age") == "age_bl", c["bl_bin"]).otherwise(c["fu_bin"])
                       == F.col("bin"))
    raw = F.aggregate(in_cell, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    label = capitalize(F.col("sex"))
    return g.select("age", "sex", "bin", raw.alias("raw")).select(
        "age", "sex", label.alias("label"), "bin", bucket_of(F.col("bin"), cfg).alias("bucket"), "raw",
        jitter_and_mask(F.col("raw"), F.concat(label, F.col("bin").cast("string")), cfg, jitter).alias("value"),
    ).withColumn("masked", (F.col("raw") > 0) & (F.col("value") == 0))


def chart_parts(cells: DataFrame, cfg: ChartConfig, jitter: bool = True) -> dict:
    """Steps 2-4 on cells of one selection; returns the pieces the chart and the single-purpose queries use.

    One-row results (the two published totals, the follow-up sums) are scalar subqueries: each is computed once and
    read as a value by the rows that need it, with no join.
    """
    spark = cells.sparkSession
    m = _matrices(cells, cfg, jitter)
    bl = m.where(F.col("age") == "age_bl").drop("age")
    fu = m.where(F.col("age") == "age_fu").drop("age")
    # The age whose published (censored) total is larger wins; ties go to follow-up
    s_bl = m.agg(F.coalesce(F.sum(F.when(F.col("age") == "age_bl", F.col("value"))), F.lit(0))).scalar()
    s_fu = m.agg(F.coalesce(F.sum(F.when(F.col("age") == "age_fu", F.col("value"))), F.lit(0))).scalar()
    use_bl = s_bl > s_fu
    chosen = m.where(F.col("age") == F.when(use_bl, F.lit("age_bl")).otherwise(F.lit("age_fu")))
    masked = chosen.where("masked").select("sex", F.col("bin").alias("chosen_bin"))
    # cells of masked (sex, bin) of the chosen age leave every other statistic; a NULL bin never matches
    kept = cells.withColumn("chosen_bin", F.when(use_bl, F.col("bl_bin")).otherwise(F.col("fu_bin"))).join(
        masked, ["sex", "chosen_bin"], "left_anti")
    # Enrolment totals over the kept cells, jittered and masked on the total with the plain label
    enr = kept.where(F.col("enrollment").isNotNull()).groupBy("enrollment").agg(
        F.coalesce(F.sum(F.when(F.col("chosen_bin").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("raw")
    ).withColumn("label", capitalize(F.col("enrollment")))
    if cfg.enrollment_retain:
        enr = enr.where(F.lower("label").isin([r.lower() for r in cfg.enrollment_retain]))
    enr = enr.withColumn("value", jitter_and_mask(F.col("raw"), F.col("label"), cfg, jitter))
    # Mean follow-up over every kept subject (NULL and under-min ages included)
    follow = kept.agg(F.sum("fsum").alias("fsum"), F.sum("fcnt").alias("fcnt"))
    # A5 totals per sex from the chosen matrix
    sex_totals = chosen.groupBy("sex", "label").agg(F.sum("value").alias("value"))
    return {
        "bl": bl,
        "fu": fu,
        "s_bl": s_bl,
        "s_fu": s_fu,
        "use_bl": use_bl,
        "choice": spark.range(1).select(s_bl.alias("s_bl"), s_fu.alias("s_fu"), use_bl.alias("use_bl")),
        "kept": kept,
        "enrollment": enr,
        "follow": follow,
        "fsum": kept.agg(F.sum("fsum")).scalar(),
        "fcnt": kept.agg(F.sum("fcnt")).scalar(),
        "sex_totals": sex_totals,
    }


def round2_ratio(num: Column, den: Column) -> Column:
    """round(num / den, 2), ties to even, in exact integer arithmetic (same digits in every engine)."""
    hundred = F.lit(100) * num
    low = F.floor(hundred / den)
    twice = F.lit(2) * (hundred - low * den)  # against den: below, at or above half
    q = low + F.when((twice > den) | ((twice == den) & (low % 2 != 0)), 1).otherwise(0)
    return (q / F.lit(100.0)).cast("double")


def subject_counts(parts: dict, population: DataFrame, cfg: ChartConfig, no_result: Column | None = None):
    """A10: total, selected, enrolment rows, sex rows, mean follow-up -> (section, pos, id, header, value)."""
    upd = cfg.update_text()
    title = cfg.cohort_title
    head = parts["bl"].sparkSession.range(1)
    pop = population.select("population").scalar()
    fsum, fcnt = parts["fsum"], parts["fcnt"]
    selected = F.when(parts["use_bl"], parts["s_bl"]).otherwise(parts["s_fu"])
    ok = selected > F.lit(cfg.mask)
    if no_result is not None:
        ok = ok & ~no_result
    mean = F.when(ok & (fcnt > 0), round2_ratio(fsum, fcnt)).otherwise(F.lit(0.0))
    sel_shown = F.when(ok, F.least(selected, pop)).otherwise(F.lit(0))
    total_row = head.select(
        F.lit(0).alias("section"), F.lit(1).alias("pos"), F.lit("total-count").alias("id"),
        F.lit(f"Total {title} Population {upd}".strip()).alias("header"),
        pop.cast("double").alias("value"),
    )
    sel_row = head.select(
        F.lit(1).alias("section"), F.lit(1).alias("pos"), F.lit("selected-count").alias("id"),
        F.lit("Current Selection").alias("header"), sel_shown.cast("double").alias("value"),
    )
    fu_row = head.select(
        F.lit(4).alias("section"), F.lit(1).alias("pos"), F.lit("followup-years").alias("id"),
        F.lit(f"{title} Follow-up {upd} (mean years)".strip()).alias("header"), mean.alias("value"),
    )
    enr = parts["enrollment"].select(
        F.lit(2).alias("section"),
        F.row_number().over(Window.partitionBy(F.lit(2)).orderBy("enrollment")).alias("pos"),
        F.lower(F.concat(F.lit("enroll-"), F.col("label"), F.lit("-count"))).alias("id"),
        F.concat(F.lit("- "), F.col("label"), F.lit(f" {upd}")).alias("header"),
        F.col("value").cast("double").alias("value"),
    )
    sex = parts["sex_totals"].select(
        F.lit(3).alias("section"),
        F.row_number().over(Window.partitionBy(F.lit(3)).orderBy("sex")).alias("pos"),
        F.lower(F.concat(F.lit("sex-"), F.col("label"), F.lit("-count"))).alias("id"),
        F.concat(F.lit("- "), F.col("label")).alias("header"),
        F.col("value").cast("double").alias("value"),
    )
    return total_row.unionByName(sel_row).unionByName(enr).unionByName(sex).unionByName(fu_row)


def _matrix_out(m: DataFrame) -> DataFrame:
    return m.select("bin", "bucket", "label", F.col("value").cast("long").alias("value"))


def _zeroed(df: DataFrame) -> DataFrame:
    """The same rows with every number 0."""
    return df.withColumn("value", (F.col("value") * 0).cast(df.schema["value"].dataType))


def filter_chart(
    subjects: DataFrame,
    cfg: ChartConfig,
    selected: DataFrame | None = None,
    jitter: bool = True,
    cells: DataFrame | None = None,
    precomputed: dict | None = None,
) -> ChartResult:
    """Q1. ``selected`` is DataFrame[case] from ``operators.filters.select_cases`` (None = no filter).

    With a selection, the two totals of the materialised cell table (selected subjects, population) are read as
    one row to choose the reference's shortcut, so only the plan of the chosen answer is built: the filtered
    chart, the un-jittered chart over everyone (the selection covers the population) or its zeroed copy (empty
    selection). ``precomputed`` (from ``plans.precompute.read_precomputed``, written with the same ``cfg``)
    supplies the population and the answers over everyone, as the reference serves them.
    """
    if precomputed is not None and selected is None:
        return ChartResult(*(precomputed[f"chart_{n}"] for n in ("subject_counts", "age_bl", "age_fu")))
    if cells is None:
        # the cell table is small (bounded by labels x bins^2) and feeds every branch below: materialise it once
        cells = cut_lineage(cell_table(subjects, cfg, selected), "cells")
    spark = cells.sparkSession

    def over_everyone() -> tuple[ChartResult, DataFrame]:
        if precomputed is not None:
            pre = ChartResult(*(precomputed[f"chart_{n}"] for n in ("subject_counts", "age_bl", "age_fu")))
            return pre, precomputed["population"]
        everyone = cells.groupBy("sex", "enrollment", "bl_bin", "fu_bin").agg(
            F.sum("n").alias("n"), F.sum("fsum").alias("fsum"), F.sum("fcnt").alias("fcnt")
        )
        population = everyone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("population"))
        base = chart_parts(everyone, cfg, jitter=False)
        return ChartResult(subject_counts(base, population, cfg), _matrix_out(base["bl"]),
                           _matrix_out(base["fu"])), population

    if selected is None:
        return over_everyone()[0]
    totals = cells.agg(
        F.coalesce(F.sum(F.when(F.col("sel"), F.col("n"))), F.lit(0)).alias("n_sel"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("population"),
    ).first()
    if totals.n_sel == 0 or totals.n_sel >= totals.population:
        full, _ = over_everyone()
        if totals.n_sel == 0:
            return ChartResult(_zeroed(full.subject_counts), _zeroed(full.age_bl), _zeroed(full.age_fu))
        return full
    population = spark.range(1).select(F.lit(totals.population).cast("long").alias("population"))
    parts = chart_parts(cells.where("sel").drop("sel"), cfg, jitter=jitter)
    return ChartResult(subject_counts(parts, population, cfg), _matrix_out(parts["bl"]), _matrix_out(parts["fu"]))


def pivot_chart(m: DataFrame, labels: list[str]) -> DataFrame:
    """[Age, label1, label2, ...] rows; labels are passed in so the plan needs no extra distinct job."""
    return m.groupBy("bin", "bucket").pivot("label", labels).agg(F.first("value")).orderBy("bin")
