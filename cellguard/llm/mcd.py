"""Quality rules: base rules plus robust multivariate outliers, in DataFrame functions only.

Each document's text statistics are transformed into a short vector. Per language and source, a minimum covariance
determinant estimate of its centre and scatter is found by concentration steps: from two deterministic starts (all
rows; rows within two standard deviations in each coordinate), the ``KEEP`` share of rows with the least Mahalanobis
distance gives the next mean and covariance, and the start that ends with the smaller determinant wins. Documents
farther than the chi-square cutoff are rejected. Distances are counted in logarithmic bins, so each step is one
pre-aggregated pass over the narrow statistics, however large a group is; what is joined back is one row per group.

Groups under ``SMALL`` documents that pass the base rules use their language's estimate, and that of all documents if
the language is as small. Most clean texts hold no symbol and no repeated line, so the core often has no spread there at
all. Every statistic comes from a count, though, and a count of independent events scatters even where its rate is the
same for all documents: by the delta method its transformed value has a variance known from the text's length alone
(``NOISE``). A coordinate's spread, given those before it, is therefore never taken to be less than the mean of that
variance over the core's documents, nor than that of the document judged. ``rejections`` reports the verdicts by language and source.

A null text counts as empty and fails the base rules, as every text under ``MIN_WORDS`` words does. Null language or
source form groups of their own. Repeated rows are judged alike. An empty table gives an empty result. Equality of
three-word windows is decided on the words themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import let

MIN_WORDS, SMALL, KEEP, STEPS = 50, 100, 0.75, 5
CUTOFF = 0.999
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BINS_PER_E = 48
POSITION = (1 << 26) - 1  # low bits of a packed hash: place of a window in its text
VECTOR = ["x_len", "x_sym", "x_dup", "x_rep"]
NOISE = ["v_len", "v_sym", "v_dup", "v_rep"]  # variances of the coordinates under equal rates


def repeat_words(words: Column) -> Column:
    """Struct of n, the words inside three-word windows that occur at least twice among ``words``, and their runs."""
    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def neighbours(s: Column, same) -> Column:
        """Places (low bits, or field p) of entries equal to the one before or after in sorted order."""
        return F.filter(F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x)),
                        lambda x: x.isNotNull())

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), 26) == 0, F.lit(False))

    def count(w: Column) -> Column:
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")))
        # windows whose hashes meet are compared in full: hashes only thin them out
        maybe = let(F.sort_array(packed), lambda s: neighbours(s, alike))
        exact = F.sort_array(F.transform(maybe, lambda x: let(x.bitwiseAND(F.lit(POSITION)).cast("int"), lambda i:
                                         F.struct(window(w, i).alias("t"), i.alias("p")))))
        same = let(exact, lambda s: neighbours(s, lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))))
        places = F.array_sort(F.transform(same, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"), F.lit(0).alias("runs"))
        return F.aggregate(places, zero, lambda a, p: F.struct(
            (a["n"] + p + 3 - F.greatest(p, a["stop"])).alias("n"), (p + 3).alias("stop"),
            (a["runs"] + F.when((p > a["stop"]) | (a["n"] == 0), 1).otherwise(0)).alias("runs")))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"), F.lit(0).alias("runs"))
    return F.when(F.size(words) < 4, none).otherwise(let(words, count))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("repeats"))).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("d")))
        .alias("l")).select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols",
                            F.col("w.repeats.n").cast("long").alias("n_repeat_words"),
                            F.col("w.repeats.runs").alias("n_repeat_runs"),
                            F.col("l.d").cast("long").alias("n_dup_lines"), F.col("l.n").alias("n_lines"))


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the transformed vector and its counting noise.

    A count c of events in n places scatters by sqrt(c): log(c / n) then has the variance 1 / c, sqrt(c / n) has 1 / 4n.
    A passage found a second time is one event and two runs of repeated words, however long it is.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars, lines = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed)
            .withColumn("x_len", F.log(chars / n) * 2)
            .withColumn("x_sym", F.sqrt(F.col("n_symbols") / n))
            .withColumn("x_dup", F.sqrt(F.col("n_dup_lines") / lines))
            # chance repeats grow with the square of the length: this ratio does not depend on it
            .withColumn("x_rep", F.sqrt(F.col("n_repeat_runs") / (2 * n * F.sqrt(n))))
            .withColumn("v_len", 4 / chars).withColumn("v_sym", 1 / (4 * n)).withColumn("v_dup", 1 / (4 * lines))
            .withColumn("v_rep", 1 / (4 * n * F.sqrt(n))))


def chi_square_cdf(x: float, k: int) -> float:
    """Distribution function of the chi-square law with k degrees of freedom (series of the incomplete gamma)."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-17:
        term *= z / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a))) if z > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency() -> float:
    """By how much the covariance of the central ``KEEP`` share of normal rows falls short of that of all."""
    p = len(VECTOR)
    return KEEP / chi_square_cdf(chi_square_quantile(KEEP, p), p + 2)


def estimates(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Mean m_i, lower Cholesky factor l_ij of ``factor`` times the covariance and log determinant, from ``moments``."""
    p = range(len(VECTOR))
    out = sums
    for i in p:
        out = out.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for i in p:
        for j in range(i + 1):
            c = (F.col(f"s_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.lit(factor)
            for k in range(j):
                c = c - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            least = F.col(f"s_v{i}") / F.col("n")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(c, least)) if i == j else c / F.col(f"l_{j}{j}"))
    det = sum((F.log(F.col(f"l_{i}{i}")) for i in p), F.lit(0.0))
    return out.select(*keys, *[f"m_{i}" for i in p], *[f"l_{i}{j}" for i in p for j in range(i + 1)],
                      det.alias("log_det"))


def distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the joined estimate.

    A document shorter than its group's others scatters more: its own counting noise counts where it is the larger.
    """
    out = df
    for i in range(len(VECTOR)):
        z = F.col(VECTOR[i]) - F.col(f"m_{i}")
        for j in range(i):
            z = z - F.col(f"l_{i}{j}") * F.col(f"z_{j}")
        out = out.withColumn(f"z_{i}", z / F.greatest(F.col(f"l_{i}{i}"), F.sqrt(NOISE[i])))
    d2 = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(VECTOR))), F.lit(0.0))
    return out.withColumn("d2", d2).drop(*[f"z_{i}" for i in range(len(VECTOR))])


def moments() -> list[Column]:
    p = range(len(VECTOR))
    return [F.count(F.lit(1)).alias("n"), *[F.sum(VECTOR[i]).alias(f"s_{i}") for i in p],
            *[F.sum(NOISE[i]).alias(f"s_v{i}") for i in p],
            *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s_{i}{j}") for i in p for j in range(i + 1)]]


def robust_estimates(rows: DataFrame, key: str) -> DataFrame:
    """MCD estimate per ``key`` over rows with the vector and its noise; one row per key."""
    p, factor = range(len(VECTOR)), consistency()
    sums = ["n", *[f"s_{i}" for i in p], *[f"s_v{i}" for i in p], *[f"s_{i}{j}" for i in p for j in range(i + 1)]]
    plain = cut_lineage(estimates(rows.groupBy(key).agg(*moments()), [key]), "start")
    centred = rows.join(plain, key)
    inside = F.lit(True)
    for i, x in enumerate(VECTOR):
        spread = F.sqrt(sum((F.col(f"l_{i}{j}") ** 2 for j in range(i + 1)), F.lit(0.0)))
        inside = inside & (F.abs(F.col(x) - F.col(f"m_{i}")) <= 2 * spread)
    trimmed = estimates(centred.where(inside).groupBy(key).agg(*moments()), [key])
    now = cut_lineage(plain.withColumn("start", F.lit(1)).unionByName(trimmed.withColumn("start", F.lit(2))), "mcd")
    ranked = Window.partitionBy(key, "start").orderBy("bin")
    for _ in range(STEPS):
        far = distance(rows.join(now, key))
        far = far.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS_PER_E))
        bins = far.groupBy(key, "start", "bin").agg(*moments())
        # bins below the KEEP share of the group's rows, and the one that reaches it
        bins = (bins.withColumn("below", F.coalesce(F.sum("n").over(
            ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("all", F.sum("n").over(Window.partitionBy(key, "start"))))
        core = bins.where(F.col("below") < KEEP * F.col("all"))
        core = core.groupBy(key, "start").agg(*[F.sum(c).alias(c) for c in sums])
        now = cut_lineage(estimates(core, [key, "start"], factor), "mcd")
    best = now.groupBy(key).agg(F.min(F.struct("log_det", "start")).alias("b"))
    best = best.select(key, F.col("b.start").alias("start"))
    return cut_lineage(now.join(best, [key, "start"]).drop("start"), "mcd")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept."""
    stats = cut_lineage(with_vector(text_statistics(docs)), "statistics")
    good = stats.where(~F.col("base_failed"))
    levels = {"own": F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
              "tongue": F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}), "all": F.lit("all")}
    # each document teaches the estimate of its pair, of its language and of the whole, where those are asked for
    counts = good.groupBy(levels["own"].alias("own"), levels["tongue"].alias("tongue")).agg(
        F.count(F.lit(1)).alias("n"))
    tongues = counts.groupBy("tongue").agg(F.sum("n").alias("n_tongue"))
    use = F.when(F.col("n") >= SMALL, F.col("own")).when(F.col("n_tongue") >= SMALL, F.col("tongue")).otherwise("all")
    chosen = cut_lineage(counts.join(tongues, "tongue").select("own", "tongue", use.alias("key")), "levels")
    wanted = chosen.select("key").distinct()
    taught = good.select(F.explode(F.array(*levels.values())).alias("key"), *VECTOR, *NOISE).join(wanted, "key", "left_semi")
    fitted = robust_estimates(cut_lineage(taught, "taught"), "key")
    limit = chi_square_quantile(CUTOFF, len(VECTOR))
    judged = distance(stats.withColumn("own", levels["own"]).join(chosen.select("own", "key"), "own", "left")
                      .join(fitted, "key", "left"))
    inlier = F.coalesce(F.col("d2") <= limit, F.lit(True))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", F.col("d2"), (~F.col("base_failed") & inlier).alias("kept"))


def rejections(judged: DataFrame) -> DataFrame:
    """Per language and source of ``quality``'s rows: documents, those the base rules fail, those the distance rejects."""
    return judged.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("n_failed"),
        F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("n_rejected"))
