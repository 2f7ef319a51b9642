"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword; each of its bits is a binary classifier telling the languages with that bit set from
the others by hashed byte trigrams (log odds of n-gram rates, averaged over the text's n-grams). A text's language is
the codeword with the least weighted logistic loss; the weight of a bit for a language is how often that bit is right
for it on labelled texts. A text whose two best codewords are closer than ``AMBIGUOUS`` is flagged.

N-gram counts are taken over all labelled training rows given (aggregated per task before the shuffle); what reaches
the driver is one count per language and hash bucket. Scales and bit weights are estimated on a bounded sample of about
``CALIBRATION`` labelled rows.

A null text, or one without a letter, gives ``und`` with score 0 and is flagged; without any training row every text
does. Repeated rows are predicted alike. An empty table gives an empty result. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
CALIBRATION = 2000
AMBIGUOUS = 0.1
UNKNOWN = "und"
STEP = 1 << 20  # bytes taken at a time: long texts are scored in pieces, never cut short

#: ASCII letters stay, other ASCII becomes a space, bytes of other characters stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1: the exhaustive code up to 7 languages, else a seeded random code with far-apart rows."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        columns = np.arange(1, 1 << (n - 1))
        bits = (columns[None, :] >> np.arange(n)[:, None]) & 1  # the last row is all zero: no complements
        return np.where(bits == 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(seed)
    width, best, far = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        both = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(both, -width)
        least = min((width - both.max()) // 2, width // 2)
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, starts, hash buckets) of trigrams, about ``STEP`` bytes at a time."""
    rows, parts, size = [], [], 0

    def out():
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        mixed = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        return np.array(rows), starts, np.append(mixed >> np.uint32(16), [0, 0]).astype(np.intp)

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.lower().encode().translate(LETTERS)
        for at in range(0, len(data), STEP):
            rows.append(i)
            parts.append(data[max(0, at - 2):at + STEP] + b"  ")
            size += len(parts[-1])
            if size >= STEP:
                yield out()
                rows, parts, size = [], [], 0
    if parts:
        yield out()


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Average log odds of each bit, scaled; zero for texts without n-grams."""
        total = np.zeros((len(texts), self.weights.shape[1]))
        count = np.zeros(len(texts))
        for rows, starts, grams in gram_pieces(texts):
            np.add.at(total, rows, np.add.reduceat(self.weights[grams], starts, axis=0, dtype=np.float32))
            np.add.at(count, rows, np.diff(np.append(starts, len(grams))))
        return total / np.maximum(count, 1)[:, None] / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row."""
        loss = np.stack([(np.logaddexp(0, -2 * margins * c) * t).sum(axis=1)
                         for c, t in zip(self.code, self.trust)], axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(np.clip(4 * (loss.min(axis=1)[:, None] - loss), -50, 0))
        order = np.sort(loss, axis=1)
        gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / odds.sum(axis=1), gap < AMBIGUOUS


def fit(labelled: DataFrame) -> LanguageModel | None:
    """Train on (doc_id, text, lang) rows; rows without lang or text teach nothing."""
    rows = labelled.where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                at = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, _, grams in gram_pieces([texts[i] for i in np.nonzero(langs == lang)[0]]):
                    at += np.bincount(grams, minlength=BUCKETS)
        for lang, at in seen.items():
            some = np.nonzero(at)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()),
                                              pa.array(at[some], pa.int64())], names=["lang", "bucket", "n"])

    counts = (rows.select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    rates = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        rates[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    rates /= rates.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(rates[c == 1].mean(axis=0) / (rates[c == -1].mean(axis=0) if (c == -1).any()
                                                             else 1 / BUCKETS)) for c in code.T], axis=1)
    bits = code.shape[1]
    plain = LanguageModel(languages, code, np.clip(weights, -6, 6).astype(np.float32), np.ones(bits),
                          np.full(code.shape, 1 / bits))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = plain.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found.tolist(), pa.list_(pa.float64()))],
                                             names=["lang", "m"])

    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("scale")), F.lit(max(1, n // CALIBRATION))) == 0)
    sample = some.select("text", F.col("lang").cast("string")).mapInArrow(measure, "lang string, m array<double>")
    sample = sample.toPandas()
    if not len(sample):
        return plain
    margins = np.array(sample["m"].tolist())
    side = code[[languages.index(x) for x in sample["lang"]]]
    scale = np.maximum(np.abs(margins).mean(axis=0), 1e-3)
    right = np.ones(code.shape)
    for i, lang in enumerate(languages):
        own = (sample["lang"] == lang).to_numpy()
        if own.any():
            right[i] = (margins[own] * side[own] > 0).mean(axis=0)
    right = np.maximum(right, 0.05)
    return LanguageModel(languages, code, plain.weights, scale, right / right.sum(axis=1, keepdims=True))


def decide(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text."""
    known = np.array([has_letter(t) for t in texts], bool)
    if model is None or not len(texts):
        none = np.zeros(len(texts))
        return [UNKNOWN] * len(texts), none, none == 0
    best, score, unsure = model.decode(model.margins(texts))
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, np.where(known, score, 0.0), unsure | ~known


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs (doc_id, text)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, unsure = decide(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        label, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_recognised(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language that is not in doubt."""
    at = docs.columns.index("text")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, unsure = decide(batch.column(at).to_pylist(), model)
            yield batch.filter(pa.array(~unsure))

    return docs.mapInArrow(sieve, docs.schema)
