"""Packing documents into fixed-length token sequences by cutting-stock column generation.

Documents become token ids and an end id, cut into full sequences and one remainder. The histogram of remainder
lengths (in units of ``unit`` tokens) is the demand of a cutting-stock linear program over patterns: which lengths
share a sequence. The program starts with one-length patterns; an unbounded-knapsack dynamic program prices new
columns with the duals until none improves the bound by more than ``gap``. Patterns are rounded down and used that
often, what is left over is packed first-fit decreasing, and ranks of documents within their length class decide
which documents fill which pattern. The program only sees the histogram, whose size depends on the sequence length
and not on the corpus; tokenizing, ranking and assignment are distributed.

A null text is an empty document (its end id alone); repeated rows are packed as rows of their own; an empty table
gives an empty result. A text of any length is cut, never shortened.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import global_rank

SEQUENCE = 2048
END_ID = 1
#: Chunks kept encoded per Python worker; beyond this many the memo starts afresh (results do not depend on it).
MEMO = 1_000_000
MARKS = ".,;:!?|()[]\"*#-"
#: The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_workers: dict = {}


class Chunks(dict):
    """Ids (packed) of a word with its leading space and the marks after it; an unseen one is encoded and kept.

    Letters alone are one pre-token, which goes straight to the model; marks after them are another. Anything that
    holds other white space raises, as its pre-tokens depend on what stands around it.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.merge = tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if word.removeprefix(" ").isalpha():
            if word != chunk:
                ids = self[word] + self[chunk[len(word):]]
            else:
                ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(BYTE_CHARS))])
                ids = ids.tobytes()
        elif chunk == "\n" or chunk.split() == [chunk.removeprefix(" ")]:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            raise ValueError("white space inside")
        self[chunk] = ids
        return ids


class Encoder:
    """Token ids of a text, little-endian unsigned 32-bit.

    Merges never cross the pre-tokens of the vocabulary's pattern, and a pre-token never crosses the start of
    `` word`` or a single line break, so the ids of a text are those of such chunks in order. Any other white space
    (runs, tabs, leading or trailing) or the name of an added token sends the whole text to the tokenizer instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Chunks(self.tokenizer)

    def packed(self, text: str) -> bytes:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        try:
            if "\0" not in text and not any(t in text for t in self.added):
                return b"".join([memo[c] for c in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")])
        except ValueError:
            pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _workers[path] = Encoder(path)
    return _workers[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces of ``size`` ids and one remainder per document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1)):
                packed = enc.packed(text.as_py() or "") + end
                n = len(packed) // 4
                rows.extend((doc, at, min(size, n - at), zlib.crc32(packed[4 * at:4 * (at + size)]), n)
                            for at in range(0, n, size))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most worth that fits, and how often each size is taken."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            gain = value[c - sizes[:fit]] + worth[:fit]
            k = int(gain.argmax())
            if gain[k] > value[c] + 1e-12:
                value[c], took[c] = gain[k], k
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3) -> tuple:
    """Patterns (columns) and their fractional uses from column generation; sizes ascending, demand positive."""
    m = len(sizes)
    each = capacity // sizes
    basis = np.diag(each.astype(float))
    inverse = np.diag(1.0 / each)
    use = demand / each
    for _ in range(100 * m + 100):
        duals = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, duals, capacity)
        if worth <= 1 + gap:  # Farley: the optimum is at least sum(use) / worth
            break
        step = inverse @ column
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.full(m, np.inf)
        ratio[can] = use[can] / step[can]
        out = int(ratio.argmin())
        amount = ratio[out]
        use = use - amount * step
        use[out] = amount
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return basis, np.maximum(use, 0)


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Assignment table and number of sequences for {size: count}.

    Table rows (size, first rank, end rank, first sequence, pieces per sequence), ranks counted within the size and
    covering every rank once.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return np.zeros((0, 5), np.int64), 0
    demand = np.array([histogram[s] for s in sizes], dtype=float)
    basis, use = cutting_stock(sizes, demand, capacity)
    rows, given, sequence = [], np.zeros(len(sizes), np.int64), 0
    for p in range(len(sizes)):
        times = int(np.floor(use[p] + 1e-7))
        held = np.rint(basis[:, p]).astype(np.int64)
        while times and (given + held * times > demand).any():
            times -= 1
        for i in np.nonzero(held)[0] if times else ():
            rows.append((sizes[i], given[i], given[i] + held[i] * times, sequence, held[i]))
        given += held * times
        sequence += times
    room: list[int] = []  # what rounding left over: first fit, longest first
    for i in range(len(sizes) - 1, -1, -1):
        for rank in range(given[i], int(demand[i])):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= sizes[i]
            rows.append((sizes[i], rank, rank + 1, sequence + at, 1))
    return np.array(sorted(rows), np.int64), sequence + len(room)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, unit: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = cut_lineage(pieces(docs, tokenizer, size), "pieces")
    cut = cut.withColumn("_size", F.ceil(F.col("length") / unit).cast("long"))
    counts = cut.groupBy("_size").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["_size"]: r["n"] for r in counts.collect()}  # at most size / unit rows
    capacity = size // unit
    starts, at = {}, 0
    for s in sorted(histogram):
        starts[s], at = at, at + histogram[s]
    table, _ = plan(histogram, capacity)
    first = np.array([starts.get(s, 0) for s in range(capacity + 1)], np.int64)

    @F.pandas_udf("long")
    def sequence(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        s = sizes.to_numpy()
        r = ranks.to_numpy() - first[s]
        span = np.int64(1) << 40
        k = np.searchsorted(table[:, 0] * span + table[:, 1], s * span + r, side="right") - 1
        return pd.Series(table[k, 3] + (r - table[k, 1]) // table[k, 4])

    ranked = global_rank(cut, ["_size", "doc_id", "start", "ids_crc32", "length", "doc_tokens"], "_rank")
    placed = ranked.withColumn("sequence_id", sequence("_size", "_rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("_size", "_rank")


def packed_tokens(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_id, offset, ids of each piece (tokenizes once more)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(enc.packed(text or "") + end, "<u4").astype(np.int32)
                at = range(0, len(ids), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(at), pa.int64()), pa.array(list(at), pa.int64()),
                     pa.array([ids[a:a + size].tolist() for a in at], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "ids"])

    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        slices, "doc_id long, start long, ids array<int>")
    where = pack(docs, tokenizer, size).select("doc_id", "start", "sequence_id", "offset")
    return where.join(ids, ["doc_id", "start"])
