"""Near-duplicate documents by SimHash, linked through pivot distance tables.

Each distinct fingerprint gets a table row of its Hamming distances to ``PIVOTS`` fixed reference fingerprints. By the
triangle inequality two fingerprints within ``bits`` of each other differ by at most ``bits`` in every coordinate, so
pairs with a larger coordinate difference are dropped and only survivors are verified bit by bit.

To avoid comparing all pairs of the corpus, fingerprints are first dealt by equality of blocks: of ``bits + 2``
blocks at least two are untouched by ``bits`` flips, so linked pairs share at least one of the block-pair keys. That
step loses nothing; the table then decides inside each key, in order of the first coordinate, so a row only meets the
rows within ``bits`` of it there. Keys holding more than ``SPLIT`` fingerprints are split into sub-groups whose pairs
are separate tasks. Tasks return a spanning forest of their links, never all pairs, and components are found on
distinct fingerprints, so a group of copies is one node however large.

A null text has no words: fingerprint zero, linked like any other. Fewer words than the shingle length: one shingle of
all of them. Repeated rows link to each other. An empty table gives an empty result. A null doc_id is never the
smallest of its component unless all are null (then the component is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import components

WORDS, BITS, SEED = 4, 4, 42
PIVOTS, SPLIT = 16, 4096
#: Reference fingerprints: any spread of 64-bit numbers will do; these follow from a seed.
REFERENCE = np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles (repeats included) hashed by XXH64."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1:] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for a in range(0, len(starts), 100_000):
        h = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in
                      zip(starts[a:a + 100_000], stops[a:a + 100_000])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp): text_key hashes the text, fp is the fingerprint's 64 bits as a signed LONG."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(
        scan, "doc_id long, text_key long, fp long")


def block_keys(bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each pair of blocks: its number and the (shift, width) of both."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]
    return list(enumerate(combinations(blocks, 2)))


def local_links(keys: np.ndarray, fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, root index) of rows sorted by (key, first coordinate); whole keys only."""
    n = len(fp)
    root = np.arange(n)
    low = np.arange(n)
    first = table[:, 0].astype(np.int16)
    step = 0
    while len(low):
        step += 1
        low = low[low < n - step]
        near = (keys[low] == keys[low + step]) & (first[low + step] - first[low] <= bits)
        low = low[near]  # sorted: whoever fails here fails for every larger step
        a, b = low, low + step
        for p in range(1, table.shape[1]):
            keep = np.abs(table[a, p].astype(np.int16) - table[b, p]) <= bits
            a, b = a[keep], b[keep]
            if not len(a):
                break
        keep = (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (root[a] != root[b])
        a, b = a[keep], b[keep]
        if len(a):
            for x, y in zip(a.tolist(), b.tolist()):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
            while (flat := root[root]).tobytes() != root.tobytes():
                root = flat
    linked = np.nonzero(root != np.arange(n))[0]
    return linked, root[linked]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) at most ``bits`` apart."""

    @F.pandas_udf("binary")
    def distances(fp: pd.Series) -> pd.Series:
        apart = np.bitwise_count(fp.to_numpy().view(np.uint64)[:, None] ^ REFERENCE[None, :]).astype(np.uint8)
        return pd.Series([row.tobytes() for row in apart])

    table = prints.select("fp", distances("fp").alias("table"))
    keys = []
    for number, blocks in block_keys(bits):
        key = F.lit(number).cast("long")
        for shift, width in blocks:
            key = F.shiftleft(key, width) + F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(key)
    dealt = cut_lineage(table.select("fp", "table", F.explode(F.array(*keys)).alias("key")), "blocks")
    hot = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
    hot = cut_lineage(hot.select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.concat_ws(
        "-", F.least(x.cast("long"), own), F.greatest(x.cast("long"), own)))
    dealt = dealt.join(hot, "key", "left").select(
        "key", "fp", "table", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(""))).otherwise(meets))
        .alias("part"))
    dealt = dealt.select(F.xxhash64("key", "part").alias("task"), "key", "part", "fp", "table",
                         F.substring("table", 1, 1).alias("first"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            earlier = np.nonzero(rest["task"].to_numpy() != rest["task"].iat[-1])[0] if len(rest) else []
            if len(earlier):  # all but the last task are whole
                yield forest(rest.iloc[:earlier[-1] + 1])
                rest = rest.iloc[earlier[-1] + 1:]
        if rest is not None and len(rest):
            yield forest(rest)

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        grid = np.frombuffer(b"".join(rows["table"]), np.uint8).reshape(len(rows), PIVOTS)
        # two keys may share a task number: links between them are verified like any other, so none is wrong
        a, b = local_links(rows["task"].to_numpy(), fp, grid, bits)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    placed = dealt.select("task", "fp", "table", "first").repartition("task").sortWithinPartitions("task", "first")
    return placed.select("task", "fp", "table").mapInPandas(compare, "a long, b long")


def rooted(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, text_key, fp, root): root is one fingerprint of the component, the same for all its rows."""
    prints = cut_lineage(fingerprints(docs, words), "prints")
    distinct = cut_lineage(prints.select("fp").distinct(), "distinct")
    roots = cut_lineage(components(links(distinct, bits)).where("node <> root"), "roots")
    named = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return named.select("doc_id", "text_key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    rows = cut_lineage(rooted(docs, words, bits), "rooted")
    least = cut_lineage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their component: by doc_id (null last), then text.

    Of rows with equal doc_id and text the least in all columns stays.
    """
    rows = rooted(docs, words, bits)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
                                     .alias("f"), F.count(F.lit(1)).alias("n")).select("f.*", "n")
    first = cut_lineage(first.drop("none"), "first").alias("f")
    own = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string"))).alias("d")
    same = (F.col("d.__key") == F.col("f.text_key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id"))
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    alone = own.join(first.where("n = 1"), same, "left_semi").select(*cols)
    # groups of several rows may hold the first one twice
    several = own.join(first.where("n > 1"), same).groupBy("f.text_key", "f.doc_id").agg(
        F.min(F.struct(*cols)).alias("row")).select("row.*")
    return alone.unionByName(several)
