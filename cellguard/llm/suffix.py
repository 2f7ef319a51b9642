"""Removing repeated byte strings: suffix arrays by Larsson-Sadakane refinement, Kasai common prefixes, binary search.

A byte is removed if it lies in a ``LENGTH``-byte string that also starts in a document with a smaller doc_id.

Every such string (a window) contains a lowest-hashed ``GRAM``-byte gram (the leftmost on ties), and a run of windows
with the same lowest gram is one stretch of text. Equal windows have equal grams, so stretches are dealt by that
hash and equal windows always meet in one part. In two rounds over blocks of documents (see ``blocks``):

1. blocks send the hashes of their lowest grams; only grams in two or more documents go on;
2. blocks send the distinct stretches around those grams with their smallest document. Each part cuts its
   distinct stretches into shards of ``SHARD`` bytes, builds each shard's suffix array in numpy, groups its windows by
   common prefixes of ``LENGTH`` or more, and merges shards by binary search of their sorted windows. A block gets
   back, for each stretch, its smallest document and which of its windows start in a smaller one yet.

All comparisons that decide are on bytes; hashes only choose who meets whom. What a task holds is a block, or a part
whose number follows from the corpus size. A stretch that a third of all documents share is sent once a block.

A null text is empty. A null doc_id counts as larger than every id and not smaller than another null. Documents with
equal doc_id never remove from each other; repeated rows get equal results. Texts shorter than ``LENGTH`` stay. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from . import blocks as B

LENGTH, GRAM = 50, 20
SHARD = 1 << 20
SPAN = LENGTH - GRAM + 1  # grams in a window
LAST = np.iinfo(np.int64).max
_rng = np.random.default_rng(20)
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
FACTORS = _rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM = 16 + 4 bytes from each position (the last 19 positions have none)."""
    one = BYTE_HASH[data]
    two = one[:-1] * FACTORS[0] + one[1:]
    four = two[:-2] * FACTORS[1] + two[2:]
    eight = four[:-4] * FACTORS[2] + four[4:]
    sixteen = eight[:-8] * FACTORS[3] + eight[8:]
    h = sixteen[:-4] * FACTORS[4] + four[16:]
    h ^= h >> np.uint64(29)
    h *= FACTORS[5]
    h ^= h >> np.uint64(32)
    return h


class Stretches:
    """Runs of windows with the same lowest gram, over the concatenated texts of a block."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = b"".join(texts)
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = empty  # first and last window start, document number
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        h = gram_hashes(np.frombuffer(self.data, np.uint8))
        low = np.uint64(max(1, (len(h) - 1).bit_length()))
        keyed = h >> low << low | np.arange(len(h), dtype=np.uint64)
        width = 1
        least = keyed
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[:n - LENGTH + 1], least[SPAN - width:][:n - LENGTH + 1])
        at = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        starts = np.concatenate([np.arange(e - l, e - LENGTH + 1) for e, l in zip(self.ends, self.lengths)
                                 if l >= LENGTH] or [empty])
        doc = np.repeat(np.arange(len(texts)), np.maximum(self.lengths - LENGTH + 1, 0))
        if not len(starts):
            return
        at = at[starts]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
        begin = np.nonzero(new)[0]
        stop = np.append(begin[1:], len(starts)) - 1
        self.first, self.last, self.doc, self.hash = starts[begin], starts[stop], doc[begin], h[at[begin]]

    def shared_here(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, number of each stretch's, whether two documents of the block have it)."""
        values, number = np.unique(self.hash, return_inverse=True)
        ids = self.ids[self.doc] if len(self.doc) else self.doc
        low = np.full(len(values), LAST)
        high = np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, number, ids)
        np.maximum.at(high, number, ids)
        return values, number, low < high

    def contents(self, chosen: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct stretches in order of appearance, number of each chosen one's, smallest id of each distinct)."""
        seen: dict[bytes, int] = {}
        data = self.data
        number = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(
            self.first[chosen].tolist(), (self.last[chosen] + LENGTH).tolist())), np.int64, len(chosen))
        least = np.full(len(seen), LAST)
        if len(chosen):
            np.minimum.at(least, number, self.ids[self.doc[chosen]])
        return list(seen), number, least


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def ask_grams(block: tuple, parts: int) -> dict:
    values, _, _ = Stretches(*block).shared_here()
    return {p: values[own].astype(np.uint32) for p, own in B.split_by(part_of(values, parts))}


def merge_grams(asked: list[np.ndarray]) -> tuple[list[np.ndarray], None]:
    """For each question, as bits, which of its hashes another block sent too."""
    values = np.concatenate(asked)
    order = np.argsort(values)
    same = np.diff(values[order]) == 0
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return [np.packbits(t) for t in np.split(twice, np.cumsum([len(a) for a in asked])[:-1])], None


def chosen_stretches(block: tuple, told: dict, parts: int) -> tuple[Stretches, np.ndarray]:
    """The stretches whose gram stands in two or more documents."""
    found = Stretches(*block)
    values, number, shared = found.shared_here()
    for p, own in B.split_by(part_of(values, parts)):
        shared[own] |= np.unpackbits(told[p], count=len(own)).astype(bool)
    return found, np.nonzero(shared[number])[0] if len(number) else number


def dealt_contents(block: tuple, told: dict, gram_parts: int, parts: int):
    """(stretches, chosen, number of each chosen's content, [(part, numbers of its contents)], contents, ids, hashes)."""
    found, chosen = chosen_stretches(block, told, gram_parts)
    texts, number, least = found.contents(chosen)
    first = np.full(len(texts), len(number))
    np.minimum.at(first, number, np.arange(len(number)))
    hashes = found.hash[chosen[first]] if len(texts) else np.zeros(0, np.uint64)
    return found, chosen, number, list(B.split_by(part_of(hashes, parts))), texts, least, hashes.astype(np.uint32)


def ask_stretches(block: tuple, told: list[dict], gram_parts: int, parts: int) -> dict:
    """The questions, and under ``B.OWN`` what the block needs to read their answers: where its chosen stretches lie."""
    found, chosen, number, dealt, texts, least, hashes = dealt_contents(block, told[0], gram_parts, parts)
    first = found.first[chosen]
    places = (first.astype(np.uint32), (found.last[chosen] - first).astype(np.uint8), number.astype(np.uint32),
              [(p, own.astype(np.uint32)) for p, own in dealt], len(texts))
    return {B.OWN: places} | {p: ([texts[i] for i in own], least[own], hashes[own]) for p, own in dealt}


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of int symbols 1..256 with 0 after each string; equal suffixes share a rank.

    Larsson and Sadakane's refinement: ranks by the first seven symbols, then groups that are not yet single are sorted
    by the rank as far ahead as they are already sorted, which doubles that length each time.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)  # no string end before this symbol of the suffix
    for k in range(7):
        s = np.zeros(n, np.int64)
        s[:n - k] = symbols[k:]
        s[~alive] = 0
        alive &= s > 0
        key = key << 9 | s
    order = np.argsort(key, kind="stable")
    stop = np.nonzero(symbols == 0)[0]  # distance to the end of the string, to stop a comparison there
    ends = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    rank[order] = np.nonzero(new)[0][np.cumsum(new) - 1]
    done = 7
    while True:
        group = rank[order]
        same = np.concatenate((group[1:] == group[:-1], [False]))
        member = same | np.concatenate(([False], same[:-1]))
        places = np.nonzero(member)[0]
        own = order[places]
        open_ = ends[own] > done  # a string that ended is as sorted as it gets
        if not open_.any():
            return order, rank
        ahead = np.where(open_, rank[np.minimum(own + done, n - 1)] + 1, 0)
        both = rank[own] * np.int64(n + 2) + ahead
        by = np.argsort(both, kind="stable")
        order[places] = own[by]
        both = both[by]
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        rank[order[places]] = places[np.nonzero(fresh)[0]][np.cumsum(fresh) - 1]
        done *= 2


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefix of each suffix in the array with the one before it, up to ``cap``.

    All strings go forward in step: the prefix of the next suffix is at most one shorter, so it is only extended.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)
    padded = np.append(symbols, np.zeros(cap, symbols.dtype))
    out = np.zeros(n, np.int64)
    now, length = starts.copy(), np.zeros(len(starts), np.int64)
    while True:
        live = symbols[now] > 0
        now, length = now[live], length[live]
        if not len(now):
            return out[order]
        other = before[now]
        length[other < 0] = 0
        todo = np.nonzero(other >= 0)[0]
        while len(todo):
            a = padded[now[todo] + length[todo]]
            more = (a > 0) & (a == padded[other[todo] + length[todo]]) & (length[todo] < cap)
            todo = todo[more]
            length[todo] += 1
        out[now] = length
        now, length = now + 1, np.maximum(length - 1, 0)


def shard_windows(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct windows of a shard: (window bytes, smallest id), and per window of all: (group, text * 64 + offset)."""
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int16) + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    symbols[starts + lengths] = 0
    order, _ = suffix_array(symbols)
    prefix = common_prefixes(symbols, starts, order, LENGTH)
    text = np.repeat(np.arange(len(texts)), lengths + 1)[order]
    offset = order - starts[text]
    whole = np.nonzero(offset + LENGTH <= lengths[text])[0]
    steps = np.ones(len(whole), bool)
    if len(whole) > 1:  # two windows share what the least prefix between them allows
        steps[1:] = np.minimum.reduceat(prefix[:whole[-1] + 1], whole[:-1] + 1) < LENGTH
    group = np.cumsum(steps) - 1
    heads = order[whole[steps]]
    raw = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    windows = np.ascontiguousarray(raw[heads[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
    least = np.minimum.reduceat(ids[text[whole]], np.nonzero(steps)[0]) if len(whole) else ids[:0]
    return windows, least, group, text[whole] * 64 + offset[whole]


def merge_stretches(asked: list[tuple[list[bytes], np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], None]:
    """For each question: the smallest document of each stretch, and the windows that start in a smaller one, as bits.

    A stretch that is the only one with its gram (interior of a copy) shares windows with no other and is done; the
    others go through suffix arrays.
    """
    seen: dict[bytes, int] = {}
    numbers = [np.array([seen.setdefault(t, len(seen)) for t in a[0]], np.int64) for a in asked]
    all_least = np.full(len(seen), LAST)
    gram = np.zeros(len(seen), np.uint32)
    for number, (_, ids, hashes) in zip(numbers, asked):
        np.minimum.at(all_least, number, ids)
        gram[number] = hashes
    _, at, held = np.unique(gram, return_inverse=True, return_counts=True)
    several = np.nonzero(held[at] > 1)[0] if len(gram) else at
    all_texts = list(seen)
    texts, least = [all_texts[i] for i in several.tolist()], all_least[several]
    edges = np.searchsorted(np.cumsum([len(t) for t in texts]), np.arange(SHARD, SHARD * 100_000, SHARD))
    edges = np.unique(np.concatenate(([0], edges[edges < len(texts)], [len(texts)])))
    shards = []
    for a, b in zip(edges[:-1], edges[1:]):
        windows, low, group, where = shard_windows(texts[a:b], least[a:b])
        shards.append([windows, low, group, where + a * 64])
    for i, one in enumerate(shards):  # what the other shards hold of the same windows
        low = one[1].copy()
        for j, other in enumerate(shards):
            if i != j and len(other[0]) and len(one[0]):
                at = np.minimum(np.searchsorted(other[0], one[0]), len(other[0]) - 1)
                low = np.where(other[0][at] == one[0], np.minimum(low, other[1][at]), low)
        one.append(low)
    bits = np.zeros(len(texts), np.uint64)
    for _, _, group, where, low in shards:
        text, offset = where // 64, (where % 64).astype(np.uint64)
        earlier = low[group] < least[text]
        np.bitwise_or.at(bits, text[earlier], np.uint64(1) << offset[earlier])
    all_bits = np.zeros(len(all_texts), np.uint32)
    all_bits[several] = bits
    return [(all_least[number], all_bits[number]) for number in numbers], None


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans(n: int, first: np.ndarray, last: np.ndarray, later: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True for every byte of a block of ``n`` to remove: whole stretches that are ``later`` than another document's
    equal one, and the windows of the others that ``bits`` name."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first[later], 1)
    np.add.at(change, last[later] + LENGTH, -1)
    some, mask = first[~later], bits[~later]
    for k in range(SPAN):
        at = some[(mask >> np.uint32(k)) & np.uint32(1) == 1] + k
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if ``keep_text``) per document row."""
    held = B.blocks(docs)
    total = held.agg({"n_bytes": "sum"}).first()[0] or 0
    gram_parts = B.parts_for(total, 24 << 20)
    parts = B.parts_for(total, 16 << 20)
    grams = B.answer(B.send(held, lambda block, _: ask_grams(block, gram_parts)), merge_grams, "grams")
    # written, as the questions are read twice: by the parts, and what a block keeps for itself by the block
    asked = cut_lineage(B.send(held, lambda block, told: ask_stretches(block, told, gram_parts, parts), [grams]), "asked")
    kept_places = asked.where(f"part = {B.OWN}").select("block", "part", F.col("sent").alias("answer"))
    found = B.answer(asked.where(f"part <> {B.OWN}"), merge_stretches, "stretches")

    def judge(key, block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in block["data"]:
            own_places, told = B.by_round(back, 2)
            ids, texts = B.unpack(data)
            first, more, number, dealt, many = own_places[B.OWN]
            first = first.astype(np.int64)
            least, bits = np.zeros(many, np.int64), np.zeros(many, np.uint32)
            for p, own in dealt:
                least[own], bits[own] = told[p]
            ends = np.cumsum([len(t) for t in texts])
            by = np.array([LAST if i is None else i for i in ids], np.int64)[np.searchsorted(ends, first, side="right")]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            gone = spans(len(raw), first, first + more, by > least[number], bits[number])
            for doc, end, text in zip(ids, ends.tolist(), texts):
                length = len(text)
                cut = gone[end - length:end]
                runs = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                kept = raw[end - length:end][~cut].tobytes() if runs else text
                rows.append((doc, length, int(cut.sum()), runs, hashlib.sha256(kept).hexdigest(),
                             *([kept] if keep_text else [])))
        names = [c.split()[0] for c in RESULT.split(", ")] + ["kept"] * keep_text
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"doc_id": "Int64"})

    return B.with_answers(held, [kept_places, found], judge, RESULT + ", kept binary" * keep_text)
