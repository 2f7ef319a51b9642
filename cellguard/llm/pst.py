"""Language-model scoring with a probabilistic suffix tree over words.

Nodes are contexts of up to ``DEPTH`` preceding words. A context is a candidate if it occurs in at least ``MIN_COUNT``
training places, however large the corpus is. It is retained if its next-symbol distribution diverges from that of its
longest suffix: the mean leave-one-out gain of its training places, in nats, reaches ``GAIN``. Next-symbol distributions
hold every training place of the corpus and are smoothed towards the suffix: P(w|s) = (n(s,w) + MU P(w|suffix)) / (n(s)
+ MU), down to the root's (c+1) / (N+V+1). A token is scored in the state of the longest retained suffix of the words
before it in its document.

Texts are cut into words once; blocks then hold word numbers. Counts are merged in hash-dealt parts from distinct
entries a block (see ``blocks``), so a frequent word or a copied document is one entry a block. A context's entries meet
in one part, which decides whether it is retained, and the answers take counts and decisions back to the blocks that
hold the context. Parts also tell which words and entries stand in one block only. Every longer entry around such a one
is then known to that block, which counts it by itself and sends its context's gain in their place. Contexts of so many
places that a part would grow by them (more than one of ``HOT`` of all tokens) are dealt by their next word too; only
their gains, of at most ``HOT`` contexts a depth, are added up on the driver. The vocabulary, the candidates and the
distributions are never gathered in one place.

Words are counted by themselves and numbered. Contexts are told apart by 64-bit hashes of their words' numbers, among the
candidates of one depth; entries by that and the next word's number.

Tokens: words between ASCII white space with A-Z lower-cased, and one end token a document. A null text is empty (its
end alone). Training rows are those the caller marks; a null doc_id counts as the empty id. Repeated rows count and
score each. An empty table gives an empty result; without training rows every probability is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

DEPTH, MIN_COUNT = 4, 10
HOT, HOT_LEAST = 4096, 1024
GAIN, MU = 0.01, 500.0
UNITS = 1 << 20  # a nat in the whole numbers that parts' gains are added in
END = b""


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of word sequences followed by one more word."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + words
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def small(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest unsigned type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def joined(answer: dict, like: tuple) -> list[np.ndarray]:
    """The arrays that parts answered, in the parts' order; arrays of the types ``like`` if none did."""
    if not answer:
        return [np.zeros(0, t) for t in like]
    return [np.concatenate(x) for x in zip(*(answer[p] for p in sorted(answer)))]


def ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of pairs of whole numbers from 0 on, and both in it: one sort of numbers that hold all, if they fit."""
    bits, wide = len(high).bit_length(), int(low.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + wide + bits < 64:
        both = np.sort((high.astype(np.int64) << wide | low) << bits | np.arange(len(high)))
        order, both = both & ((1 << bits) - 1), both >> bits
        return order, both >> wide, both & ((1 << wide) - 1)
    order = np.lexsort((low, high))
    return order, high[order], low[order]


def changes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether a pair of an ordered list differs from the one before it."""
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return new


class Tokens:
    """A block's tokens as places of its distinct words, which are ordered by part."""

    def __init__(self, ids: list, train: np.ndarray, lengths: np.ndarray, number: np.ndarray, end: int):
        self.ids, self.train, self.lengths, self.number, self.end = ids, train, lengths, number, end
        self.weight = np.repeat(train.astype(np.float64), lengths)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values."""
        return np.bincount(np.repeat(np.arange(len(self.ids)), self.lengths), values, len(self.ids))


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of UTF-8 texts, the places among them of all tokens in order, and the texts' numbers of tokens."""
    _, offsets, body = pa.array(texts, pa.large_binary()).buffers()
    lower = pc.ascii_lower(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, body]))
    cut = pc.ascii_split_whitespace(lower)
    said, ends = cut.flatten(), cut.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(said), 0)  # white space around a text leaves empty pieces
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = said.filter(full).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    lengths = np.diff(before[ends - ends[0]]) + 1
    numbers = np.full(len(coded) + len(texts), len(words), np.int32)
    inside = np.ones(len(numbers), bool)
    inside[np.cumsum(lengths) - 1] = False
    numbers[inside] = coded.indices.to_numpy()
    return [*words, END], numbers, lengths.astype(np.int64)


def tokenise(ids: list, texts: list[bytes], trains: Callable[[int | None], bool], parts: int) -> tuple[tuple, dict]:
    """What ``Tokens`` takes, and per part: its number, words and their training counts."""
    words, numbers, lengths = split_words(texts)
    dealt = (word_hashes(words) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(dealt, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    train = np.array([trains(i) for i in ids], bool)
    numbers = place[numbers]
    tokens = (ids, train, lengths, numbers, int(place[-1]))
    counts = np.bincount(numbers, np.repeat(train, lengths), len(words)).astype(np.int64)
    return tokens, {p: (p, b" ".join([words[i] for i in own]), small(counts[place[own]]))
                    for p, own in B.split_by(dealt)}


def tokenised(docs: DataFrame, trains: Callable[[int | None], bool], parts: int) -> DataFrame:
    """(block, data, words): the packed tokens of each block, and its questions about words."""
    sent = pa.list_(pa.struct([("part", pa.int64()), ("sent", pa.binary())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in B.gathered(batches, B.BLOCK):
            tokens, asked = tokenise(ids, texts, trains, parts)
            words = [{"part": p, "sent": B.pack(x)} for p, x in asked.items()]
            yield pa.RecordBatch.from_arrays([pa.array([B.pack(tokens)], pa.binary()), pa.array([words], sent)],
                                             names=["data", "words"])

    packed = B.shaped(docs).mapInArrow(read, "data binary, words array<struct<part: bigint, sent: binary>>")
    return B.cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()), "tokens")


class Model:
    """What every task needs: totals, how contexts are dealt, and the hashes of the retained hot ones of each depth."""

    def __init__(self, total: int, distinct: int, parts: int = B.LEAST_PARTS):
        self.total, self.distinct, self.parts = total, distinct, parts
        self.least, self.hot = MIN_COUNT, max(HOT_LEAST, -(-total // HOT))
        self.kept: list[np.ndarray] = []

    def root(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.total + self.distinct + 1.0)


class Places:
    """A block's places: distinct entries of the present depth (context, next word), and which the tokens end.

    What an entry's places share is held once an entry: its count, its hash, its word, whether it is in this block only,
    its probability. An entry's ``parent`` is that of its context's suffix, one depth before; words are those of depth 0.
    """

    def __init__(self, tokens: Tokens, model: Model, answers: list[dict], last: bool = False):
        """``answers``: of the words, then of each depth that is known; after the last one no place is followed."""
        self.tokens, self.model, self.depth = tokens, model, 0
        self.counts, self.code, self.own = joined(answers[0], (np.int64, np.int64, bool))
        self.base = model.root(self.counts)
        self.word_hash = longer(np.zeros(len(self.code), np.uint64), self.code.astype(np.uint64))
        self.count, self.hash, self.now = self.counts, self.word_hash, self.base
        self.word = np.arange(len(self.code), dtype=np.int32)
        self.at, self.entry = np.arange(len(tokens.number)), tokens.number  # entries that end at these tokens
        self.known = [(self.at, self.entry, self.now)]
        self._follow()
        for answer in answers[1:]:
            self._step(answer)
            if not last or self.depth + 1 < len(answers):
                self._follow()

    def _follow(self) -> None:
        """Entries are the contexts of the next tokens if frequent, numbered by part."""
        tokens, model, before = self.tokens, self.model, self.entry
        fit = np.nonzero((self.count >= model.least) & (self.word != tokens.end))[0]
        order, part, fit = ordered((self.hash[fit] % np.uint64(model.parts)).astype(np.int64), fit)
        self.part, self.context_count, self.context_hash = part, self.count[fit], self.hash[fit]
        context = np.full(len(self.count), -1, np.int32)
        context[fit] = np.arange(len(fit))
        ending = np.zeros(len(tokens.number), np.int32)
        ending[self.at] = before
        of = context[before]
        here = of >= 0
        self.at = self.at[here] + 1  # a document's last token is its end: there is a next one
        order, of, parent = ordered(of[here], ending[self.at])
        new = changes(of, parent)
        self.entry = np.empty(len(order), np.int32)
        self.entry[order] = np.cumsum(new, dtype=np.int32) - 1
        self.of, parent = of[new], parent[new]
        self.word, self.lower = self.word[parent], self.now[parent]
        self.own = self.own[parent] | self.own[fit][self.of]  # as is its suffix or its context
        self.seen = np.bincount(self.entry, tokens.weight[self.at], len(parent)).astype(np.int64)
        self.longer = longer(self.context_hash[self.of], self.word_hash[self.word])
        self._deal()

    def _deal(self) -> None:
        """Order what is sent: (part, context) pairs, and the entries that may stand in other blocks by them."""
        shared, contexts = np.nonzero(~self.own)[0], np.arange(len(self.part))
        of = self.of[shared]
        self.hot = self.context_count >= self.model.hot
        hot = np.nonzero(self.hot[of])[0]
        if not len(hot):  # they are in order
            self.pair_part, self.pair_context, self.at_home, self.sent, self.pair = self.part, contexts, contexts, shared, of
            return
        part = self.part[of]
        part[hot] = (self.longer[shared[hot]] % np.uint64(self.model.parts)).astype(np.int64)
        order, part, of = ordered(np.concatenate([self.part, part]), np.concatenate([contexts, of]))
        new = changes(part, of)
        self.pair_part, self.pair_context = part[new], of[new]
        pair, entry = np.cumsum(new) - 1, order >= len(contexts)
        self.at_home = pair[~entry]  # pairs that carry a context's own gain and get its decision
        self.sent, self.pair = shared[order[entry] - len(contexts)], pair[entry]

    def _step(self, answer: dict) -> None:
        kept, seen, alone = joined(answer, (bool, np.int64, bool))
        self.seen[self.sent], self.own[self.sent] = seen, alone
        retained = kept[self.at_home]
        retained[self.hot] = np.isin(self.context_hash[self.hot], self.model.kept[self.depth])
        use = np.nonzero(retained[self.of])[0]
        self.now = self.lower.copy()
        self.now[use] = (self.seen[use] + MU * self.lower[use]) / (self.context_count[self.of[use]] + MU)
        self.count, self.hash = self.seen, self.longer
        self.known.append((self.at, self.entry, self.now))
        self.depth += 1

    def sums(self) -> tuple:
        """Per document: known tokens, base score, and score by the longest known entries that end at its tokens."""
        tokens, out = self.tokens, np.zeros(len(self.tokens.number))
        for at, entry, now in self.known:
            out[at] = np.log10(now)[entry]
        known, base = (self.counts > 0)[tokens.number], np.log10(self.base)[tokens.number]
        return tokens.by_doc(known).astype(int), tokens.by_doc(base), tokens.by_doc(out)


def gains(n: np.ndarray, of: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Leave-one-out gain of entries of ``n`` training places, over the context's ``of`` and the suffix' probability."""
    return n * np.log((n - 1 + MU * lower) / (of - 1 + MU) / lower)


def merge_words(asked: list, parts: int) -> tuple[list, pd.DataFrame]:
    """Answers: training counts of the words, their numbers, whether they are in one block only; facts: totals."""
    said = pc.split_pattern(pa.array([a[1] for a in asked], pa.large_binary()), b" ")
    coded = said.flatten().dictionary_encode()
    size, number = len(coded.dictionary), coded.indices.to_numpy()
    counts = np.bincount(number, np.concatenate([a[2] for a in asked]), size).astype(np.int64)
    alone = np.bincount(number, minlength=size) == 1
    codes = np.arange(1, size + 1) * parts + asked[0][0]
    codes[pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)] = 0  # END
    numbers = np.split(number, np.cumsum([len(a[2]) for a in asked])[:-1])
    return ([(small(counts[n]), small(codes[n]), alone[n]) for n in numbers],
            pd.DataFrame({"n": [int(counts.sum())], "v": [int((counts > 0).sum())]}))


def ask_entries(places: Places) -> dict:
    """Per part: contexts (hash, count, gain by this block's own entries), whether an own entry is a next candidate,
    and shared entries (how many a context, words, counts, suffix probabilities of those with a count)."""
    model, end = places.model, places.tokens.end
    own = np.nonzero(places.own & (places.seen > 0))[0]
    of, seen = places.of[own], places.seen[own]
    gain = np.bincount(of, gains(seen, places.context_count[of], places.lower[own]), len(places.part))
    local = np.zeros(len(places.pair_part), np.int64)
    local[places.at_home] = np.round(gain * UNITS)
    more = int(((seen >= model.least) & (places.word[own] != end)).sum())
    sent = places.sent
    code, count, low = places.code[places.word[sent]], places.seen[sent], places.lower[sent].astype(np.float32)
    sizes = np.bincount(places.pair, minlength=len(places.pair_part))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for p, pairs in B.split_by(places.pair_part):
        lo, hi = bounds[pairs[0]], bounds[pairs[-1] + 1]
        contexts = places.pair_context[pairs]
        out[p] = (places.context_hash[contexts], small(places.context_count[contexts]), local[pairs], more,
                  small(sizes[pairs]), small(code[lo:hi]), small(count[lo:hi]), low[lo:hi][count[lo:hi] > 0])
    return out


def merge_entries(asked: list, model: Model) -> tuple[list, pd.DataFrame]:
    """Answers (whether contexts are retained; entries' counts and whether they are in one block only); facts: hot
    contexts' gains, whether there are next candidates."""
    contexts, sent = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    sizes = np.cumsum([0, *[len(a[0]) for a in asked]])
    of = np.zeros(len(contexts), np.int64)
    of[sent] = np.concatenate([a[1] for a in asked])
    local = np.zeros(len(contexts), np.int64)
    np.add.at(local, sent, np.concatenate([a[2] for a in asked]))
    context = np.repeat(sent, np.concatenate([a[4] for a in asked]).astype(np.int64))
    code = np.concatenate([a[5] for a in asked]).astype(np.int64)
    size = int(code.max(initial=0)) + 1
    key, inverse = np.unique(context * size + code, return_inverse=True)
    count = np.concatenate([a[6] for a in asked])
    seen = np.bincount(inverse, count, len(key)).astype(np.int64)
    alone = np.bincount(inverse, minlength=len(key)) == 1
    low = np.ones(len(key))
    low[inverse[count > 0]] = np.concatenate([a[7] for a in asked])  # the same in all blocks
    context, code = key // size, key % size
    held = seen > 0
    gain = np.bincount(context[held], gains(seen[held], of[context[held]], low[held]), len(contexts))
    kept = gain + local / UNITS >= GAIN * of
    hot = np.nonzero(of >= model.hot)[0]
    following = int(((seen >= model.least) & (code != 0)).sum()) + sum(a[3] for a in asked)
    hot_gain = np.round(gain[hot] * UNITS).astype(np.int64) + local[hot]
    known = pd.DataFrame({"context": pd.array([None, *contexts[hot].view(np.int64).tolist()], "Int64"),
                          "gain": [0, *hot_gain.tolist()], "n": [following, *of[hot].tolist()]})
    ends = np.cumsum([0, *[len(a[5]) for a in asked]])
    return [(kept[sent[a:b]], small(seen[inverse[c:d]]), alone[inverse[c:d]])
            for a, b, c, d in zip(sizes, sizes[1:], ends, ends[1:])], known


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def by_crc(hold_out: int, of: int) -> Callable[[int | None], bool]:
    """Training test: crc32 of the id as text, modulo ``of``, is not ``hold_out``."""
    def trains(doc: int | None) -> bool:
        return crc32(b"" if doc is None else str(doc).encode()) % of != hold_out
    return trains


def score_texts(docs: DataFrame, trains: Callable[[int | None], bool], depth: int = DEPTH) -> DataFrame:
    """Train on the rows whose id ``trains`` accepts and score all: one row per document, see ``SCORES``."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = B.parts_for(total, 16 << 20)
    held = tokenised(docs, trains, parts)
    words = B.answer(held.select("block", F.inline("words")), lambda asked: merge_words(asked, parts), "words", parts)
    row = B.facts(words, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    model = Model(row[0] or 0, row[1] or 0, parts)
    rounds: list[DataFrame] = [words]

    for d in range(1, depth + 1):
        asked = B.send(held, lambda block, told: ask_entries(Places(Tokens(*block), model, told)), list(rounds), 2 * parts)
        back = B.answer(asked, lambda asked: merge_entries(asked, model), f"depth{d}", parts)
        own = B.facts(back, "context long, gain long, n long")
        own = own.groupBy("context").agg(F.sum("gain").alias("gain"), F.sum("n").alias("sum"), F.max("n").alias("n"))
        own = own.collect()  # hot contexts, at most HOT, and the number of next candidates
        kept = [r["context"] for r in own if r["context"] is not None and r["gain"] >= GAIN * r["n"] * UNITS]
        model.kept.append(np.array(kept, np.int64).view(np.uint64))
        rounds.append(back)
        if not any(r["sum"] for r in own if r["context"] is None):
            break
    used = len(rounds)

    def score(key, block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for data in block["data"]:
            tokens = Tokens(*B.unpack(data))
            known, base, scored = Places(tokens, model, B.by_round(back, used), last=True).sums()
            frames.append(pd.DataFrame({
                "doc_id": pd.array(tokens.ids, "Int64"), "held_out": ~tokens.train, "n_tokens": tokens.lengths,
                "n_known": known, "train_tokens": model.total, "base_score": base, "score": scored}))
        return pd.concat(frames)

    return B.with_answers(held, rounds, score, SCORES, 2 * parts)
