"""The suffix tree's words and pairs, and the shuffle files of its rounds."""

import glob
import time

import numpy as np

from cellguard.llm import blocks as B
from cellguard.llm import pst as P


def test_words_are_those_of_a_plain_split():
    odd = b"".join(bytes([c]) + b"aB" for c in range(1, 33)) + "  Äx".encode()
    for texts in ([b""], [b" \t\n"], [b"", b" one", b"Two one \n", odd, b"", odd + b" "]):
        words, numbers, lengths = P.split_words(texts)
        assert len(set(words)) == len(words)
        want = [w for t in texts for w in (*t.lower().split(), P.END)]
        assert [words[n] for n in numbers] == want
        assert lengths.tolist() == [len(t.split()) + 1 for t in texts]


def test_pairs_too_wide_for_one_number_are_ordered_alike():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 5, 400), rng.integers(0, 5, 400)
    order, a, b = P.ordered(high, low)
    assert order.tolist() == np.lexsort((low, high)).tolist()
    assert (a == high[order]).all() and (b == low[order]).all()
    wide, a, b = P.ordered(high << 50, low << 50)
    assert wide.tolist() == order.tolist() and (a == high[order] << 50).all() and (b == low[order] << 50).all()


def test_a_round_leaves_no_shuffle_files(spark):
    """The questions of a round are gone once they are answered."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    own = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]  # other sessions have theirs

    def files():
        return {f for d in own for f in glob.glob(f"{d}/*/shuffle_*")}

    def merge(asked):
        return [sum(asked)] * len(asked), None

    sent = spark.createDataFrame([(p, b, B.pack(b)) for p in range(3) for b in range(4)], B.SENT)
    before = files()
    back = B.answer(sent, merge, "rounds", 3)
    assert sorted((r["block"], r["part"], B.unpack(r["answer"])) for r in back.collect()) == [
        (b, p, 6) for b in range(4) for p in range(3)]
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
