"""Conversation repair against a plain table of costs and edit strings."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from cellguard.llm import registry, repair  # noqa: E402

SMALL = "/root/testdata/sf0.001"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, cid string, part int, no int, kind int, uid int, open int"


def rows_of(df):
    out = {}
    for r in df.collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = tuple(r[f] for f in FIELDS)
    return out


def make_rows():
    rng = random.Random(11)
    rows = []
    texts = ["Yes.", "no", "Why? ", "", " \t", "Well then!\n", "cut of", "a.b", "Ünï?", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]
    for conv in [None, *range(60)]:
        turn = 0
        for _ in range(rng.randint(1, 14)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice((0, 1, 1, 1, 3))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t % 700}.") for t in range(1500)]  # a hot one
    rows += [(101, 5, "user", "the same row.")] * 300 + [(102, None, None, None)] * 3
    rows += [(103, t, "user", "w" * 200_000 + ".") for t in range(3)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


def test_tables_agree_with_single_steps():
    rng = random.Random(2)
    t = repair.tables()
    for _ in range(200):
        word = bytes(rng.randrange(9) for _ in range(rng.randint(0, 23)))
        v = repair.END
        for s in reversed(word):
            v = repair.step(v, s)
        assert t.vectors[t.summary(word)[0]] == tuple(x - min(v) for x in v)
        edits, state, cost = repair.trace(word, 0, repair.START, True)
        assert cost == v[0] and state in (repair.START, repair.ASSISTANT)


@pytest.mark.parametrize("partitions, limit", [(3, 1 << 16), (7, 5)])
def test_repair_equals_plain_table(spark, rows, partitions, limit, monkeypatch):
    """The second case cuts every conversation over five rows into chunks that meet only by their summaries."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", limit)
    df = spark.createDataFrame([(*r, "c", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(partitions)
    pieces = repair.repair(repair.damage(repair.turns(df)))
    assert pieces.where("open and audit <> ''").count() > (400 if limit == 5 else 0)
    got, want = rows_of(repair.digests(pieces)), brute.repaired(rows)
    assert got == want


def test_repaired_rows_read_as_they_should(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 100], "conv_id long, turn long, role string, text string")
    pieces = repair.repair(repair.turns(df))
    said = {}
    for r in repair.repaired_rows(pieces).orderBy("conv_id", "part", "no", "position").collect():
        said.setdefault(r["conv_id"], []).append(r["role"][0])
    import re

    assert said and all(re.fullmatch("s?(ua)+", "".join(v)) for v in said.values())


def test_given_conversations_and_empty_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = brute.repaired([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(registry.op11_block_repair(spark, SMALL)) == want
    assert repair.digests(repair.repair(repair.damage(repair.turns(table.limit(0))))).count() == 0
