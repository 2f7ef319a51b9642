"""The training-data operators against plain-Python versions, on fixtures with nulls, copies, ties and long texts."""

import io
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from cellguard.llm import (bundles, hilbert, langid, mcd, packing, postings, pst, registry, simhash,  # noqa: E402
                           suffix, templates)

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, root string"


def make_rows():
    rng = random.Random(5)
    stock = {"aa": "the of and thing other then with that from there".split(),
             "bb": "der die und nicht ein zu über schön größe straße".split()}
    vocab = {k: v + ["".join(rng.choice(v)[:3] for _ in range(2)) for _ in range(200)] for k, v in stock.items()}

    def prose(lang, n):
        ws = [rng.choice(vocab[lang]) for _ in range(n)]
        return "\n".join(" ".join(ws[i:i + 25]) for i in range(0, n, 25))

    rows = []
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, prose(lang, 60 + 5 * i), lang, f"s{i % 2}"))
    passage = prose("aa", 24)
    for i in range(60, 90):  # a passage and a numbered footer that many share
        rows.append((i, f"{prose('aa', 40)}\n{passage}\n{prose('aa', 40)}\nPage {i} of 90 - all rights kept", "aa", "s0"))
    copy = prose("bb", 120)
    rows += [(i, copy, "bb", "s1") for i in (101, 99, 100)]
    words = copy.split(" ")
    words[50] = "changed"
    rows.append((98, " ".join(words), "bb", "s1"))
    rows += [(110, "x", "aa", None), (111, "", None, "s0"), (112, None, "aa", "s0"), (113, " \n\t ", None, None),
             (114, "1234 5678 !!", "bb", "s0"), (115, "Ab " * 400, "aa", "s0"), (116, "Ünïcode ÄÖ " * 9, "bb", "s0"),
             (117, prose("aa", 9000), "aa", "s0"), (3, rows[3][1], "aa", "s0"), (3, rows[3][1], "aa", "s0"),
             (4, "same id other text " * 8, "aa", "s0"), (None, passage + " and more words here", "aa", "s0"),
             (None, None, None, None), (118, "### $$$ %%% " * 40 + prose("aa", 60), "aa", "s0")]
    return [(*r, len(r[1] or ""), 7, "r") for r in rows]


ROWS = make_rows()
ITEMS = [(1, " ".join(ROWS[70][1].split()[45:60])), (2, "no such words anywhere in these documents at all ever, really"),
         (3, ROWS[62][1].split("\n")[0][:80]), (4, None), (5, ""), (6, "ÜNÏCODE äö ünïcode"), (7, "ünïcode"),
         (None, "ab ab ab ab ab ab ab ab ab ab ab"), (1, "Ab ab, ab")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_suffix_tree_base_scores_and_gain(spark, docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in unique.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in pst.score_texts(unique, pst.by_crc(2, 7)).collect()}
    want = brute.base_scores(rows, lambda i: brute.in_bucket(i, 7) != 2)
    assert got.keys() == want.keys()
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (brute.in_bucket(i, 7) == 2)


def test_suffix_tree_contexts_help(spark):
    """Words that follow each other are scored above their frequency, on texts kept from training."""
    rng = random.Random(1)
    pairs = [(f"w{i}", f"v{i}") for i in range(20)]
    rows = [(i, " ".join(" ".join(rng.choice(pairs)) for _ in range(60))) for i in range(200)]
    got = pst.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), pst.by_crc(2, 7))
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > 0.7 * held[1]  # the second word of a pair is nearly free


@pytest.mark.parametrize("hot", [20, pst.HOT_LEAST])
def test_suffix_tree_keeps_rare_contexts(spark, monkeypatch, hot):
    """Contexts seen about twenty times count in a corpus of any size; all scores equal those from plain n-gram counts."""
    rng = random.Random(2)
    phrases = [" ".join(f"{a}{i}" for a in "opqrs") for i in range(1200)]
    rows = []
    for i in range(240):
        words = [rng.choice(phrases) if rng.random() < 0.08 else f"filler{int(rng.paretovariate(0.7)) % 9000}"
                 for _ in range(1100)]
        rows.append((i, " ".join(words)))
    assert sum(len(t) for _, t in rows) > 19 << 17  # a bar of one place per 2^17 bytes would pass few of the phrases
    monkeypatch.setattr(pst, "HOT_LEAST", hot)
    got = pst.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pst.by_crc(2, 7))
    want, kept = brute.tree_scores(rows, pst.by_crc(2, 7), pst.DEPTH, pst.MIN_COUNT, pst.GAIN, pst.MU)
    assert sum(kept.get(tuple(p.encode().split()[:3]), False) for p in phrases) > 1000
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(want, rel=1e-9)


def test_suffix_tree_edges(spark, docs, none):
    assert pst.score_texts(none, pst.by_crc(2, 7)).collect() == []
    got = pst.score_texts(docs, pst.by_crc(2, 7)).collect()
    assert len(got) == len(ROWS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (111, 112)} == {1}
    untrained = pst.score_texts(docs.where("doc_id < 5"), lambda doc: False).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_suffix_tree_is_a_distribution(spark):
    """In the root, known words and one unknown word share all the probability."""
    model = pst.Model(7, 3)
    assert sum(model.root(np.array([4, 2, 1, 0]))) == pytest.approx(1)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.unravel_index(np.arange(1 << dims * bits), (1 << bits,) * dims)).T
        index = hilbert.curve_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_hilbert_shards(spark, docs, none):
    dims = [hilbert.Dimension("lang", "category"), hilbert.Dimension("doc_id"), hilbert.Dimension("n_chars")]
    got = hilbert.hilbert_shards(docs, dims, 16, ["doc_id", "n_chars"]).collect()
    assert len(got) == len(ROWS)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        own = sorted((r["slot"], r["hilbert"]) for r in got if r["shard"] == s)
        assert [a for a, _ in own] == list(range(n)) and [h for _, h in own] == sorted(h for _, h in own)
    assert hilbert.hilbert_shards(none, dims, 16, ["doc_id"]).collect() == []
    few = hilbert.hilbert_shards(docs.where("doc_id < 3"), dims, 16, ["doc_id"]).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2]


def test_hilbert_shards_prune_by_language_and_source(spark):
    """What a min/max reader of one language or source opens is little more than what holds it."""
    got = registry.op2_hilbert_shards(spark, MIDDLE).select("doc_id", "shard")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", "source")
    placed = got.join(docs, "doc_id").toPandas()
    size = len(placed) / 16
    for column, slack, spread in (("lang", 1.0, 4), ("source", 1.5, 10)):
        ends = placed.groupby("shard")[column].agg(["min", "max"])
        for value, rows in placed.groupby(column):
            opened = ((ends["min"] <= value) & (value <= ends["max"])).sum()
            assert opened <= slack * rows["shard"].nunique()
            assert opened <= len(rows) / size + spread  # those its rows fill, and few more


def test_hilbert_borders(spark):
    rows = [(i, "b" if i < 60 else ("a" if i < 80 else f"c{i}")) for i in range(100)] + [(10 ** 12, None)]
    df = spark.createDataFrame(rows, "x long, c string").repartition(5)
    borders = hilbert.number_borders(df, ["x"], 4)["x"]
    assert np.abs(borders - [25, 50, 75]).max() <= 1  # the far value squeezes nothing
    cells = dict(hilbert.category_borders(df, "c", 8))
    assert cells["a"] == 0 and cells["b"] == 4 and list(cells) == sorted(cells) and max(cells.values()) == 7


def test_hilbert_keeps_clashing_columns(spark, docs):
    clash = docs.withColumn("Shard", F.lit("mine")).withColumn("_rank", F.lit(1)).withColumn("slot", F.lit(2)).withColumn(
        "slot_in", F.lit(3)).withColumn("a.b", F.lit(4))
    got = hilbert.hilbert_shards(clash, [hilbert.Dimension("lang", "category"), hilbert.Dimension("a.b")], 4, ["doc_id"])
    row = got.first()
    assert got.count() == len(ROWS) and len(set(got.columns)) == len(got.columns) == len(clash.columns) + 3
    assert (row["Shard_in"], row["_rank"], row["slot_in_in"], row["slot_in"], row["a.b"]) == ("mine", 1, 2, 3, 4)


def test_hilbert_files_prune(spark, docs, tmp_path):
    dims = [hilbert.Dimension("source", "category"), hilbert.Dimension("n_chars")]
    sharded = hilbert.hilbert_shards(docs, dims, 4, ["doc_id", "n_chars"])
    hilbert.write_shards(sharded, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
    spans = hilbert.shard_ranges(sharded, dims).collect()
    assert len(spans) == 4 and all(r["min_n_chars"] <= r["max_n_chars"] for r in spans)


def test_simhash_against_all_pairs(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    rows = [(i, t) for i, t, *_ in ROWS]
    prints = [brute.simhash(t) for _, t in rows]
    roots = brute.linked(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_split_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)})
    roots = brute.linked(prints)
    monkeypatch.setattr(simhash, "SPLIT", 8)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from cellguard.llm.common import components
    got = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df)).collect()}
    groups = defaultdict(set)
    for p, r in zip(prints, roots):
        groups[r].add(got.get(p, p if p < 1 << 63 else p - (1 << 64)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_keeps_one_of_each(spark, docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({brute.linked([brute.simhash(t) for _, t, *_ in ROWS])[k] for k in range(len(ROWS))})
    assert not {100, 101} & set(ids) and ids.count(3) == 1
    assert simhash.one_of_each(none).collect() == []


def test_language_codes():
    for n in (2, 3, 5, 9):
        code = langid.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= 1 and (n < 3 or min(apart) >= 2)


def test_language_id(spark, docs, none):
    model = langid.fit(docs.where("lang is not null"))
    got = langid.predict(docs, model).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(ROWS)
    for i, t, lang, *_ in ROWS[:94]:
        assert all(r["lang_pred"] == lang and 0.5 < r["score"] <= 1 for r in by[i] if i not in (3, 4))
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (111, 112, 113, 114))
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.fit(none) is None and langid.predict(none, model).collect() == []
    kept = langid.keep_recognised(docs, model)
    assert kept.columns == docs.columns and not {111, 112, 113, 114} & {r["doc_id"] for r in kept.collect()}


def test_language_long_text_in_pieces(monkeypatch):
    texts = ["the other thing " * 500, None, "", "über größe " * 700]
    model = langid.LanguageModel(["a", "b"], langid.codewords(2), np.random.default_rng(0).normal(
        size=(langid.BUCKETS, 1)).astype(np.float32), np.ones(1), np.full((2, 1), 1.0))
    whole = model.margins(texts)
    monkeypatch.setattr(langid, "STEP", 1000)
    assert np.allclose(whole, model.margins(texts), atol=0.02)


def test_language_held_out_accuracy(spark):
    got = registry.op4_output_codes(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(lang, "doc_id").where("lang is not null").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_contamination(spark, docs, items, none):
    got = postings.contamination(docs, items).collect()
    want = Counter((i, *brute.contamination(t, [x for x in ITEMS if x[0] is not None])) for i, t, *_ in ROWS)
    have = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got
                   if r["doc_id"] != 115)
    assert have == Counter({k: v for k, v in want.items() if k[0] != 115})
    repeated = [r for r in got if r["doc_id"] == 115]  # hit by an item without id too, which is not counted
    assert [(r["n_hit"], r["items"]) for r in repeated] == [(400, ["1"])]
    assert postings.contamination(none, items).collect() == []
    clean = postings.contamination(docs, items.where("false")).collect()
    assert len(clean) == len(ROWS) and not any(r["contaminated"] for r in clean)
    kept = postings.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(v for k, v in want.items() if not k[2])


def near_places(spark, rows, items, slack):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = postings.proximity_matches(docs, bench, slack).collect()
    return Counter((r["doc_id"], tuple(r["words"]), r["start"]) for r in got)


def test_contamination_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(1, item), (2, "alpha beta odd gamma delta epsilon zeta"), (3, "zeta " + "x " * 50 + "alpha"),
            (4, "beta alpha delta gamma zeta epsilon"), (5, "alpha beta gamma"), (None, "one " + item), (6, None), (7, "")]
    near = Counter({i for i, *_ in near_places(spark, rows, [(1, item)], 3)})
    assert set(near) == {1, 2, 4, None}
    assert {i for i, *_ in near_places(spark, rows, [(1, item)], 0)} == {1, None}
    # a word that no document holds is passed over, but not most of a window's words; in row 4 the rarest word, delta,
    # stands one place early, which puts alpha two places from its own
    assert {i for i, *_ in near_places(spark, rows, [(1, item.replace("gamma", "unheard"))], 1)} == {1, 2, None}
    assert not near_places(spark, rows, [(1, "alpha new words only here"), (2, None)], 3)
    assert {i for i, *_ in near_places(spark, rows, [(1, "Odd!")], 3)} == {2}
    assert not near_places(spark, [], [(1, item)], 3) and not near_places(spark, rows, [], 3)


@pytest.mark.parametrize("slack", [0, 2])
def test_contamination_proximity_against_brute_force(spark, slack):
    rng = random.Random(slack)
    words = "a b c d e f g h i j k l".split()
    rows = [(i % 40, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(60)] * 2
    items = []
    for k in range(25):
        own = rng.choice(rows)[1].split()[:rng.randrange(1, 14)]
        if k % 3 == 0 and len(own) > 3:
            own[2], own[0] = own[0], rng.choice([own[2], "absent"])
        items.append((k, " ".join(own)))
    want = brute.proximity(rows, items, slack)
    assert near_places(spark, rows, items, slack) == want and len(want) > 25


def test_bundles_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 400_000
    rows = [(1, "u1", "<a>"), (2, "u2", "<b>"), (3, "u3", "<a>"), (9, "u9", None), (8, None, ""), (4, "u4", "<a>"),
            (5, "u\n5", big), (6, "u6", big), (None, "u", "<a>"), (None, "u", "<only null>"), (2, "u2", "<b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = bundles.bundle_pages(pages, str(tmp_path / "w")).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter()
    for p, _, h in rows:
        body, own = (h or "").encode(), first.get(h or "")
        revisit = own is not None and p != own
        want[(p, len(body), bundles.base32_sha1(body), "revisit" if revisit else "response",
              own if revisit else None)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 5} == {big.encode()}
    for f in (tmp_path / "w").glob("part-*"):
        import io

        import zstandard

        data = f.read_bytes()
        for record_id, *_ in bundles.record_index(data):  # any single record, from its frame alone
            assert bundles.parse_record(bundles.seek(data, record_id))[0]["WARC-Record-ID"] == f"<{record_id}>"
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")  # plain Zstandard readers see the records
    assert bundles.bundle_pages(pages.where("false"), str(tmp_path / "none")).collect() == []


def test_bundles_are_valid_warc(spark, tmp_path):
    """Every record has a date and an id of its own, also if rows repeat; revisits name their response's record."""
    rows = [(1, "u1", "<a>"), (3, "u3", "<a>"), (4, "u4", "<a>"), (2, "u2", "<b>"), (2, "u2", "<b>"), (7, "u7", "<b>"),
            (None, "u", "<c>"), (None, "u", "<c>"), (5, "u5", None), (6, "u6", "")] + [(9, "u9", "<d>")] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bundles.write_bundles(pages, str(tmp_path / "w"))
    heads = {}
    for f in (tmp_path / "w").glob("part-*"):
        for record_id, *_ in bundles.record_index(f.read_bytes()):
            with f.open("rb") as file:
                head, _ = bundles.parse_record(bundles.seek_in(file, record_id))
            assert head["WARC-Record-ID"] == f"<{record_id}>" and head["WARC-Date"].endswith("Z")
            assert record_id not in heads
            heads[record_id] = head
    assert len(heads) == len(rows)
    named = {h["X-Page-ID"]: h["WARC-Refers-To"] for h in heads.values() if "WARC-Refers-To" in h}
    assert set(named) == {"3", "4", "6"}  # page 7 revisits a row that stands twice
    for page, to in named.items():
        target = heads[to.strip("<>")]
        assert target["WARC-Type"] == "response" and target["X-Page-ID"] == {"3": "1", "4": "1", "6": "5"}[page]


def test_bundles_seek_reads_ranges(tmp_path):
    """One record of a file costs its footer, record index and one frame."""
    now = bundles.Bundle()
    for k in range(60):
        now.add(f"id{k}", bundles.warc_record("response", f"id{k}", "u", "d", os.urandom(20_000), {}))
    data = now.close()

    class Counting(io.BytesIO):
        total = 0

        def read(self, size=-1):
            got = super().read(size)
            self.total += len(got)
            return got

    file = Counting(data)
    assert bundles.seek_in(file, "id33") == bundles.seek(data, "id33")
    assert file.total < len(data) / 3


def test_bundles_close_when_full(spark, tmp_path, monkeypatch):
    now = bundles.Bundle()
    for k in range(50):
        now.add(f"id{k}", bundles.warc_record("response", f"id{k}", "u", "d", os.urandom(20_000), {}))
    data = now.close()
    assert len(bundles.frame_table(data)) > 3 and data.endswith(bundles.LAST)


def test_quality_statistics(spark, docs, none):
    got = mcd.quality(docs).collect()
    want = Counter((i, *brute.text_statistics(t)) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                   for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(60)) <= kept | {3, 4} and 118 not in kept and 115 not in kept
    assert mcd.quality(none).collect() == []


def test_chi_square():
    assert mcd.chi_square_cdf(9.4877, 4) == pytest.approx(0.95, abs=1e-4)
    assert mcd.chi_square_quantile(0.99, 2) == pytest.approx(9.2103, abs=1e-3)


def test_quality_rejects_outliers_in_each_statistic(spark):
    """A text that stands apart from its clean source in one statistic alone is rejected, the source is kept."""
    rng = random.Random(6)

    def word(n=None):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n or rng.randrange(3, 9)))

    def lines(words):
        return "\n".join(" ".join(words[k:k + 10]) for k in range(0, len(words), 10))

    clean = [lines([word() for _ in range(rng.randrange(80, 300))]) for _ in range(300)]
    apart = {1000: lines([word(30) for _ in range(100)]), 1001: lines([word()[:-1] + "#" for _ in range(100)]),
             1002: "\n".join(f"{word()} {word()} {word()}\nyes no" for _ in range(20)),
             1003: lines([w for _ in range(9) for w in ("one", "more", "time", word(), word(), word(), word())])}
    rows = [*enumerate(clean), *apart.items()]
    docs = spark.createDataFrame([(i, t, "aa", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in mcd.quality(docs).collect()}
    assert not any(got[i]["base_failed"] for i in apart) and got[1002]["n_dup_lines"] == 19
    assert not any(got[i]["kept"] for i in apart)
    assert sum(got[i]["kept"] for i in range(300)) >= 295


def vectors(spark, x, noise=1e-6):
    rows = [("g", i, *map(float, r), *[noise] * 4) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key string, i long, " + ", ".join(f"{c} double" for c in mcd.VECTOR + mcd.NOISE))


def distances(df):
    est = mcd.robust_estimates(df, "key")
    d2 = mcd.distance(df.join(est, "key")).select("i", "d2").orderBy("i").collect()
    return est.first(), np.array([r["d2"] for r in d2])


def test_mcd_resists_contamination(spark):
    """A fifth of the rows far off do not hide one another, and the bulk stays inside."""
    rng = np.random.default_rng(2)
    good = rng.normal(0, 1, (400, 4)) @ np.diag([1, 2, 1, 0.5])
    bad = rng.normal(9, 0.3, (100, 4))
    est, d2 = distances(vectors(spark, np.vstack([good, bad])))
    assert np.sort(d2)[399] * 3 < np.sort(d2)[400]
    assert np.abs([est[f"m_{i}"] for i in range(4)]).max() < 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_mcd_against_many_random_starts(spark, seed):
    """As small a determinant as the best of 300 random starts, and the same rows beyond the cutoff."""
    rng = np.random.default_rng(seed)
    mix = np.array([[1, 0, 0, 0], [0.6, 1, 0, 0], [0, -0.4, 2, 0], [0.3, 0, 0, 0.5]])
    x = np.vstack([rng.normal(0, 1, (340, 4)) @ mix, rng.normal(0, 1, (60, 4)) @ mix + [14, -9, 12, 6]])
    mean, cov = brute.fast_mcd(x, mcd.KEEP, rng)
    cov = cov * mcd.consistency()
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    est, got = distances(vectors(spark, x))
    assert 2 * est["log_det"] <= np.linalg.slogdet(cov)[1] + 0.2  # a core's last bin is taken whole
    limit = mcd.chi_square_quantile(mcd.CUTOFF, 4)
    far = np.abs(want - limit) > 0.1 * limit  # rows at the very cutoff may fall to either side
    assert ((got > limit) == (want > limit))[far].all() and (got > limit)[340:].all() and (got > limit)[:340].sum() <= 4


def test_quality_keeps_clean_texts_with_rare_events(spark):
    """Where each text holds symbols and repeated lines by chance alone, about the nominal share is rejected."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]

    def text():
        lines = [" ".join(rng.choice(words) + ("#" if rng.random() < 0.002 else "") for _ in range(9))
                 for _ in range(rng.randrange(12, 40))]
        return "\n".join(x if rng.random() > 0.01 else lines[0] for x in lines)

    docs = spark.createDataFrame([(i, text(), "aa", "s") for i in range(1500)],
                                 "doc_id long, text string, lang string, source string")
    judged = mcd.quality(docs).cache()
    row = mcd.rejections(judged).first()
    assert judged.where("n_symbols > 0 or n_dup_lines > 0").count() > 500
    assert (row["n"], row["n_failed"]) == (1500, 0) and row["n_rejected"] <= 12


def test_suffix_arrays_against_brute_force(spark, docs, none):
    got = Counter(map(tuple, suffix.remove_repeats(docs).collect()))
    assert got == Counter(brute.repeats([(i, t) for i, t, *_ in ROWS]))
    assert suffix.remove_repeats(none).collect() == []
    kept = suffix.remove_repeats(docs.where("doc_id in (99, 100)"), keep_text=True).collect()
    assert sorted(len(r["kept"]) == 0 for r in kept) == [False, True]


def test_suffix_array_shards_merge(monkeypatch):
    """Stretches dealt over many small shards give what one shard gives."""
    rng = random.Random(8)
    stock = [bytes(rng.choice(b"ab \0\xff") for _ in range(120)) for _ in range(6)]
    texts = list(dict.fromkeys((s := rng.choice(stock))[a:a + rng.randrange(50, 81)] for _ in range(300)
                               if (a := rng.randrange(40)) >= 0))
    texts = [t for t in texts if len(t) >= 50]
    asked = [(texts[k::3], np.array([rng.randrange(9) for _ in texts[k::3]]), np.zeros(len(texts[k::3]), np.uint32))
             for k in range(3)]
    one, _ = suffix.merge_stretches(asked)
    monkeypatch.setattr(suffix, "SHARD", 700)
    many, _ = suffix.merge_stretches(asked)
    first = {}
    for t, i in ((t, i) for ts, ids, _ in asked for t, i in zip(ts, ids)):
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    for (a, ab), (b, bb), (ts, _, _) in zip(one, many, asked):
        assert (a == b).all() and (ab == bb).all()
        for t, low, bits in zip(ts, a, ab):
            assert [bool(bits >> k & 1) for k in range(len(t) - 49)] == [first[t[k:k + 50]] < low
                                                                         for k in range(len(t) - 49)]


def test_suffix_array_and_prefixes():
    text = b"mississippi\0missing\0ssi\0"
    symbols = np.frombuffer(text, np.uint8).astype(np.int16)
    order, rank = suffix.suffix_array(symbols)
    tails = [text[i:].split(b"\0")[0] for i in order]
    assert tails == sorted(tails)
    starts = np.array([0, 12, 20])
    lcp = suffix.common_prefixes(symbols, starts, order, 50)
    for k in range(1, len(tails)):
        n = 0
        while n < min(len(tails[k]), len(tails[k - 1])) and tails[k][n] == tails[k - 1][n]:
            n += 1
        assert lcp[k] == n or not tails[k]


def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t, *_ in ROWS:
        if i in (3, 4, None):
            continue
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, path).collect() == []


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    enc, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    odd = ["hello <|endoftext|> world", "a<|endoftext|><|endoftext|>\nb", "<|endoftext", "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\na", "a \nb", "a\n b", "a\tb", "it's we'll 'tis",
           "12 3a .,; x\0y", "a\x1cb", "\xa0x y", "<|endoftext|> x", "ÄÖ ß straße, größe. ²x", "x" * 3000, "a.b,c"]
    for text in [*odd, *(t for _, t, *_ in ROWS if t)]:
        want = np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.packed(text) == want, text


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(4)
    sizes = Counter((1 + (rng.beta(1.2, 3, 20_000) * 127)).astype(int).tolist())
    table, n = packing.plan(sizes, 128)
    filled = Counter()
    for size, a, b, first, each in table.tolist():
        for rank in range(a, b):
            filled[first + (rank - a) // each] += size
    assert max(filled.values()) <= 128 and sum(filled.values()) == sum(k * v for k, v in sizes.items())
    assert n <= 1.01 * sum(filled.values()) / 128 + 2
    assert packing.plan({}, 128)[1] == 0 and packing.plan({128: 3}, 128)[1] == 3


def test_template_tree(spark, docs, none):
    got = templates.without_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    passage = ROWS[60][1].split("\n")[2]
    for i in range(61, 90):  # the numbered footer and the passage go, all but the first
        lines = ROWS[i][1].split("\n")
        assert by[i][0]["n_dropped"] == 2 and passage not in by[i][0]["text"]
        assert by[i][0]["text"].split("\n") == [x for x in lines if x != passage and not x.startswith("Page")]
    assert by[60][0]["text"] == ROWS[60][1]
    for i, t, *_ in ROWS[:60]:  # clean texts and copies of whole documents stay
        assert all(r["n_dropped"] == 0 for r in by[i])
    assert all(by[i][0]["text"] == ROWS[91][1] for i in (99, 100, 101))
    assert by[112][0]["text"] is None and by[112][0]["n_lines"] == 0
    assert templates.without_recurring_lines(none).collect() == []


def lines_left(spark, rows):
    got = templates.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["text"] or "").split("\n") for r in got.collect()}


NAMES = [f"{a}{b}{c}" for a in ("ann", "bob", "eve", "joe") for b in ("ette", "ard", "lin", "son") for c in "pqrs"]


def test_template_tree_generalises_words(spark):
    """A field without digits varies: the leaf's constant positions make the template."""
    left = lines_left(spark, [(i, f"intro {n} line {i * 'x'}\nPosted by user {n} in the news\nend {n} of text {i * 'y'}")
                              for i, n in enumerate(NAMES[:16])])
    assert "Posted by" in left[0][1] and all(len(left[i]) == 2 for i in range(1, 16))


def test_template_tree_takes_lines_between_blank_lines_and_whole_blocks(spark):
    rows = [(i, f"{n} tells\n\nSubscribe to our letter today\n\n{n} ends\nfirst of block\nsecond of block here\nthird\nRead more")
            for i, n in enumerate(NAMES[:40])]
    left = lines_left(spark, rows)
    assert left[0] == rows[0][1].split("\n")
    for i in range(1, 40):
        assert left[i] == [f"{NAMES[i]} tells", "", "", f"{NAMES[i]} ends"]


def test_template_tree_holds_several_templates_a_leaf(spark):
    ends = ("in the daily news", "for all our friends")
    prose = "Posted by user {} {} {} {} {}"
    rows = [(i, f"own {n}\nPosted by user {n} {ends[i % 2]}") for i, n in enumerate(NAMES[:60])]
    rows += [(100 + i, prose.format(*(NAMES[(i * 7 + k * 11) % 64][k:] for k in range(5)))) for i in range(30)]
    left = lines_left(spark, rows)
    assert [i for i in range(60) if len(left[i]) == 2] == [0, 1]
    assert all(left[100 + i] == [rows[60 + i][1]] for i in range(30))


def test_template_tree_counts_copies_once(spark):
    text = "\n".join(f"{n} says what nobody else does" for n in NAMES[:5])
    rows = [(i, text) for i in range(30)] + [(100 + i, f"{n}\nkept by seven texts") for i, n in enumerate(NAMES[:7])]
    rows += [(200, "kept by seven texts\nshared foot line"), (201, "kept by seven texts\nshared foot line")]
    rows += [(300 + i, f"{n} has\nshared foot line") for i, n in enumerate(NAMES[:9])]
    left = lines_left(spark, rows)
    assert all(left[i] == text.split("\n") for i in range(30))
    assert left[100] == [NAMES[0], "kept by seven texts"] and left[101] == [NAMES[1]]  # the copies are its eighth text
    assert left[200] == left[201] == ["shared foot line"] and left[300] == [f"{NAMES[0]} has"]


def test_line_stage_keeps_clashing_columns(spark):
    import corpus_pipeline as P

    rows = [(i, f"{n}\nshared line of all", 5, "a", i, {"k": n}) for i, n in enumerate(NAMES[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped int, row string, n_chars long, gone map<string,string>")
    got = P.line_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    for r in got.collect():
        i = r["doc_id"]
        want = rows[i][1] if i == 0 else NAMES[i]
        assert tuple(r)[1:] == (want, 5, "a", 0 if i == 0 else len(want), {"k": NAMES[i]})


def test_pipeline(spark, docs, items, tmp_path):
    import corpus_pipeline as P

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in P.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < len(ROWS) and counts[-1] > 30
    texts = [r["text"] for r in now.collect()]
    assert not any(brute.contamination(t, ITEMS)[1] for t in texts)
    assert [r["n_chars"] for r in now.collect()] == [len(t) for t in texts]
    packed = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in now.collect()}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_return_every_row(spark, name):
    got = registry.QUERIES[name](spark, SMALL)
    n = got.count()
    source = {"op6": "pages", "op11": "conversations", "op12": "embeddings", "op13": "pages"}.get(
        name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet")
    rows = rows.select("conv_id").distinct().count() if source == "conversations" else rows.count()
    assert n >= rows if name.startswith("op9") else n == rows
