"""Benchmark decontamination through a positional inverted index, in DataFrame functions only.

The index stores one posting (term, document, position) for every occurrence of a benchmark term in the corpus, and
one length row per document under the empty term, in the checkpoint folder. A benchmark window is looked up from its
two rarest terms: their posting lists, moved back by the term's offset in the window, must meet at the same start.
Phrase matches are the meeting starts whose document words equal the window. For proximity matches the two lists need
only meet within a slack; then every word of the window that the corpus holds must stand within that slack of its place.

Documents are told apart by (doc_id, xxhash64 of the text), so null ids, ids given twice and repeated rows each keep
their own result; repeated rows get equal ones. Null and wordless texts have no words and no hits. A null benchmark
text has no window; an item without id marks words but is not counted. Extra columns are ignored. Empty tables give
empty results, an empty benchmark hits nothing. Long texts are indexed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import let, lower_ascii

WINDOW = 10
#: Words: ASCII letters (lower-cased) and digits, and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase, words, n) of each distinct window with a number, and (phrase, item_id) of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    each = cut_lineage(each.distinct(), "windows")
    phrases = each.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id())
    phrases = cut_lineage(phrases.withColumn("n", F.size("words")), "phrases")
    return phrases, each.join(phrases, "words").where("item_id is not null").select("phrase", "item_id")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, text_key, term, pos) of ``terms`` (column term), and per document ('', its word count)."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"),
                        F.posexplode(F.concat(words_of(text), F.array(F.lit("")))).alias("pos", "term"))
    # written first: Spark then knows the size of the vocabulary, and whether to send it to the tokens or shuffle both
    wanted = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    wanted = cut_lineage(wanted, "terms")
    return cut_lineage(keyed.join(wanted, "term", "left_semi"), "postings")


def anchors(phrases: DataFrame, index: DataFrame, whole: bool = True) -> list[DataFrame]:
    """The rarest and second rarest term of the windows that can occur: two tables (phrase, n, offset, term).

    A ``whole`` window can occur if the corpus holds all its words; otherwise more than half of them are enough.
    """
    counts = index.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("many"))
    terms = phrases.select("phrase", "n", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    own = Window.partitionBy("phrase")
    found = terms.withColumn("known", F.count(F.lit(1)).over(own)).where("known = n" if whole else "2 * known > n")
    placed = found.withColumn("place", F.row_number().over(own.orderBy("many", "offset"))).where("place <= 2")
    placed = cut_lineage(placed.select("phrase", "n", "offset", "term", "place"), "places")
    return [cut_lineage(placed.where(F.col("place") == k).drop("place"), f"anchors{k}") for k in (1, 2)]


def moved_lists(index: DataFrame, terms: DataFrame, least: int = 0) -> DataFrame:
    """Posting lists of one term a window, moved back by its offset: (doc_id, text_key, phrase, n, start >= least)."""
    return (index.where("term <> ''").join(terms, "term")
            .select("doc_id", "text_key", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start"))
            .where(F.col("start") >= least))


def candidates(index: DataFrame, rare: list[DataFrame]) -> DataFrame:
    """Starts at which the two rarest terms of a window both stand (one term: all its postings)."""
    first, second = (moved_lists(index, terms) for terms in rare)
    one = first.where("n = 1")
    a, b = first.where("n > 1").alias("a"), second.select("doc_id", "text_key", "phrase", "start").alias("b")
    same = (F.col("a.phrase") == F.col("b.phrase")) & (F.col("a.text_key") == F.col("b.text_key")) & (
        F.col("a.start") == F.col("b.start")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return one.unionByName(a.join(b, same, "left_semi"))


def phrase_matches(docs: DataFrame, index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact matches per document: (doc_id, text_key, hits), hits an array of struct(start, stop, phrase)."""
    found = candidates(index, anchors(phrases, index))
    found = cut_lineage(found.join(phrases.select("phrase", "words"), "phrase"), "starts")
    # one row per document, at most one entry per word and window: bounded by the text it is checked against
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "n", "phrase", "words")).alias("found")).alias("f")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("body"),
                        F.xxhash64(F.col("text").cast("string")).alias("text_key")).alias("d")
    both = texts.join(per_doc, (F.col("d.text_key") == F.col("f.text_key"))
                      & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")))
    true = let(words_of(F.col("body")), lambda w: F.filter(
        "found", lambda c: F.slice(w, c["start"] + 1, c["n"]) == c["words"]))
    hits = F.transform(true, lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("stop"),
                                                c["phrase"].alias("phrase")))
    return both.select("d.doc_id", "d.text_key", hits.alias("hits")).where("size(hits) > 0")


def covered(hits: Column) -> Column:
    """Number of positions inside any of the spans."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["stop"]))).alias("n"),
        F.greatest(a["stop"], s["stop"]).alias("stop")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    phrases, holders = windows(benchmark, width)
    index = build_index(docs, phrases.select(F.explode("words").alias("term")).distinct())
    matches = cut_lineage(phrase_matches(docs, index, phrases)
                          .select("doc_id", "text_key", covered(F.col("hits")).alias("n_hit"),
                                  F.array_distinct(F.col("hits.phrase")).alias("phrases")), "matches")
    items = (matches.select("doc_id", "text_key", "n_hit", F.explode("phrases").alias("phrase"))
             .join(holders, "phrase", "left").groupBy("doc_id", "text_key")
             .agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")).alias("i"))
    lengths = index.where("term = ''").select("doc_id", "text_key", F.col("pos").alias("n_words")).alias("l")
    joined = lengths.join(items, (F.col("l.text_key") == F.col("i.text_key"))
                          & F.col("l.doc_id").eqNullSafe(F.col("i.doc_id")), "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select(
        "l.doc_id", "l.text_key", F.col("n_words").cast("long"), n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    bad = contamination(docs, benchmark, width).where("contaminated").select("doc_id", "text_key").distinct()
    bad = cut_lineage(bad, "contaminated").alias("b")
    own = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string"))).alias("d")
    same = (F.col("d.__key") == F.col("b.text_key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id"))
    return own.join(bad, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int, width: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, phrase, words, start): windows whose words stand within ``slack`` of their places.

    The window's rarest word fixes ``start``; every other word that occurs anywhere in ``docs`` must stand at most
    ``slack`` from its place there, in any order. Words that no document holds are passed over, if the window has more
    words that do occur. A window of one word matches where it stands; ``slack`` 0 gives phrase matches of whole windows.
    """
    phrases, _ = windows(benchmark, width)
    terms = phrases.select("phrase", F.posexplode("words").alias("offset", "term"))
    index = build_index(docs, terms.select("term").distinct())
    rare = anchors(phrases, index, whole=False)
    occurring = cut_lineage(index.where("term <> ''").select("term").distinct(), "occurring")
    present = terms.join(occurring, "term").groupBy("phrase").agg(  # at most ``width`` entries
        F.collect_list(F.struct("offset", "term")).alias("present"))
    cell = F.floor(F.col("start") / (slack + 1))
    first = moved_lists(index, rare[0], -slack)
    a = first.where("n > 1").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("a")
    b = moved_lists(index, rare[1], -2 * slack).withColumn("cell", cell).alias("b")
    near = (F.col("a.phrase") == F.col("b.phrase")) & (F.col("a.text_key") == F.col("b.text_key")) & (
        F.col("a.cell") == F.col("b.cell")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (
        F.abs(F.col("a.start") - F.col("b.start")) <= slack)
    met = a.join(b, near, "left_semi").drop("cell").unionByName(first.where("n = 1"))
    met = cut_lineage(met.join(present, "phrase"), "near")
    # one row per document: its places of rare words, bounded by its own length and the windows that hold them
    per_doc = met.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("phrase", "start", "present")).alias("found")).alias("f")
    key = F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("body"),
                        key.alias("text_key")).distinct().alias("d")
    both = texts.join(per_doc, (F.col("d.text_key") == F.col("f.text_key"))
                      & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")))

    def stands(w: Column, start: Column, t: Column) -> Column:
        place = start + t["offset"]
        low = F.greatest(place - slack, F.lit(0))
        return F.array_contains(F.slice(w, low + 1, place + slack - low + 1), t["term"])

    true = let(words_of(F.col("body")), lambda w: F.filter(
        "found", lambda c: F.forall(c["present"], lambda t: stands(w, c["start"], t))))
    hits = both.select("d.doc_id", "d.text_key", F.explode(true).alias("hit"))
    hits = hits.select("doc_id", "text_key", "hit.phrase", "hit.start")
    return hits.join(phrases.select("phrase", "words"), "phrase").select(
        "doc_id", "text_key", "phrase", "words", "start")
