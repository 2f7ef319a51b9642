"""Dropping boilerplate lines by a log-template tree, in DataFrame functions only.

A line's tokens are its runs of non-space characters; a token with a digit is a variable field ``<*>``, and a line's
form is its tokens so masked. The fixed-depth tree goes by token count and the first ``DEPTH`` tokens, and from there a
leaf is settled in ``ROUNDS`` rounds. In a group of forms a position is constant if one token holds it in at least
``SHARE`` of the group's (text, form) pairs. If constants make up ``CONSTANT`` of the positions, they are a template, to
which every form that agrees with all of them belongs; the forms that disagree are a group of their own in the next
round. Else the group is split by the token at the position that is nearest to constant, so one leaf may hold many
templates; tokens in fewer than ``MIN_DOCS`` texts there make no group. A form that no template takes is its own.

A template is boilerplate if it stands in at least ``MIN_DOCS`` distinct texts: copies of a document count once. All its
lines go but the first line of the first text (by doc_id, text, line) that has it; documents with that same text
all keep it, so copies stay copies.

Counts run over all documents; they are pre-aggregated per task before each shuffle, so a line that a third of all
documents share is one row per task. Only leaves and templates that recur are joined back.

Lines without a token are never dropped. Null texts have no lines and stay null. Texts are told apart by xxhash64.
Extra columns pass through, save n_lines and n_dropped where they are added. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

from .common import let

DEPTH, ROUNDS, MIN_DOCS = 3, 3, 8
SHARE, CONSTANT = 0.6, 0.75
FIELD = "<*>"


def masked(line: Column) -> Column:
    """Tokens of a line joined by single spaces, those with a digit as fields."""
    shown = F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)
    return F.trim(F.regexp_replace(shown, r"[\x20\x09-\x0D]+", " "))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, n, form, leaf): one row per line with a token."""
    text = F.col("text").cast("string")

    def shaped(line: Column, at: Column) -> Column:
        return let(masked(line), lambda m: let(F.split(m, " "), lambda t: F.struct(
            at.alias("line"), F.when(m == "", 0).otherwise(F.size(t)).alias("n"), F.xxhash64(m).alias("form"),
            F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)).alias("leaf"))))

    rows = F.filter(F.transform(F.split(text, "\n"), shaped), lambda r: r["n"] > 0)
    return (docs.where("text is not null")
            .select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), F.explode(rows).alias("r"))
            .select("doc_id", "text_key", "r.*"))


def busy_forms(docs: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """(form, n, held, place, pos, token): forms that share a leaf with others, in how many texts they stand."""
    longer = lines.where(F.col("n") > DEPTH)  # shorter lines are alone in their leaf
    busy = longer.groupBy("leaf").agg(F.count(F.lit(1)).alias("many"), F.min("form").alias("a"), F.max("form").alias("b"))
    busy = cut_lineage(busy.where((F.col("many") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf"), "leaves")
    forms = (longer.join(busy, "leaf", "left_semi").select("leaf", "form", "n", "text_key").distinct()
             .groupBy("leaf", "form", "n").agg(F.count(F.lit(1)).alias("held")))
    forms = cut_lineage(forms, "forms")
    # the words of those forms, from the texts: only forms of busy leaves leave the scan
    texts = docs.where("text is not null").select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("l"))
    words = (texts.select(masked(F.col("l")).alias("m")).select(F.xxhash64("m").alias("form"), "m")
             .join(forms.select("form"), "form", "left_semi").groupBy("form").agg(F.min("m").alias("m")))
    return forms.join(words, "form").select(
        "form", "n", "held", F.col("leaf").alias("place"), F.posexplode(F.split("m", " ")).alias("pos", "token"))


def leaf_templates(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(form, template) of the lines that belong to a generalised template (template: a LONG other than the form)."""
    tokens = cut_lineage(busy_forms(docs, lines, min_docs), "tokens")
    found = []
    for turn in range(ROUNDS):
        sizes = tokens.where("pos = 0").groupBy("place").agg(
            F.sum("held").alias("all"), F.min("form").alias("a"), F.max("form").alias("b"))
        sizes = sizes.where((F.col("a") != F.col("b")) & (F.col("all") >= min_docs)).select("place", "all")
        votes = tokens.groupBy("place", "pos", "token").agg(F.sum("held").alias("votes"))
        best = votes.groupBy("place", "pos").agg(F.max(F.struct("votes", "token")).alias("top")).join(sizes, "place")
        fixed = (F.col("top.token") != FIELD) & (F.col("top.votes") >= SHARE * F.col("all"))
        near = F.when((F.col("top.token") != FIELD) & ~fixed, F.struct("top.votes", (-F.col("pos")).alias("less")))
        best = cut_lineage(best.select("place", "pos", F.col("top.token").alias("token"), fixed.alias("fixed"),
                                       near.alias("near")), "best")
        judged = best.groupBy("place").agg(F.count_if("fixed").alias("constants"), (-F.max("near")["less"]).alias("split"))
        agree = (tokens.join(best.where("fixed").select("place", "pos", "token"), ["place", "pos", "token"], "left_semi")
                 .groupBy("place", "form").agg(F.count(F.lit(1)).alias("same")))
        firm = F.col("constants") >= CONSTANT * F.col("n")
        state = (tokens.select("place", "form", "n").distinct().join(judged, "place").join(agree, ["place", "form"], "left")
                 .select("place", "form", "split", firm.alias("firm"),
                         (firm & (F.coalesce("same", F.lit(0)) == F.col("constants"))).alias("fits")))
        state = cut_lineage(state, "state")
        found.append(state.where("fits").select("form", F.xxhash64(F.lit("template"), F.lit(turn), "place").alias("template")))
        if turn + 1 < ROUNDS:
            rest = state.where("firm and not fits").select(
                "place", "form", F.xxhash64(F.col("place"), F.lit("rest")).alias("next"))
            common = votes.where(F.col("votes") >= min_docs).select("place", F.col("pos").alias("split"), "token")
            parts = (state.where("not firm and split is not null")
                     .join(tokens.select("place", "form", F.col("pos").alias("split"), "token"), ["place", "form", "split"])
                     .join(common, ["place", "split", "token"], "left_semi")
                     .select("place", "form", F.xxhash64("place", "split", "token").alias("next")))
            tokens = cut_lineage(tokens.join(rest.unionByName(parts), ["place", "form"]).select(
                "form", "n", "held", F.col("next").alias("place"), "pos", "token"), "tokens")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, line, template) of the lines to drop: all of a boilerplate template but its first."""
    lines = cut_lineage(line_rows(docs), "lines")
    general = cut_lineage(leaf_templates(docs, lines, min_docs), "templates")
    named = lines.join(general, "form", "left").withColumn("template", F.coalesce("template", "form"))
    # cheap counts first; exact counts of texts only for templates that can pass
    often = named.groupBy("template").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= min_docs)
    often = cut_lineage(often.select("template"), "often")
    named = cut_lineage(named.join(often, "template", "left_semi")
                        .select("doc_id", "text_key", "line", "template"), "named")
    passed = (named.select("template", "text_key").distinct().groupBy("template")
              .agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_docs).select("template"))
    first = named.groupBy("template").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"))
    passed = cut_lineage(passed.join(first, "template"), "passed")
    return (named.join(passed, "template")
            .where((F.col("text_key") != F.col("first.text_key")) | (F.col("line") != F.col("first.line")))
            .select("doc_id", "text_key", "line", "template"))


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, text, n_lines, n_dropped): every row of ``docs`` whole, and its text rid of boilerplate lines."""
    gone = recurring_lines(docs, min_docs).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    # both sides grow with the corpus: one shuffle by document at every size, not a broadcast while it is small
    gone = cut_lineage(gone, "gone").hint("merge").alias("g")
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias(
        "id"), F.xxhash64(text).alias("key"), text.alias("text"))
    both = own.join(gone, F.col("id").eqNullSafe(F.col("g.doc_id")) & (F.col("key") == F.col("g.text_key")), "left")
    lines = F.split("text", "\n")
    left = let(lines, lambda all_: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone")), lambda i: F.get(all_, i)), "\n"))
    return both.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
                       F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


COUNTS = ("n_lines", "n_dropped")


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with text rid of boilerplate lines, and n_lines (before) and n_dropped (LONG) after its columns.

    Columns of ``docs`` that bear those two names give way to them; ``cleaned`` keeps them.
    """
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in COUNTS]
    return cleaned(docs, min_docs).select(*kept, *COUNTS)
