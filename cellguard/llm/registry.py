"""The dealt operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bundles, hilbert, langid, mcd, packing, postings, pst, repair, simhash, styletree, suffix, templates,
               zonemaps)
from .common import id_bucket, table
from .sql import SQL as SQL

SHARDS = 16
#: What training readers filter on; most of them read one language, which therefore leads by two bits.
DIMENSIONS = [hilbert.Dimension("lang", "category", lead=2), hilbert.Dimension("source", "category"),
              hilbert.Dimension("doc_id"), hilbert.Dimension("size")]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), pst.by_crc(2, 7))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), "lang", "source")
    sharded = hilbert.hilbert_shards(docs, DIMENSIONS, SHARDS, ["doc_id", "text_crc32", "size"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = id_bucket(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~out))
    told = langid.predict(docs, model)
    return told.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score",
                       "ambiguous")


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = bundles.bundle_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = mcd.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = templates.without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
                       .alias("kept_sha256"))


def op11_block_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damage(repair.turns(table(spark, sf_dir, "conversations")))))


def op12_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_tree, op2_hilbert_shards, op3_simhash_pivots, op4_output_codes, op5_positional_index, op6_warc_bundles,
    op7_robust_outliers, op8_suffix_arrays, op9_cutting_stock, op10_template_tree,
    op11_block_repair, op12_zone_maps, op13_style_tree)}
