"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Stages, in order: language ID (texts without a recognisable language go), line dedup (boilerplate lines go), SimHash
near-dedup (one document of each group stays), benchmark decontamination (documents with benchmark passages go),
packing into sequences. All but the last return the columns of ``documents``. Each stage's result is written as Parquet
in the checkpoint folder and read again, so a lost executor costs at most one stage.

Null ids, repeated rows, empty texts and extra columns are handled as the operators' docstrings say; what is joined
back by id is joined null-safe and by the text too, so rows that share an id keep their own decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellguard.llm import langid, packing, postings, simhash, templates
from cellguard.llm.common import id_bucket, table
from cellguard.llm.registry import tokenizer_path
from cellguard.session import cut_lineage

#: SQL has no byte-pair encoder, SimHash or trained classifier.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or letterless text, or two codewords about equally near."""
    model = langid.fit(docs.where(id_bucket(F.col("doc_id"), 3) != 1))
    return langid.keep_recognised(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines (all but their first occurrence) and refresh n_chars where the text changed."""
    left = templates.cleaned(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document (smallest doc_id, then text) of each group linked by SimHash."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    return postings.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences: one row per piece."""
    packed = packing.pack(docs.select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
