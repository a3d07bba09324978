"""A corpus from raw documents to packed sequences: each stage's rows are written as Parquet and read by the next.

Defined results: null texts, and texts without a letter, go with language ID; rows without doc_id neither lose lines nor count
as near copies, and are mixed and packed; repeated rows of one doc_id are one document, of which near-dedup keeps a row; ties
follow the operators' own rules; very long texts pass whole; other columns stay as they are up to packing, whatever their
names; no rows give no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegrove.llm import common, language_id, line_dedup, mixing, packing, simhash


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents for which language ID finds no language (null texts and texts without a letter)."""
    return language_id.keep_known(docs, language_id.fit(docs))


def line_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; documents that lose every word with them go."""
    prefix = "__line_"  # a table may have columns of the plain names, or of these
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    done = line_dedup.dedup_lines(docs, prefix=prefix)
    whole, kept = F.col(f"{prefix}n_dropped") == 0, F.col(f"{prefix}kept_text")
    done = done.where(whole | kept.rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.when(whole, F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(kept).cast("long"))
    return done.withColumns(columns).select(*docs.columns)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays, once; rows without doc_id stay."""
    return simhash.keep_representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", line_deduped),
    ("simhash_near_dedup", near_deduped),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: Fingerprints by XXH64, seeded rounding and tokenizers are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with common.passing():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
