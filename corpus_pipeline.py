"""The corpus pipeline: language, quality, exact copies, near copies, packing, each stage on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet below the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import exact_dedup, language, ngram_join, packing, quality
from inkwell.session import Scratch, load


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return language.stage(spark, docs, sf_dir)


def qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.stage(spark, docs, sf_dir)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return ngram_join.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    import public_tokenizers as p

    return packing.curve_pack(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", languages),
    ("quality_classifier", qualities),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("packing", packed),
]

#: Trained models and tokenization are not SQL; tests/llm/test_brute_force.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted when the next one's is written."""
    scratch, docs, before = Scratch(spark), load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
