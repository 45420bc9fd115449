"""From raw documents to packed training sequences: documents of low quality, repeated passages and near copies go, and what
is left is packed into sequences. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webtally.llm import jaccard, lines, packing, quality
from webtally.llm.common import stored, table

#: Tokens of a sequence.
CAPACITY = 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; those that lose all their lines go."""
    return lines.drop_repeated_lines(spark, docs, sf_dir)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies."""
    return jaccard.drop_near_copies(spark, docs, sf_dir)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(docs, path, CAPACITY), CAPACITY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier can't be written in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
