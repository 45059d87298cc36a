"""From raw documents to a tokenised mix: language ID, exact and near dedup, mixing, SentencePiece.

Every stage is one operator of `tableprep.llm`, takes and returns a table, and is written as Parquet before the next.
All but the last return the columns of documents; the last returns doc_id, tokens, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableprep.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_dropout
from tableprep.llm.common import read
from tableprep.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    return language_id.fit(docs).accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a similarity of 0.8 or more the document with the largest id stays."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens with merge-dropout; rows of one document get the same."""
    return sentencepiece_dropout.encode(docs)


STAGES = [
    ("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("ngram_join", drop_near_copies),
    ("mixing", mix_sources), ("sentencepiece", encode_pieces),
]

# The knapsack and the seeded segmentation have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
