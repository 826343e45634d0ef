"""A training-data pipeline over ``documents``: each stage is an operator whose decisions take effect.

Rows without a doc_id stay unless a stage judges their text (quality, leaks, secrets);
near duplicates of them are found only by equal texts of rows with an id. Columns other
than doc_id, text and n_chars pass through untouched.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, near_dedup, piece_coding, quality_rules, secrets
from corpusloom.llm.common import semi_by_size, table, written
from corpusloom.session import small_batches

PIECE_MODEL = "piece_bpe_32k.model"
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of the current policy; null texts have no words and go."""
    rows = quality_rules.measured(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")))
    # A filter is copied into the steps below it unless it uses a column like this one.
    rows = rows.withColumn("failed", quality_rules.failed_bits()).withColumn("at", F.monotonically_increasing_id())
    return rows.where(quality_rules.passes("failed") & (F.col("at") >= 0)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; repeated rows of one id are one document."""
    groups = near_dedup.near_groups(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    gone = written(groups.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct(), "gone")
    return semi_by_size(docs, gone, ["doc_id"], "left_anti").select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any item of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redacted(docs, secrets.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids with an end id, and whether they decode to the text."""
    return piece_coding.encode_documents(docs, public_tokenizers.path(PIECE_MODEL))


def _bounded(stage):
    """The stage with small Arrow batches, as its rows have whole texts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", _bounded(near_duplicates)),
    ("benchmark decontamination", _bounded(leaks)),
    ("secret scans", _bounded(secret_spans)),
    ("SentencePiece encoding and decoding", _bounded(encoded)),
]

#: The stages of signatures, search, network and subword ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
