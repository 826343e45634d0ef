"""Importance resampling of documents towards the distribution of target texts.

Word runs are hashed to buckets; a bucket's gain is the log ratio of its share in the
target to its share in the documents, and a document's weight the mean gain of its runs.
A Gumbel number from a hash of the id is added, so that the highest scores are a draw
without replacement; they are found by the ranks of ``sample_sort``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, arrow_schema, terms_of, text_batches, written
from corpusloom.llm.sample_sort import ranks

BUCKETS, RUN_WORDS = 10_000, 2
SEED, MIN_WORDS, PERCENT = 7, 20, 25
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
_LAST = (1 << 63) - 1


class Hasher:
    """Buckets of all runs of up to ``run_words`` words."""

    def __init__(self, buckets: int, run_words: int):
        self.buckets, self.run_words = buckets, run_words
        self.single, self.spaced = Memo(crc32), Memo(b" ".__add__)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = [list(map(self.single.__getitem__, words))]
        spaced = list(map(self.spaced.__getitem__, words)) if self.run_words > 1 else []
        for k in range(1, self.run_words):  # a checksum goes on from that of the run without its last word
            found.append(list(map(crc32, spaced[k:], found[-1])))
        flat = np.array([c for level in found for c in level], np.int64)
        return flat % self.buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run_words: int = RUN_WORDS) -> DataFrame:
    """(bucket, n): occurrences of all word runs of all texts, added up in each task first."""
    schema = arrow_schema("bucket long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(buckets, np.int64), Hasher(buckets, run_words)
        for batch in text_batches(batches):
            for data in batch.column("text").to_pylist():
                counts += np.bincount(hasher(terms_of(data)), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], schema=schema)

    found = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, from two tables of ``bucket_counts`` (``buckets`` rows at most)."""
    counts = np.zeros((2, buckets), np.int64)
    for row, table in zip(counts, (source, target)):
        for found in table.collect():
            row[found["bucket"]] = found["n"]
    (source_n, target_n), total = counts, counts.sum(1)
    above, below = (target_n + 1.0) * float(total[0] + buckets), (source_n + 1.0) * float(total[1] + buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(above.tolist(), below.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 * ln(-ln(u))), u from the hash of ``<seed>:<id>``; no id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, run_words: int = RUN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = arrow_schema(_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        hasher = Hasher(len(gain), run_words)
        for batch in text_batches(batches):
            out = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(data)
                found = hasher(words)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out.append((doc_id, len(words), len(found), weight, weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return columns.mapInArrow(run, _SCORED)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
    run_words: int = RUN_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, whole texts.

    Of the rows with ``min_words`` words or more the highest-scoring ``percent`` have
    ranks 1, 2, 3, ... (ties by smaller doc_id, rows without one last); all others have
    null. Null and empty texts have no features, weight 0 and aren't drawn. Repeated rows
    are drawn each. An empty target makes all gains nearly alike; without documents there
    are no rows. Other columns aren't read.
    """
    rows = scored(docs, gains(bucket_counts(docs, buckets, run_words), bucket_counts(target, buckets, run_words), buckets),
                  run_words, seed)
    keyed = rows.withColumns({"high": -F.col("score"), "low": F.coalesce("doc_id", F.lit(_LAST))})
    # Rows that can't be drawn come behind all others, and count for none.
    keyed = keyed.withColumn("high", F.when(F.col("n_words") >= min_words, F.col("high")).otherwise(F.lit(_LAST)))
    keyed = written(keyed, "scored")
    able = keyed.where(F.col("n_words") >= min_words).count()
    return ranks(keyed, first=percent * able // 100).drop("high", "low")
