"""Toxicity: ordinal regression with cumulative links on sparse text features.

Grades are 0 (labelled clean), 1 and 2 (labelled toxic; 2 from the upper half by the
number of marker words). P(grade >= k) = sigmoid(score - threshold k), with one weight
for each feature, shared by all thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, arrow_schema, text_batches

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE_PER_LABEL = 3000
MIN_DOCS = 3
#: A feature is used if its log odds, less this many standard errors, reach the bound.
ERRORS, MIN_LOG_ODDS = 1.64, 1.2
PREFIX = 5
_SCHEMA = "doc_id long, p_grade_1 double, p_grade_2 double, expected_severity double, toxic boolean"
_PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"


@dataclass
class OrdinalModel:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, float] = (20.0, 20.0)
    cutoff: float = 0.5  # of P(grade >= 1), from which a text is called toxic


def word_features(word: bytes) -> tuple[int, ...]:
    """A hash of the word, and one of how it starts."""
    word = word.strip(_PUNCTUATION)
    if not word:
        return ()
    signed = xxhash.xxh64_intdigest(word) - (1 << 63)
    start = word.decode()[:PREFIX]
    return signed, xxhash.xxh64_intdigest(start.encode(), seed=1) - (1 << 63)


def text_features(text: str | None, memo) -> set[int]:
    return {f for w in set((text or "").encode().lower().split()) for f in memo[w]}


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> list:
    """Features of a bounded number of labelled rows, chosen by a hash of the id."""
    truth = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    )
    chosen = [truth.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = keyed.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * per_label rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features)
        for batch in text_batches(batches):
            found = [np.fromiter(sorted(text_features(t, memo)), np.int64).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())],
                schema=arrow_schema("doc_id long, toxic long, features binary"))

    found = rows.mapInArrow(run, "doc_id long, toxic long, features binary")
    return sorted(found.groupBy("doc_id", "toxic").agg(F.min("features").alias("features")).collect())  # one row of an id


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> OrdinalModel:
    """The model of at most ``per_label`` clean and as many toxic labelled rows."""
    rows = _sample(docs, labels, per_label)
    toxic = np.array([r["toxic"] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return OrdinalModel()
    lists = [np.frombuffer(r["features"], np.int64) for r in rows]
    names, column = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    n = len(names)
    hits = np.bincount(column[toxic[row]], minlength=n)
    misses = np.bincount(column[~toxic[row]], minlength=n)
    odds = np.log((hits + 0.25) / (toxic.sum() + 0.5)) - np.log((misses + 0.25) / ((~toxic).sum() + 0.5))
    error = np.sqrt(1 / (hits + 0.5) + 1 / (misses + 0.5))
    kept = (hits + misses >= MIN_DOCS) & (odds - ERRORS * error >= MIN_LOG_ODDS)
    if not kept.any():
        return OrdinalModel()
    place = np.cumsum(kept) - 1
    use = kept[column]
    row, column = row[use], place[column[use]]
    markers = np.bincount(row, minlength=len(rows))
    grade = toxic * (1 + (markers > np.median(markers[toxic])))
    weights, thresholds = _descend(row, column, grade, odds[kept] / 2)
    score = np.bincount(row, weights=weights[column], minlength=len(rows))
    return OrdinalModel(dict(zip(names[kept].tolist(), weights.tolist())), thresholds, _cutoff(score - thresholds[0], toxic))


def _cutoff(logits: np.ndarray, toxic: np.ndarray) -> float:
    """Where the share of toxic rows above, less twice that of clean ones, is largest."""
    cuts = np.unique(logits)
    above = [1 - np.searchsorted(np.sort(logits[side]), cuts) / side.sum() for side in (toxic, ~toxic)]
    best = int(np.argmax(above[0] - 2 * above[1]))
    middle = cuts[best] - (cuts[best] - cuts[best - 1]) / 4 if best else cuts[0]
    return float(1 / (1 + np.exp(-np.clip(middle, -40, 40))))


def _descend(row, column, grade, start, steps: int = 250, rate: float = 0.05, ridge: float = 1e-3):
    """Weights and ordered thresholds by Adam on the likelihood of the grades."""
    n = len(start)
    x = np.concatenate([start, [2.0, 0.0]])  # weights, first threshold, log of the gap to the second
    first, second = np.zeros_like(x), np.zeros_like(x)
    share = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=x[column], minlength=len(grade))
        upper = x[n] + np.exp(x[n + 1])
        p1, p2 = (1 / (1 + np.exp(np.clip(t - score, -40, 40))) for t in (x[n], upper))
        middle = np.maximum(p1 - p2, 1e-9)
        d1 = np.where(grade == 0, -p1, np.where(grade == 1, p1 * (1 - p1) / middle, 0.0)) * share
        d2 = np.where(grade == 2, 1 - p2, np.where(grade == 1, -p2 * (1 - p2) / middle, 0.0)) * share
        gradient = np.empty_like(x)
        gradient[:n] = np.bincount(column, weights=(d1 + d2)[row], minlength=n) - ridge * x[:n]
        gradient[n], gradient[n + 1] = -(d1 + d2).sum(), -d2.sum() * np.exp(x[n + 1])
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:n], (float(x[n]), float(x[n] + np.exp(x[n + 1])))


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, p_grade_1, p_grade_2, expected_severity, toxic) of every row, whole texts.

    ``p_grade_k`` is the probability of grade k or more; ``expected_severity`` is their
    sum; ``toxic`` is p_grade_1 >= the model's cutoff. Null and empty texts have a score of zero before
    the thresholds; without labels of both kinds nothing is toxic. Repeated rows are
    graded row by row; a null doc_id stays.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value.weights, shared.value.thresholds
        memo = Memo(lambda word: tuple(f for f in word_features(word) if f in weights))
        for batch in text_batches(batches):
            score = np.array([sum(weights[f] for f in text_features(t, memo)) for t in batch.column("text").to_pylist()])
            p1, p2 = (1 / (1 + np.exp(np.clip(t - score, -40, 40))) for t in thresholds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p1), pa.array(p2), pa.array(p1 + p2), pa.array(p1 >= shared.value.cutoff)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)
