"""Language ID with error-correcting output codes.

Each language has a codeword; for each bit a classifier on hashed byte n-grams of the
whole text tells the languages with a one from those with a zero. A text gets the
language whose codeword loses least, with the bits weighted by how well they are learned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, text_batches

#: Distinct texts of each language that the classifiers are fitted on, at most.
SAMPLE_PER_LANGUAGE = 500
BUCKETS, PARTS = 8192, (64, 8, 1)
AMBIGUOUS_GAP = 0.2
CHUNK = 1 << 20
UNKNOWN = "und"
_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
_LETTER = re.compile(r"\p{L}")
#: ASCII letters in lower case and bytes of other characters; all else is a space.
_CLASS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # bits


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 2- and 3-byte grams, of length one."""
    data = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    counts = np.zeros(BUCKETS)
    for start in range(0, len(data), CHUNK):
        part = data[max(0, start - 2):start + CHUNK].astype(np.uint32)
        pairs = part[:-1] << np.uint32(8) | part[1:]
        triples = pairs[:-1] << np.uint32(8) | part[2:]
        for grams in (pairs + np.uint32(1 << 25), triples):
            hashed = (grams * np.uint32(2654435761)) >> np.uint32(19)
            counts += np.bincount(hashed, minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def codewords(n: int) -> np.ndarray:
    """One row for each of ``n`` classes: all splits of few classes, hashed ones of many."""
    if n <= 5:
        splits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c] or [(1,) * n]
    else:
        draw = np.random.default_rng(n)
        bits = max(16, 6 * int(np.ceil(np.log2(n))))
        splits = [np.where(draw.permutation(n) < n // 2, 1, -1) for _ in range(bits)]
    return np.array(splits, float).T


def held_out() -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> CodeModel | None:
    """Classifiers from text and lang of rows that aren't held out; None without any.

    Of each language the ``per_language`` distinct texts with the least hash are used,
    or all if there are fewer.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = known.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.withColumns({"draw": F.xxhash64("text", F.lit(7)), "body": F.xxhash64("text", F.lit(8))})
    texts = known.groupBy("lang", "draw", "body").agg(F.min("doc_id").alias("doc_id"))
    # A language's texts are cut to the limit in parts before they meet, so none has to go to one task.
    least = texts
    for parts in PARTS:
        part = F.pmod("body", F.lit(parts))
        place = F.row_number().over(Window.partitionBy("lang", part).orderBy("draw", "body"))
        least = least.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    chosen = known.join(F.broadcast(least), ["lang", "draw", "body", "doc_id"]).select("text", "lang", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                values = profile(text)
                at = np.flatnonzero(values)
                rows.append(at.astype(np.uint16).tobytes() + values[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("draw"), pa.array(rows, pa.binary())],
                schema=arrow_schema("lang string, draw long, grams binary"))

    own = chosen.mapInArrow(run, "lang string, draw long, grams binary")  # rows repeated with their id meet here
    rows = sorted(own.groupBy("lang", "draw").agg(F.min("grams").alias("grams")).select("lang", "grams").collect())
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        half = len(r["grams"]) // 2
        x[i, np.frombuffer(r["grams"][:half], np.uint16)] = np.frombuffer(r["grams"][half:], np.float16)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    codes = codewords(len(languages))
    truth = codes[[languages.index(r["lang"]) for r in rows]]
    return CodeModel(languages, codes, *_classifiers(x, truth))


def _classifiers(x: np.ndarray, truth: np.ndarray, steps: int = 150, rate: float = 0.1):
    """Logistic regressions, one for each column of ``truth``, and how far to trust each."""
    weights, bias = np.zeros((x.shape[1], truth.shape[1]), np.float32), np.zeros(truth.shape[1])
    state = [np.zeros_like(weights), np.zeros_like(weights)]
    for step in range(1, steps + 1):
        pull = truth / (1 + np.exp(np.clip(truth * (x @ weights + bias), -30, 30))) / len(x)
        gradient = x.T @ pull.astype(np.float32) - 1e-5 * weights
        state[0] += 0.1 * (gradient - state[0])
        state[1] += 0.001 * (gradient**2 - state[1])
        weights += rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        bias += pull.sum(0)
    right = ((x @ weights + bias) * truth > 0).mean(0)
    return weights, bias, np.maximum(0.05, 2 * right - 1)


def decode(margins: np.ndarray, model: CodeModel) -> tuple[np.ndarray, np.ndarray]:
    """(best language by row, probabilities of all): weighted losses against each codeword."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * model.codes[None], -30, 30)))
    total = -(loss * model.trust).sum(2)
    odds = np.exp(total - total.max(1, keepdims=True))
    return total.argmax(1), odds / odds.sum(1, keepdims=True)


def predict_languages(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of ``docs``, whole texts.

    ``score`` is the probability of the chosen language; ``ambiguous`` marks texts whose
    second language comes within a gap of 0.2. Null texts, texts without a letter, and
    all texts if nothing could be learned, are ``und`` with score 0. Repeated rows are
    predicted row by row; a null doc_id stays, not held out. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_batches(batches):
            texts = batch.column("text").to_pylist()
            names, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            able = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
            if able:
                margins = np.stack([profile(texts[i]).astype(np.float32) @ model.weights for i in able]) + model.bias
                best, odds = decode(margins, model)
                ranked = np.sort(odds, 1)
                for i, k in zip(able, best):
                    names[i] = model.languages[k]
                scores[able] = ranked[:, -1]
                unsure[able] = ranked[:, -1] - (ranked[:, -2] if odds.shape[1] > 1 else 0) < AMBIGUOUS_GAP
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores), pa.array(unsure)], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.withColumn("held_out", held_out()).mapInArrow(run, _SCHEMA)
