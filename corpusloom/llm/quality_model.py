"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Each token has an index vector of a few signs, made from its hash. A word's vector is the
sum of the index vectors of itself and of its neighbours at all its places in the whole
corpus. A document is the mean of its words' vectors; a network of two layers gives a
logit, which is divided by a temperature fitted on rows that the network hasn't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, arrow_schema, mix, text_batches

#: Labelled rows of each label that the model is fitted on, and words with a vector, at most.
SAMPLE_PER_LABEL, VOCABULARY = 3000, 2040
DIMENSIONS, SIGNS, REACH = 96, 4, 2
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.01, 1e-3
CALIBRATION_SHARE = 4  # one in so many rows of the sample sets the temperature
CUTOFF = 0.3
#: Rows of the word table that travel together.
GROUP = 64
POOL_TEXTS = 256
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
#: Stand for a token that comes again at once, and for a word that comes again behind one other token.
_AGAIN, _ECHO = b"\x00again", b"\x00echo"
_SHAPES = [b"\x00lower", b"\x00Title", b"\x00UPPER", b"\x00digits", b"\x00mixed", b"\x00signs", b"\x00long"]
_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def shape(token: bytes) -> bytes:
    """The class that stands for a token without a vector of its own."""
    if not (token[:1].isalnum() or token[0] > 127):
        return _SHAPES[5]
    if len(token) > 30:
        return _SHAPES[6]
    if token.islower():
        return _SHAPES[0]
    if token.isdigit():
        return _SHAPES[3]
    if token.istitle():
        return _SHAPES[1]
    return _SHAPES[2] if token.isupper() else _SHAPES[4]


def tokens_of(data: bytes | None) -> list[bytes]:
    """Runs of letters and digits, and runs of other signs; case stays, repeats are told."""
    found = _TOKEN.findall(data or b"")
    before = [b"", *found]
    return [
        _AGAIN if token == last else _ECHO if token == other and (token[0] > 127 or token.isalnum()) else token
        for token, last, other in zip(found, before, [b"", *before])
    ]


class Vocabulary:
    """Numbers of tokens: of the ``words`` first, then of the shapes of all others."""

    def __init__(self, words: list[bytes]):
        self.words = [*words, _AGAIN, _ECHO, *_SHAPES]
        self.number = {w: i for i, w in enumerate(self.words)}

    def memo(self) -> Memo:
        number = self.number
        return Memo(lambda token: number[token] if token in number else number[shape(token)])

    def index_vectors(self) -> np.ndarray:
        """The index vector of each word: SIGNS places with 1 or -1 (added where they meet)."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        out = np.zeros((len(self.words), DIMENSIONS))
        for k in range(SIGNS):
            draw = mix(hashes + np.uint64(k + 1))
            place = (draw >> np.uint64(8)).astype(np.int64) % DIMENSIONS
            out[np.arange(len(out)), place] += 1.0 - 2.0 * (draw & np.uint64(1)).astype(float)
        return out


@dataclass
class QualityModel:
    vocabulary: Vocabulary
    vectors: np.ndarray  # words x dimensions
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows of pooled vectors."""
        logit = _forward((pooled - self.centre) / self.scale, self.layers)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def held_out() -> F.Column:
    """Whether crc32 of the id as text can be divided by 5; a null id isn't held out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most ``per_label`` rows of each label by a hash of the id,
    one text of an id, and how many rows each label has. Held-out rows count for nothing."""
    truth = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("long").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()}
    draw = [F.xxhash64("doc_id", F.lit(13)), F.col("doc_id")]
    chosen = [truth.where(F.col("label") == k).orderBy(*draw).limit(per_label) for k in (0, 1)]
    rows = _columns(docs).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * per_label ids
    rows = rows.withColumn("own", F.xxhash64("text"))
    first = rows.groupBy("doc_id").agg(F.min("own").alias("own"))
    return rows.join(F.broadcast(first), ["doc_id", "own"]).drop("own"), counts


def _common_words(rows: DataFrame, size: int) -> list[bytes]:
    """The tokens that most texts of the sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            seen = Counter()
            for data in batch.column("text").to_pylist():
                seen.update({t for t in tokens_of(data) if len(t) <= 30 and t[0]})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [bytes(r["word"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect()]


def word_vectors(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Vectors of all words from all places in ``docs``: summed in each task, then by groups of words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    groups = -(-len(vocabulary.words) // GROUP)
    cells = GROUP * DIMENSIONS
    out = "part int, sums binary"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        memo, n = vocabulary.memo(), len(vocabulary.words)
        side = n + 1  # one more number stands between texts
        # Who is how often behind whom; index vectors are added for a pair once, times its count.
        pairs = np.zeros(side * side, np.int64)
        for batch in text_batches(batches):
            flat = []
            for data in batch.column("text").to_pylist():
                flat += map(memo.__getitem__, tokens_of(data))
                flat += [n] * REACH
            words = np.array(flat, np.int64)
            for offset in range(1, REACH + 1):
                pairs += np.bincount(words[:-offset] * side + words[offset:], minlength=len(pairs))
            own = np.bincount(words, minlength=side)
            pairs[np.arange(n) * side + np.arange(n)] += (own[:n] + 1) // 2  # a word is in its own context, from both sides
        near = pairs.reshape(side, side)[:n, :n].astype(float)
        rows = np.zeros((groups * GROUP, DIMENSIONS))
        rows[:n] = (near + near.T) @ vocabulary.index_vectors()
        rows = rows.reshape(groups, cells)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([rows[g].tobytes() for g in used], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                row = np.frombuffer(data)
                sums[part] = sums[part] + row if part in sums else row.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])

    found = _columns(docs).select("text").mapInArrow(places, out).repartition(min(groups, 64), "part").mapInArrow(add, out)
    table = np.zeros((groups, cells))
    for row in found.collect():  # one row of a group of words
        table[row["part"]] = np.frombuffer(row["sums"])
    table = table.reshape(-1, DIMENSIONS)[:len(vocabulary.words)]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pool(texts: list[bytes | None], memo: Memo, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of the tokens of each text; zeros without any."""
    out, n = np.zeros((len(texts), vectors.shape[1])), len(vectors)
    for start in range(0, len(texts), POOL_TEXTS):
        lists = [list(map(memo.__getitem__, tokens_of(data))) for data in texts[start:start + POOL_TEXTS]]
        sizes = np.array([len(x) for x in lists])
        cells = np.repeat(np.arange(len(lists)), sizes) * n + np.array([w for x in lists for w in x], np.int64)
        counts = np.bincount(cells, minlength=len(lists) * n).reshape(-1, n)
        out[start:start + len(lists)] = (counts / np.maximum(sizes, 1)[:, None]).astype(np.float32) @ vectors
    return out


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, vocabulary_size: int = VOCABULARY,
) -> QualityModel | float:
    """The model from labelled rows that aren't held out; with one label or none only its share (1/2 without labels)."""
    sample, counts = _sample(docs, labels, per_label)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    if not counts.get(0) or not counts.get(1):
        return share
    vocabulary = Vocabulary(_common_words(sample, vocabulary_size))
    vectors = word_vectors(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vectors = shared.value
        memo = vocabulary.memo()
        for batch in text_batches(batches):
            rows = [x.tobytes() for x in pool(batch.column("text").to_pylist(), memo, vectors)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                schema=arrow_schema("doc_id long, label long, pooled binary"))

    pooled = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label long, pooled binary")
    # A row of an id, at most 2 * per_label of DIMENSIONS numbers.
    rows = sorted(pooled.groupBy("doc_id", "label").agg(F.min("pooled").alias("pooled")).collect())
    x = np.array([np.frombuffer(r["pooled"]) for r in rows])
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return share
    # Rows count so that the labels have the weights that they have among all labelled rows.
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    last = np.array([xxhash.xxh64_intdigest(str(r["doc_id"]), 5) % CALIBRATION_SHARE == 0 for r in rows])
    if len(np.unique(y[last])) < 2 or len(np.unique(y[~last])) < 2:
        last = np.zeros(len(y), bool)
    centre, scale = x[~last].mean(0), x[~last].std(0) + 1e-6
    x = (x - centre) / scale
    layers = _descend(x[~last], y[~last], weight[~last] / weight[~last].sum())
    use = last if last.any() else ~last
    temperature = _temperature(_forward(x[use], layers)[1], y[use], weight[use])
    return QualityModel(vocabulary, vectors, centre, scale, layers, temperature)


def _forward(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Two layers by Adam on the weighted log loss."""
    draw = np.random.default_rng(13)
    layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step in range(1, STEPS + 1):
        hidden, logit = _forward(x, layers)
        pull = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight
        inner = np.outer(pull, layers[2]) * (1 - hidden**2)
        gradients = [x.T @ inner + DECAY * layers[0], inner.sum(0), hidden.T @ pull + DECAY * layers[2], pull.sum()]
        for i, (g, (m, v)) in enumerate(zip(gradients, moments)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            layers[i] = layers[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def _temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted log loss."""
    tries = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [(weight * np.logaddexp(0, np.where(y > 0, -logit, logit) / t)).sum() for t in tries]
    return float(tries[int(np.argmin(loss))])


def score_documents(docs: DataFrame, model: QualityModel | float, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, whole texts.

    ``score`` is the probability of label 1, ``predicted`` whether it reaches the cutoff.
    Null and empty texts and texts of spaces have the score of a vector of zeros; without
    labels of both kinds all rows have the share of label 1. Repeated rows are scored row
    by row; a null doc_id stays, not held out. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = None if isinstance(model, float) else model.vocabulary.memo()
        for batch in text_batches(batches):
            n = batch.num_rows
            scores = np.full(n, model) if memo is None else model.scores(pool(batch.column("text").to_pylist(), memo, model.vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))],
                schema=schema)

    return _columns(docs).withColumn("held_out", held_out()).select("doc_id", "text", "held_out").mapInArrow(run, _SCHEMA)
