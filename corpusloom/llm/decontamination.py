"""Benchmark decontamination: passages of documents as queries on a BM25 index of test items.

The index holds the items (long ones in chunks), with impacts divided by the score an item
must reach, so that one threshold, 1, holds for all. A passage is passed over at once if
its words' largest impacts can't add up to it; the rest are searched by block-max WAND,
which gives every item above the threshold. What is retrieved is then verified: enough
word runs of the item's question, and of its answer, must occur in the document.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, arrow_schema, text_batches, written

PASSAGE, STRIDE = 128, 64
CHUNK = STRIDE
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of each part's runs that a document must have.
SCORE, OVERLAP, RUN = 0.6, 0.6, 3
BLOCK = 4
TABLE_CELLS = 4_000_000
SHARD_BYTES = 16 * 1024 * 1024
_PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"
_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def plain(word: bytes) -> bytes:
    return word.strip(_PUNCTUATION) or word


def item_words(text: str | None) -> list[bytes]:
    return [plain(w) for w in (text or "").encode().lower().split()]


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer): up to the first question mark that has words after it, else halves."""
    head, mark, tail = text.partition("?")
    question, answer = item_words(head), item_words(tail)
    if mark and question and answer:
        return question, answer
    words = item_words(text)
    return words[:(len(words) + 1) // 2], words[(len(words) + 1) // 2:]


def runs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(RUN, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


@dataclass
class Index:
    """Postings by word: entries (ascending), impacts, and the largest impact of each block."""

    items: list[tuple[int, list[set], int]]  # item id, runs of its two parts, length of a run
    owner: list[int]  # the item of each entry
    postings: dict[bytes, tuple[list[int], list[float], list[float]]]
    largest: dict[bytes, float]

    def search(self, words: set[bytes]) -> list[tuple[int, float]]:
        """(entry, score) of every entry with a score of at least 1, by block-max WAND."""
        lists = [[self.postings[w], 0, self.largest[w]] for w in words]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][0][x[1]])
            bound, pivot = 0.0, -1
            for k, (_, _, most) in enumerate(lists):
                bound += most
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == entry:
                pivot += 1
            bound, until = 0.0, None
            for (entries, _, blocks), at, _ in lists[:pivot + 1]:
                k = bisect_left(entries, entry, at) // BLOCK
                if k < len(blocks):
                    bound += blocks[k]
                    end = entries[min((k + 1) * BLOCK, len(entries)) - 1] + 1
                    until = end if until is None else min(until, end)
            if bound >= 1 - 1e-9:
                if lists[0][0][0][lists[0][1]] == entry:
                    score = math.fsum(x[0][1][x[1]] for x in lists[:pivot + 1])
                    if score >= 1 - 1e-9:
                        found.append((entry, score))
                    target = entry + 1
                else:
                    target = entry
            else:  # no entry before the end of these blocks, or the next list, can do it
                target = max(until or entry + 1, entry + 1)
                if pivot + 1 < len(lists):
                    target = min(target, max(entry + 1, lists[pivot + 1][0][0][lists[pivot + 1][1]]))
            for x in lists[:pivot + 1]:
                x[1] = bisect_left(x[0][0], target, x[1])
            lists = [x for x in lists if x[1] < len(x[0][0])]
        return found


def entries_of(text: str | None) -> list[Counter]:
    """Words of an item with their numbers, one for each chunk."""
    words = item_words(text)
    return [Counter(words[at:at + CHUNK]) for at in range(0, len(words), CHUNK)]


@dataclass
class Statistics:
    """Of all items: entries, words in them, and the entries that have a word."""

    entries: int
    words: int
    frequency: dict[bytes, int]

    @staticmethod
    def of(texts: list[str]) -> "Statistics":
        entries = [e for t in texts for e in entries_of(t)]
        return Statistics(len(entries), sum(sum(e.values()) for e in entries), Counter(w for e in entries for w in e))


def build_index(items: list[tuple[int, str]], score: float = SCORE, known: Statistics | None = None) -> Index:
    """The index of some items; ``known`` are the statistics of all, without it those of ``items``."""
    items = sorted((i, t) for i, t in items if i is not None and item_words(t))
    known = known or Statistics.of([t for _, t in items])
    entries, owner, kept = [], [], []
    for k, (item_id, text) in enumerate(items):
        parts = parts_of(text)
        kept.append((item_id, [runs(p) for p in parts], [min(RUN, len(p)) for p in parts]))
        own = entries_of(text)
        entries += own
        owner += [k] * len(own)
    sizes = [sum(c.values()) for c in entries]
    mean = known.words / max(1, known.entries)
    idf = {w: math.log(1 + (known.entries - n + 0.5) / (n + 0.5)) for w, n in known.frequency.items()}
    postings = defaultdict(lambda: ([], []))
    for e, c in enumerate(entries):
        weight = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[e] / mean)) for w, n in c.items()}
        needed = score * math.fsum(weight.values())
        for w, x in weight.items():
            postings[w][0].append(e)
            postings[w][1].append(x / needed)
    blocked = {w: (es, xs, [max(xs[i:i + BLOCK]) for i in range(0, len(xs), BLOCK)]) for w, (es, xs) in postings.items()}
    return Index(kept, owner, blocked, {w: max(xs) for w, (_, xs, _) in blocked.items()})


class Detector:
    def __init__(self, index: Index):
        self.index = index
        self.words = list(index.postings)
        ids = {w: i for i, w in enumerate(self.words)}
        self.n = len(self.words)
        self.ids = Memo(lambda word: ids.get(plain(word), self.n))
        self.bounds = np.array([index.largest[w] for w in self.words])
        blocks = -(-len(index.owner) // BLOCK)
        #: Largest impact of each word in each block of entries, where this table is small.
        self.table = np.zeros((self.n, blocks)) if self.n * blocks <= TABLE_CELLS else None
        if self.table is not None:
            for i, w in enumerate(self.words):
                entries, impacts, _ = index.postings[w]
                np.maximum.at(self.table[i], np.array(entries) // BLOCK, impacts)

    def passages(self, words: list[bytes]) -> list[set[bytes]]:
        """Index words of those passages whose bounds reach 1: of the words, then by block."""
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(ids < self.n)
        if not len(at):
            return []
        cell, last = at // STRIDE, max(0, -(-(len(words) - PASSAGE) // STRIDE))
        # A position is in the passage that starts in its stretch and in the one before.
        keys = np.concatenate([np.minimum(cell, last), np.maximum(cell - 1, 0)]) * self.n + np.tile(ids[at], 2)
        keys = np.unique(keys)
        passage, word = keys // self.n, keys % self.n
        able = np.bincount(passage, weights=self.bounds[word]) >= 1 - 1e-6
        if not able.any():
            return []
        use = able[passage]
        passage, word = passage[use], word[use]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(passage))
        if self.table is not None:
            near = np.add.reduceat(self.table[word], starts, axis=0).max(axis=1) >= 1 - 1e-6
            starts, ends = starts[near], ends[near]
        return [{self.words[w] for w in word[s:e]} for s, e in zip(starts, ends)]

    def hits(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item id, score, overlap of question, of answer) of every item the text has."""
        words = (text or "").encode().lower().split()
        if not words:
            return []
        best: dict[int, float] = {}
        for passage in self.passages(words):
            for entry, score in self.index.search(passage):
                item = self.index.owner[entry]
                best[item] = max(score, best.get(item, 0.0))
        if not best:
            return []
        stripped = [plain(w) for w in words]
        grams = {k: set(zip(*(stripped[i:] for i in range(k)))) for k in {k for i in best for k in self.index.items[i][2]} if k}
        out = []
        for item, score in sorted(best.items()):
            item_id, parts, lengths = self.index.items[item]
            shares = [len(p & grams[k]) / len(p) if p else 1.0 for p, k in zip(parts, lengths)]
            if min(shares) >= OVERLAP:
                out.append((item_id, score, *shares))
        return out


_STATISTICS = "word binary, entries long, words long"


def _statistics(rows: DataFrame) -> DataFrame:
    """(word, entries, words) of all items: a row for each word, and one without a word for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            part = Statistics.of(batch.column("text").to_pylist())
            columns = [*part.frequency, None], [*part.frequency.values(), part.entries], [0] * len(part.frequency) + [part.words]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(_STATISTICS))], schema=arrow_schema(_STATISTICS))

    found = rows.select("text").mapInArrow(run, _STATISTICS)
    return written(found.groupBy("word").agg(F.sum("entries").alias("entries"), F.sum("words").alias("words")), "statistics")


def _words(rows: DataFrame) -> DataFrame:
    """The distinct words of some items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = {w for t in batch.column("text").to_pylist() for w in item_words(t)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    return rows.select("text").mapInArrow(run, "word binary").distinct()


def _shards(items: DataFrame, shard_bytes: int):
    """(index, whether it is the only one): indexes of about ``shard_bytes`` of items, one at a time.

    Scores don't depend on the shard: frequencies and lengths are those of all items.
    """
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / shard_bytes))
    counts = _statistics(rows)
    total = counts.where("word IS NULL").first()
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        # A row for each word of the shard, whose texts are bounded.
        own = counts.where("word IS NOT NULL").join(_words(part), "word", "left_semi").collect()
        known = Statistics(total["entries"] if total else 0, total["words"] if total else 0, {bytes(r["word"]): r["entries"] for r in own})
        yield build_index([tuple(r) for r in part.collect()], known=known), n == 1


def _passes(docs: DataFrame, items: DataFrame, shard_bytes: int, search):
    """``search(docs, broadcast index)`` for each shard; with several, each is done before the next is built."""
    for index, only in _shards(items, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = search(docs, shared)
        if not only:
            found = written(found, "hits")
            shared.destroy()
        yield found


def find_leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item in every text.

    Each whole text is read in overlapping passages. ``score`` is the best passage's BM25
    score over what the item needs. Of an item without a second half (one word) the first
    alone must be there. Null and empty texts or items, and items without an id, give no rows; a
    null doc_id stays; repeated rows give repeated pairs, repeated items a pair each. The items
    are indexed in shards of ``shard_bytes``, one pass over the documents for each, with the
    same rows and scores whatever the number of shards.
    """
    schema = arrow_schema(_SCHEMA)

    def search(columns: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            detector = Detector(shared.value)
            for batch in text_batches(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(i, *hit) for i, t in zip(ids, batch.column("text").to_pylist()) for hit in detector.hits(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

        return columns.mapInArrow(run, _SCHEMA)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = list(_passes(columns, items, shard_bytes, search))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` that have none of the items; all columns as they are."""
    for index, only in _shards(items, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detector = Detector(shared.value)
            for batch in text_batches(batches):
                clean = [not detector.hits(t) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if not only:
            docs = written(docs, "clean")
            shared.destroy()
    return docs
