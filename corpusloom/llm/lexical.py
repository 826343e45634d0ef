"""Ranked lexical search over an index of bit-sliced Bloom signatures.

The index has blocks of documents of similar size. A block has one bitmap over its
documents (a slice) for each signature bit; a term's documents are within the common bits
of its slices, which may show too many documents and never too few. A term is entered
again where it occurs twice and four times, so the slices also bound how often it occurs.
Weighted sums of them bound every document's score from above; what can't be excluded
by its bound is scored from the block's postings.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, mix, terms_of, text_batches, word_hashes, word_memo, written

BLOCK_BYTES, BLOCK_DOCS, GROUP_BLOCKS = 1024 * 1024, 1024, 4
HASHES, BITS_PER_ENTRY = 3, 6
#: Occurrences from which a term is entered (again).
LEVELS = (1, 2, 4)
#: Terms of items that are searched in one pass over the index, and blocks that set first floors.
QUERY_TERMS, SEED_BLOCKS = 1 << 17, 16
TOP, FIRST_LOOK = 10, 32
SLOTS = 64
UNIT = 1_000_000_000
_INDEX = "key long, n_docs int, ids binary, sizes binary, width int, slices binary, ends binary, terms binary, count_bytes int, counts binary"
_TOP = "item long, doc_id long, score long"
_NO_ID = (1 << 63) - 1


def _rows(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Slice numbers of terms at a level, HASHES of each; ``width`` is a power of two."""
    first = mix(hashes ^ np.uint64(level * 0x9E3779B97F4A7C1 % (1 << 64)))
    step = (first >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(j) * step) & np.uint64(width - 1) for j in range(HASHES)]).astype(np.int64)


def _width(counts: np.ndarray) -> int:
    """Bits of a document's signature: BITS_PER_ENTRY or more, less than twice that, for each entry."""
    entries = sum(int((counts >= level).sum()) for level in LEVELS)
    return 1 << max(6, (BITS_PER_ENTRY * entries - 1).bit_length())


def _block(docs: list[tuple[int, int, np.ndarray, np.ndarray]], width: int) -> tuple:
    """One index row from (id, n terms with repeats, sorted term hashes, counts) of its documents."""
    ids, sizes, terms, counts = zip(*docs)
    ends = np.cumsum([len(t) for t in terms])
    terms, counts = np.concatenate(terms), np.concatenate(counts)
    row = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
    bits = np.zeros((width, len(docs)), bool)
    for level in LEVELS:
        use = counts >= level
        for places in _rows(terms[use], level, width):
            bits[places, row[use]] = True
    key = int(mix(np.uint64([terms[0], len(terms), ids[0] & ((1 << 64) - 1)])).sum(dtype=np.uint64).view(np.int64))
    parts = np.array(ids, np.int64), np.array(sizes, np.int64), np.packbits(bits, axis=1), ends.astype(np.int64)
    ids, sizes, slices, ends = (p.tobytes() for p in parts)
    counts = counts.astype(np.min_scalar_type(int(counts.max())))
    return key, len(docs), ids, sizes, width, slices, ends, terms.tobytes(), counts.itemsize, counts.tobytes()


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of all rows of ``docs`` with a term, as a written table of blocks."""
    schema = arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        open_: dict[int, list] = {}  # documents by the width of their signatures
        room: dict[int, int] = {}

        def close(width: int) -> pa.RecordBatch:
            block = _block(open_.pop(width), width)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block, schema)], schema=schema)

        for batch in text_batches(batches):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(data)
                if not words:
                    continue
                terms, counts = np.unique(word_hashes(words, memo), return_counts=True)
                width = _width(counts)
                if width not in open_:
                    open_[width], room[width] = [], block_bytes
                open_[width].append((_NO_ID if doc_id is None else doc_id, len(words), terms, counts))
                room[width] -= terms.nbytes
                if room[width] <= 0 or len(open_[width]) >= block_docs:
                    yield close(width)
        for width in sorted(open_):
            yield close(width)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(columns.mapInArrow(run, _INDEX), "signatures", GROUP_BLOCKS)


@dataclass
class Queries:
    """Items as rows of term numbers: ``terms`` are the hashes of all their terms, in order."""

    items: list[int]
    terms: np.ndarray
    members: list[np.ndarray]  # of each item, numbers into terms
    weights: np.ndarray | None = None
    floors: np.ndarray | None = None  # a score that TOP documents of each item are known to reach
    n_docs: int = 0
    n_terms: int = 0

    def weighted(self, df: np.ndarray, n_docs: int, n_terms: int) -> "Queries":
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
        return Queries(self.items, self.terms, self.members, np.array(weights, np.int64),
                       np.zeros(len(self.items), np.int64), n_docs, n_terms)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): distinct terms of each distinct row of items, under a number of its own."""
    known = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    known = known.distinct().withColumn("item", F.xxhash64("item_id", "text"))
    out = "item long, item_id long, term long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in text_batches(batches):
            for k, data in enumerate(batch.column("text").to_pylist()):
                terms = np.unique(word_hashes(terms_of(data), memo)).view(np.int64)
                same = [batch.column(c).take(pa.array(np.full(len(terms), k))) for c in ("item", "item_id")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(terms)], schema=arrow_schema(out))

    return written(known.mapInArrow(run, out), "items")


def _frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """In how many documents each term of the queries occurs."""
    shared = index.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for data in batch.column("terms"):
                terms = np.frombuffer(data.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                counts += np.bincount(at[wanted[at] == terms], minlength=len(wanted))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], schema=arrow_schema("at long, n long"))

    found = index.select("terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(queries.terms), np.int64)
    for row in found.collect():  # a row for each term of the queries at most
        counts[row["at"]] = row["n"]
    return counts


def _reach(tf, length_term):
    return (UNIT * tf) // (1000 * tf + length_term)


class _Best:
    """The best documents of one item: scores and ids, best first."""

    def __init__(self, floor: int):
        self.floor, self.scores, self.ids = floor, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = (scores > 0) & (scores >= self.floor)
        scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
        order = np.lexsort((ids, -scores))[:TOP]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == TOP:
            self.floor = max(self.floor, int(self.scores[-1]))


def search_block(row: dict, queries: Queries, best: list[_Best]) -> int:
    """Bring the best documents of all items up to date with one block; how many were scored exactly."""
    n, width = row["n_docs"], row["width"]
    ids, sizes, ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "sizes", "ends"))
    terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], f"u{row['count_bytes']}")
    starts = np.concatenate([[0], ends[:-1]])
    slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
    length_term = 8 * (10 + (90 * sizes * queries.n_docs) // queries.n_terms)
    most = np.maximum.reduceat(counts, starts).astype(np.int64)
    bounds = [_reach(np.minimum(most, t), length_term) for t in (*(level - 1 for level in LEVELS[1:]), most)]
    steps = np.diff(np.stack(bounds), axis=0, prepend=0)
    shown = []
    for level in LEVELS:
        places = _rows(queries.terms, level, width)
        common = slices[places[0]]
        for more in places[1:]:
            common = common & slices[more]
        shown.append(common)
    scored = 0
    for item, members in enumerate(queries.members):
        weights, top = queries.weights[members], best[item]
        # Sums of whole numbers stay exact in these floats.
        kind = np.float32 if int(weights.sum()) < 1 << 24 else np.float64
        weighted = weights.astype(kind)
        sums = (weighted @ np.unpackbits(shown[0][members], axis=1, count=n).astype(kind)).astype(np.int64)
        open_ = np.flatnonzero((sums > 0) & (sums * bounds[-1] >= top.floor))
        if not len(open_):
            continue
        bound = sums[open_] * steps[0][open_]
        for step, bits in zip(steps[1:], shown[1:]):
            part = np.unpackbits(bits[members], axis=1, count=n)[:, open_].astype(kind)
            bound += (weighted @ part).astype(np.int64) * step[open_]
        order = np.argsort(-bound, kind="stable")
        open_, bound = open_[order], bound[order]
        wanted = queries.terms[members]
        for start, stop in ((0, FIRST_LOOK), (FIRST_LOOK, len(open_))):
            some = open_[start:stop][bound[start:stop] >= max(1, top.floor)]
            if not len(some):
                break
            scores = np.empty(len(some), np.int64)
            for k, d in enumerate(some.tolist()):
                own = terms[starts[d]:ends[d]]
                at = np.searchsorted(own, wanted)
                at[at == len(own)] = 0
                hit = own[at] == wanted
                tf = counts[starts[d]:ends[d]][at[hit]].astype(np.int64)
                scores[k] = (weights[hit] * _reach(tf, length_term[d])).sum()
            scored += len(some)
            top.add(scores, ids[some])
    return scored


def _search(index: DataFrame, queries: Queries) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each task, and all that tie with floors."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    schema = arrow_schema(_TOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [_Best(int(f)) for f in queries.floors]
        for batch in batches:
            for k in range(batch.num_rows):
                search_block(batch.slice(k, 1).to_pylist()[0], queries, best)
        found = [len(b.ids) for b in best]
        rows = [np.repeat(np.array(queries.items, np.int64), found),
                *(np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "scores"))]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=schema)

    return index.mapInArrow(run, _TOP)


def _best(found: DataFrame) -> DataFrame:
    """The TOP rows of each item with their rank, in two steps, so that no task has an item's rows of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    slots = found.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    for keys in (["item", "slot"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        slots = slots.withColumn("rank", place).where(F.col("rank") <= TOP)
    return slots.drop("slot")


def search(index: DataFrame, items: DataFrame, query_terms: int = QUERY_TERMS, seed_blocks: int = SEED_BLOCKS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the TOP highest-scoring documents above 0, all if fewer.

    Ties go to the smaller doc_id, documents without one last. Rows of ``items`` that are
    equal are one item; items without a term, or an empty index, give no rows. Items are
    searched in as many passes over the index as their terms need, ``query_terms`` in each
    (one item's terms are never split).
    """
    spark = index.sparkSession
    n_docs, n_terms = _totals(index)
    wanted = _item_terms(items)
    names = wanted.select("item", "item_id").distinct()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    total = wanted.count()
    if not n_terms or not total:
        return empty
    passes = -(-total // query_terms)
    # The first floors come from a bounded number of blocks; any true scores will do.
    seeds = [r["key"] for r in index.select("key").orderBy("key").limit(seed_blocks).collect()]
    found = []
    for number in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item", F.lit(3)), F.lit(passes)) == number)
        grouped = rows.groupBy("item").agg(F.collect_set("term").alias("terms")).collect()  # query_terms or so
        if not grouped:
            continue
        lists = [np.sort(np.array(r["terms"], np.int64).view(np.uint64)) for r in grouped]
        terms = np.unique(np.concatenate(lists))
        queries = Queries([r["item"] for r in grouped], terms, [np.searchsorted(terms, x) for x in lists])
        queries = queries.weighted(_frequencies(index, queries), n_docs, n_terms)
        first = _best(_search(index.where(F.col("key").isin(seeds)), queries)).where(F.col("rank") == TOP).collect()
        floors = {r["item"]: r["score"] for r in first}
        queries.floors = np.array([floors.get(i, 0) for i in queries.items], np.int64)
        found.append(_search(index, queries))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranked = _best(every).withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _totals(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            n += sum(batch.column("n_docs").to_pylist())
            total += sum(int(np.frombuffer(s.as_buffer(), np.int64).sum()) for s in batch.column("sizes"))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    row = index.select("n_docs", "sizes").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def ranked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``search`` of the items in an index of all ``docs``; null and empty texts have no terms."""
    return search(build_index(docs), items)
