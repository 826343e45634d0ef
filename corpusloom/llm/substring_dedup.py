"""Substring dedup: a compressed FM-index for each shard, searched backwards.

Every window of ``WINDOW`` words belongs to its anchor, the run of ``GRAM`` words in it
with the least hash. Equal windows have equal anchors, so the stretches of text around
anchors that several documents have are dealt to shards by anchor, and a shard can be
searched alone. A shard's FM-index (burrows-wheeler transform in a wavelet matrix of
packed bits) holds its distinct stretches; searching each of them backwards gives its
matching statistics, and windows matched in full get the smallest document in the
interval of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import (
    Memo, arrow_schema, gram_hashes, join_by_size, mix, release_shuffles, semi_by_size, text_batches, word_hashes, word_memo,
    words_of, written,
)

WINDOW, GRAM = 13, 7
#: Words in a shard, about.
SHARD_WORDS = 1_000_000


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma with 0 between the pieces."""

    def __init__(self, symbols: np.ndarray):
        self.order = suffix_order(symbols)
        last = symbols[self.order - 1]  # the first suffix is preceded by the last symbol
        self.n = len(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 1))])
        self.levels = []
        for bit in range(max(1, int(symbols.max(initial=1)).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32)
            self.levels.append((bit, words, before, self.n - int(ones.sum())))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        # Where each symbol's own stretch begins on the last level.
        self.start = np.zeros(len(self.first), np.int64)
        values = np.arange(len(self.start))
        for level in self.levels:
            self.start = self._down(level, values, self.start)

    def _ones(self, level, at: np.ndarray) -> np.ndarray:
        _, words, before, _ = level
        inside = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(inside)

    def _down(self, level, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = self._ones(level, at).astype(np.int64)
        return np.where((symbols >> level[0]) & 1 == 1, level[3] + one, at - one)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of the matches with one more symbol in front.

        How often a symbol comes before a place is followed down the levels, for both ends
        of the interval.
        """
        for level in self.levels:
            low, high = self._down(level, symbols, low), self._down(level, symbols, high)
        base = self.first[symbols] - self.start[symbols]
        return base + low, base + high


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all cyclic suffixes in order, by doubling; as far as ``WINDOW`` words.

    Suffixes that agree in 16 symbols stay in any order: no search is longer.
    """
    rank, step, n = symbols.astype(np.int64), 1, len(symbols)
    while True:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank, step = new, 2 * step
        if step >= 16 or rank[order[-1]] == n - 1:
            return order


def matching_statistics(index: FMIndex, symbols: np.ndarray, ends: np.ndarray, limit: int = WINDOW):
    """(lengths, low, high): the longest match that ends before each place, up to ``limit``,
    and the interval of those matches.

    Intervals of one step are equal or apart, so each is extended by a symbol once,
    however many places are in it.
    """
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    lengths, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
    for step in range(1, limit + 1):
        at = ends[live] - step
        ok = at >= 0
        live, at = live[ok], at[ok]
        ok = symbols[at] > 0
        live, at = live[ok], at[ok]
        state = low[live] * len(index.first) + symbols[at]
        _, one, which = np.unique(state, return_index=True, return_inverse=True)
        a, b = index.extend(symbols[at[one]], low[live[one]], high[live[one]])
        a, b = a[which], b[which]
        ok = b > a
        live = live[ok]
        low[live], high[live] = a[ok], b[ok]
        lengths[live] = step
        if not len(live):
            break
    return lengths, low, high


def anchors(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, start, stop, first) of each anchor in texts of ``sizes`` words, end to end.

    The windows of an anchor are the words from ``start`` to ``stop``; ``first`` is the
    first of them, counted in its text.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.uint64)) + (np.empty(0, np.int64),) * 3
    grams = gram_hashes(hashes, GRAM)
    least, offset = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        offset[grams[j:j + n] < least] = j
        np.minimum(least, grams[j:j + n], out=least)
    stops = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    windows = np.flatnonzero(np.arange(n) + WINDOW <= stops[text])  # those within one text
    place = windows + offset[windows]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    start, text = windows[new], text[windows[new]]
    stop = windows[np.append(new[1:], len(windows))[:len(new)] - 1] + WINDOW
    return text, least[start], start, stop, start - (stops - sizes)[text]


def stretch_keys(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words from ``start`` to ``stop`` (none of them empty)."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = stop - start
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    words = hashes[np.repeat(start, sizes) + inside] + mix(inside.astype(np.uint64))
    one = mix(words)
    return tuple(
        mix(np.add.reduceat(x, begins) + sizes.astype(np.uint64)).view(np.int64) for x in (one, mix(one + np.uint64(1))))


def _hashed(batch: pa.RecordBatch, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words in each text)."""
    parts = [word_hashes(words_of(t.as_py()), memo) for t in batch.column("text")]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, doc_id, body, first, sure): anchors of all texts, dealt by ``key``, which is the anchor of all but the sure ones.

    ``sure`` ones were seen in two documents of the same batch; one of each batch is sent
    by its anchor to meet those of other batches, so that a passage in a third of all
    documents sends no more rows to one place than there are batches.
    """
    out = "key long, doc_id long, body long, first int, sure boolean"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in text_batches(batches, 16 * 1024 * 1024):
            ids, bodies = batch.column("doc_id").to_numpy(), batch.column("body").to_numpy()
            text, anchor, _, _, first = anchors(*_hashed(batch, memo))
            anchor, first = anchor.view(np.int64), first.astype(np.int32)
            doc, body = ids[text], bodies[text]
            order = np.lexsort((doc, anchor))
            anchor, first, doc, body = anchor[order], first[order], doc[order], body[order]
            starts = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1)) if len(anchor) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(anchor))[:len(starts)]
            several = doc[starts] != doc[ends - 1] if len(starts) else np.empty(0, bool)
            sure = np.repeat(several, ends - starts)
            probe = ~sure  # all places of a single document, and the first and last document of several
            probe[starts] = True
            if len(ends):
                probe[ends - 1] = True
            both = sure & probe
            take = np.concatenate([np.flatnonzero(sure), np.flatnonzero(probe & ~both), np.flatnonzero(both)])
            is_sure = np.arange(len(take)) < sure.sum()
            own = mix(body[take].view(np.uint64) ^ mix(doc[take].view(np.uint64))).view(np.int64)  # copies go apart
            key = np.where(is_sure, own, anchor[take])
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.array(doc[take]), pa.array(body[take]), pa.array(first[take]), pa.array(is_sure),
            ], schema=schema)

    return docs.mapInArrow(run, out)


def _recurring(rows: DataFrame) -> DataFrame:
    """(doc_id, body, first) of anchors that two documents have."""
    out = "doc_id long, body long, first int"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, several = None, None, False  # rows of one anchor and one document so far

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            sure = table.column("sure").to_numpy()
            yield from table.filter(pa.array(sure)).select(["doc_id", "body", "first"]).to_batches()
            table = table.filter(pa.array(~sure)).combine_chunks()
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            anchor, doc = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            ends = np.append(starts[1:], len(anchor))
            low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            many = low != high
            if several and anchor[0] == of:
                many[0] = True
            of, several = int(anchor[-1]), bool(many[-1])
            if several:
                held = None
            else:  # the last anchor may go on in the next batch
                held = table.slice(int(starts[-1]))
            yield from table.filter(pa.array(np.repeat(many, ends - starts))).select(["doc_id", "body", "first"]).to_batches()
        if held is None:
            return

    return rows.mapInArrow(run, out).select("doc_id", "body", "first")


_STRETCH = "one long, other long, anchor long, doc_id long, body long, first int, words binary"


def _stretches(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(one, other, anchor, doc_id, body, first, words) of the anchors in ``hits`` (doc_id, body, places).

    ``one`` and ``other`` name a stretch; a batch gives its ``words`` once, null elsewhere.
    """
    schema = arrow_schema(_STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in text_batches(batches, 16 * 1024 * 1024):
            ids, bodies, places = batch.column("doc_id").to_numpy(), batch.column("body").to_numpy(), batch.column("places")
            hashes, sizes = _hashed(batch, memo)
            text, anchor, start, stop, first = anchors(hashes, sizes)
            begins = np.cumsum(sizes) - sizes
            counts = np.diff(places.offsets.to_numpy())
            wanted = np.repeat(begins, counts) + places.flatten().to_numpy()
            take = np.searchsorted(start, wanted)
            text, anchor, start, stop, first = (x[take] for x in (text, anchor, start, stop, first))
            one, other = stretch_keys(hashes, start, stop)
            order = np.lexsort((other, one))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(one[order]) != 0) | (np.diff(other[order]) != 0)
            words = np.full(len(order), None, object)
            for k in order[new]:
                words[k] = hashes[start[k]:stop[k]].tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(one), pa.array(other), pa.array(anchor.view(np.int64)), pa.array(ids[text]), pa.array(bodies[text]),
                pa.array(first.astype(np.int32)), pa.array(words, pa.binary()),
            ], schema=schema)

    placed = join_by_size(docs, hits, ["doc_id", "body"], F.size("places") * 4)
    return placed.select("doc_id", "body", "text", "places").mapInArrow(run, _STRETCH)


def search_shard(stretches: list[bytes], lowest: np.ndarray) -> list[np.ndarray]:
    """For each stretch of words, the smallest document that has each of its windows."""
    sizes = np.array([len(s) // 8 for s in stretches])
    words = np.frombuffer(b"".join(stretches), np.uint64)
    symbols = np.zeros(len(words) + len(stretches), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.arange(len(words)) + np.repeat(np.arange(len(stretches)), sizes)
    symbols[inside] = np.unique(words, return_inverse=True)[1] + 1
    index = FMIndex(symbols)
    counts = sizes - WINDOW + 1
    offsets = np.cumsum(counts) - counts
    ends = np.repeat(starts - offsets, counts) + np.arange(counts.sum()) + WINDOW
    lengths, low, high = matching_statistics(index, symbols, ends)
    assert (lengths == WINDOW).all()  # each stretch is in the index itself
    documents = np.repeat(lowest, sizes + 1)[index.order]
    # Intervals of windows are equal or apart: the least of each is taken once.
    distinct, which = np.unique(low, return_inverse=True)
    stops = np.zeros(len(distinct), np.int64)
    stops[which] = high
    bounds = np.column_stack([distinct, stops]).ravel()
    least = np.minimum.reduceat(np.append(documents, np.iinfo(np.int64).max), bounds)[::2][which]
    return np.split(least, offsets[1:])


def _least_by_window(distinct: DataFrame) -> DataFrame:
    """(one, other, least) of stretches, by the hash of each window instead of an index.

    Equal windows share the hash, and are reduced to their smallest document first.
    """
    out = "one long, other long, at int, lowest long, low long, high long"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            sizes = np.array([len(p) for p in parts])
            counts = sizes - WINDOW + 1
            row = np.repeat(np.arange(len(parts)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(np.cumsum(sizes) - sizes, counts) + at
            low, high = stretch_keys(np.concatenate(parts), start, start + WINDOW)
            one, other, lowest = (batch.column(c).to_numpy()[row] for c in ("one", "other", "lowest"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (one, other, at.astype(np.int32), lowest, low, high)], schema=schema)

    windows = written(distinct.select("one", "other", "lowest", "words").mapInArrow(run, out), "windows")
    first = windows.groupBy("low", "high").agg(F.min("lowest").alias("least"))
    found = join_by_size(windows.drop("lowest"), first, ["low", "high"], F.lit(24))
    ordered = found.groupBy("one", "other").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("found"))
    return ordered.select("one", "other", F.col("found.least").alias("least"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, body, starts, stops): ranges of words in windows that start in a document with a smaller doc_id.

    ``docs`` has doc_id, body (a hash of the text) and text; ranges are apart and in order.
    """
    spark = docs.sparkSession
    rows = _anchor_rows(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    hits = written(
        _recurring(met).groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("first")).alias("places")), "hits")
    release_shuffles(spark)
    stretches = written(_stretches(docs, hits), "stretches")
    release_shuffles(spark)
    # Words of each anchor, counted once for each batch, so at least its distinct ones.
    words = stretches.where("words IS NOT NULL").groupBy("anchor").agg((F.sum(F.octet_length("words")) / 8).alias("n"))
    crowded = F.col("n") > SHARD_WORDS
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(crowded).alias("crowded")).first()
    shards = max(1, math.ceil(sums["n"] / SHARD_WORDS))
    distinct = stretches.groupBy("one", "other").agg(
        F.min("anchor").alias("anchor"), F.first("words", ignorenulls=True).alias("words"), F.min("doc_id").alias("lowest"))

    def search(shard: pa.Table) -> pa.Table:
        least = search_shard(shard.column("words").to_pylist(), shard.column("lowest").to_numpy())
        return shard.select(["one", "other"]).append_column("least", pa.array(least, pa.list_(pa.int64())))

    apart = None
    if sums["crowded"]:  # one anchor is too much for a shard: no more of them than shards
        anchors_apart = written(words.where(crowded).select("anchor"), "crowded")
        apart = _least_by_window(distinct.join(F.broadcast(anchors_apart), "anchor", "left_semi"))
        distinct = distinct.join(F.broadcast(anchors_apart), "anchor", "left_anti")
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    least = dealt.groupBy("shard").applyInArrow(search, "one long, other long, least array<long>")
    if apart is not None:
        least = least.unionByName(apart)
    # The windows of an anchor overlap all others of it, so those to remove are one range.
    smaller = F.transform("least", lambda low: low < F.col("doc_id"))
    start = F.col("first") + F.array_position(smaller, F.lit(True)) - 1
    stop = F.col("first") + F.size(smaller) - F.array_position(F.reverse(smaller), F.lit(True)) + WINDOW
    ranges = (
        stretches.select("one", "other", "doc_id", "body", "first").join(least, ["one", "other"])
        .where(F.exists("least", lambda low: low < F.col("doc_id")))
        .select("doc_id", "body", F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")).alias("range"))
        .groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("range")).alias("all"))
    )
    # Both ends are in order: what touches the range before it is joined to it.
    begins = F.filter("all", lambda r, i: F.coalesce(r["start"] > F.get(F.col("all"), i - 1)["stop"], F.lit(True)))
    ends = F.filter("all", lambda r, i: F.coalesce(F.get(F.col("all"), i + 1)["start"] > r["stop"], F.lit(True)))
    marks = written(ranges.select(
        "doc_id", "body", begins["start"].alias("starts"), ends["stop"].alias("stops")), "marks")
    release_shuffles(spark)
    return marks


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, body) of documents whose whole text also is in a document with a smaller doc_id."""
    bodies = written(docs.select("doc_id", "body").distinct(), "bodies")
    first = bodies.groupBy("body").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    several = first.where("lowest < highest").select("body", "lowest")
    return written(bodies.join(several, "body").where("doc_id > lowest").select("doc_id", "body"), "copies")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: words in no window of 13 words that
    also starts in a document with a smaller doc_id; ``kept`` joins them by one space.

    Windows are judged on the input, not on what is left. Null, empty and blank texts have
    no words; texts under 13 words keep all; repeated rows of one doc_id don't count
    against each other; a row with a null doc_id keeps all its words. Of equal texts the
    index gets the one with the smallest doc_id; all windows of the others start there.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("body"))
    named = rows.where("doc_id IS NOT NULL")
    again = copies(named)
    marks = repeated_windows(semi_by_size(named, again, ["doc_id", "body"], "left_anti"))
    marks = marks.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True)), allowMissingColumns=True)
    out = "doc_id long, n_words long, n_removed long, kept string"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sizes, gone, kept = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "again", "starts", "stops"))
            for text, again, starts, stops in zip(*columns):
                words = words_of(text)
                sizes.append(len(words))
                if again and len(words) >= WINDOW:
                    words = []
                elif starts:
                    edges = np.zeros(len(words) + 1, np.int64)
                    edges[starts] = 1
                    edges[stops] = -1
                    stay = np.cumsum(edges[:-1]) == 0
                    words = [w for w, s in zip(words, stay) if s]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    joined = join_by_size(rows, marks, ["doc_id", "body"], F.coalesce(F.size("starts"), F.lit(0)) * 8, "left")
    return joined.select("doc_id", "text", "again", "starts", "stops").mapInArrow(run, out)
