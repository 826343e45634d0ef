"""Ranks of rows by parallel sorting with regular sampling.

Every task sorts what it reads into runs. Keys at equal distances in all runs are the
sample; keys at equal distances in the sorted sample split the order into segments of
nearly equal size, whatever the keys. Each segment is exchanged to one place and merged
there, and the number of rows in the segments before it makes its ranks exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Rows that a task sorts at once, rows of a segment, and sample keys that may meet on the driver.
RUN_ROWS, SEGMENT_ROWS, SAMPLE_KEYS = 1 << 20, 1 << 20, 1 << 19
_KEYS = ("high", "low", "run", "place")


def _runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows (high, low, payload) in sorted runs; equal keys are told apart by run and place."""
    held, n, run = [], 0, TaskContext.get().partitionId() << 32

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n, run
        if not n:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        high, low = (table.column(c).to_numpy() for c in ("high", "low"))
        table = table.take(pa.array(np.lexsort((low, high))))
        table = table.append_column("run", pa.array(np.full(n, run, np.int64)))
        table = table.append_column("place", pa.array(np.arange(n)))
        held, n, run = [], 0, run + 1
        yield from table.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= run_rows:
            yield from flush()
    yield from flush()


def _segments(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters are at most each key; both are rows of four numbers, splitters in order."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(splitters), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = splitters[np.minimum(middle, len(splitters) - 1)]
        less, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for c in range(keys.shape[1]):
            less |= equal & (at[:, c] < keys[:, c])
            equal &= at[:, c] == keys[:, c]
        up = open_ & (less | equal)
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low


def _splitters(runs: DataFrame, stride: int, share: int, sample_keys: int) -> np.ndarray:
    """Every ``share``-th key of the sorted sample, which has every ``stride``-th key of each run."""
    sample = runs.where(F.col("place") % stride == stride // 2).select(*_KEYS)
    if sample.count() <= sample_keys:
        rows = np.array(sample.collect(), np.int64).reshape(-1, len(_KEYS))
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[share - 1::share]
    # A sample too large for the driver is ranked the same way.
    payload = F.struct("run", "place").alias("own")
    ranked = ranks(sample.select("high", "low", payload), sample_keys=sample_keys)
    rows = ranked.where(F.col("rank") % share == 0).select("high", "low", "own.*").collect()
    rows = np.array(rows, np.int64).reshape(-1, len(_KEYS))
    return rows[np.lexsort(rows.T[::-1])]


def ranks(
    rows: DataFrame, first: int | None = None, segments: int | None = None, run_rows: int = RUN_ROWS,
    sample_keys: int = SAMPLE_KEYS,
) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ...) in ascending order of the longs high, low.

    Equal keys are ranked one after the other. With ``first`` only so many ranks are
    given: segments behind them stay where they are, with a null rank. High and low must
    not be null, and run, place and segment can't be columns of ``rows``. No rows give none.
    """
    spark = rows.sparkSession
    columns = rows.columns
    shape = rows.limit(0).withColumns({"run": F.lit(0).cast("long"), "place": F.lit(0).cast("long")}).schema
    runs = written(rows.mapInArrow(lambda batches: _runs(batches, run_rows), shape), "runs")
    n, n_runs = runs.agg(F.count("*"), F.count_distinct("run")).first()
    if not n:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    wanted = segments or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    size = max(1, -(-n // wanted))
    # What a run has between two sample keys can fall on either side of a splitter: with
    # this stride all runs together err by at most half a segment.
    stride = max(1, size // (2 * n_runs))
    splitters = _splitters(runs, stride, max(1, size // stride), sample_keys)
    shared = spark.sparkContext.broadcast(splitters)
    cut = runs.limit(0).withColumn("segment", F.lit(0)).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in _KEYS], 1)
            place = _segments(keys, shared.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "segment"])

    dealt = written(runs.mapInArrow(deal, cut), "segments")
    counts = np.zeros(len(splitters) + 1, np.int64)
    for row in dealt.groupBy("segment").count().collect():  # one row of a segment
        counts[row["segment"]] = row["count"]
    before = np.cumsum(counts) - counts
    limit = n if first is None else first
    last = int(np.searchsorted(before, limit, "left"))  # segments from here on start behind the limit
    offsets = spark.sparkContext.broadcast(before)
    out = rows.limit(0).withColumn("rank", F.lit(None).cast("long")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            rank = np.empty(len(segment), np.int64)
            for s in np.unique(segment).tolist():
                at = np.flatnonzero(segment == s)
                start = seen.get(s, int(offsets.value[s]))
                rank[at] = start + 1 + np.arange(len(at))
                seen[s] = start + len(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(rank, mask=rank > limit)], names=[*columns, "rank"])

    merged = dealt.where(F.col("segment") < last).repartitionById(max(1, last), "segment")
    merged = merged.sortWithinPartitions("segment", *_KEYS).mapInArrow(number, out)
    rest = dealt.where(F.col("segment") >= last).select(*columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(rest)
