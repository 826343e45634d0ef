"""Connected components by union-find inside tasks and shared steps between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Edges that a task ties together, about; nodes that it holds meanwhile.
EDGES = 100_000
CHUNK = 2 * EDGES


def _forests(edges: DataFrame, parts: int) -> DataFrame:
    """Each part's edges (a, b) as edges from every node to the smallest it is tied to there.

    The edges are read in ``parts`` parts at most, as many as their number asks for. A part
    is worked on in chunks of bounded size; the ties of all chunks together are those of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def done() -> pa.RecordBatch:
            ties = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            a, b = zip(*ties) if ties else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > CHUNK:
                yield done()
        yield done()

    return edges.select("a", "b").coalesce(parts).mapInArrow(run, "a binary, b binary")


def _unsettled(ties: DataFrame) -> bool:
    """Whether a node is tied to several, or to one that is tied to another."""
    ends = ties.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        ties.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    many = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(many.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b binary) with the smallest node it reaches.

    Each round ties the neighbours of a node, and the node, to the smallest of them
    (aggregated before it is shuffled), and shrinks what comes out inside tasks. It ends
    when every node is tied to one root that is tied to nothing: a few rounds, each
    written to the shared folder. Nothing is gathered but two counts a round. Tasks are as
    many as ``EDGES`` edges each ask for: where these are no more than one task's, its ties
    are those of the whole. Self-loops and repeated edges don't matter; no edges give no rows.
    """
    parts = max(1, math.ceil(edges.count() / EDGES))
    ties = _forests(edges.where("a != b"), parts)
    ties = written(ties.distinct() if parts > 1 else ties, "ties")
    while True:
        # Every tie is (node, smaller node). A node with one smaller neighbour that has none is done.
        if parts == 1 or not _unsettled(ties):
            return ties.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                ties.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        # The smallest of a node's neighbours takes over the others; then it jumps to its own.
        low = ties.groupBy("a").agg(F.min("b").alias("low"))
        hooked = (
            ties.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
        )
        jump = low.select(F.col("a").alias("b"), F.col("low").alias("next"))
        jumped = hooked.join(jump, "b", "left").select("a", F.coalesce("next", "b").alias("b"), F.col("b").alias("was"), "next")
        both = jumped.select("a", "b").unionByName(
            jumped.where("next IS NOT NULL").select(F.col("was").alias("a"), F.col("next").alias("b")))
        parts = max(1, math.ceil(2 * ties.count() / EDGES))
        ties = written(_forests(both.where("a != b"), parts).distinct(), "ties")
