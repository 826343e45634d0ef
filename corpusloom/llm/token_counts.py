"""Token counts: lengths only, batches balanced by bytes, long texts split at safe places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, text_batches

CACHE_ENTRIES = 400_000
CACHED_CHARS = 40
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: A segment is one or more spaces and what follows up to the next space.
_SEGMENT = re.compile(" +[^ ]*")
_COUNTERS: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the pieces of texts with a sentencepiece model.

    No piece of such a model has a space mark behind another character, so no merge
    crosses the place before a space that follows a non-space: texts are split there,
    the segments of a batch that are not known yet are encoded in one call, and only
    their lengths are kept. Models for which this doesn't hold are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        mark = "▁"
        self.safe = not any(mark in p.lstrip(mark) for p in pieces) and len(self.model.encode("a  b")) == sum(
            len(self.model.encode(s)) for s in ("a", " b"))
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """What to encode; the library puts the space back that each segment lacks here."""
        parts = text.split(" ")
        return [s[1:] for s in _SEGMENT.findall(" " + text)] if "" in parts else parts

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        split = [self.segments(t.replace("▁", " ")) if t else () for t in texts]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        known[""] = self.lone_space
        new = list({s for parts in split for s in parts if s not in known})
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        totals = [sum(map(known.__getitem__, parts)) for parts in split]
        for s in new:
            if len(s) > CACHED_CHARS:  # rare and large: not kept
                del known[s]
        return totals


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    No begin or end token is added and nothing is truncated. Null and empty texts have
    0 bytes and 0 tokens; repeated rows are counted row by row; a null doc_id stays.
    ``model_path`` is a sentencepiece model every executor can open.
    """
    schema = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).counts
        for batch in text_batches(batches, batch_bytes):
            texts = batch.column("text")
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            n = count([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n, pa.int64())], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = columns.mapInArrow(run, _SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
