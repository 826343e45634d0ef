"""Helpers of the operators on training text: tables, hashing, batches, bounded joins."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

MEMO_BYTES = 24 * 1024 * 1024
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read back.

    Wide rows should be in row groups of ``group_rows``, as a reader holds one at a time.

    The folder is the one in ``spark.checkpoint.dir``, so the table survives the loss of
    any executor; ``drop_written`` removes what this session wrote.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": group_rows}
    df.write.options(**rows).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Delete the tables of ``written``; frames that read them can't be used afterwards."""
    jvm = spark._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Free the shuffle files of steps whose result is ``written``.

    Spark deletes them when the driver has collected the frames that they belong to, which
    may be long after; what is still in use stays.
    """
    gc.collect()
    spark._jvm.System.gc()


def semi_by_size(
    many: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", max_rows: int = 2_000_000,
    at_most: int | None = None,
) -> DataFrame:
    """Rows of ``many`` with a key in ``keys`` (distinct, a few numbers wide), or without (left_anti).

    The keys are counted; up to ``max_rows`` they are broadcast, so that wide texts need
    no shuffle, beyond that both sides are shuffled. They aren't counted where ``at_most``, a bound
    that is known before, is within that. The result is the same.
    """
    small = (at_most is not None and at_most <= max_rows) or keys.limit(max_rows + 1).count() <= max_rows
    return many.join(F.broadcast(keys) if small else keys, on, how)


def join_by_size(
    many: DataFrame, one: DataFrame, on: list[str], payload: Column, how: str = "inner",
    max_bytes: int = 48 * 1024 * 1024,
) -> DataFrame:
    """Join wide rows to ``one`` row per key, which is broadcast only if its measured size
    (``payload`` plus 64 bytes a row) stays within ``max_bytes``; else both are shuffled."""
    size = one.agg(F.coalesce(F.sum(payload.cast("long") + 64), F.lit(0)).alias("n")).first()["n"]
    return many.join(F.broadcast(one) if size <= max_bytes else one, on, how)


class Memo(dict):
    """A dict that computes what it lacks, and starts anew when it holds about ``max_bytes``.

    Make one for each pass over a partition, so that nothing outlives its stage in a
    Python worker that Spark uses again.
    """

    def __init__(self, compute, max_bytes: int = MEMO_BYTES, entry: int = 180):
        """``entry``: bytes of a key, a small value and their place, besides the key's length."""
        super().__init__()
        self.compute, self.max_bytes, self.room, self.entry = compute, max_bytes, max_bytes, entry

    def __missing__(self, key):
        self.room -= self.entry + (len(key) if isinstance(key, (bytes, str)) else 0)
        if self.room < 0:
            self.clear()
            self.room = self.max_bytes
        value = self[key] = self.compute(key)
        return value


def word_memo() -> Memo:
    """64-bit hashes of words."""
    return Memo(xxhash.xxh64_intdigest)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` changes A-Z only."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


#: ASCII letters in lower case, digits and bytes of other characters; all else is a space.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(data: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, in UTF-8."""
    return (data or b"").translate(_TERM_BYTES).split()


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive words (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:n])
    for j in range(1, k):
        out = mix(out * np.uint64(3) + hashes[j:j + n])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, no words none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < k:
        return gram_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(gram_hashes(hashes, k))


def text_batches(
    batches: Iterator[pa.RecordBatch], max_bytes: int = 4 * 1024 * 1024, column: str = "text",
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about equal bytes of text; a long text is one batch."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 64)
        start, n = 0, len(sizes)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
        "double": pa.float64(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
