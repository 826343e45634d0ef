"""Join and assembly helpers that hold when one key owns a large share of the rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ensure_checkpoint_dir

_SALT = "__salt"
_PARTS = "__parts"
_FIRST = "__first"
#: Pieces of a hot key for each share of all rows that it has.
PIECES = 4
#: The same where each piece has a partition of its own and costs a copy of a wide row.
WIDE_PIECES = 2
#: A key with fewer rows keeps no task busy, whatever its share, and stays whole.
HOT_ROWS = 100_000
#: The largest value that Spark can hold, about.
MAX_TEXT_BYTES = 2_000_000_000


def spread_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread_on: list[str],
    how: str = "left", parts: int = 16,
) -> DataFrame:
    """Join ``many`` to ``one``, where ``one`` has at most one (narrow) row per key.

    A key that owns a third of ``many`` would land in one task. The key is therefore
    split ``parts`` ways by a hash of ``spread_on``, and the rows of ``one`` are
    repeated for every part. When ``one`` turns out small at run time, adaptive
    execution still turns this into a broadcast join by its measured size.
    """
    salted = many.withColumn(
        _SALT, F.pmod(F.xxhash64(*spread_on), F.lit(parts)).cast("int")
    )
    repeated = one.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)


def balanced_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread_on: list[str],
    how: str = "left", parts: int | None = None, sized_by: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` (at most one row per key), splitting only keys that are hot.

    Keys are counted at once, in one job with partial counts before its shuffle. One that
    has more than the ``parts``-th share of all rows, and ``HOT_ROWS``, is split into pieces of a quarter of
    such a share by a hash of ``spread_on``, and its row of ``one`` is repeated for each
    piece. Pieces fall to partitions by hash too; whole shares would now and then meet in
    one. There are fewer than ``parts`` such keys, whatever the size of the data, so they
    come to the driver and are broadcast, and ``one`` grows by less than ``5 * parts``
    rows. Without such a key this is a plain join. Rows with a null key match nothing and
    are spread as well, if they are many. ``sized_by`` has the keys of ``many`` where that
    is costly to compute twice; ``how`` is inner, left, left_semi or left_anti.
    """
    spark = many.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (many if sized_by is None else sized_by).groupBy(*keys).agg(F.count("*").alias("__n"))
    pieces = _hot_keys(counts, n, HOT_ROWS, PIECES)
    if not pieces:
        return many.join(one, keys, how)
    schema = T.StructType([*counts.select(*keys).schema.fields, T.StructField(_PARTS, T.IntegerType())])
    hot = F.broadcast(spark.createDataFrame(pieces, schema))
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    spread = F.when(no_key, F.lit(PIECES * n)).otherwise(F.coalesce(_PARTS, F.lit(1)))
    salted = many.join(hot, keys, "left").withColumn(
        _SALT, F.pmod(F.xxhash64(*spread_on), spread).cast("int")
    ).drop(_PARTS)
    repeated = one.join(hot, keys, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1))
    ).drop(_PARTS)
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)


def _hot_keys(counts: DataFrame, n: int, least: int, pieces: int) -> list[tuple]:
    """(*key, pieces) of the keys with more than the ``n``-th share of all rows, and ``least`` rows: ``pieces`` for each share."""
    seen = Observation()
    most = counts.observe(seen, F.sum("__n").alias("total")).orderBy(F.desc("__n")).limit(n).collect()
    share = (seen.get["total"] or 0) / n
    return [(*row[:-1], math.ceil(pieces * row["__n"] / share)) for row in most if row["__n"] > max(share, least)]


def wide_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread_on: list[str], order: list[Column],
    slots: int | None = None,
) -> DataFrame:
    """Left join of ``many`` to ``one``, which has at most one row per key, but one of many MB.

    Every piece of a hot key costs a copy of its wide row in the shuffle. The pieces therefore follow the
    tasks that the cluster runs at once (``slots``) and not the partitions, which grow with the input:
    ``WIDE_PIECES`` for each slot's share of the rows. Each has a partition of its own, so no two meet in one;
    the other keys, and rows with a null key, fall to the usual number of partitions by hash. Within a partition
    rows stay together by key and are in ``order``. Its rows of ``one`` are hashed rather than sorted, which
    would hold more copies of them; they have to fit in memory.
    """
    spark = many.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = slots or max(spark.sparkContext.defaultParallelism, 2)
    counts = many.groupBy(*keys).agg(F.count("*").alias("__n")).dropna(subset=keys)
    hot = _hot_keys(counts, tasks, 0, WIDE_PIECES)
    firsts = [0, *itertools.accumulate(row[-1] for row in hot)]
    numbers = [T.StructField(name, T.IntegerType()) for name in (_PARTS, _FIRST)]

    def with_ranges(df: DataFrame) -> DataFrame:
        if not hot:
            return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in numbers})
        rows = [(*row, first) for row, first in zip(hot, firsts, strict=False)]
        ranges = spark.createDataFrame(rows, T.StructType([*counts.select(*keys).schema.fields, *numbers]))
        return df.join(F.broadcast(ranges), keys, "left")

    def by_hash(columns: list[str]) -> Column:
        return F.lit(firsts[-1]) + F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def dealt(df: DataFrame, partition: Column) -> DataFrame:
        placed = with_ranges(df).withColumn(_SALT, partition).drop(_PARTS, _FIRST)
        return placed.repartitionById(firsts[-1] + n, F.col(_SALT))

    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    piece = F.col(_FIRST) + F.pmod(F.xxhash64(*spread_on), F.col(_PARTS)).cast("int")
    every_piece = F.sequence(F.col(_FIRST), F.col(_FIRST) + F.col(_PARTS) - 1)
    rows = dealt(many, F.when(no_key, by_hash(spread_on)).otherwise(F.coalesce(piece, by_hash(keys))))
    wide = dealt(one, F.explode(F.coalesce(every_piece, F.array(by_hash(keys)))))
    # The condition holds for every row; without one that isn't deterministic Spark drops the sort below the join.
    ordered = rows.sortWithinPartitions(*keys, *order).where(F.spark_partition_id() >= 0)
    return ordered.join(wide.hint("shuffle_hash"), [*keys, _SALT], "left").drop(_SALT)


def lookup(
    one: DataFrame, keys: list[str], spread_on: list[str], how: str = "left",
    max_broadcast_bytes: int = 256 * 1024 * 1024, bound: DataFrame | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """A function that joins wide rows to a lookup table, without moving them if possible.

    For rows with file contents a shuffle is the cost to avoid, and adaptive execution
    would only find out after having written it. The lookup table is measured once (one
    aggregated number comes back) and broadcast only within the bound; beyond it the
    spread shuffle join takes over. ``bound`` is measured in its place, where a table that
    is surely no smaller costs less to compute.
    """
    sized = one if bound is None else bound
    size = F.sum(F.octet_length(F.to_json(F.struct(*sized.columns))))
    measured = sized.agg(F.coalesce(size, F.lit(0)).alias("bytes")).first()["bytes"]
    if measured <= max_broadcast_bytes:
        return lambda many: many.join(F.broadcast(one), keys, how)
    return lambda many: spread_join(many, one, keys, spread_on, how)


def ordered_buckets(df: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``bucket``: evenly filled ranges of ``order``, numbered in that order.

    Spark samples the range bounds anew whenever the plan runs, so the rows are written
    to the checkpoint folder with their bucket; every later use, also after the loss of
    an executor, reads the same assignment. ``order`` should be unique, so that ties
    cannot crowd one bucket.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()).checkpoint()


def assemble(
    sections: DataFrame, keys: list[str], order: list[str], text: str = "text", separator: str = "",
) -> DataFrame:
    """One text row per key, every key.

    Only for what has to be one text, such as a request: nothing is left out, and a key
    whose text goes beyond what one value can hold fails the job with a message that names
    it. Packs and contexts stay ordered rows. Sizes are summed along with the rows.
    """
    size = F.sum(F.octet_length(text).cast("long") + len(separator.encode()))
    grouped = sections.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, text))).alias("__rows"), size.alias("__bytes")
    )
    joined = F.array_join(F.col(f"__rows.{text}"), separator)
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    whole = F.when(
        F.col("__bytes") > MAX_TEXT_BYTES, F.raise_error(F.concat(F.lit("text too large for one row: "), named))
    ).otherwise(joined)
    return grouped.select(*keys, whole.alias(text))
