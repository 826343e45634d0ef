"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only in local mode without one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def wide_rows(spark: SparkSession) -> None:
    """Let Parquet writers of this session look at their buffers from the first row on.

    By default they first look after 100 rows, which is too late where a row has many MB.
    Only the layout of files changes; for narrow rows the next look is estimated from their size.
    """
    spark.conf.set("parquet.page.size.row.check.min", "1")


def shared_prefixes(spark: SparkSession, columns: list[str]) -> None:
    """Let Parquet writers of this session store texts as what differs from the text before (DELTA_BYTE_ARRAY).

    Rows that begin alike and stand together, as prompts with the same diff, then take the room of one and of their
    ends. That needs pages and row groups with room for several rows of ``columns``: texts of up to 53 MB share, longer ones are
    whole. Of ``columns`` no dictionary and no smallest and largest value are kept, which would be copies of whole texts.
    Only the layout of files changes.
    """
    spark.conf.set("parquet.writer.version", "v2")
    spark.conf.set("parquet.page.size", str(64 << 20))
    spark.conf.set("parquet.block.size", str(320 << 20))
    for column in columns:
        spark.conf.set(f"parquet.enable.dictionary#{column}", "false")
        spark.conf.set(f"parquet.column.statistics.enabled#{column}", "false")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches between Spark and Python have 1000 rows instead of 10 000.

    A task holds copies of a batch outside the heap and in its Python worker; with whole texts
    in the rows these are tens of MB each. Results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
