"""Corpus tables: the entries of many repositories."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.schemas import ENTRIES


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet corpus table. Path filters and column choices reach the scan."""
    return spark.read.schema(ENTRIES).parquet(path)


def corpus_scan(entries: DataFrame) -> DataFrame:
    """Entries in scan order: ``walk_key`` sorts a repository the way a walk visits it."""
    return entries.withColumn("walk_key", paths.walk_key("path"))


#: Directory levels that are dealt to tasks anew; what lies deeper is walked where it is met.
LISTED_LEVELS = 6
#: Rows of a listing, and bytes of contents, that are handed on together.
BATCH_ROWS = 10_000
BATCH_BYTES = 16 * 1024 * 1024
_LISTING = "repo string, root string, path string, is_dir boolean, error string, open boolean"
_LISTING_NAMES = ["repo", "root", "path", "is_dir", "error", "open"]


def _scan(root: str, below: str) -> Iterator[tuple[str, bool, str | None, bool]]:
    """(path, is_dir, error, open) of what one directory holds; of itself where it can't be read."""
    try:
        with os.scandir(os.path.join(root, below)) as found:
            for entry in found:
                is_dir = entry.is_dir(follow_symlinks=False)
                yield (f"{below}/{entry.name}" if below else entry.name), is_dir, None, is_dir
    except OSError as failure:
        yield below, True, str(failure), False


def _listed(rows: Iterator[tuple], whole: bool) -> Iterator[tuple]:
    """Listing rows, those of open directories followed by what they hold: one level, or all of it."""
    for repo, root, path, is_dir, error, is_open in rows:
        if not is_open:
            yield repo, root, path, is_dir, error, False
            continue
        if path:  # the root itself is no entry
            waiting = [(path, True, None, True)]
        else:
            waiting = list(_scan(root, path))
            if not whole:
                yield from ((repo, root, *found) for found in waiting)
                continue
        while waiting:
            below, is_dir, error, is_open = waiting.pop()
            held = _scan(root, below) if is_open else iter(())
            first = next(held, None)
            if first and first[2]:  # it could not be read
                yield repo, root, *first
                continue
            yield repo, root, below, is_dir, error, False
            for found in itertools.chain([first] if first else [], held):
                if found[3] and whole:
                    waiting.append(found)
                else:
                    yield repo, root, *found


def _in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while batch := list(itertools.islice(rows, BATCH_ROWS)):
        yield pd.DataFrame(batch, columns=columns)


def read_directories(roots: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Entries of directory trees, with ``error`` for what could not be read.

    ``roots`` has repo and root, a directory that every executor can see. Directories are
    listed level by level, and those found are dealt to the tasks anew at each of the first
    ``LISTED_LEVELS``, so that one folder that holds everything does not keep one task busy.
    File bytes are read where their row was dealt to, in Arrow batches of bounded bytes.
    Dot files, empty files and ``_`` names are kept, which Spark's own binary file source
    would drop. A directory that can't be read is a row with its error, at any level.
    """

    def listing(whole: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
            yield from _in_batches(_listed(rows, whole), _LISTING_NAMES)

        return run

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, held = ["repo", "path", "is_dir", "content", "error"], [], 0
        for batch in batches:
            for repo, root, path, is_dir, error in batch.itertuples(index=False, name=None):
                content = None
                if not is_dir and not error:
                    try:
                        with open(os.path.join(root, path), "rb") as source:
                            content = source.read()
                    except OSError as failure:
                        error = str(failure)
                rows.append((repo, path, is_dir, content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    n = parallelism or roots.sparkSession.sparkContext.defaultParallelism
    found = roots.select(
        "repo", "root", F.lit("").alias("path"), F.lit(True).alias("is_dir"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("open"),
    )
    for level in range(LISTED_LEVELS + 1):
        found = found.mapInPandas(listing(level == LISTED_LEVELS), _LISTING).repartition(n, "repo", "path")
    return found.select("repo", "root", "path", "is_dir", "error").mapInPandas(
        read, "repo string, path string, is_dir boolean, content binary, error string"
    )


def read_binary_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Entries through Spark's binary file source. It leaves out dot files, ``_`` names
    and empty files, so :func:`read_directories` is the complete way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = F.regexp_replace("path", r"\A[a-z]+:/*(?=/)", "")
    return files.select(
        F.lit(repo).alias("repo"),
        F.substring(local, F.lit(len(root.rstrip("/")) + 2), F.char_length(local)).alias("path"),
        F.lit(False).alias("is_dir"), "content",
    )
