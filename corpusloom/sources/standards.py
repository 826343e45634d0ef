"""Standards configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column
from corpusloom.schemas import STANDARDS


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """Standards files (JSON), one row per file, with the explicit schema."""
    return spark.read.schema(STANDARDS).option("multiLine", "true").json(path)


def parse_standards(content) -> Column:
    """A standards text column as a struct."""
    return F.from_json(as_column(content), STANDARDS)


def standards_of(entries: DataFrame, file_name: str) -> DataFrame:
    """(repo, path, ...) of all standards files in a corpus; the name filter reaches the scan."""
    named = (F.col("path") == file_name) | F.col("path").endswith("/" + file_name)
    return entries.where(named).select(
        "repo", "path", parse_standards(F.col("content").cast("string")).alias("s")
    ).select("repo", "path", "s.*")
