"""Sinks for packs and requests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.packs import ORDER


def write_pack_sections(sections: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pack sections as Parquet, range-sorted: a large repository spans many files."""
    sections.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.mode(mode).parquet(path)


def write_pack_text(sections: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packs as text, one directory per repository.

    Part files in name order, one after the other, are the pack (closed by a newline).
    The range sort splits a large repository over many tasks. The writer closes every
    row with a newline, so a row gives up its last one, and a separator row the first
    one of the two it starts with.
    """
    text = F.when(F.col("part") == 1, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    (
        sections.repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .select("repo", F.regexp_replace(text, r"\n\z", "").alias("value"))
        .write.mode(mode)
        .partitionBy("repo")
        .text(path)
    )


CURRENT = "CURRENT"


def replace_pack_text(sections: DataFrame, path: str) -> str:
    """Packs as text under ``path``, in place of what was there; the folder of this version.

    Every run writes a folder of its own, which Spark's committer fills only with the
    output of tasks that ended. Then a small file with its name is moved over the one of
    the run before in one step: a reader sees the old packs or the new ones, and after a
    failure the old ones. Old folders stay until someone removes them.
    """
    spark = sections.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    write_pack_text(sections, f"{path}/{version}")
    fs = spark._jvm.org.apache.hadoop.fs
    target, fresh = fs.Path(f"{path}/{CURRENT}"), fs.Path(f"{path}/_{version}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, how)
    return f"{path}/{version}"


def read_pack_text(spark: SparkSession, path: str) -> DataFrame:
    """(repo, part, text) of the packs that ``replace_pack_text`` wrote last; the texts of a repository, by part, are its pack."""
    version = spark.read.text(f"{path}/{CURRENT}").first()["value"]
    parts = spark.read.schema("value string, repo string").text(f"{path}/{version}", wholetext=True)
    name = F.col("_metadata.file_name")
    return parts.select("repo", F.struct(F.length(name), name).alias("part"), F.col("value").alias("text"))


def write_requests(requests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Request JSON lines for an offline batch service."""
    requests.select("value").write.mode(mode).text(path)
