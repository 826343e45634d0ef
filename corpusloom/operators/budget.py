"""Context with a byte budget per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import head_bytes, n_bytes
from corpusloom.operators.joins import lookup, spread_join

_BEFORE = (Window.unboundedPreceding, -1)


def header(path="path") -> Column:
    return F.concat(F.lit("\n--- File: "), F.col(path), F.lit(" ---\n"))


def _used_before(window) -> Column:
    return F.coalesce(F.sum("cost").over(window.rowsBetween(*_BEFORE)), F.lit(0))


def taken_files(files: DataFrame, budget: int, parts: int) -> DataFrame:
    """Live files up to and including the first that goes over the budget (``over``).

    The running total is exact without gathering a repository in one task. Files are
    first split into ``parts`` groups per repository, and a file is let go when its own
    group alone already uses up the budget: the full total can only be larger. What
    remains per repository is bounded by parts x budget, however large it is.
    """
    live = files.where(F.col("state") == "live").select(
        "repo", "path", (F.octet_length(header()) + F.col("size")).cast("long").alias("cost")
    )
    near = (
        live.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)))
        .withColumn("used", _used_before(Window.partitionBy("repo", "part").orderBy("path")))
        .where(F.col("used") <= budget)
        .drop("part", "used")
    )
    # Whatever lies behind the first overflow has used_before > budget, so at most one
    # file per repository goes over.
    return (
        near.withColumn("used_before", _used_before(Window.partitionBy("repo").orderBy("path")))
        .where(F.col("used_before") <= budget)
        .withColumn("over", F.col("used_before") + F.col("cost") > budget)
        .withColumn("header_bytes", F.octet_length(header()).cast("long"))
        .withColumn("size", F.col("cost") - F.col("header_bytes"))
    )


def _ends(taken: DataFrame) -> DataFrame:
    """(repo, end): the path at which the walk of a repository stops."""
    return taken.where("over").select("repo", F.col("path").alias("end"))


def _plan(files: DataFrame, taken: DataFrame, budget: int) -> DataFrame:
    room = F.greatest(
        F.lit(budget) - F.col("used_before") - F.col("header_bytes") - C.TRUNCATION_RESERVE,
        F.lit(0),
    )
    fitting = taken.where(~F.col("over") | (room > 0)).select(
        "repo", "path",
        F.when(F.col("over"), F.lit("cut")).otherwise(F.lit("full")).alias("action"),
        "used_before",
        F.when(F.col("over"), room).otherwise(F.col("size")).alias("content_bytes"),
    )
    stubs = spread_join(
        files.where(F.col("state") != "live").select("repo", "path", "state"),
        _ends(taken), ["repo"], ["path"],
    ).where(F.col("end").isNull() | (F.col("path") < F.col("end"))).select(
        "repo", "path", F.col("state").alias("action"),
        F.lit(None).cast("long").alias("used_before"), F.lit(0).cast("long").alias("content_bytes"),
    )
    return fitting.unionByName(stubs)


def budget_plan(
    files: DataFrame, budget: int = C.CONTEXT_BUDGET, parts: int = 1024
) -> DataFrame:
    """Which files fit: (repo, path, action, used_before, content_bytes).

    ``files`` has repo, path, state (``live``, ``deleted`` or ``error``) and size in
    bytes, no content. Files are taken in path order. ``full`` files fit; the first that
    does not is ``cut``, or dropped when nothing of it fits; everything behind it is
    dropped. Deleted and unreadable files are stubs and cost nothing.
    """
    return _plan(files, taken_files(files, budget, parts), budget)


def budgeted_context(
    entries: DataFrame, budget: int = C.CONTEXT_BUDGET, parts: int = 1024
) -> DataFrame:
    """Ordered context rows (repo, path, action, used_before, content_bytes, text).

    ``entries`` has repo, path, state and text content (optionally ``size`` and
    ``error``). Contents behind the end of their repository are filtered out in the scan,
    before anything with content is shuffled. Nothing is cached: the decision on what is
    taken moves the same three columns for each of its uses, so Spark shuffles them once.
    """
    size = F.col("size") if "size" in entries.columns else n_bytes("content")
    error = F.col("error") if "error" in entries.columns else F.lit("")
    files = entries.select("repo", "path", "state", size.alias("size"))
    taken = taken_files(files, budget, parts)
    plan = _plan(files, taken, budget)
    # One end a repository, so its longest path bounds what the ends can take.
    longest = files.groupBy("repo").agg(F.max_by("path", F.octet_length("path")).alias("end"))
    contents = lookup(_ends(taken), ["repo"], ["path"], bound=longest)(
        entries.select("repo", "path", "content", error.alias("error"))
    ).where(F.col("end").isNull() | (F.col("path") <= F.col("end"))).drop("end")
    path = F.col("path")
    text = (
        F.when(F.col("action") == "full", F.concat(header(), F.col("content")))
        .when(
            F.col("action") == "cut",
            F.concat(
                header(), head_bytes("content", F.col("content_bytes")), F.lit(C.TRUNCATION_LINE)
            ),
        )
        .when(
            F.col("action") == "deleted",
            F.concat(F.lit("\n--- File (Deleted): "), path, F.lit(" ---\n")),
        )
        .otherwise(
            F.concat(
                F.lit("\n--- File (Error): "), path, F.lit(" ---\nError reading file: "),
                F.coalesce("error", F.lit("")), F.lit("\n"),
            )
        )
    )
    return plan.join(contents, ["repo", "path"]).select(
        "repo", "path", "action", "used_before", "content_bytes", text.alias("text")
    )
