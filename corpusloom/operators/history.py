"""Commit history: the newest commits and changelog sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import ordered_buckets


def last_n_commits(commits: DataFrame, n: int, parts: int = 64) -> DataFrame:
    """(repo, commit_no, ts, event_id, subject) of the ``n`` newest commits per repository.

    Every repository is split into ``parts`` groups first; the newest n of all are among
    the newest n of each group, so no task sees more than parts x n rows of one
    repository in the final ranking.
    """
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    local = Window.partitionBy("repo", "part").orderBy(*newest)
    final = Window.partitionBy("repo").orderBy(*newest)
    return (
        commits.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
        .withColumn("rank", F.row_number().over(local))
        .where(F.col("rank") <= n)
        .withColumn("commit_no", F.row_number().over(final))
        .where(F.col("commit_no") <= n)
        .select("repo", "commit_no", "ts", "event_id", "subject")
    )


def versions_at(contents: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(files n commits back, newest files) of a table (repo, commit_no, path, content).

    ``commit_no`` counts back from the newest commit, 1, and a row is what a commit made
    of a path; ``is_deleted``, if there is such a column, marks paths it took away. A path
    has the content of the newest commit that touched it, up to the version asked for. A
    repository with ``n`` commits or fewer starts from nothing.
    """
    gone = F.col("is_deleted") if "is_deleted" in contents.columns else F.lit(False)
    rows = contents.withColumn("gone", F.coalesce(gone, F.lit(False)))

    def at(first: int) -> DataFrame:
        newest = rows.where(F.col("commit_no") >= first).groupBy("repo", "path").agg(F.min("commit_no").alias("commit_no"))
        live = rows.where(~F.col("gone")).select("repo", "path", "commit_no", "content")
        return live.join(newest, ["repo", "path", "commit_no"], "left_semi").drop("commit_no")

    return at(n + 1), at(1)


def net_change(contents: DataFrame, n: int) -> DataFrame:
    """(repo, path, status) of the net change that the newest ``n`` commits made.

    A file that was changed and changed back isn't in it. Takes what ``versions_at`` takes,
    with one row for a path in a commit. Contents are hashed where they are read; one
    aggregation finds both versions of a path, so that only keys and hashes are shuffled,
    combined before.
    """
    gone = F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in contents.columns else F.lit(False)
    state = F.struct(gone.alias("gone"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    rows = contents.select("repo", "path", "commit_no", state.alias("state"))
    old_no = F.when(F.col("commit_no") > n, F.col("commit_no"))
    both = rows.groupBy("repo", "path").agg(
        F.min_by("state", old_no).alias("old"), F.min_by("state", "commit_no").alias("new"))
    old, new = ~F.coalesce(F.col("old.gone"), F.lit(True)), ~F.col("new.gone")
    before, after = F.col("old.hash"), F.col("new.hash")
    status = (
        F.when(~old & new, F.lit("added")).when(old & ~new, F.lit("deleted"))
        .when(old & (before.isNull() != after.isNull()), F.lit("unreadable"))
        .when(old & ~before.eqNullSafe(after), F.lit("modified")))
    return both.select("repo", "path", status.alias("status")).where(F.col("status").isNotNull())


def changelog(commits: DataFrame, buckets: int | None = None) -> DataFrame:
    """Changelog lines (repo, version, tag_ts, ts, event_id, line).

    A commit belongs to the first tag at or after it; commits behind the last tag have
    a null version (unreleased). Newest section first is a sort by tag_ts descending,
    nulls first; within a section by ts descending.

    The next tag is found in two levels over evenly filled, ordered buckets, so that
    neither a long repository nor a crowded moment is ever one window: within a bucket
    among its own rows, and beyond it from the first tag of the following buckets, of
    which there is one row each.
    """
    tagged = F.when(F.col("is_tag"), F.struct("ts", "event_id"))
    rows = ordered_buckets(
        commits.select("repo", "ts", "event_id", "subject", "is_tag"),
        ["repo", "ts", "event_id"], buckets,
    )
    per_bucket = rows.groupBy("repo", "bucket").agg(F.min(tagged).alias("first_tag"))
    # Looking ahead is done backwards: a frame that grows from the start is one pass.
    following = (
        Window.partitionBy("repo").orderBy(F.col("bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    beyond = per_bucket.select(
        "repo", "bucket", F.min("first_tag").over(following).alias("later_tag")
    )
    onward = (
        Window.partitionBy("repo", "bucket")
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("near_tag", F.min(tagged).over(onward))
        .join(beyond, ["repo", "bucket"])
        .withColumn("tag", F.coalesce("near_tag", "later_tag"))
        .select(
            "repo",
            F.concat(F.lit("v"), F.col("tag.event_id")).alias("version"),
            F.col("tag.ts").alias("tag_ts"), "ts", "event_id",
            F.concat(F.lit("- "), F.col("subject")).alias("line"),
        )
    )


def release_notes(lines: DataFrame, repo: str, version: str) -> DataFrame:
    """The lines of one section."""
    return lines.where((F.col("repo") == repo) & (F.col("version") == version))


def changelog_headers(lines: DataFrame) -> DataFrame:
    """(repo, version, tag_ts, header) of every section that has a version."""
    return (
        lines.where(F.col("version").isNotNull())
        .select("repo", "version", "tag_ts").distinct()
        .select(
            "repo", "version", "tag_ts",
            F.concat(
                F.lit("## "), F.col("version"), F.lit(" ("),
                F.date_format("tag_ts", "yyyy-MM-dd"), F.lit(")"),
            ).alias("header"),
        )
    )
