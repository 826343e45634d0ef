"""File trees as ordered rows (repo, key, text).

A plain string sort by (repo, key) gives the tree; a tree is never gathered into one
row, so a repository of any size stays spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import crawl, ignore
from corpusloom.operators.joins import balanced_join


def _root_rows(entries: DataFrame, suffix: str = "", target: str = "") -> DataFrame:
    name = paths.base_name(F.lit(target) if target else "repo")
    return entries.select("repo").distinct().select(
        "repo", F.lit("").alias("key"), F.concat(name, F.lit(suffix)).alias("text")
    )


def _indented(is_dir: Column, level: Column) -> Column:
    mark = F.when(is_dir, F.lit("└── ")).otherwise(F.lit("├── "))
    return F.concat(F.repeat(F.lit("  "), level), mark, paths.base_name("path"))


def _all_nodes(entries: DataFrame) -> DataFrame:
    files = crawl.files_only(entries).select("repo", "path", F.lit(False).alias("is_dir"))
    folders = crawl.directories(entries).select("repo", "path", F.lit(True).alias("is_dir"))
    return files.unionByName(folders)


def file_tree_v1(entries: DataFrame, options: crawl.CrawlOptions) -> DataFrame:
    """Walk order, two blanks per level. Binary files are listed; dropped directories prune."""
    layers = options.layers or ignore.layers_v1(
        options.excludes, options.includes, compat=options.compat
    )

    def dropped(path: Column) -> Column:
        return ignore.ignored_v1(path, layers, options.compat)

    shown = ~paths.in_skipped_root_dir("path") & ~dropped(F.col("path"))
    if options.max_depth > 0:
        shown = shown & (paths.depth("path") < options.max_depth)
    shown = shown & ~ignore.below_dropped_dir("path", dropped)
    entries = crawl.retarget(entries, options.target)
    rows = options.with_rules(_all_nodes(entries)).where(shown).select(
        "repo", paths.walk_key("path").alias("key"),
        _indented(F.col("is_dir"), paths.depth("path")).alias("text"),
    )
    return _root_rows(entries, target=options.target).unionByName(rows)


def file_tree_plain(entries: DataFrame) -> DataFrame:
    """Everything in walk order; directories are indented one level deeper than files."""
    level = paths.depth("path") + F.col("is_dir").cast("int")
    rows = _all_nodes(entries).select(
        "repo", paths.walk_key("path").alias("key"),
        _indented(F.col("is_dir"), level).alias("text"),
    )
    return _root_rows(entries).unionByName(rows)


def file_tree_v2(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """Directories first, then names in any case, with branch lines.

    ``nodes`` are the included (repo, path, is_dir) rows, ``repos`` the (repo) rows that
    get a root line. A node is shown only if all directories above it are. The last child of every
    directory is one partial aggregation. Branch prefixes are built for directories
    only and then joined to the children. One directory may hold a large share of all
    files or directories, directly or further below: both joins split such a directory.
    """
    nodes = nodes.select(
        "repo", "path", "is_dir",
        paths.dir_name("path").alias("parent"),
        paths.tree_key("path", "is_dir").alias("key"),
    )
    last = nodes.groupBy("repo", "parent").agg(F.max_by("path", "key").alias("path")).select(
        "repo", "path", F.lit(True).alias("is_last")
    )
    marked = nodes.join(last, ["repo", "path"], "left").withColumn(
        "is_last", F.coalesce("is_last", F.lit(False))
    )
    folders = marked.where("is_dir").select("repo", "path", "is_last")
    bar = F.when(F.col("is_last"), F.lit("    ")).otherwise(F.lit("│   "))
    # From the nodes, since the chains need no marks.
    chains = nodes.where("is_dir").select(
        "repo", F.col("path").alias("parent"),
        F.posexplode(F.array_append(paths.ancestors("path"), F.col("path"))).alias("pos", "path"),
    )
    prefixes = (
        balanced_join(
            chains, folders.select("repo", "path", bar.alias("bar")), ["repo", "path"], ["parent"], "inner"
        )
        .groupBy("repo", "parent")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "bar"))).alias("bars"))
        .where(F.size("bars") == F.size(paths.parts("parent")))
        .select("repo", "parent", F.array_join("bars.bar", "").alias("prefix"))
    )
    branch = F.when(F.col("is_last"), F.lit("└── ")).otherwise(F.lit("├── "))
    rows = balanced_join(marked, prefixes, ["repo", "parent"], ["path"], sized_by=nodes).where(
        (F.col("parent") == ".") | F.col("prefix").isNotNull()
    ).select(
        "repo", "key",
        F.concat(
            F.coalesce("prefix", F.lit("")), branch, paths.base_name("path"),
            F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")),
        ).alias("text"),
    )
    return _root_rows(repos, "/").unionByName(rows)
