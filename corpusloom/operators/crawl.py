"""Crawls: which entries of each repository are included, and why the others are not."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import paths, text
from corpusloom.operators import ignore


@dataclass(frozen=True)
class CrawlOptions:
    """Choices of one crawl, known while the plan is built."""

    excludes: Sequence[str] = ()
    includes: Sequence[str] = ()
    layers: Sequence = ()
    target: str = ""
    max_depth: int = 0
    exclude_binary: bool = True
    output_file: str = C.DEFAULT_OUTPUT_FILE
    compat: str = "reference"
    # Adds the rule columns that ``layers`` refer to, where rules differ by repository.
    attach: Callable[[DataFrame], DataFrame] | None = None

    def with_rules(self, df: DataFrame) -> DataFrame:
        return self.attach(df) if self.attach else df


def directories(entries: DataFrame) -> DataFrame:
    """Distinct (repo, path) of all directories above the entries, and of directory rows.

    Parents are made distinct first, so the ancestor explosion works on directories,
    not on files; both steps aggregate before they shuffle.
    """
    own = F.when(F.col("is_dir"), F.col("path")) if "is_dir" in entries.columns else F.lit(None)
    parents = entries.select(
        "repo", F.coalesce(own, paths.dir_name("path")).alias("path")
    ).where(F.col("path") != ".").distinct()
    chain = F.array_append(paths.ancestors("path"), F.col("path"))
    return parents.select("repo", F.explode(chain).alias("path")).distinct()


def files_only(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_dir")) if "is_dir" in entries.columns else entries


def retarget(entries: DataFrame, target: str) -> DataFrame:
    """Pack v1 with a target: everything below it, with paths relative to it."""
    if not target:
        return entries
    below = entries.where(F.col("path").startswith(target + "/"))
    return below.withColumn("path", F.substring("path", len(target) + 2, 2**31 - 1))


# --- Pack v1 --------------------------------------------------------------------------

def crawl_v1(entries: DataFrame, options: CrawlOptions) -> DataFrame:
    """Content pass: files with ``drop_reason`` (skipped, ignored, binary or null).

    The depth limit and directory pruning belong to the tree only.
    """
    layers = options.layers or ignore.layers_v1(
        options.excludes, options.includes, compat=options.compat
    )
    reason = F.when(paths.in_skipped_root_dir("path"), F.lit("skipped")).when(
        ignore.ignored_v1("path", layers, options.compat), F.lit("ignored")
    )
    if options.exclude_binary:
        reason = reason.when(~text.is_text_v1("content", options.compat), F.lit("binary"))
    files = retarget(files_only(entries), options.target)
    return options.with_rules(files).withColumn("drop_reason", reason).drop(*ignore.RULE_COLUMNS)


def summary_v1(crawled: DataFrame) -> DataFrame:
    """Included and excluded files; files in skipped root directories count nowhere."""
    return crawled.groupBy("repo").agg(
        F.count_if(F.col("drop_reason").isNull()).alias("included_count"),
        F.count_if(F.col("drop_reason").isin("ignored", "binary")).alias("excluded_count"),
    )


# --- Pack v2 --------------------------------------------------------------------------

def _path_reason_v2(path: Column, is_dir, options: CrawlOptions) -> Column:
    """Reason a path is left out before its content is looked at, null if it is not."""
    reason = F.when(F.lit(False), F.lit(""))
    if options.target:
        inside = paths.is_under(path, options.target)
        parent = F.lit(options.target).startswith(F.concat(path, F.lit("/")))
        if options.compat == "intended":
            inside = inside | parent
        reason = reason.when(
            ~inside, F.when(parent, F.lit("above_target")).otherwise(F.lit("outside_target"))
        )
    if options.max_depth > 0:
        reason = reason.when(F.size(paths.parts(path)) > options.max_depth, F.lit("depth"))
    reason = reason.when(path == options.output_file, F.lit("output_file"))
    return reason.when(
        ignore.ignored_v2(path, is_dir, options.layers, options.excludes, options.includes),
        F.lit("ignored"),
    )


def _prunes_v2(options: CrawlOptions) -> Callable[[Column], Column]:
    """A directory whose subtree is not visited. Parents of the target are visited."""

    def prunes(folder: Column) -> Column:
        reason = _path_reason_v2(folder, True, options)
        return F.coalesce(reason != "above_target", F.lit(False))

    return prunes


def crawl_v2(entries: DataFrame, options: CrawlOptions) -> DataFrame:
    """Visited files with their ``drop_reason``; entries below a dropped directory are gone."""
    reason = _path_reason_v2(F.col("path"), False, options)
    if options.exclude_binary:
        is_text = F.coalesce(
            text.is_text_v2("path", "content", options.compat), F.lit(False)
        )
        if options.includes:
            is_text = is_text | ignore.ignored_gitignore("path", False, [list(options.includes)])
        reason = F.coalesce(reason, F.when(~is_text, F.lit("binary")))
    visited = options.with_rules(files_only(entries)).where(
        ~ignore.below_dropped_dir("path", _prunes_v2(options))
    )
    return visited.withColumn("drop_reason", reason).drop(*ignore.RULE_COLUMNS)


def crawl_dirs_v2(entries: DataFrame, options: CrawlOptions) -> DataFrame:
    """Visited directories (repo, path) with their ``drop_reason``."""
    return (
        options.with_rules(directories(entries))
        .where(~ignore.below_dropped_dir("path", _prunes_v2(options)))
        .withColumn("drop_reason", _path_reason_v2(F.col("path"), True, options))
        .drop(*ignore.RULE_COLUMNS)
    )


def nodes_v2(entries: DataFrame, options: CrawlOptions) -> DataFrame:
    """Visited files and directories: (repo, path, is_dir, drop_reason), no content."""
    files = crawl_v2(entries, options).select(
        "repo", "path", F.lit(False).alias("is_dir"), "drop_reason"
    )
    folders = crawl_dirs_v2(entries, options).select(
        "repo", "path", F.lit(True).alias("is_dir"), "drop_reason"
    )
    return files.unionByName(folders)


def summary_v2(nodes: DataFrame) -> DataFrame:
    """Included and excluded files and directories; a pruned subtree counts once."""
    return nodes.groupBy("repo").agg(
        F.count_if(F.col("drop_reason").isNull()).alias("included_count"),
        F.count_if(F.col("drop_reason").isNotNull()).alias("excluded_count"),
    )


# --- Working set ----------------------------------------------------------------------

def working_set(
    entries: DataFrame, git_layers: Sequence = (), pack_layers: Sequence = (),
    compat: str = "reference",
) -> DataFrame:
    """Files with ``lang`` and ``drop_reason``; a null reason is the working set.

    Order of the tests: ignored (itself or a directory above, by either ignore file),
    hidden directory, unknown language, unreadable content (null), binary content.
    """

    def dropped(path: Column, is_dir: bool) -> Column:
        hit = F.lit(False)
        for layers in (git_layers, pack_layers):
            if len(layers):
                hit = hit | ignore.ignored_gitignore(path, is_dir, layers)
        return hit

    reason = (
        F.when(
            ignore.below_dropped_dir("path", lambda folder: dropped(folder, True))
            | dropped(F.col("path"), False),
            F.lit("ignored"),
        )
        .when(paths.in_hidden_dir("path"), F.lit("hidden_dir"))
        .when(F.col("lang") == "", F.lit("unknown_language"))
        .when(F.col("content").isNull(), F.lit("unreadable"))
        .when(~text.is_text_v1("content", compat), F.lit("binary"))
    )
    return (
        files_only(entries)
        .withColumn("lang", paths.language("path"))
        .withColumn("drop_reason", reason)
    )


def text_files(
    entries: DataFrame, git_layers: Sequence = (), compat: str = "reference"
) -> DataFrame:
    """Files a plain file callback gets: not ignored themselves, and text.

    Directories are not pruned here and languages do not matter.
    """
    kept = text.is_text_v1("content", compat)
    if len(git_layers):
        kept = ~ignore.ignored_gitignore("path", False, git_layers) & kept
    return files_only(entries).where(kept)
