"""Whole packs: rules, crawl, tree, sections and summary from one corpus table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import crawl, ignore, packs, trees
from corpusloom.operators.crawl import CrawlOptions
from corpusloom.sources.ignore_files import repo_rules


@dataclass(frozen=True)
class Pack:
    """The results of one pack run; all of them are lazy."""

    included: DataFrame
    tree: DataFrame
    sections: DataFrame
    summary: DataFrame
    verdicts: DataFrame


def _with_layers(
    entries: DataFrame, options: CrawlOptions, dialect: str,
    no_gitignore: bool, no_packignore: bool,
) -> CrawlOptions:
    """Options that use the rules of every repository's own ignore files."""
    if options.layers:
        return options
    defaults = C.DEFAULT_RULES_V1 if dialect == "path" else C.DEFAULT_RULES_V2
    git, pack, attach = (), (), None
    if not (no_gitignore and no_packignore):
        attach = ignore.rule_lookup(repo_rules(entries, dialect, options.compat))
        git = () if no_gitignore else F.col("git_rules")
        pack = () if no_packignore else ignore.own_or_default(F.col("pack_rules"), defaults, dialect)
    if dialect == "path":
        layers = ignore.layers_v1(options.excludes, options.includes, git, pack, options.compat)
    else:
        layers = [git, pack, C.ALWAYS_RULES_V2]
    return replace(options, layers=layers, attach=attach)


def pack_v1(
    entries: DataFrame, options: CrawlOptions = CrawlOptions(), include_header: bool = True,
    no_gitignore: bool = False, no_packignore: bool = False,
) -> Pack:
    """Pack v1 of every repository."""
    options = _with_layers(entries, options, "path", no_gitignore, no_packignore)
    crawled = crawl.crawl_v1(entries, options)
    included = crawled.where(F.col("drop_reason").isNull())
    tree = trees.file_tree_v1(entries, options)
    repos = entries.select("repo").distinct()
    sections = packs.pack_v1(included, tree, repos, include_header)
    return Pack(included, tree, sections, crawl.summary_v1(crawled), crawled.drop("content"))


def pack_v2(
    entries: DataFrame, options: CrawlOptions = CrawlOptions(), include_header: bool = True,
    generated_at: str | None = None, no_gitignore: bool = False, no_packignore: bool = False,
) -> Pack:
    """Pack v2 of every repository.

    The verdicts (repo, path, is_dir, drop_reason) feed the tree, the separators and the
    summary, and need the contents for the text check. They are persisted, so that the
    contents are scanned twice in all: for the verdicts and for the sections. Unpersist
    ``Pack.verdicts`` when done.
    """
    options = _with_layers(entries, options, "gitignore", no_gitignore, no_packignore)
    nodes = crawl.nodes_v2(entries, options).persist(StorageLevel.MEMORY_AND_DISK)
    included = crawl.crawl_v2(entries, options).where(F.col("drop_reason").isNull())
    kept = nodes.where(F.col("drop_reason").isNull())
    repos = entries.select("repo").distinct()
    tree = trees.file_tree_v2(kept, repos)
    sections = packs.pack_v2(
        included, tree, repos, generated_at, include_header,
        names=kept.where(~F.col("is_dir")).select("repo", "path"),
    )
    return Pack(included, tree, sections, crawl.summary_v2(nodes), nodes)
