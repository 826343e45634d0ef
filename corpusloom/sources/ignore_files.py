"""Ignore rules: from ignore files in the corpus, from defaults, from the command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import globs
from corpusloom.functions.text import decode, lines, trim

LAYERS = ["gitignore", "packignore", "exclude", "include", "always"]


def _text(entries: DataFrame) -> Column:
    if dict(entries.dtypes)["content"] == "binary":
        return decode("content")
    return F.col("content")


def _ignore_files(entries: DataFrame) -> DataFrame:
    """Root ignore files only; the path filter reaches the scan before content is read."""
    return entries.where(F.col("path").isin(C.GITIGNORE_FILE, C.PACKIGNORE_FILE))


def rule_lines(text) -> Column:
    """Rules of one ignore file in order: trimmed lines without blanks and ``#`` comments."""
    return F.filter(
        F.transform(lines(text), trim), lambda line: (line != "") & ~line.startswith("#")
    )


def ignore_rules(entries: DataFrame) -> DataFrame:
    """(repo, layer, ord, pattern) of all ignore files. A missing file has no rules."""
    return _ignore_files(entries).select(
        "repo",
        F.when(F.col("path") == C.GITIGNORE_FILE, 0).otherwise(1).alias("layer"),
        F.posexplode(rule_lines(_text(entries))).alias("ord", "pattern"),
    )


def default_rules(entries: DataFrame, version: int = 1) -> DataFrame:
    """(repo, layer, ord, pattern) for every repository that has no pack ignore file."""
    patterns = C.DEFAULT_RULES_V1 if version == 1 else C.DEFAULT_RULES_V2
    # One partial aggregation decides it; no second scan and no join.
    without = (
        entries.groupBy("repo")
        .agg(F.bool_or(F.col("path") == C.PACKIGNORE_FILE).alias("has_file"))
        .where(~F.col("has_file"))
    )
    return without.select(
        "repo", F.lit(1).alias("layer"),
        F.posexplode(F.array(*map(F.lit, patterns))).alias("ord", "pattern"),
    )


def command_rules(
    excludes: list[str] = (), includes: list[str] = ()
) -> list[tuple[int, int, str]]:
    """(layer, ord, pattern) of the command line, then the rules that always come last."""
    return [
        *((2, i, p) for i, p in enumerate(excludes)),
        *((3, i, "!" + p) for i, p in enumerate(includes)),
        *((4, i, p) for i, p in enumerate(C.ALWAYS_RULES_V1)),
    ]


def rule_layers(
    entries: DataFrame, excludes: list[str] = (), includes: list[str] = (),
    no_gitignore: bool = False, no_packignore: bool = False,
) -> DataFrame:
    """The whole ordered rule table: (layer, ord) is the order within a repository."""
    layers = ignore_rules(entries)
    if no_gitignore:
        layers = layers.where(F.col("layer") != 0)
    if no_packignore:
        layers = layers.where(F.col("layer") != 1)
    else:
        layers = layers.unionByName(default_rules(entries))
    fixed = command_rules(excludes, includes)
    rows = F.array(*[
        F.struct(
            F.lit(layer).alias("layer"), F.lit(i).alias("ord"), F.lit(p).alias("pattern")
        )
        for layer, i, p in fixed
    ])
    per_repo = entries.select("repo").distinct().select("repo", F.inline(rows))
    return layers.unionByName(per_repo)


def repo_rules(
    entries: DataFrame, dialect: str = "path", compat: str = "reference"
) -> DataFrame:
    """One row per repository that owns ignore files, with its rules already compiled.

    ``git_rules`` and ``pack_rules`` are runs of like rules (``globs.rule_runs_column``);
    an array is as long as its ignore file, which is itself one row. ``pack_rules`` is null
    without a pack ignore file: such repositories take the defaults, which are plan-time
    literals.
    """
    if dialect == "path":
        compiled = F.transform(
            rule_lines(_text(entries)), lambda line: globs.path_rule_column(line, compat)
        )
    else:
        compiled = F.filter(
            F.transform(lines(_text(entries)), globs.gitignore_column),
            lambda rule: rule.isNotNull(),
        )
    files = _ignore_files(entries).select("repo", "path", globs.rule_runs_column(compiled).alias("rules"))
    own = F.col("path") == C.PACKIGNORE_FILE
    return files.groupBy("repo").agg(
        F.any_value(F.when(~own, F.col("rules")), True).alias("git_rules"),
        F.any_value(F.when(own, F.col("rules")), True).alias("pack_rules"),
    )
