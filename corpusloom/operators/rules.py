"""Coding standards and nearest configuration files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths
from corpusloom.operators.crawl import directories
from corpusloom.operators.joins import balanced_join, spread_join

RULE_FIELDS = ["id", "description", "prompt", "language", "applies_to"]


def standards_flatten(standards: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per rule: keys, scope, ord, id, description, prompt, language, applies_to.

    ``scope`` is ``general`` or the language a rule is listed under. A missing language
    map or list is empty.
    """
    general = standards.select(
        *keys, F.lit("general").alias("scope"),
        F.posexplode("llm_rules_general").alias("ord", "rule"),
    )
    per_language = (
        standards.select(*keys, F.explode("languages").alias("scope", "settings"))
        .select(*keys, "scope", F.posexplode("settings.llm_rules").alias("ord", "rule"))
    )
    rule = [F.col(f"rule.{name}").alias(name) for name in RULE_FIELDS]
    return general.unionByName(per_language).select(*keys, "scope", "ord", *rule)


def standards_warnings(standards: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Configurations whose version is not 1, with the warning text."""
    return standards.where(F.coalesce("version", F.lit(0)) != 1).select(
        *keys, "version",
        F.format_string(
            "Unsupported standards config version '%d'. Expected version 1.",
            F.coalesce("version", F.lit(0)),
        ).alias("warning"),
    )


def compiled_rules(rules: Column) -> Column:
    """Rules with their globs as one regex: array<struct<id, language, all_files, regex>>.

    The regex is null for a rule without a valid glob.
    """

    def regex(rule: Column) -> Column:
        globs_of = F.coalesce(rule["applies_to"], F.array().cast("array<string>"))
        found = F.filter(F.transform(globs_of, globs.rule_glob_regex_column), lambda glob: glob.isNotNull())
        return F.nullif(F.array_join(F.transform(found, lambda g: F.concat(F.lit("(?:"), g, F.lit(")"))), "|"), F.lit(""))

    return F.transform(
        F.coalesce(rules, F.array()),
        lambda rule: F.struct(
            rule["id"].alias("id"), F.coalesce(rule["language"], F.lit("")).alias("language"),
            (F.coalesce(F.size(rule["applies_to"]), F.lit(0)) <= 0).alias("all_files"), regex(rule).alias("regex"),
        ),
    )


def _literal_rules(rules: list[dict], path: Column) -> Column:
    """array<struct<id, language, fits>> from rules known while the plan is built.

    Every rule is one literal regex, which is compiled once for all files.
    """
    rows = []
    for rule in rules:
        found = [globs.rule_glob_regex(g) for g in rule.get("applies_to") or []]
        regexes = [f"(?:{g})" for g in found if g is not None]
        fits = path.rlike("|".join(regexes)) if regexes else F.lit(not found)
        rows.append(F.struct(
            F.lit(rule["id"]).alias("id"), F.lit(rule.get("language") or "").alias("language"), fits.alias("fits")))
    if not rows:
        return F.array().cast("array<struct<id:string,language:string,fits:boolean>>")
    return F.array(*rows)


def _fits(path: Column):
    return lambda rule: rule["all_files"] | F.coalesce(F.rlike(path, rule["regex"]), F.lit(False))


def applicable_ids(
    lang: Column, general: Column, for_language: Column, applies: Callable[[Column], Column], only: list[str] = ()
) -> Column:
    """array<struct<scope, id>> of the rules for one file, of those that ``applies`` holds for.

    General rules are never made distinct; a language rule whose id is already taken is
    left out. The rules travel in the file's row, so files and rules are never paired.
    """

    def fits(rule: Column) -> Column:
        hit = applies(rule)
        return hit & rule["id"].isin(list(only)) if only else hit

    def tagged(scope: str):
        return lambda rule: F.struct(F.lit(scope).alias("scope"), rule["id"].alias("id"))

    first = F.filter(
        general, lambda r: ((r["language"] == "") | (r["language"] == lang)) & fits(r)
    )
    second = F.filter(for_language, fits)
    taken = F.transform(first, lambda r: r["id"])
    second_ids = F.transform(second, lambda r: r["id"])
    new = F.filter(
        second,
        lambda r, i: ~F.array_contains(taken, r["id"]) & (F.array_position(second_ids, r["id"]) == i + 1),
    )
    return F.concat(
        F.transform(first, tagged("general")), F.transform(new, tagged("language"))
    )


def applicable_rules(files: DataFrame, standards: dict, only: list[str] = ()) -> DataFrame:
    """(repo, path, lang, ord, scope, id) for standards known while the plan is built."""
    path = F.col("path")
    general = _literal_rules(standards.get("llm_rules_general") or [], path)
    per_language = _literal_rules([], path)
    languages = standards.get("languages") or {}
    lang = F.col("lang")
    if languages:
        chain = F.when(F.lit(False), per_language)
        for name, settings in languages.items():
            chain = chain.when(lang == name, _literal_rules(settings.get("llm_rules") or [], path))
        per_language = chain.otherwise(per_language)
    found = applicable_ids(lang, general, per_language, lambda rule: rule["fits"], only)
    return files.select(
        "repo", "path", "lang", F.posexplode(found).alias("ord", "rule")
    ).select("repo", "path", "lang", "ord", "rule.scope", "rule.id")


def applicable_rules_by_repo(
    files: DataFrame, standards: DataFrame, only: list[str] = ()
) -> DataFrame:
    """The same with one standards row per repository: an equi join on repo."""
    compiled = standards.select(
        "repo",
        compiled_rules(F.col("llm_rules_general")).alias("general"),
        F.transform_values(
            F.coalesce(
                "languages", F.from_json(F.lit("{}"), standards.schema["languages"].dataType)
            ),
            lambda _, settings: compiled_rules(settings["llm_rules"]),
        ).alias("by_language"),
    )
    joined = spread_join(files.select("repo", "path", "lang"), compiled, ["repo"], ["path"], "inner")
    empty = F.slice(F.col("general"), 1, 0)
    found = applicable_ids(
        F.col("lang"), F.col("general"), F.coalesce(F.try_element_at("by_language", F.col("lang")), empty),
        _fits(F.col("path")), only,
    )
    return joined.select("repo", "path", "lang", F.posexplode(found).alias("ord", "rule")).select(
        "repo", "path", "lang", "ord", "rule.scope", "rule.id"
    )


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Every file with ``config``: the config file in its directory or the closest above.

    ``configs`` are the (repo, path) of config files. The search runs once per
    directory; files then look their directory up. Both joins split a directory that has a
    large share of all directories below it, or of all files in it.
    """
    found = configs.select("repo", paths.dir_name("path").alias("folder"), F.col("path").alias("config"))
    tree = directories(files).select(
        "repo", F.col("path").alias("dir"),
        F.array_append(paths.ancestors("path"), F.col("path")).alias("chain"),
    )
    roots = files.select("repo").distinct().select(
        "repo", F.lit(".").alias("dir"), F.array().cast("array<string>").alias("chain")
    )
    levels = tree.unionByName(roots).select(
        "repo", "dir",
        F.posexplode(F.concat(F.array(F.lit(".")), F.col("chain"))).alias("level", "folder"),
    )
    nearest = (
        balanced_join(levels, found, ["repo", "folder"], ["dir"], "inner")
        .groupBy("repo", "dir")
        .agg(F.max_by("config", "level").alias("config"))
    )
    placed = files.withColumn("dir", paths.dir_name("path"))
    return balanced_join(placed, nearest, ["repo", "dir"], ["path"]).drop("dir")
