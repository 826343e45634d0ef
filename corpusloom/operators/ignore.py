"""Ignore verdicts.

A verdict is a column expression over the path, so it runs inside the scan stage: no
files x rules join, and directory pruning needs no join either, because a path carries
all its ancestors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import globs, paths
from corpusloom.functions.text import as_column, let
from corpusloom.operators.joins import lookup

Layer = Sequence[str] | Column | Callable[[Column], Column]


def _literal_action(path: Column, runs: list[tuple[list[str], str | None, bool]]) -> Column:
    def action(mark: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for needles, regex, keep in runs:
            found = [F.exists(F.array(*map(F.lit, needles)), lambda needle: F.contains(mark, needle))] if needles else []
            found += [path.rlike(regex)] if regex else []
            out = out.when(reduce(or_, found), F.lit(keep))
        return out

    return let(globs.marked(path), action)


def _matching_runs(path: Column, runs: Column) -> Column:
    return let(globs.marked(path), lambda mark: F.filter(runs, lambda run: globs.run_matches(path, mark, run)))


def first_action(path, layers: Sequence[Layer], compat: str = "reference") -> Column:
    """Keep flag of the first rule that matches, null when none does (pack v1).

    A layer is a list of patterns known now, a column of ``globs.rule_runs_column``, or a
    function from path to action.
    """
    path = as_column(path)
    actions = []
    for layer in layers:
        if isinstance(layer, Column):
            actions.append(F.get(_matching_runs(path, layer), 0)["keep"])
        elif callable(layer):
            actions.append(layer(path))
        elif layer:
            actions.append(_literal_action(path, globs.rule_runs(list(layer), "path", compat)))
    return F.coalesce(*actions) if actions else F.lit(None).cast("boolean")


def last_action(path, layers: Sequence[Layer]) -> Column:
    """Keep flag of the last gitignore line that matches, null when none does."""
    path = as_column(path)
    actions = []
    for layer in reversed(layers):
        if isinstance(layer, Column):
            actions.append(F.try_element_at(_matching_runs(path, layer), F.lit(-1))["keep"])
        elif callable(layer):
            actions.append(layer(path))
        elif layer:
            runs = globs.rule_runs(list(layer), "gitignore")
            actions.append(_literal_action(path, runs[::-1]))
    return F.coalesce(*actions) if actions else F.lit(None).cast("boolean")


def ignored_v1(path, layers: Sequence[Layer], compat: str = "reference") -> Column:
    """First match wins, in rule order."""
    return ~F.coalesce(first_action(path, layers, compat), F.lit(True))


def ignored_gitignore(path, is_dir, layers: Sequence[Layer]) -> Column:
    """Last match wins; directories are matched with a trailing slash."""
    path = as_column(path)
    if is_dir is True:
        path = F.concat(path, F.lit("/"))
    elif is_dir is not False:
        path = F.when(as_column(is_dir), F.concat(path, F.lit("/"))).otherwise(path)
    return ~F.coalesce(last_action(path, layers), F.lit(True))


def ignored_v2(
    path, is_dir, layers: Sequence[Layer], excludes: Sequence[str] = (),
    includes: Sequence[str] = (),
) -> Column:
    """Ignore files and command excludes; a command include overrides both."""
    dropped = ignored_gitignore(path, is_dir, layers)
    if excludes:
        dropped = dropped | ignored_gitignore(path, is_dir, [list(excludes)])
    if includes:
        dropped = dropped & ~ignored_gitignore(path, is_dir, [list(includes)])
    return dropped


def below_dropped_dir(path, dropped: Callable[[Column], Column]) -> Column:
    """Some directory above is dropped, so the walk never gets here."""
    return F.exists(paths.ancestors(path), dropped)


def layers_v1(
    excludes: Sequence[str] = (), includes: Sequence[str] = (),
    git_rules: Layer = (), pack_rules: Layer = (), compat: str = "reference",
) -> list[Layer]:
    """Rule layers of pack v1 in order of precedence.

    Includes come after all drops, so that they only beat the four fixed rules;
    ``intended`` puts them first.
    """
    keep = ["!" + p for p in includes]
    command = list(excludes)
    if compat == "intended":
        return [keep, git_rules, pack_rules, command, C.ALWAYS_RULES_V1]
    return [git_rules, pack_rules, command + keep + C.ALWAYS_RULES_V1]


RULE_COLUMNS = ["git_rules", "pack_rules"]


def rule_lookup(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``git_rules`` and ``pack_rules`` of ``repo_rules`` to entries."""
    return lookup(rules, ["repo"], ["path"])


def own_or_default(pack_rules: Column, defaults: Sequence[str], dialect: str = "path") -> Layer:
    """Layer of a repository's own pack rules, or of the defaults where it has none.

    Only repositories with an ignore file carry a rule array; for all the others the
    default list is one literal regex.
    """
    action = first_action if dialect == "path" else last_action

    def layer(path: Column) -> Column:
        return F.when(pack_rules.isNotNull(), action(path, [pack_rules])).otherwise(
            action(path, [list(defaults)])
        )

    return layer
