"""Packs: tree and contents of each repository as ordered section rows.

Sorting by (repo, section, key, part) and concatenating ``text`` gives the pack. The
file rows are made inside the scan stage: contents are never shuffled by these
operators, and no repository is gathered into one row (``joins.assemble`` does that,
behind a size check, for those who want it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import paths
from corpusloom.functions.text import decode

ORDER = ["repo", "section", "key", "part"]
COLUMNS = [*ORDER, "path", "text"]


def _section(df: DataFrame, section: int, text: Column, key=None, path=None, part=0) -> DataFrame:
    return df.select(
        "repo", F.lit(section).alias("section"),
        (F.lit("") if key is None else key).alias("key"),
        F.lit(part).alias("part"),
        (F.lit(None).cast("string") if path is None else path).alias("path"),
        text.alias("text"),
    )


def _content(files: DataFrame) -> Column:
    """Decoded content; an unreadable file shows its error in place."""
    error = F.col("error") if "error" in files.columns else F.lit("no content")
    raw = F.col("content")
    text = decode(raw) if dict(files.dtypes)["content"] == "binary" else raw
    return F.coalesce(text, F.concat(F.lit("Error reading file: "), F.coalesce(error, F.lit(""))))


def pack_v1(
    included: DataFrame, tree: DataFrame, repos: DataFrame, include_header: bool = True
) -> DataFrame:
    """``## path`` sections in walk order, behind an optional header with the tree.

    ``included`` are files with content, ``tree`` the rows of a file tree, ``repos`` the
    (repo) rows that get a pack.
    """
    path = F.col("path")
    body = _section(
        included, 3,
        F.concat(F.lit("## "), path, F.lit("\n\n"), _content(included), F.lit("\n\n")),
        paths.walk_key("path"), path,
    )
    if not include_header:
        return body
    return (
        _section(repos, 0, F.lit("# Project Structure\n\n"))
        .unionByName(_section(tree, 1, F.concat("text", F.lit("\n")), F.col("key")))
        .unionByName(_section(repos, 2, F.lit("\n\n# File Contents\n\n")))
        .unionByName(body)
    )


def pack_v2(
    included: DataFrame, tree: DataFrame, repos: DataFrame,
    generated_at: str | None = None, include_header: bool = True,
    names: DataFrame | None = None,
) -> DataFrame:
    """Fenced tree, then fenced files in plain path order with ``---`` between them.

    The separators are rows of their own, made from (repo, path) alone, so that finding
    the last file of a repository never moves contents. ``names`` are the (repo, path)
    of ``included``, where they are already at hand without another scan of the contents.
    """
    path = F.col("path")
    body = _section(
        included, 4,
        F.concat(
            F.lit("### File: "), path, F.lit("\n\n```"), paths.fence_hint("path"), F.lit("\n"),
            _content(included), F.lit("\n```"),
        ),
        path, path,
    )
    names = included.select("repo", "path") if names is None else names
    last = names.groupBy("repo").agg(F.max("path").alias("path"))
    between = _section(
        names.join(last, ["repo", "path"], "left_anti"), 4, F.lit("\n\n---\n\n"), path, path, 1
    )
    opening = _section(repos, 1, F.lit("## File Tree Structure\n\n```\n"))
    middle = F.lit("```\n\n" + C.RULE_LINE + "\n## File Contents\n\n")
    pack = (
        opening
        .unionByName(_section(tree, 2, F.concat("text", F.lit("\n")), F.col("key")))
        .unionByName(_section(repos, 3, middle))
        .unionByName(body)
        .unionByName(between)
    )
    if not include_header:
        return pack
    banner = F.concat(
        F.lit(C.RULE_LINE + "Project Root: "), F.col("repo"),
        F.lit(f"\nGenerated At: {generated_at or ''}\n" + C.RULE_LINE + "\n"),
    )
    return _section(repos, 0, banner).unionByName(pack)
