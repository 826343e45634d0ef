"""Column functions on ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import as_column

NUL = "\u0000"


def base_name(path) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def dir_name(path) -> Column:
    """Directory part; ``.`` for a path without one."""
    path = as_column(path)
    return F.when(
        F.contains(path, F.lit("/")),
        F.substring(
            path, F.lit(1), F.char_length(path) - F.char_length(base_name(path)) - 1
        ),
    ).otherwise(F.lit("."))


def extension(path) -> Column:
    """From the last dot of the base name; a leading dot counts (``.gitignore``)."""
    base = base_name(path)
    return F.when(
        F.contains(base, F.lit(".")),
        F.concat(F.lit("."), F.substring_index(base, ".", -1)),
    ).otherwise(F.lit(""))


def parts(path) -> Column:
    return F.split(as_column(path), "/", -1)


def depth(path) -> Column:
    """Number of separators."""
    return F.size(parts(path)) - 1


def ancestors(path) -> Column:
    """Proper ancestor directories from the top down; empty for a top-level entry."""
    names = parts(path)
    return F.transform(
        F.slice(names, F.lit(1), F.size(names) - 1),
        lambda _, i: F.array_join(F.slice(names, F.lit(1), i + 1), "/"),
    )


def is_under(path, target: str) -> Column:
    """The target itself or anything below it; an empty target is the whole tree."""
    path = as_column(path)
    if not target:
        return F.lit(True)
    return (path == target) | path.startswith(target + "/")


def walk_key(path) -> Column:
    """Text key whose byte order is the walk order (component by component).

    NUL cannot occur in a file name and sorts before every other character, so a
    plain string sort of the key equals a sort by the array of components.
    """
    return F.replace(as_column(path), F.lit("/"), F.lit(NUL))


def tree_key(path, is_dir) -> Column:
    """Text key for tree order: per level directories first, then name in any case."""
    names = parts(path)
    last = F.size(names) - 1
    file_at = F.when(as_column(is_dir), F.lit(-1)).otherwise(last)
    return F.array_join(
        F.transform(
            names,
            lambda name, i: F.concat(
                F.when(i == file_at, F.lit("1")).otherwise(F.lit("0")),
                F.lower(name), F.lit(NUL), name, F.lit(NUL),
            ),
        ),
        "",
    )


def _lookup(table: dict, key: Column) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def language(path) -> Column:
    """Language by lower-cased extension, else by exact base name, else empty."""
    return F.coalesce(
        _lookup(C.LANGUAGES, F.lower(extension(path))),
        _lookup(C.LANGUAGES, base_name(path)),
        F.lit(""),
    )


def formatter(lang) -> Column:
    return _lookup({k: v[0] for k, v in C.TOOLS.items()}, F.lower(as_column(lang)))


def linter(lang) -> Column:
    return _lookup(
        {k: v[1] for k, v in C.TOOLS.items() if v[1]}, F.lower(as_column(lang))
    )


def fence_hint(path) -> Column:
    """Extension without its dot, for the opening fence."""
    return F.substring(extension(path), F.lit(2), F.lit(2**31 - 1))


def in_skipped_root_dir(path) -> Column:
    """In (or itself) a top-level directory that packs always leave out."""
    return F.element_at(parts(path), 1).isin(C.ROOT_SKIPPED_DIRS)


def skipped_dir_name(name) -> Column:
    """A directory name the working-set walk does not enter."""
    name = as_column(name)
    return name.isin(C.WALK_SKIPPED_DIRS) | (
        name.startswith(".") & ~name.isin(C.WALK_KEPT_DOT_DIRS)
    )


def in_hidden_dir(path) -> Column:
    """Some directory above the file is one the working-set walk does not enter."""
    names = parts(path)
    return F.exists(F.slice(names, F.lit(1), F.size(names) - 1), skipped_dir_name)


def is_markdown_path(path) -> Column:
    """``.md`` in any case, outside ``.git/``."""
    path = as_column(path)
    return F.lower(base_name(path)).endswith(".md") & ~F.contains(path, F.lit(".git/"))


def is_relevant_doc(path, compat: str = "reference") -> Column:
    """Documentation file in a documentation directory.

    ``reference`` tests the directory by plain prefix, so ``docker/`` counts as well;
    ``intended`` compares whole components.
    """
    folder = dir_name(path)
    if compat == "intended":
        in_docs = F.element_at(F.split(folder, "/"), 1).isin(C.DOC_DIRS)
    else:
        in_docs = folder.startswith(C.DOC_DIRS[0])
        for name in C.DOC_DIRS[1:]:
            in_docs = in_docs | folder.startswith(name)
    base = base_name(path)
    is_doc = base.endswith(C.DOC_SUFFIXES[0])
    for suffix in C.DOC_SUFFIXES[1:]:
        is_doc = is_doc | base.endswith(suffix)
    return in_docs & is_doc
