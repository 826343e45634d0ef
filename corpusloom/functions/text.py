"""Column functions on text and bytes. All of them are map-only and JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C


def as_column(value) -> Column:
    """A column as it is; a string is a column name."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def trim(text) -> Column:
    """Cut Unicode white space off both ends (Spark's own ``trim`` cuts blanks only)."""
    return F.btrim(as_column(text), F.lit(C.WHITESPACE))


def lines(text) -> Column:
    """Lines of a text, trailing empty lines kept; an empty text is one empty line."""
    return F.split(as_column(text), "\n", -1)


def n_bytes(text) -> Column:
    """Length in bytes, null counted as 0."""
    return F.coalesce(F.octet_length(as_column(text)), F.lit(0)).cast("long")


def head_bytes(text, n) -> Column:
    """The first ``n`` bytes of a text, backed off to the last whole character."""
    raw = as_column(text).cast("binary")
    n = F.lit(n) if isinstance(n, int) else n
    n = n.cast("int")
    cuts = [
        F.try_validate_utf8(F.substring(raw, F.lit(1), n - F.lit(back)).cast("string"))
        for back in range(4)
    ]
    return F.when(n <= 0, F.lit("")).otherwise(F.coalesce(*cuts))


def limit_text(text, n: int) -> Column:
    """Cut a text of more than ``n`` bytes, at its last newline if that lies beyond n / 2."""
    text = as_column(text)
    head = head_bytes(text, n)
    last_line = F.substring_index(head, "\n", -1)
    at_newline = F.octet_length(head) - F.octet_length(last_line) - 1
    cut = F.when(
        at_newline > n // 2,
        F.substring(head, F.lit(1), F.char_length(head) - F.char_length(last_line) - 1),
    ).otherwise(head)
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def decode(content) -> Column:
    """Bytes to text: valid UTF-8 as it is, anything else byte for byte as Latin-1."""
    content = as_column(content)
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def _prefix_is_utf8(content: Column, n: int, whole_characters: bool) -> Column:
    """Whether the first ``n`` bytes are valid UTF-8.

    With ``whole_characters`` a character cut by the end of the prefix is left out.
    """

    def valid(k):
        return F.is_valid_utf8(F.substring(content, 1, k).cast("string"))

    if not whole_characters:
        return valid(n)
    result = valid(n)
    cut_tails = {1: "^[CDEF]", 2: "^[EF][0-9A-F][89AB]", 3: "^F[0-9A-F][89AB][0-9A-F][89AB]"}
    for back, lead in cut_tails.items():
        tail = F.hex(F.substring(content, n - back + 1, back))
        result = result | (
            (F.octet_length(content) > n) & tail.rlike(lead) & valid(n - back)
        )
    return result


def is_text_v1(content, compat: str = "reference") -> Column:
    """Text check on the first 1024 bytes: UTF-8, no binary signature, few control bytes."""
    content = as_column(content).cast("binary")
    prefix = F.substring(content, 1, C.TEXT_PREFIX_V1)
    size = F.octet_length(prefix)
    plain = F.regexp_replace(
        prefix.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""
    )
    controls = size - F.octet_length(plain)
    signature = F.hex(F.substring(content, 1, 3))
    return (
        F.when(size == 0, F.lit(True))
        .when(~_prefix_is_utf8(content, C.TEXT_PREFIX_V1, compat == "intended"), F.lit(False))
        .when(signature.isin(C.BINARY_SIGNATURES), F.lit(False))
        .otherwise(controls / size <= C.MAX_CONTROL_RATIO)
    )


def is_text_v2(path, content, compat: str = "reference") -> Column:
    """Text check by extension first, then on the first 4096 bytes: UTF-8, at most two NULs."""
    from corpusloom.functions.paths import base_name, extension

    path, content = as_column(path), as_column(content).cast("binary")
    prefix = F.substring(content, 1, C.TEXT_PREFIX_V2)
    nuls = F.octet_length(prefix) - F.octet_length(
        F.replace(prefix.cast("string"), F.lit("\u0000"), F.lit(""))
    )
    binary_name = F.lower(extension(path)).isin(C.BINARY_EXTENSIONS)
    if compat == "intended":
        binary_name = binary_name | base_name(path).isin(C.BINARY_EXTENSIONS)
    return (
        F.when(binary_name, F.lit(False))
        .when(~_prefix_is_utf8(content, C.TEXT_PREFIX_V2, compat == "intended"), F.lit(False))
        .otherwise(nuls <= C.MAX_NUL_BYTES)
    )


def import_lines(text) -> Column:
    """Array of the lines that import something, as they stand in the text."""
    return F.filter(
        lines(text),
        lambda line: trim(line).startswith("import ") | trim(line).startswith("export * from"),
    )


def _without_closing_fence(text: Column) -> Column:
    def close(opened: Column) -> Column:
        return F.when(
            opened.endswith(C.FENCE),
            trim(F.substring(opened, F.lit(1), F.char_length(opened) - len(C.FENCE))),
        ).otherwise(opened)

    return let(text, close)


def strip_fence_editor(reply, compat: str = "reference") -> Column:
    """Reply text without its code fence, openers matched case-sensitively.

    ``reference`` cuts the first listed opener only, so that the rest of a longer
    language name stays; ``intended`` cuts through the end of the opener's line.
    """
    # Ordered alternation picks the first listed opener.
    opener = r"(?s)\A```[^\n]*" if compat == "intended" else rf"\A(?:{'|'.join(C.EDITOR_FENCES)})"

    def open_up(text: Column) -> Column:
        return F.when(
            text.startswith(C.FENCE), trim(F.regexp_replace(text, opener, ""))
        ).otherwise(text)

    return _without_closing_fence(let(trim(reply), open_up))


def strip_fence_general(reply) -> Column:
    """Reply text without its code fence: known openers in any case, cut through the newline."""
    opener = rf"(?i)\A(?:{'|'.join(C.GENERAL_FENCES)})"

    def after_line(rest: Column) -> Column:
        return trim(
            F.when(F.contains(rest, F.lit("\n")), F.regexp_replace(rest, r"\A[^\n]*", ""))
            .otherwise(rest)
        )

    def open_up(text: Column) -> Column:
        return F.when(
            text.startswith(C.FENCE), let(F.regexp_replace(text, opener, ""), after_line)
        ).otherwise(text)

    return _without_closing_fence(let(trim(reply), open_up))
