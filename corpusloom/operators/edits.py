"""Edits: parsed from model replies and applied to documents.

Both steps are column expressions over one row (document and reply), so they need no
shuffle beyond the join that brings the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import as_column, let, lines, strip_fence_editor, trim

REPLACE, INSERT_AFTER, DELETE = "REPLACE", "INSERT_AFTER", "DELETE"

# --- Fixed values: edit blocks; {marker} is a parameter ------------------------------
BLOCKS = {
    REPLACE: (
        "--- {marker} REPLACE START ---\n<<< ORIGINAL >>>\n(.*?)\n<<< REPLACEMENT >>>\n(.*?)"
        "\n--- {marker} REPLACE END ---"
    ),
    INSERT_AFTER: (
        "--- {marker} INSERT_AFTER START ---\n<<< CONTEXT_LINE >>>\n(.*?)\n<<< INSERTION >>>\n"
        "(.*?)\n--- {marker} INSERT_AFTER END ---"
    ),
    DELETE: "--- {marker} DELETE START ---\n<<< CONTENT >>>\n(.*?)\n--- {marker} DELETE END ---",
}
FIELDS = {
    REPLACE: ("original", "replacement"),
    INSERT_AFTER: ("context_line", "insertion"),
    DELETE: ("content",),
}
ALL_FIELDS = ["original", "replacement", "context_line", "insertion", "content"]


def _blocks(reply: Column, kind: str, marker: str, compat: str) -> Column:
    # (?d): "." stops at "\n" only; one-line fields under reference, any under intended.
    pattern = ("(?s)" if compat == "intended" else "(?d)") + BLOCKS[kind].replace(
        "{marker}", marker
    )
    found = F.regexp_extract_all(reply, F.lit(pattern), F.lit(0))

    def clean(text: Column) -> Column:
        if compat == "intended":
            return F.regexp_replace(text, r"\A\n+|(?<!\n)\n+\z", "")
        return trim(text)

    def edit(block: Column) -> Column:
        values = {
            name: clean(F.regexp_extract(block, pattern, i + 1))
            for i, name in enumerate(FIELDS[kind])
        }
        return F.struct(
            F.lit(kind).alias("type"),
            *[values.get(n, F.lit(None).cast("string")).alias(n) for n in ALL_FIELDS],
        )

    return F.transform(found, edit)


def parse_edits(reply, marker: str = C.MARKER, compat: str = "reference") -> Column:
    """Edits of a reply: REPLACE, then INSERT_AFTER, then DELETE blocks; empty if none.

    A reply that starts with a fence is a whole file and holds no edits.
    """
    reply = as_column(reply)
    found = F.concat(*[_blocks(reply, kind, marker, compat) for kind in BLOCKS])
    return F.when(reply.startswith(C.FENCE), F.slice(found, 1, 0)).otherwise(found)


def full_content(reply, edits, compat: str = "reference") -> Column:
    """Whole-file content of a reply without edits, null when there are edits."""
    return F.when(F.size(as_column(edits)) == 0, strip_fence_editor(reply, compat))


def _block(edit: Column) -> Column:
    """The lines an edit looks for, each closed by a newline."""
    return F.concat(
        F.coalesce(edit["original"], edit["context_line"], edit["content"]), F.lit("\n")
    )


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def _valid(edits: Column, compat: str) -> Column:
    if compat == "intended":
        return F.filter(edits, lambda e: _block(e) != "\n")
    return edits


def _search_pattern(edits: Column, compat: str) -> Column:
    """One regex per document that finds every place an edit applies, left to right.

    Alternatives are in edit order, so the first edit that matches a position wins.
    Under ``reference`` the edits behind it are then tried on what follows: each is an
    optional continuation (an INSERT_AFTER whose context is the line the match began
    with takes any one line).
    """

    def alternative(edit: Column, i: Column) -> Column:
        start = _quoted(_block(edit))
        if compat == "intended":
            return start
        begun = _first_line(_block(edit))

        def follow(later: Column) -> Column:
            return (
                F.when(
                    later["type"] != INSERT_AFTER,
                    F.concat(F.lit("(?:"), _quoted(_block(later)), F.lit(")?+")),
                )
                .when(later["context_line"] == begun, F.lit(r"(?:[^\n]*+\n)?+"))
                .otherwise("")
            )

        later = F.slice(edits, i + 2, F.size(edits))
        return F.concat(start, F.array_join(F.transform(later, follow), ""))

    return F.concat(
        F.lit("(?md)^(?:"), F.array_join(F.transform(edits, alternative), "|"), F.lit(")")
    )


def _replay(match: Column, edits: Column, compat: str) -> Column:
    """What a matched stretch of lines turns into."""
    begun = _first_line(match)

    def step(state: Column, edit: Column) -> Column:
        rest, out, hit = state["rest"], state["out"], state["hit"]
        block = _block(edit)
        inserts = edit["type"] == INSERT_AFTER
        behind = F.substring(rest, F.char_length(block) + 1, F.char_length(rest))
        if compat == "intended":  # the whole block is what was searched for, and stays before an insertion
            applies, tail, context = F.startswith(rest, block) & ~hit, behind, block
        else:
            applies = F.when(inserts, edit["context_line"] == begun).otherwise(F.startswith(rest, block))
            first = F.substring(rest, F.char_length(_first_line(rest)) + 2, F.char_length(rest))
            tail, context = F.when(inserts, first).otherwise(behind), F.concat(begun, F.lit("\n"))
        text = (
            F.when(edit["type"] == REPLACE, F.concat(edit["replacement"], F.lit("\n")))
            .when(inserts, F.concat(context, edit["insertion"], F.lit("\n")))
            .otherwise("")
        )
        return F.struct(
            F.when(applies, tail).otherwise(rest).alias("rest"),
            F.when(applies, F.concat(out, text)).otherwise(out).alias("out"),
            (hit | applies).alias("hit"),
        )

    start = F.struct(
        match.alias("rest"), F.lit("").alias("out"), F.lit(False).alias("hit")
    )
    if compat == "intended":  # no line that no edit took may get lost
        return F.aggregate(edits, start, step, lambda state: F.concat(state["out"], state["rest"]))
    return F.aggregate(edits, start, step, lambda state: state["out"])


def apply_edits(content, edits, compat: str = "reference") -> Column:
    """The document after its edits; every occurrence is edited, output is not rescanned.

    The text is cut at the matched stretches and the stretches are rewritten, so the
    cost grows with the text, not with text x edits.
    """
    content, edits = as_column(content), as_column(edits)

    def rewrite(found: Column, pattern: Column, closed: Column) -> Column:
        new = F.transform(
            F.regexp_extract_all(closed, pattern, F.lit(0)), lambda m: _replay(m, found, compat)
        )
        pieces = F.zip_with(
            F.split(closed, pattern, -1), new,
            lambda kept, text: F.concat(kept, F.coalesce(text, F.lit(""))),
        )
        return F.regexp_replace(F.array_join(pieces, ""), r"\n\z", "")

    def prepared(found: Column) -> Column:
        bound = F.struct(
            _search_pattern(found, compat).alias("pattern"),
            F.concat(content, F.lit("\n")).alias("closed"),
        )
        return let(bound, lambda b: rewrite(found, b["pattern"], b["closed"]))

    return F.when(F.size(edits) == 0, content).otherwise(
        let(
            _valid(edits, compat),
            lambda found: F.when(F.size(found) == 0, content).otherwise(prepared(found)),
        )
    )


def edit_anchors(
    df: DataFrame, keys: list[str], content: str = "content", edits: str = "edits"
) -> DataFrame:
    """(keys, edit_no, edit_type, line_no): every place where the block of an edit occurs.

    Positions are found within the row: only they are given per edit, not the document.
    """
    doc = F.col("__lines")

    def places(block: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(doc) - 1),
            lambda i: (F.get(doc, i) == F.get(block, F.lit(0))) & (F.slice(doc, i + 1, F.size(block)) == block),
        )

    def found(edit: Column, i: Column) -> Column:
        block = F.split(F.coalesce(edit["original"], edit["context_line"], edit["content"]), "\n", -1)
        return F.struct(i.alias("edit_no"), edit["type"].alias("edit_type"), let(block, places).alias("at"))

    per_edit = df.select(*keys, lines(content).alias("__lines"), F.col(edits).alias("__edits")).select(
        *keys, F.inline(F.transform("__edits", found)))
    return per_edit.select(*keys, "edit_no", "edit_type", F.explode("at").alias("line_no"))
