"""Edit parsing and application, against hand cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import edits as E
from corpusloom.schemas import EDIT


def edit(kind, a, b=None):
    keys = {"REPLACE": ("original", "replacement"), "INSERT_AFTER": ("context_line", "insertion"), "DELETE": ("content",)}
    row = dict.fromkeys(EDIT.names)
    row.update(type=kind, **dict(zip(keys[kind], (a, b))))
    return row


def run(spark, cases, compat):
    df = spark.createDataFrame(
        [(i, doc, list(found)) for i, (doc, found) in enumerate(cases)],
        f"id int, doc string, edits array<{EDIT.simpleString()}>",
    )
    rows = df.select("id", E.apply_edits("doc", "edits", compat).alias("out")).collect()
    return {r["id"]: r["out"] for r in rows}


CASES = [
    ("a\nb\na", [edit("REPLACE", "a", "x")], "x\nb\nx", "x\nb\nx"),
    ("a\nb", [edit("INSERT_AFTER", "a", "n")], "a\nn\nb", "a\nn\nb"),
    ("a\nb\nc", [edit("DELETE", "a\nb")], "c", "c"),
    ("a\nb\nc", [edit("REPLACE", "a", "x"), edit("REPLACE", "b", "y")], "x\ny\nc", "x\ny\nc"),
    ("a\nb\nc", [edit("REPLACE", "a", "x"), edit("INSERT_AFTER", "a", "n")], "x\na\nn\nc", "x\nb\nc"),
    ("a\nb\na", [edit("REPLACE", "b", "y"), edit("DELETE", "a")], "y", "y"),
    ("  a", [edit("REPLACE", "a", "x")], "  a", "  a"),
    ("a\n\nb", [edit("REPLACE", "", "x")], "a\nx\nb", "a\n\nb"),
    ("a", [edit("DELETE", "a")], "", ""),
    ("a\nb", [], "a\nb", "a\nb"),
    ("x\\Ey\n$1.*", [edit("REPLACE", "x\\Ey", "\\E$0"), edit("DELETE", "$1.*")], "\\E$0", "\\E$0"),
    ("", [edit("DELETE", "q")], "", ""),
    ("a\n", [edit("DELETE", "a")], "", ""),
]


def test_apply_hand_cases(spark):
    cases = [(doc, found) for doc, found, _, _ in CASES]
    for compat, at in [("reference", 2), ("intended", 3)]:
        out = run(spark, cases, compat)
        for i, case in enumerate(CASES):
            assert out[i] == case[at], (compat, case)


def brute_force(doc, found, compat):
    """Line by line, the slow way."""
    lines, out, at = doc.split("\n"), [], 0
    while at < len(lines):
        entry, hits, here = lines[at], 0, at
        for e in found:
            want = next(e[k] for k in ("original", "context_line", "content") if e[k] is not None).split("\n")
            if compat == "intended" and (hits or want == [""]):
                continue
            if e["type"] == "INSERT_AFTER":
                if [entry] != want:
                    continue
                out += [entry, *e["insertion"].split("\n")]
                here += 1
            else:
                if lines[here:here + len(want)] != want:
                    continue
                out += e["replacement"].split("\n") if e["type"] == "REPLACE" else []
                here += len(want)
            hits += 1
        if not hits:
            out.append(entry)
        at = here if hits else at + 1
    return "\n".join(out)


def test_apply_random_documents(spark):
    dice = random.Random(7)
    alphabet = ["a", "b", "c", "", "é", "a b"]

    def block(most):
        return "\n".join(dice.choice(alphabet) for _ in range(dice.randint(1, most)))

    cases = []
    for _ in range(600):
        found = []
        for _ in range(dice.randint(1, 4)):
            kind = dice.choice(["REPLACE", "INSERT_AFTER", "DELETE"])
            found.append(edit(kind, block(1 if kind == "INSERT_AFTER" else 3), None if kind == "DELETE" else block(2)))
        cases.append((block(12), found))
    for compat in ("reference", "intended"):
        out = run(spark, cases, compat)
        for i, (doc, found) in enumerate(cases):
            assert out[i] == brute_force(doc, found, compat), (compat, doc, found)


def reply(*blocks, marker="EDIT"):
    names = {"REPLACE": ("ORIGINAL", "REPLACEMENT"), "INSERT_AFTER": ("CONTEXT_LINE", "INSERTION"), "DELETE": ("CONTENT",)}
    out = []
    for kind, *fields in blocks:
        lines = [f"--- {marker} {kind} START ---"]
        for name, value in zip(names[kind], fields):
            lines += [f"<<< {name} >>>", value]
        out.append("\n".join([*lines, f"--- {marker} {kind} END ---"]))
    return "\n".join(out)


@pytest.fixture(scope="module")
def parsed(spark):
    def parse(text, compat="reference", marker="EDIT"):
        row = spark.range(1).select(E.parse_edits(F.lit(text), marker, compat).alias("e")).select(
            "e", E.full_content(F.lit(text), "e", compat).alias("whole")
        ).first()
        return [{k: v for k, v in e.asDict().items() if v is not None} for e in row["e"]], row["whole"]

    return parse


def test_parse_orders_kinds(parsed):
    text = reply(("DELETE", "d"), ("INSERT_AFTER", "c", "n"), ("REPLACE", " a ", "b c"))
    found, whole = parsed(text)
    assert [e["type"] for e in found] == ["REPLACE", "INSERT_AFTER", "DELETE"]
    assert found[0] == {"type": "REPLACE", "original": "a", "replacement": "b c"}
    assert whole is None


def test_parse_multi_line_blocks(parsed):
    text = reply(("REPLACE", "a\nb", "c"))
    found, whole = parsed(text)
    assert found == [] and whole == text
    found, whole = parsed(text, "intended")
    assert found == [{"type": "REPLACE", "original": "a\nb", "replacement": "c"}] and whole is None


def test_parse_fences_and_marker(parsed):
    block = reply(("DELETE", "x"))
    assert parsed("```\n" + block + "\n```") == ([], block)
    assert parsed(" ```\nx\n```") == ([], "x")
    other = reply(("DELETE", "x"), marker="PATCH")
    assert parsed(other)[0] == [] and parsed(other, marker="PATCH")[0] == [{"type": "DELETE", "content": "x"}]


def test_parse_indented_field(parsed):
    text = reply(("REPLACE", "  a", "x"))
    assert parsed(text)[0][0]["original"] == "a"
    assert parsed(text, "intended")[0][0]["original"] == "  a"


def test_anchors(spark):
    df = spark.createDataFrame(
        [(1, "a\nb\na\nb", [edit("REPLACE", "a\nb", "x"), edit("DELETE", "b"), edit("DELETE", "zz")])],
        f"id int, content string, edits array<{EDIT.simpleString()}>",
    )
    got = {(r["edit_no"], r["line_no"]) for r in E.edit_anchors(df, ["id"]).collect()}
    assert got == {(0, 0), (0, 2), (1, 1), (1, 3)}


def test_two_line_context_keeps_its_lines(values):
    fields = "type string, original string, replacement string, context_line string, insertion string, content string"
    edit = F.array(F.struct(*[
        F.lit(v).cast("string").alias(k.split()[0])
        for k, v in zip(fields.split(", "), (E.INSERT_AFTER, None, None, "a\nb", "n", None))
    ]))
    assert values(E.apply_edits(F.lit("a\nb\nc"), edit, "intended")) == "a\nb\nn\nc"
