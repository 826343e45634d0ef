"""Trees, packs, crawls and budgets against hand-made and brute-force results."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import budget, crawl, joins, packs, trees
from corpusloom.operators.crawl import CrawlOptions
from corpusloom.plans import packing
from corpusloom.sources import sinks


def table(spark, files):
    rows = [(repo, path, content) for repo, repo_files in files.items() for path, content in repo_files.items()]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def lines(tree):
    return [r["text"] for r in tree.orderBy("repo", "key").collect()]


def joined(sections):
    return "".join(r["text"] for r in sections.orderBy(*packs.ORDER).collect())


FILES = {"r": {"a.txt": "1", "a/x": "2", "a-b/x": "3"}}


def test_tree_v1_order(spark):
    tree = trees.file_tree_v1(table(spark, FILES), CrawlOptions(layers=[["none"]]))
    assert lines(tree) == ["r", "└── a", "  ├── x", "└── a-b", "  ├── x", "├── a.txt"]


def test_tree_v1_prunes_dropped_folders_and_limits_depth(spark):
    df = table(spark, {"r": {"foo.lock/a.txt": "", "b/c/d/e": "", "node_modules/x": "", "z": ""}})
    tree = trees.file_tree_v1(df, CrawlOptions(layers=[["*.lock"]], max_depth=2))
    assert lines(tree) == ["r", "└── b", "  └── c", "├── z"]
    crawled = crawl.crawl_v1(df, CrawlOptions(layers=[["*.lock"]], max_depth=2))
    kept = {r["path"] for r in crawled.where("drop_reason is null").collect()}
    assert kept == {"foo.lock/a.txt", "b/c/d/e", "z"}  # contents are neither pruned nor cut


def test_tree_plain(spark):
    assert lines(trees.file_tree_plain(table(spark, FILES))) == [
        "r", "  └── a", "  ├── x", "  └── a-b", "  ├── x", "├── a.txt",
    ]


def test_tree_v2_branches(spark):
    df = table(spark, FILES)
    nodes = crawl.nodes_v2(df, CrawlOptions())
    assert lines(trees.file_tree_v2(nodes, df)) == [
        "r/", "├── a/", "│   └── x", "├── a-b/", "│   └── x", "└── a.txt",
    ]


def test_tree_v2_case_and_last_folder(spark):
    df = table(spark, {"r": {"B": "", "a": "", "D/q/x": "", "D/y": "", "c/z": ""}})
    assert lines(trees.file_tree_v2(crawl.nodes_v2(df, CrawlOptions()), df)) == [
        "r/", "├── c/", "│   └── z", "├── D/", "│   ├── q/", "│   │   └── x", "│   └── y", "├── a", "└── B",
    ]


def test_empty_folders_come_from_entries(spark):
    df = spark.createDataFrame(
        [("r", "e/f", True, None), ("r", "x", False, b"1")],
        "repo string, path string, is_dir boolean, content binary",
    )
    assert lines(trees.file_tree_plain(df)) == ["r", "  └── e", "    └── f", "├── x"]


def test_nested_target_empties_the_tree_unless_intended(spark):
    df = table(spark, {"r": {"a/b/x": "1", "c": "2"}})
    for compat, expected in [
        ("reference", ["r/"]), ("intended", ["r/", "└── a/", "    └── b/", "        └── x"]),
    ]:
        options = CrawlOptions(target="a/b", compat=compat)
        nodes = crawl.nodes_v2(df, options)
        assert lines(trees.file_tree_v2(nodes.where("drop_reason is null"), df)) == expected
        kept = {r["path"] for r in nodes.where("drop_reason is null and not is_dir").collect()}
        assert kept == {"a/b/x"}


def test_summary_v2_counts_a_pruned_subtree_once(spark):
    df = table(spark, {"r": {"build/a": "", "build/b/c": "", "src/x": "", "src/y.log": ""}})
    nodes = crawl.nodes_v2(df, CrawlOptions(layers=[["build/", "*.log"]]))
    row = crawl.summary_v2(nodes).first()
    assert (row["included_count"], row["excluded_count"]) == (2, 2)


def test_command_include_overrides(spark):
    df = table(spark, {"r": {"a.log": "\0\0\0", "b.log": "", "c.tmp": ""}})
    options = CrawlOptions(layers=[["*.log"]], excludes=["*.tmp"], includes=["a.log", "c.*"])
    reasons = {r["path"]: r["drop_reason"] for r in crawl.crawl_v2(df, options).collect()}
    assert reasons == {"a.log": None, "b.log": "ignored", "c.tmp": None}


def test_pack_v1_text(spark):
    df = table(spark, {"r": {"b.md": "B\n", "a/x.py": "A", "k.log": "no", ".llmignore": "*.log\n.llmignore"}})
    pack = packing.pack_v1(df)
    assert joined(pack.sections) == (
        "# Project Structure\n\nr\n└── a\n  ├── x.py\n├── b.md\n\n\n# File Contents\n\n"
        "## a/x.py\n\nA\n\n## b.md\n\nB\n\n\n"
    )
    row = pack.summary.first()
    assert (row["included_count"], row["excluded_count"]) == (2, 2)


def test_pack_v1_target_and_flags(spark):
    df = table(spark, {"r": {"s/.gitignore": "x", "s/a": "A", "t": "T", ".gitignore": "a\n"}})
    pack = packing.pack_v1(df, CrawlOptions(target="s"), include_header=False)
    assert joined(pack.sections) == "## .gitignore\n\nx\n\n"
    pack = packing.pack_v1(df, CrawlOptions(target="s"), include_header=False, no_gitignore=True)
    assert joined(pack.sections) == "## .gitignore\n\nx\n\n## a\n\nA\n\n"
    assert lines(pack.tree) == ["s", "├── .gitignore", "├── a"]


PACK_V2 = (
    "============================================================\nProject Root: r\nGenerated At: T0\n"
    "============================================================\n\n## File Tree Structure\n\n```\n"
    "r/\n├── docs/\n│   └── u.md\n├── .llmignore\n└── main.go\n```\n\n"
    "============================================================\n\n## File Contents\n\n"
    "### File: .llmignore\n\n```llmignore\n*.log\n```\n\n---\n\n### File: docs/u.md\n\n```md\nU\n```"
    "\n\n---\n\n### File: main.go\n\n```go\npackage main\n```"
)


def pack_v2_input(spark):
    return table(spark, {"r": {"main.go": "package main", "docs/u.md": "U", "x.log": "", ".llmignore": "*.log"}})


def test_pack_v2_text(spark):
    pack = packing.pack_v2(pack_v2_input(spark), generated_at="T0")
    assert joined(pack.sections) == PACK_V2
    row = pack.summary.first()
    assert (row["included_count"], row["excluded_count"]) == (4, 1)


def test_pack_text_sink(spark, tmp_path):
    sinks.write_pack_text(packing.pack_v2(pack_v2_input(spark), generated_at="T0").sections, str(tmp_path / "v2"))
    parts = sorted((tmp_path / "v2" / "repo=r").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == PACK_V2 + "\n"
    v1 = packing.pack_v1(table(spark, FILES)).sections
    sinks.write_pack_text(v1, str(tmp_path / "v1"))
    parts = sorted((tmp_path / "v1" / "repo=r").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == joined(v1)


def test_pack_text_is_replaced_in_one_step(spark, tmp_path):
    first, second = ({"r": {"a": f"one {v}", "b/c": "x" * 9}, "7": {"z": "\n\n"}} for v in (1, 2))
    path = str(tmp_path / "packs")

    def read():
        rows = sinks.read_pack_text(spark, path).collect()
        texts = {}
        for row in sorted(rows, key=lambda r: (r["repo"], r["part"])):
            texts[row["repo"]] = texts.get(row["repo"], "") + row["text"]
        return texts

    for files in (first, second):
        sections = packing.pack_v1(table(spark, files)).sections
        sinks.replace_pack_text(sections, path)
        assert read() == {repo: joined(sections.where(sections.repo == repo)) for repo in files}
    before = read()
    broken = packing.pack_v1(table(spark, first)).sections.selectExpr(
        "repo", "section", "key", "part", "path", "CASE WHEN path = 'b/c' THEN raise_error('lost') ELSE text END AS text")
    with pytest.raises(Exception, match="lost"):
        sinks.replace_pack_text(broken, path)
    assert read() == before


def test_unreadable_content_shows_its_error(spark):
    df = spark.createDataFrame([("r", "a", None, "denied")], "repo string, path string, content string, error string")
    sections = packs.pack_v1(df, df.select("repo").limit(0), df.select("repo"), include_header=False)
    assert joined(sections) == "## a\n\nError reading file: denied\n\n"


def test_every_candidate_is_included_or_excluded(spark):
    df = table(spark, {f"r{i}": {f"d{j}/f{j}.{e}": "x" for j in range(9) for e in ("log", "md")} for i in range(3)})
    pack = packing.pack_v1(df)
    for row in pack.summary.collect():
        assert row["included_count"] + row["excluded_count"] == 18
    contents = pack.sections.where("section = 3")
    assert contents.count() == pack.included.count() == contents.select("repo", "path").distinct().count()


# --- Budget ------------------------------------------------------------------------------------

def simple_budget(files, limit):
    """Files of one repository in path order: [(path, action, used before, bytes)]."""
    out, used = [], 0
    for path, state, size in sorted(files):
        if state != "live":
            out.append((path, state, None, 0))
            continue
        head = len(f"\n--- File: {path} ---\n".encode())
        if used + head + size > limit:
            room = limit - used - head - 20
            if room > 0:
                out.append((path, "cut", used, room))
            return out
        out.append((path, "full", used, size))
        used += head + size
    return out


def test_budget_hand_case(spark):
    df = spark.createDataFrame(
        [("r", "a", "live", "x" * 10), ("r", "b", "deleted", None), ("r", "c", "live", "é" * 40), ("r", "d", "live", "y")],
        "repo string, path string, state string, content string",
    )
    rows = {r["path"]: r for r in budget.budgeted_context(df, 100).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["text"] == "\n--- File: a ---\n" + "x" * 10
    assert rows["b"]["text"] == "\n--- File (Deleted): b ---\n"
    assert rows["c"]["content_bytes"] == 36
    assert rows["c"]["text"] == "\n--- File: c ---\n" + "é" * 18 + "\n... (file truncated)\n"


def test_budgeted_context_caches_nothing(spark):
    rows = [("hot", f"p{i:04d}", "live", "x" * (i % 50)) for i in range(900)] + [(f"r{i}", "p", "live", "y") for i in range(100)]
    df = spark.createDataFrame(rows, "repo string, path string, state string, content string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got = budget.budgeted_context(df, 5000)
    assert "InMemory" not in got._jdf.queryExecution().executedPlan().toString()
    taken, used = {}, 0
    for _, path, _, content in rows[:900]:
        cost = len(f"\n--- File: {path} ---\n") + len(content)
        if used + cost > 5000:
            break
        taken[path] = used
        used += cost
    full = {r["path"]: r["used_before"] for r in got.where("repo = 'hot' AND action = 'full'").collect()}
    assert full == taken
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_budget_against_brute_force_with_a_hot_repository(spark, parts):
    dice = random.Random(parts)
    rows = []
    for repo, n in [("hot", 900), *((f"r{i}", dice.randint(0, 40)) for i in range(30))]:
        for i in range(n):
            state = dice.choice(["live"] * 8 + ["deleted", "error"])
            rows.append((repo, f"d{dice.randint(0, 9)}/f{i}é", state, dice.choice([0, 1, 30, 200, 900, 4000])))
    df = spark.createDataFrame(rows, "repo string, path string, state string, size long").repartition(8)
    for limit in (0, 60, 3000, 20_000, 10**7):
        got = {}
        for r in budget.budget_plan(df, limit, parts).collect():
            got.setdefault(r["repo"], []).append((r["path"], r["action"], r["used_before"], r["content_bytes"]))
        for repo in {r[0] for r in rows}:
            want = simple_budget([r[1:] for r in rows if r[0] == repo], limit)
            assert sorted(got.get(repo, [])) == sorted(want), (repo, limit)


def test_used_bytes_never_exceed_the_budget(spark):
    df = spark.range(500).select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit("live").alias("state"),
        (F.col("id") % 97).alias("size"),
    )
    used = budget.budget_plan(df, 5000).select(
        F.sum(F.col("content_bytes") + F.octet_length(budget.header()))
    ).first()[0]
    assert used <= 5000


# --- Joins ---------------------------------------------------------------------------------------

def test_spread_join_equals_a_plain_join(spark):
    many = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    one = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(40))], "k string, v int")
    for how in ("left", "inner"):
        got = joins.spread_join(many, one, ["k"], ["id"], how)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=str) == sorted(
            map(tuple, many.join(one, "k", how).select("k", "id", "v").collect()), key=str
        )


def test_lookup_beyond_the_bound_spreads(spark):
    one = spark.createDataFrame([("a", "x" * 100)], "k string, v string")
    many = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id int")
    small = joins.lookup(one, ["k"], ["id"])(many)
    large = joins.lookup(one, ["k"], ["id"], max_broadcast_bytes=10)(many)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (small, large)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_assemble_leaves_no_group_out(spark, monkeypatch):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z" * 50)], "k string, o int, text string")
    whole = joins.assemble(df, ["k"], ["o"], separator="|")
    assert {tuple(r) for r in whole.collect()} == {("a", "y|x"), ("b", "z" * 50)}
    monkeypatch.setattr(joins, "MAX_TEXT_BYTES", 10)
    with pytest.raises(Exception, match="too large for one row: b"):
        joins.assemble(df, ["k"], ["o"], separator="|").collect()
