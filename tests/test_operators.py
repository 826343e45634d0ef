"""Diffs, rules, prompts, batches, outcomes, history and sources."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import batch, crawl, diffs, history, joins, outcomes, prompts, rules, trees
from corpusloom.plans import commits, replies
from corpusloom.sources import corpus, ignore_files, sinks, standards


# --- Diffs ------------------------------------------------------------------------------------------

def test_line_diff_is_positional(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, "a\nb", "b"), (3, "", "")], "id int, old string, new string")
    got = {}
    for r in diffs.line_diff(df, ["id"]).orderBy("id", "line_no").collect():
        got.setdefault(r["id"], []).append(r["op"] + r["line"])
    assert got == {1: [" a", "-b", "+c", "+d"], 2: ["-a", "+b", "-b"], 3: [" "]}


def test_line_diff_rebuilds_both_sides(spark):
    dice = random.Random(3)
    rows = [
        (i, *("\n".join(dice.choice("ab") for _ in range(dice.randint(1, 9))) for _ in range(2))) for i in range(50)
    ]
    ops = diffs.line_diff(spark.createDataFrame(rows, "id int, old string, new string"), ["id"]).collect()
    for i, old, new in rows:
        mine = sorted((r for r in ops if r["id"] == i), key=lambda r: r["line_no"])
        assert "\n".join(r["line"] for r in mine if r["op"] in " -") == old
        assert "\n".join(r["line"] for r in mine if r["op"] in " +") == new


def test_render_diff(values):
    assert values(diffs.render_diff(F.lit("a\nb"), F.lit("a\nc"))) == "  a\n- b\n+ c\n"
    assert values(diffs.render_diff(F.lit("b"), F.lit("c"), color=True)) == "\x1b[31m- b\x1b[0m\n\x1b[32m+ c\x1b[0m\n"


PATCH = """diff --git a/x/a.txt b/x/a.txt
index 1..2 100644
--- a/x/a.txt
+++ b/x/a.txt
@@ -1,2 +1,3 @@
 same
---- old
+++ new
+more
@@ -9 +10 @@ tail
-z
\\ No newline at end of file
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-bye
"""


def test_patch_numstat(spark):
    df = spark.createDataFrame([(1, PATCH), (2, PATCH.split("100644\n", 1)[1].split("diff --git")[0])], "id int, patch string")
    got = {tuple(r) for r in diffs.patch_numstat(df, ["id"]).collect()}
    assert got == {(1, "x/a.txt", 2, 2), (1, "gone", 0, 1), (2, "x/a.txt", 2, 2)}
    assert [r["path"] for r in diffs.patch_numstat(df.where("id = 1"), ["id"], path_filter="x").collect()] == ["x/a.txt"]


def test_patch_signature_and_header_like_lines_do_not_count(spark):
    patch = (
        "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
        "@@ -9 +9 @@ tail\n--- old\n+++ new\n\\ No newline at end of file\n-- \n2.40.0\n"
    )
    got = diffs.patch_numstat(spark.createDataFrame([(patch,)], "patch string"), [])
    assert [tuple(r) for r in got.collect()] == [("x", 2, 2)]


def test_snapshot_diff_of_unreadable_files_and_directories(spark):
    kinds = "repo string, path string, is_dir boolean, content string"
    old = spark.createDataFrame([("r", "d", True, None), ("r", "u", False, None), ("r", "x", False, "1"), ("r", "y", False, None)], kinds)
    new = spark.createDataFrame([("r", "e", True, None), ("r", "u", False, None), ("r", "x", False, None), ("r", "z", False, None)], kinds)
    got = {tuple(r) for r in diffs.snapshot_diff(old, new).collect()}
    assert got == {("r", "x", "unreadable"), ("r", "y", "deleted"), ("r", "z", "added")}


def test_working_set_drops_unreadable_files(spark):
    rows = [("r", "a.go", b"package a"), ("r", "b.go", None)]
    got = crawl.working_set(spark.createDataFrame(rows, "repo string, path string, content binary"))
    assert {r["path"]: r["drop_reason"] for r in got.collect()} == {"a.go": None, "b.go": "unreadable"}


def test_patch_without_hunks(spark):
    patch = (
        "diff --git a/o b/n\nsimilarity index 100%\nrename from o\nrename to n\n"
        "diff --git a/i.png b/i.png\nindex 1..2\nBinary files a/i.png and b/i.png differ\n"
        "diff --git a/s.sh b/s.sh\nold mode 100644\nnew mode 100755\n"
    )
    df = spark.createDataFrame([(patch,)], "patch string")
    got = {tuple(r) for r in diffs.patch_numstat(df, []).collect()}
    assert got == {("n", 0, 0), ("i.png", None, None), ("s.sh", 0, 0)}


def snapshot(spark, files):
    return spark.createDataFrame([(r, p, c) for r, p, c in files], "repo string, path string, content string")


def test_snapshot_diff_and_outcome(spark):
    old = snapshot(spark, [("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3"), ("q", "x", "1")])
    new = snapshot(spark, [("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4"), ("q", "x", "1")])
    changed = diffs.snapshot_diff(old, new)
    assert {tuple(r) for r in changed.collect()} == {("r", "b", "modified"), ("r", "c", "deleted"), ("r", "d", "added")}
    repos = old.select("repo").distinct()
    assert {tuple(r) for r in diffs.has_changes(repos, changed).collect()} == {("r", "changes"), ("q", "no changes")}


def test_commit_requests(spark):
    old = snapshot(spark, [("r", "a", "1"), ("r", "c", "3")])
    new = snapshot(spark, [("r", "a", "2")])
    row = commits.commit_requests(old, new).first()
    assert row["diff"] == "--- a\n- 1\n+ 2\n--- c\n- 3\n"
    assert row["context"] == "\n--- File: a ---\n2\n--- File (Deleted): c ---\n"
    assert "--- DIFF START ---\n" + row["diff"] + "\n--- DIFF END ---" in row["prompt"]
    assert row["context"] not in row["prompt"]
    intended = commits.commit_requests(old, new, compat="intended").first()
    assert row["context"] in intended["prompt"]


@pytest.mark.parametrize("compat", ["reference", "intended"])
def test_commit_sections_are_the_prompts(spark, compat):
    old = snapshot(spark, [("r", "a", "1"), ("r", "c", "3"), ("r", "s", "x"), ("q", "x", "1"), ("p", "y", "1")])
    new = snapshot(spark, [("r", "a", "2"), ("r", "s", "x"), ("q", "x", "b" * 300), ("q", "z", "é" * 100), ("p", "y", "1")])
    rows = commits.commit_sections(old, new, 200, compat)
    got = {}
    for r in sorted(rows.collect()):
        assert [*r.asDict()] == [*commits.SECTION_ORDER, "text"]
        got[r["repo"]] = got.get(r["repo"], "") + r["text"]
    want = {r["repo"]: r["prompt"] for r in commits.commit_requests(old, new, 200, compat).collect()}
    assert got == want and set(got) == {"q", "r"}


def test_referenced_prompts_resolve_to_the_whole_ones(spark):
    from corpusloom.operators import joins, prompts
    from workload import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["docs_prompt_refs"](spark, sf)
    refs, parts = rows.where("owner IS NOT NULL").drop("text"), rows.where("owner IS NULL").select("part", "text")
    got = joins.assemble(prompts.resolve_refs(refs, parts), ["owner"], ["seq", "key"]).collect()
    want = {f"doc/{r['doc_id']}": r["prompt"] for r in QUERIES["docs_prompts"](spark, sf).collect()}
    assert {r["owner"]: r["text"] for r in got} == want and len(want) > 5


def test_docs_prompts_have_the_diff_of_every_repository(spark):
    from workload import QUERIES, views

    rows = {r["doc_id"]: r["prompt"] for r in QUERIES["docs_prompts_diff"](spark, "/root/testdata/sf0.001").collect()}
    docs = views.corpus(spark, "/root/testdata/sf0.001").where("path LIKE '%.md'").collect()
    diffs_of = {r["repo"]: r["diff"] for r in commits.repo_diffs(*views.snapshots(spark, "/root/testdata/sf0.001")).collect()}
    assert {r["doc_id"] for r in docs} == set(rows) and any(int(r["repo"][3:]) % 5 == 0 for r in docs)
    assert all(diffs_of[r["repo"]] in rows[r["doc_id"]] and diffs_of[r["repo"]].startswith("--- ") for r in docs)
    old = snapshot(spark, [("r", "a", "1"), ("q", "x", "1")])
    new = snapshot(spark, [("r", "a", "2"), ("q", "x", "1")])
    got = prompts.attach_diff(new, commits.repo_diffs(old, new)).collect()
    assert {r["repo"]: r["diff"] for r in got} == {"r": "--- a\n- 1\n+ 2\n", "q": ""}


# --- Rules ------------------------------------------------------------------------------------------

CONFIG = {
    "version": 1,
    "llm_rules_general": [{"id": "g"}, {"id": "g", "applies_to": ["*.py"]}, {"id": "go", "language": "go"}, {"id": "bad", "applies_to": ["["]}],
    "languages": {"python": {"llm_rules": [{"id": "p"}, {"id": "p", "applies_to": ["src/*"]}, {"id": "g"}]}},
}


@pytest.mark.parametrize("only, want", [
    ([], [("general", "g"), ("general", "g"), ("language", "p")]),
    (["p", "go"], [("language", "p")]),
])
def test_applicable_rules(spark, only, want):
    files = spark.createDataFrame([("r", "src/app/x.py", "python")], "repo string, path string, lang string")
    plain = rules.applicable_rules(files, CONFIG, only).orderBy("ord").collect()
    text = spark.createDataFrame([("r", json.dumps(CONFIG))], "repo string, content string")
    table = text.select("repo", standards.parse_standards("content").alias("s")).select("repo", "s.*")
    by_repo = rules.applicable_rules_by_repo(files, table, only).orderBy("ord").collect()
    assert [(r["scope"], r["id"]) for r in plain] == want
    assert [tuple(r) for r in plain] == [tuple(r) for r in by_repo]


def test_standards_source(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({**CONFIG, "version": 2}, indent=1))
    (tmp_path / "t.json").write_text(json.dumps({"version": 1}))
    df = standards.read_standards(spark, str(tmp_path))
    flat = {(r["scope"], r["ord"], r["id"]) for r in rules.standards_flatten(df).collect()}
    assert flat == {
        ("general", 0, "g"), ("general", 1, "g"), ("general", 2, "go"), ("general", 3, "bad"),
        ("python", 0, "p"), ("python", 1, "p"), ("python", 2, "g"),
    }
    assert [r["warning"] for r in rules.standards_warnings(df).collect()] == [
        "Unsupported standards config version '2'. Expected version 1."
    ]


def test_nearest_config(spark):
    files = spark.createDataFrame(
        [("r", p) for p in ("x", "a/x", "a/b/x", "a/b/c/x", "ab/x")] + [("q", "a/x")], "repo string, path string"
    )
    configs = spark.createDataFrame([("r", "a/tsconfig.json"), ("r", "a/b/c/tsconfig.json")], "repo string, path string")
    got = {(r["repo"], r["path"]): r["config"] for r in rules.nearest_config(files, configs).collect()}
    assert got == {
        ("r", "x"): None, ("r", "a/x"): "a/tsconfig.json", ("r", "a/b/x"): "a/tsconfig.json",
        ("r", "a/b/c/x"): "a/b/c/tsconfig.json", ("r", "ab/x"): None, ("q", "a/x"): None,
    }


# --- Prompts and batches ----------------------------------------------------------------------------

def test_docs_prompt_forms(values):
    full = values(prompts.docs_prompt(F.lit("DOC"), F.lit("DIFF"), "GOAL"))
    assert "GOAL:\nGOAL\n" in full and "START ---\nDIFF\n" in full and "TARGET START ---\nDOC\n" in full
    shifted = values(prompts.docs_prompt(F.lit("DOC"), F.lit("DIFF"), compat="reference"))
    assert "GOAL:\nDIFF\n" in shifted and "CONTEXT START ---\nDOC\n" in shifted and "%!s(MISSING)" in shifted
    assert "--- PATCH REPLACE START ---" in values(prompts.docs_prompt(F.lit(""), F.lit(""), marker="PATCH"))


def test_refactor_goal_is_required(values):
    with pytest.raises(ValueError):
        prompts.file_prompt(F.lit("p"), F.lit("c"), F.lit(""), "")
    assert values(prompts.file_prompt(F.lit("p"), F.lit("c"), F.lit("d"), "g")) == "File: p\n\nContent:\nc\n\nChanges:\nd"
    assert values(prompts.file_prompt(F.lit("p"), F.lit("c"), F.lit("d"), "g", "intended")).startswith("g\n\nFile: p")


def test_model_routing(values):
    assert values(prompts.routed_model(F.lit("a"), F.lit("b"))) == "a"
    assert values(prompts.routed_model(F.lit(""), F.lit("b"))) == "b"
    assert values(prompts.routed_model(F.lit(None).cast("string"), F.lit(""))) == "gpt-4o"


def test_chat_requests_and_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "hi")], "request_id long, prompt string")
    request = prompts.chat_requests(df, model=F.lit("")).first()
    assert request["model"] == C.EMPTY_MODEL and request["max_tokens"] == 4096
    sinks.write_requests(prompts.request_json(prompts.chat_requests(df)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    body = json.loads(text)
    assert body["messages"][1] == {"role": "user", "content": "hi"} and body["temperature"] == 0.2


def test_generate_retries_and_cancels(spark, tmp_path):
    df = prompts.chat_requests(spark.range(4).select(F.col("id").alias("request_id"), F.lit("p").alias("prompt")))
    folder = str(tmp_path)

    def call(request):
        i = request["request_id"]
        mark = os.path.join(folder, str(i))
        with open(mark, "a") as f:
            f.write("x")
        if i == 1 and os.path.getsize(mark) < 3:
            raise RuntimeError("busy")
        if i == 2:
            raise batch.Cancelled("stop")
        return None if i == 3 else f"ok {i}"

    got = {r["request_id"]: tuple(r)[1:] for r in batch.generate(df, call, waits=(0.0,)).collect()}
    assert got == {0: ("ok 0", None, 1), 1: ("ok 1", None, 3), 2: (None, "cancelled: stop", 1), 3: (None, "no choices", 1)}


def test_generate_ends_hanging_calls(spark):
    df = prompts.chat_requests(spark.range(3).select(F.col("id").alias("request_id"), F.lit("p").alias("prompt")))

    def call(request):
        if request["request_id"] == 1:
            time.sleep(60)
        if request["request_id"] == 2:
            raise ValueError("bad")
        return "ok"

    def run(**options):
        return {r["request_id"]: tuple(r)[1:] for r in batch.generate(df, call, waits=(), only_timeouts=True, **options).collect()}

    start = time.monotonic()
    bad = (None, "failed after 1 attempts: ValueError: bad", 1)
    assert run(timeout=2.0, tries=2, calls=2) == {
        0: ("ok", None, 1), 1: (None, "failed after 2 attempts: TimeoutError: no reply within 2 s", 2), 2: bad}
    got = run(timeout=2.0, deadline=3.0, tries=9)
    assert got[0] == ("ok", None, 1) and got[2] == bad
    assert got[1][1].startswith("deadline exceeded after 2 attempts: TimeoutError")
    assert time.monotonic() - start < 50


def _stored_requests(spark, n):
    return prompts.chat_requests(spark.range(n).select(F.col("id").alias("request_id"), F.lit("p").alias("prompt")))


def _calls(folder):
    """How often each request was asked."""
    return {int(name): os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder)}


def test_generate_stored_stops_and_goes_on(spark, tmp_path):
    asked, store = str(tmp_path / "asked"), str(tmp_path / "store")
    os.mkdir(asked)
    requests = _stored_requests(spark, 60)

    def call(request):
        with open(os.path.join(asked, str(request["request_id"])), "a") as f:
            f.write("x")
        if len(os.listdir(asked)) >= 10:
            batch.stop(store)
        time.sleep(0.15)
        return f"ok {request['request_id']}"

    first = {r["request_id"] for r in batch.generate_stored(requests, call, store, parallelism=3, chunk=4).collect()}
    assert 10 <= len(first) < 60
    assert first == set(_calls(asked))  # every call that began was stored

    def plain(request):
        with open(os.path.join(asked, str(request["request_id"])), "a") as f:
            f.write("x")
        return f"ok {request['request_id']}"

    rows = batch.generate_stored(requests, plain, store, parallelism=3).collect()
    assert {r["request_id"]: r["response"] for r in rows} == {i: f"ok {i}" for i in range(60)}
    assert set(_calls(asked).values()) == {1}  # none was asked twice
    assert len(batch.generate_stored(requests, plain, store).collect()) == 60
    assert set(_calls(asked).values()) == {1}


def test_generate_stored_errors_again(spark, tmp_path):
    store = str(tmp_path / "store")
    requests = _stored_requests(spark, 4)
    empty = batch.generate_stored(requests.where("false"), lambda request: "ok", store)
    assert empty.count() == 0
    once = batch.generate_stored(requests, lambda request: "ok" if request["request_id"] else None, store)
    assert {r["request_id"]: r["error"] for r in once.collect()} == {0: "no choices", 1: None, 2: None, 3: None}
    kept = batch.generate_stored(requests, lambda request: "new", store).collect()
    assert {r["request_id"]: r["response"] for r in kept} == {0: None, 1: "ok", 2: "ok", 3: "ok"}
    again = batch.generate_stored(requests, lambda request: "new", store, again=True).collect()
    assert {r["request_id"]: (r["response"], r["error"]) for r in again} == {
        0: ("new", None), 1: ("ok", None), 2: ("ok", None), 3: ("ok", None)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_is_a_join(spark, how, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 0)
    many = spark.range(2000).select(
        F.when(F.col("id") % 10 < 6, F.lit("hot")).when(F.col("id") % 10 == 6, F.lit(None)).when(F.col("id") % 10 == 7, F.lit("warm"))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.col("id").alias("row"),
    )
    one = spark.createDataFrame([("hot", 1), ("k5", 2), (None, 3), ("none", 4), ("warm", 5)], "k string, v int")
    got = joins.balanced_join(many, one, ["k"], ["row"], how, parts=5)
    expected = many.join(one, ["k"], how)
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert joins.balanced_join(many.where("false"), one, ["k"], ["row"], how).count() == 0


@pytest.fixture
def shuffled_joins(spark, monkeypatch):
    """Joins as they are on tables too large to broadcast, with partitions left as they fall."""
    monkeypatch.setattr(joins, "HOT_ROWS", 1000)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_balanced_join_splits_a_hot_key(spark, shuffled_joins):
    many = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    one = spark.range(40_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    assert _largest_share(many.join(one, ["k"])) > 0.9
    assert _largest_share(joins.balanced_join(many, one, ["k"], ["row"])) < 0.25


def test_attach_diff_splits_a_repository_with_few_documents(spark, shuffled_joins):
    docs = spark.range(600).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("repo"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("path"))
    diffs_of = docs.select("repo").distinct().select("repo", F.concat(F.lit("diff of "), F.col("repo")).alias("diff"))
    got = prompts.attach_diff(docs, diffs_of)
    assert _largest_share(got) < 0.25
    rows = [tuple(r) for r in got.select("repo", "path", "diff").collect()]
    assert len(rows) == len(set(rows)) == 600 and all(d == f"diff of {r}" for r, _, d in rows)


@pytest.mark.parametrize("name", ["docs_prompts", "docs_prompts_diff"])
def test_writers_look_at_wide_prompts_before_a_hundred_rows(spark, tmp_path, name):
    import pyarrow.parquet as pq

    from workload import QUERIES

    QUERIES[name](spark, "/root/testdata/sf0.001")
    wide = spark.range(40).repartition(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2(F.concat(F.col("id"), i), 256)), "").alias("text"))
    wide.write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "wide"))
    part, = (tmp_path / "wide").glob("*.parquet")
    assert pq.ParquetFile(part).num_row_groups > 1
    spark.conf.unset("parquet.page.size.row.check.min")


def test_a_wide_row_is_copied_for_tasks_at_once_and_not_for_partitions(spark, shuffled_joins):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    docs = spark.range(6400).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 70)).alias("repo"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("path"))
    diffs_of = docs.select("repo").distinct().select("repo", F.concat(F.lit("diff of "), F.col("repo")).alias("diff"))
    got = joins.wide_join(docs, diffs_of, ["repo"], ["path"], [F.col("path")], slots=4)
    placed = got.groupBy("repo", F.spark_partition_id().alias("p")).count().collect()
    hot = {r["p"]: r["count"] for r in placed if r["repo"] == "hot"}
    assert len(hot) == 8 and max(hot.values()) < 6400 * 0.15  # two for each slot's share, none in the same task
    assert not hot.keys() & {r["p"] for r in placed if r["repo"] != "hot"}
    assert got.where("diff = 'diff of ' || repo").count() == 6400 and len(prompts.attach_diff(docs, diffs_of).columns) == 3


@pytest.mark.parametrize("hot", [True, False])
def test_wide_join_is_a_left_join(spark, hot):
    keys = ["a"] * (30 if hot else 3) + ["b", "c", "d", "e", "f", "g", None, None]
    many = spark.createDataFrame([*enumerate(keys), (0, keys[0])], "row long, k string")  # one row comes twice
    one = spark.createDataFrame([("a", "x"), ("c", None), ("z", "y"), (None, "n")], "k string, v string")
    rows = lambda df: sorted(map(str, df.select("row", "k", "v").collect()))
    got = joins.wide_join(many, one, ["k"], ["row"], [F.col("row").desc()], slots=3)
    assert rows(got) == rows(many.join(one, ["k"], "left")) and len(rows(got)) == len(keys) + 1
    assert got.columns == many.join(one, ["k"], "left").columns
    assert joins.wide_join(many.where("false"), one, ["k"], ["row"], []).count() == 0


@pytest.mark.parametrize("name", ["docs_prompts", "docs_prompts_diff"])
def test_written_prompts_share_the_diff_of_their_repository(spark, tmp_path, name):
    import hashlib

    import pyarrow.parquet as pq

    from workload import QUERIES

    def text(i: int) -> str:
        return "\n".join(hashlib.sha256(f"{i} {line}".encode()).hexdigest() for line in range(20))

    ids = [200 * block + i for block in range(5) for i in range(20)]
    docs = spark.createDataFrame([(i, text(i), "en", "src1") for i in ids], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {k: spark.conf.get(k, None) for k in (
        "parquet.writer.version", "parquet.page.size", "parquet.block.size", "parquet.page.size.row.check.min",
        *(f"parquet.{x}#{c}" for x in ("enable.dictionary", "column.statistics.enabled") for c in ("prompt", "shifted_prompt")))}
    try:
        got = QUERIES[name](spark, str(tmp_path))
        rows = sorted(tuple(r) for r in got.collect())
        got.write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r[0] for r in rows] == ids and all(len(r[1]) > 50_000 and len(r[2]) > 50_000 for r in rows)
    files = [*(tmp_path / "out").glob("*.parquet")]
    assert sum(f.stat().st_size for f in files) < sum(len(p) + len(s) for _, p, s in rows) / 5
    assert sorted(tuple(x.values()) for f in files for x in pq.read_table(f).to_pylist()) == rows
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows


def test_nearest_config_and_tree_with_a_hot_folder(spark, shuffled_joins):
    where = F.when(F.col("id") % 10 < 9, F.concat(F.lit("src/d"), (F.col("id") % 500).cast("string"))).otherwise(F.lit("lib"))
    files = spark.range(5000).select(
        F.lit("r").alias("repo"), F.concat(where, F.lit("/f"), F.col("id").cast("string")).alias("path"))
    configs = spark.createDataFrame([("r", "src/tsconfig.json"), ("r", "src/d7/tsconfig.json")], "repo string, path string")
    got = rules.nearest_config(files, configs)
    assert {(r["folder"], r["config"]) for r in got.select(F.substring_index("path", "/f", 1).alias("folder"), "config").distinct().collect()} == (
        {("lib", None), ("src/d7", "src/d7/tsconfig.json")}
        | {(f"src/d{i}", "src/tsconfig.json") for i in range(500) if i % 10 < 9 and i != 7})
    flat = spark.range(20_000).select(
        F.lit("r").alias("repo"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"))
    assert _largest_share(rules.nearest_config(flat, configs)) < 0.25
    nodes = crawl.directories(files).withColumn("is_dir", F.lit(True)).unionByName(files.withColumn("is_dir", F.lit(False)))
    rows = {r["key"]: r["text"] for r in trees.file_tree_v2(nodes, files).collect()}
    assert len(rows) == 5000 + 452 + 1
    assert rows[max(rows)].startswith("    ") and sum("└── " in text for text in rows.values()) == 1 + 450 + 1 + 1


def test_net_change_by_commits(spark):
    rows = [
        ("r", 5, "a", "1", False), ("r", 1, "a", "2", False),  # changed
        ("r", 5, "b", "1", False), ("r", 2, "b", "2", False), ("r", 1, "b", "1", False),  # and changed back
        ("r", 5, "c", "1", False), ("r", 2, "c", None, True),  # deleted
        ("r", 2, "d", "1", False), ("r", 1, "d", None, True),  # came and went
        ("r", 2, "e", "1", False), ("r", 3, "f", "1", False), ("s", 1, "g", "1", False),
    ]
    df = spark.createDataFrame(rows, "repo string, commit_no long, path string, content string, is_deleted boolean")
    got = {tuple(r) for r in history.net_change(df, 2).collect()}
    assert got == {("r", "a", "modified"), ("r", "c", "deleted"), ("r", "e", "added"), ("s", "g", "added")}
    assert ("r", "f", "added") in {tuple(r) for r in history.net_change(df.drop("is_deleted"), 3).collect()}


def test_map_files(spark):
    files = spark.createDataFrame([("r", "p", "go", "abc")], "repo string, path string, lang string, content string")
    out = batch.map_files(files, lambda repo, path, lang, content: f"{repo}/{path}:{lang}:{len(content)}")
    assert out.first()["result"] == "r/p:go:3"


# --- Outcomes ----------------------------------------------------------------------------------------

def test_outcomes(values):
    assert tuple(values(outcomes.doc_update(F.lit(" NO_UPDATE_NEEDED\n")))) == (False, "")
    assert tuple(values(outcomes.doc_update(F.lit("")))) == (False, "")
    assert tuple(values(outcomes.doc_update(F.lit(" x ")))) == (True, "x")
    assert values(outcomes.is_no_change(F.lit("123456789"), F.lit("o"))) is True
    assert values(outcomes.is_no_change(F.lit("No Changes Needed."), F.lit("o"))) is True
    assert values(outcomes.is_no_change(F.lit("0123456789"), F.lit("o"))) is False


@pytest.mark.parametrize("lang, reply, error, proposal, confirmed, flags, status", [
    ("go", None, None, None, None, {}, "not_markdown"),
    ("markdown", None, "boom", None, None, {}, "error"),
    ("markdown", " NO_UPDATE_NEEDED ", None, "x", True, {}, "no_update"),
    ("markdown", "", None, "", True, {}, "processed"),
    ("markdown", "x", None, "x", True, {}, "changed"),
    ("markdown", "x", None, "x", None, {}, "skipped"),
    ("markdown", "x", None, "x", False, {"force": True}, "changed"),
    ("markdown", "x", None, "x", False, {"dry_run": True}, "changed"),
])
def test_docs_status(values, lang, reply, error, proposal, confirmed, flags, status):
    text = [F.lit(v).cast("string") for v in (lang, reply, error, proposal)]
    assert values(outcomes.docs_status(*text, F.lit(confirmed).cast("boolean"), **flags)) == status


def test_reply_pipeline_keeps_documents_without_anchor(spark):
    files = spark.createDataFrame([("r", "a.md", "body", 1, "markdown", True)], "repo string, path string, content string, request_id long, lang string, confirmed boolean")
    edit = "--- EDIT DELETE START ---\n<<< CONTENT >>>\nnowhere\n--- EDIT DELETE END ---"
    responses = spark.createDataFrame([(1, edit, None)], "request_id long, response string, error string")
    row = replies.docs_pipeline(files, responses).first()
    assert (row["status"], row["new_content"]) == ("changed", "body")
    changes = replies.outcome_diffs(replies.docs_pipeline(files, responses)).collect()
    assert [(r["op"], r["line"]) for r in changes] == [(" ", "body")]


# --- History ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def log(spark):
    dice = random.Random(5)
    rows = []
    for i in range(800):
        repo = "hot" if i % 3 else f"r{dice.randint(0, 5)}"
        rows.append((repo, dice.randint(0, 400) * 600, i, f"s{i}", dice.random() < 0.05))
    df = spark.createDataFrame(rows, "repo string, t long, event_id long, subject string, is_tag boolean")
    return rows, df.withColumn("ts", F.timestamp_seconds("t"))


def test_last_n_commits(log):
    rows, df = log
    for parts in (1, 16):
        got = {}
        for r in history.last_n_commits(df, 7, parts).collect():
            got.setdefault(r["repo"], {})[r["commit_no"]] = r["event_id"]
        for repo in {r[0] for r in rows}:
            newest = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1], r[2]), reverse=True)[:7]
            assert got[repo] == {i + 1: r[2] for i, r in enumerate(newest)}


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_changelog(log, buckets):
    rows, df = log
    got = {(r["repo"], r["event_id"]): r["version"] for r in history.changelog(df, buckets).collect()}
    assert len(got) == len(rows)
    for repo in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1], r[2]))
        version = None
        for r in reversed(mine):
            version = f"v{r[2]}" if r[4] else version
            assert got[repo, r[2]] == version


def test_changelog_headers(log):
    _, df = log
    lines = history.changelog(df)
    headers = history.changelog_headers(lines).collect()
    assert len(headers) == lines.where("version is not null").select("repo", "version").distinct().count()
    assert all(r["header"].startswith(f"## {r['version']} (1970-01-0") for r in headers)


# --- Sources -------------------------------------------------------------------------------------------

@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "repo"
    for path, content in {
        ".gitignore": b"*.log\n", "_pkg/__init__.py": b"", ".cache/x": b"1", "a/b/c.txt": b"caf\xe9", "z": b"\0",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "empty").mkdir()
    return str(root)


def test_read_directories_keeps_everything(spark, folder):
    roots = spark.createDataFrame([("r", folder), ("gone", folder + "-none")], "repo string, root string")
    rows = corpus.read_directories(roots).collect()
    files = {r["path"]: bytes(r["content"]) for r in rows if r["repo"] == "r" and not r["is_dir"]}
    assert files == {
        ".gitignore": b"*.log\n", "_pkg/__init__.py": b"", ".cache/x": b"1", "a/b/c.txt": b"caf\xe9", "z": b"\0",
    }
    assert {r["path"] for r in rows if r["repo"] == "r" and r["is_dir"]} == {"_pkg", ".cache", "a", "a/b", "empty"}
    assert all(r["error"] for r in rows if r["repo"] == "gone")


def test_read_directories_deals_one_deep_folder(spark, tmp_path):
    expected, folders = {}, set()
    for i in range(40):
        below = "/".join(["all", "in", "here", f"d{i}", *(f"e{k}" for k in range(i % 7))])
        os.makedirs(tmp_path / below)
        folders |= {"/".join(below.split("/")[:k + 1]) for k in range(below.count("/") + 1)}
        for name in ("x", ".y"):
            (tmp_path / below / name).write_bytes(b"%d" % i)
            expected[f"{below}/{name}"] = b"%d" % i
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    found = corpus.read_directories(roots, 4).withColumn("task", F.spark_partition_id()).collect()
    assert {r["path"]: bytes(r["content"]) for r in found if not r["is_dir"]} == expected
    assert len(found) == len(expected) + len(folders) and {r["path"] for r in found if r["is_dir"]} == folders
    assert len({r["task"] for r in found}) == 4


def test_read_directories_reports_what_it_cannot_read(spark, folder, monkeypatch, tmp_path):
    paths = ["a", "a/b", "a/b/c"]
    rows = list(corpus._listed(iter([("r", str(tmp_path), "none", True, None, True)]), True))
    assert len(rows) == 1 and rows[0][2] == "none" and rows[0][4] and not rows[0][5]
    os.makedirs(tmp_path / paths[-1])
    real = os.scandir

    def scandir(path):
        if str(path).endswith("a/b"):
            raise PermissionError("closed")
        return real(path)

    monkeypatch.setattr(corpus.os, "scandir", scandir)
    rows = list(corpus._listed(iter([("r", str(tmp_path), "a", True, None, True)]), True))
    assert [(r[2], r[4]) for r in rows] == [("a", None), ("a/b", "closed")]


def test_read_binary_files(spark, folder):
    rows = {r["path"] for r in corpus.read_binary_files(spark, folder, "r").collect()}
    assert rows == {"a/b/c.txt", "z"}  # what Spark's own source leaves


def test_corpus_round_trip(spark, folder, tmp_path):
    roots = spark.createDataFrame([("r", folder)], "repo string, root string")
    out = str(tmp_path / "corpus")
    corpus.read_directories(roots).drop("error").write.parquet(out)
    back = corpus.read_corpus(spark, out)
    assert back.count() == 10
    rules_found = ignore_files.ignore_rules(back).collect()
    assert [(r["layer"], r["ord"], r["pattern"]) for r in rules_found] == [(0, 0, "*.log")]
    plan = back.where("path = 'z'").select("repo")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(path), EqualTo(path,z)]" in plan
    assert "content" not in plan.split("ReadSchema:")[1]


def test_rule_layers_flags(spark):
    df = spark.createDataFrame([("r", ".gitignore", "a\n#b\n\n c "), ("r", "x", "")], "repo string, path string, content string")
    rows = ignore_files.rule_layers(df, ["e"], ["i"], no_packignore=True).orderBy("layer", "ord").collect()
    assert [r["pattern"] for r in rows] == ["a", "c", "e", "!i", *C.ALWAYS_RULES_V1]
    rows = ignore_files.rule_layers(df, no_gitignore=True).where("layer < 2").collect()
    assert len(rows) == len(C.DEFAULT_RULES_V1)
