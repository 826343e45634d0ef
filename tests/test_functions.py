"""Golden cases of the column functions."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths, text
from corpusloom.operators import ignore


@pytest.mark.parametrize("rules, path, ignored", [
    (["*.log"], "a/b/x.log", True),
    (["build/"], "build/a", True),
    (["build/"], "build", True),
    (["build/"], "src/build/a", False),
    (["a/**"], "a", True),
    (["a/**"], "a/b/c", True),
    (["a/**"], "z/a/b", True),
    (["a/**"], "ab/c", False),
    (["**/*.json"], "x.json", True),
    (["**/*.json"], "p/q.json", True),
    (["*.py", "!keep.py"], "keep.py", True),
    (["!keep.py", "*.py"], "keep.py", False),
    (["!keep.py", "*.py"], "d/keep.py", False),
    (["!keep.py", "*.py"], "d/other.py", True),
    (["["], "[x", False),
    (["["], "[", True),
    (["*.lock"], "foo.lock/a.txt", False),
    (["**/x/"], "a/x/b", False),
    (["src/*.ts"], "lib/src/a.ts", True),
    (["src/*.ts"], "src/app/a.ts", False),
    (["!a", "!b", "*", "!c"], "b", False),
    (["!a", "!b", "*", "!c"], "c", True),
    ([".git/", "!.git/x", "*.x"], ".git/x", True),
    ([], "a", False),
])
def test_ignore_v1(spark, rules, path, ignored):
    literal = ignore.ignored_v1(F.lit(path), [rules])
    table = F.transform(F.array(*map(F.lit, rules)), lambda r: globs.path_rule_column(r)) if rules else None
    table = globs.rule_runs_column(table) if rules else None
    row = spark.range(1).select(literal.alias("a")).first()
    assert row["a"] is ignored
    if table is not None:
        by_row = spark.range(1).select(table.alias("r")).select(
            ignore.ignored_v1(F.lit(path), [F.col("r")]).alias("b")
        ).first()
        assert by_row["b"] is ignored


def test_ignore_v1_intended_matches_folders_at_any_level(values):
    def got(rule, path):
        return values(ignore.ignored_v1(F.lit(path), [[rule]], "intended"))

    assert got("dist/", "a/dist/b") and got("**/x/", "a/x/b") and not got("dist/", "a/distb")


def test_include_wins_only_under_intended(values):
    for compat, ignored in [("reference", True), ("intended", False)]:
        layers = ignore.layers_v1(["*.md"], ["keep.md"], compat=compat)
        assert values(ignore.ignored_v1(F.lit("keep.md"), layers, compat)) is ignored
    layers = ignore.layers_v1([], ["node_modules/keep.js"])
    assert values(ignore.ignored_v1(F.lit("node_modules/keep.js"), layers)) is False


@pytest.mark.parametrize("lines, path, is_dir, ignored", [
    (["*.log"], "a/x.log", False, True),
    (["build/"], "build", True, True),
    (["build/"], "build", False, False),
    (["build/"], "a/build", True, True),
    (["/build/"], "a/build", True, False),
    (["*.md", "!keep.md"], "keep.md", False, False),
    (["!keep.md", "*.md"], "keep.md", False, True),
    (["a/**/b"], "a/b", False, True),
    (["a/**/b"], "a/x/y/b", False, True),
    (["**/x"], "x", False, True),
    (["**/x"], "p/q/x", False, True),
    (["x/**"], "x/y", False, True),
    (["docs/*.md"], "docs/a.md", False, True),
    (["docs/*.md"], "p/docs/a.md", False, False),
    (["foo/bar"], "p/foo/bar", False, True),
    (["# c", "", "  "], "c", False, False),
    (["\\#x"], "#x", False, True),
    (["*.[oa]"], "l.a", False, True),
    (["*.[oa]"], "l.c", False, False),
    (["a+b"], "a+b", False, True),
    (["x\r"], "x", False, True),
])
def test_gitignore(spark, lines, path, is_dir, ignored):
    assert spark.range(1).select(
        ignore.ignored_gitignore(F.lit(path), is_dir, [lines])
    ).first()[0] is ignored
    rules = F.filter(
        F.transform(F.array(*map(F.lit, lines)), globs.gitignore_column), lambda r: r.isNotNull()
    )
    assert spark.range(1).select(globs.rule_runs_column(rules).alias("r")).select(
        ignore.ignored_gitignore(F.lit(path), is_dir, [F.col("r")])
    ).first()[0] is ignored


PATTERNS = [
    "*.log", "build/", "a/**", "**/*.json", "!keep.py", "*.py", "keep.py", "[", "[z-a]x", "[^a-c]?.t",
    "a\\*b", "c++", "{a,b}/*.ts", "src/*.ts", "[!a-z]*", "[abc]x", "**/x/", "/**/y", "docs/*.md",
    "a/**/b", "\\#x", "# c", "", "!build/k", "foo/bar", "[a-", "]x", "{a,{b,c}d}", "a{", "x,y", "[]a]",
    " sp ", "a\\", "[\\]]", "é[ä-ü]", "$^.|()", "x-y&&z~", "!!a", "a//b", "tab\there",
]


def test_column_and_plain_globs_agree(spark):
    rows = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select(
        "p", globs.path_glob_regex_column("p").alias("glob"),
        globs.path_rule_column("p").alias("rule"),
        globs.path_rule_column("p", "intended").alias("intended"),
        globs.gitignore_column("p").alias("git"),
        globs.rule_glob_regex_column("p").alias("standard"),
    ).collect()

    def anchored(pair):
        return None if pair is None else (rf"(?s)\A(?:{pair[0]})\z", pair[1])

    for row in rows:
        p = row["p"]
        assert row["glob"] == globs.path_glob_regex(p), p
        assert tuple(row["rule"])[:2] == anchored(globs.path_rule_regex(p)), p
        assert tuple(row["intended"])[:2] == anchored(globs.path_rule_regex(p, "intended")), p
        assert (row["git"] and tuple(row["git"])[:2]) == anchored(globs.gitignore_regex(p)), p
        assert row["standard"] == globs.rule_glob_regex(p), p


@pytest.mark.parametrize("pattern, hits, misses", [
    ("src/*.ts", ["src/app/x.ts", "src/x.ts"], ["lib/src/x.ts"]),
    ("{a,b}?", ["ax", "b/"], ["a", "cx"]),
    ("[!a-c]*", ["d", "zz"], ["a", "b1"]),
])
def test_rule_globs(values, pattern, hits, misses):
    regex = globs.rule_glob_regex(pattern)
    assert all(values(F.lit(p).rlike(regex)) for p in hits)
    assert not any(values(F.lit(p).rlike(regex)) for p in misses)


@pytest.mark.parametrize("path, lang", [
    ("A.TSX", "typescript"), ("x/Dockerfile", "dockerfile"), ("dockerfile", ""),
    ("a.dockerfile", "dockerfile"), ("Makefile", ""), ("x.txt", ""), ("a.b/c", ""),
])
def test_language(values, path, lang):
    assert values(paths.language(F.lit(path))) == lang


def test_path_facts(values):
    def facts(p):
        c = F.lit(p)
        return values(
            paths.base_name(c), paths.dir_name(c), paths.extension(c), paths.depth(c), paths.ancestors(c),
            paths.fence_hint(c),
        )

    assert facts("a/b/c.tar.gz") == ("c.tar.gz", "a/b", ".gz", 2, ["a", "a/b"], "gz")
    assert facts(".gitignore") == (".gitignore", ".", ".gitignore", 0, [], "gitignore")
    assert facts("x/Dockerfile") == ("Dockerfile", "x", "", 1, ["x"], "")
    assert facts("a.d/b") == ("b", "a.d", "", 1, ["a.d"], "")


def test_walk_order_differs_from_plain_order(spark):
    names = ["a/x", "a-b/x", "a.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    walk = [r["path"] for r in df.orderBy(paths.walk_key("path")).collect()]
    plain = [r["path"] for r in df.orderBy("path").collect()]
    assert walk == ["a/x", "a-b/x", "a.txt"]
    assert plain == ["a-b/x", "a.txt", "a/x"]


def test_relevant_docs(values):
    def got(p, compat="reference"):
        return values(paths.is_relevant_doc(F.lit(p), compat))

    assert got("README.md") and got("docs/x.rst") and got("docker/a.txt") and got(".github/a.md")
    assert not got("src/a.md") and not got("docs/a.MD")
    assert not got("docker/a.txt", "intended") and got("docs/api/a.txt", "intended")
    assert values(paths.is_markdown_path(F.lit("a/B.MD"))) and not values(paths.is_markdown_path(F.lit(".git/a.md")))


@pytest.mark.parametrize("content, v1, v1_intended", [
    (b"", True, True), (b"Rar notes", False, False), (b"GIF is a format", False, False),
    (b"a" * 1023 + "é".encode(), False, True), (b"\x01AB", False, False),
    (b"abcdefg\x01\x01\x01", True, True), (b"caf\xe9", False, False),
    (b"a" * 1023 + b"\xe9zz", False, True), (b"a" * 1022 + "€".encode() + b"x", False, True),
])
def test_text_check_v1(spark, content, v1, v1_intended):
    row = spark.createDataFrame([(bytearray(content),)], "c binary").select(
        text.is_text_v1("c"), text.is_text_v1("c", "intended")
    ).first()
    assert tuple(row) == (v1, v1_intended)


@pytest.mark.parametrize("path, content, expected", [
    ("x.PNG", b"plain", False), (".DS_Store", b"plain", True), ("x", b"\0\0x", True),
    ("x", b"\0\0\0x", False), ("x", b"", True), ("x", b"a" * 4095 + "é".encode(), False),
    ("x", b"\xfe\xffab", False),
])
def test_text_check_v2(spark, path, content, expected):
    row = spark.createDataFrame([(path, bytearray(content))], "p string, c binary").select(
        text.is_text_v2("p", "c")
    ).first()
    assert row[0] is expected


def test_text_check_v2_intended_matches_names(spark):
    row = spark.createDataFrame([("a/.DS_Store", bytearray(b"x"))], "p string, c binary").select(
        text.is_text_v2("p", "c", "intended")
    ).first()
    assert row[0] is False


@pytest.mark.parametrize("raw, expected", [
    (bytes.fromhex("636166E9"), "café"), (bytes.fromhex("636166C3A9"), "café"),
    (b"\xed\xa0\x80", "\xed\xa0\x80"), (b"", ""), (bytes(range(128, 256)), bytes(range(128, 256)).decode("latin-1")),
])
def test_decode(spark, raw, expected):
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(text.decode("c")).first()[0] == expected


@pytest.mark.parametrize("value, n, expected", [
    ("abcdef\nhij", 9, "abcdef..."), ("ab\ndefghij", 9, "ab\ndefghi..."), ("short", 9, "short"),
    ("éééééé", 5, "éé..."), ("123456789", 9, "123456789"),
])
def test_limit_text(values, value, n, expected):
    assert values(text.limit_text(F.lit(value), n)) == expected


@pytest.mark.parametrize("reply, editor, intended, general", [
    ("```json\n{}\n```", "on\n{}", "{}", "{}"),
    ("```markdown\nx\n```", "markdown\nx", "x", "x"),
    ("```typescript\nx\n```", "x", "x", "x"),
    ("```tsx\nx", "x", "x", "x"),
    ("```TS\nx\n```", "TS\nx", "x", "x"),
    ("　 plain \n", "plain", "plain", "plain"),
    ("x\n```", "x", "x", "x"),
    ("```", "", "", ""),
    ("```go run```", "go run", "", "run"),
    ("``````", "", "", ""),
])
def test_fences(values, reply, editor, intended, general):
    c = F.lit(reply)
    assert values(
        text.strip_fence_editor(c), text.strip_fence_editor(c, "intended"), text.strip_fence_general(c)
    ) == (editor, intended, general)


def test_trim_and_imports(values):
    assert values(text.trim(F.lit("\t  a b \x85\n"))) == "a b"
    code = "import a\n  import b\nexport * from 'c'\nimportant\nx import y"
    assert values(text.import_lines(F.lit(code))) == ["import a", "  import b", "export * from 'c'"]


def test_merged_rules_agree_with_single_rules(spark):
    """Random rule lists: one merged literal regex per run against rule by rule."""
    import random

    dice = random.Random(11)
    names = ["a", "b.x", ".c", "d~", "x.y", "build", ".", "é.x"]
    shapes = ["{}", "*{}", "{}/", "/{}", "**/{}", "{}/**", "!{}", "!*{}", "*.{}", "{}*", "a/{}", "!a/{}", "?{}", "**/*.{}", "!{}/", "a/**/{}"]
    all_paths = sorted({"/".join(dice.choice(names) for _ in range(dice.randint(1, 4))) for _ in range(60)})
    df = spark.createDataFrame([(p,) for p in all_paths], "path string").coalesce(1).cache()
    for _ in range(8):
        lists = [[dice.choice(shapes).format(dice.choice(names)) for _ in range(dice.randint(1, 12))] for _ in range(4)]
        columns = []
        for i, rules in enumerate(lists):
            v1 = globs.rule_runs_column(F.transform(F.array(*map(F.lit, rules)), lambda r: globs.path_rule_column(r)))
            git = globs.rule_runs_column(F.transform(F.array(*map(F.lit, rules)), lambda r: globs.gitignore_column(r)))
            columns += [
                ignore.ignored_v1("path", [rules]).alias(f"a{i}"), v1.alias(f"v{i}"),
                ignore.ignored_gitignore("path", False, [rules]).alias(f"c{i}"),
                ignore.ignored_gitignore("path", True, [rules]).alias(f"e{i}"), git.alias(f"g{i}"),
            ]
        tables = df.select("path", *columns)
        single = []
        for i in range(4):
            single += [
                f"a{i}", f"c{i}", f"e{i}",
                ignore.ignored_v1("path", [F.col(f"v{i}")]).alias(f"b{i}"),
                ignore.ignored_gitignore("path", False, [F.col(f"g{i}")]).alias(f"d{i}"),
                ignore.ignored_gitignore("path", True, [F.col(f"g{i}")]).alias(f"f{i}"),
            ]
        for row in tables.select("path", *single).collect():
            for i, rules in enumerate(lists):
                for merged, alone in ("ab", "cd", "ef"):
                    assert row[f"{merged}{i}"] == row[f"{alone}{i}"], (row["path"], rules, merged)


def test_rules_of_tables_without_regexes(spark):
    rules = ["*.log", "build/", "node_modules/**", "**/*.min.js", "name", "!a/**", "!**/*.json", "!keep", "a*b", "docs/*.md"]
    runs = globs.rule_runs_column(F.transform(F.array(*map(F.lit, rules)), lambda r: globs.path_rule_column(r)))
    found = spark.range(1).select(runs.alias("r")).first()["r"]
    assert [r["keep"] for r in found] == [False, True, False]
    assert [r["regex"] is None for r in found] == [True, True, False]
    assert len(found[0]["needles"]) == 7 and found[2]["needles"] == []


def test_own_rules_cost_little_more_than_literal_ones(spark):
    """200 000 files under 85 rules in a column, against the same rules as plan-time literals."""
    names = [f"name{i}" for i in range(85)]
    shapes = ["{}/", "*.{}", "{}", "{}/**", "**/*.{}"]
    rules = [shapes[i % 5].format(n) for i, n in enumerate(names)]
    files = spark.range(200_000).select(F.concat_ws(
        "/", F.concat(F.lit("top"), F.col("id") % 7), F.concat(F.lit("name"), F.col("id") % 5000),
        F.concat(F.lit("f"), F.col("id"), F.lit(".name"), F.col("id") % 900)).alias("path"))
    owned = spark.range(1).select(globs.rule_runs_column(
        F.transform(F.array(*map(F.lit, rules)), lambda r: globs.path_rule_column(r))).alias("runs"))
    owned = spark.createDataFrame(owned.collect(), owned.schema)
    literal = files.select(F.sum(ignore.ignored_v1("path", [rules]).cast("int")))
    own = files.join(F.broadcast(owned.withColumn("k", F.lit(1))), F.col("k") == F.length(F.substring("path", 1, 1)))
    own = own.select(F.sum(ignore.ignored_v1("path", [F.col("runs")]).cast("int")))
    seconds = {}
    for name, query in (("literal", literal), ("own", own)):
        results = []
        for _ in range(3):
            start = time.perf_counter()
            results.append(query.first()[0])
            seconds[name] = min(seconds.get(name, 99), time.perf_counter() - start)
    assert literal.first()[0] == own.first()[0] > 0
    print(seconds)
    assert seconds["own"] < 2 * seconds["literal"] + 1
