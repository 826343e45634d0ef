"""Queries on sources, paths, contents and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import globs, paths, text
from corpusloom.operators import crawl, ignore
from corpusloom.operators.crawl import CrawlOptions
from corpusloom.operators.diffs import snapshot_diff
from corpusloom.sources import corpus as corpus_source
from corpusloom.sources import ignore_files
from workload import views as V
from workload.registry import query

CORPUS = V.CORPUS

# Plan-time rules of the verdict queries.
RULES = ["*.log", "build/", "*.min.js", "!src/app/*.json", "**/*.json", "node_modules/**"]
# The action of the first matching rule, by hand.
RULES_CASE = r"""CASE
  WHEN regexp_matches(path, '\.log$') THEN 'drop'
  WHEN path = 'build' OR starts_with(path, 'build/') THEN 'drop'
  WHEN regexp_matches(path, '\.min\.js$') THEN 'drop'
  WHEN regexp_full_match(path, 'src/app/[^/]*\.json') THEN 'keep'
  WHEN ends_with(path, '.json') THEN 'drop'
  WHEN regexp_matches(path, '(^|/)node_modules(/.*)?$') THEN 'drop' ELSE 'none' END"""

GIT_LINES = ["*.log", "build/", "**/x/", "/docs/*.md", "!/docs/en_*.md", "lib/**", ".cache/"]
GIT_CASE = r"""CASE
  WHEN regexp_matches(p, '(^|/)\.cache/') THEN 'drop'
  WHEN regexp_matches(p, '(^|/)lib(/.*)?$') THEN 'drop'
  WHEN regexp_matches(p, '^docs/en_[^/]*\.md(/.*)?$') THEN 'keep'
  WHEN regexp_matches(p, '^docs/[^/]*\.md(/.*)?$') THEN 'drop'
  WHEN regexp_matches(p, '(^|/)x/') THEN 'drop'
  WHEN regexp_matches(p, '(^|/)build/') THEN 'drop'
  WHEN regexp_matches(p, '(^|/)[^/]*\.log(/.*)?$') THEN 'drop' ELSE 'none' END"""


@query("corpus_scan", V.with_ctes(
    "SELECT repo, path, strlen(content) AS n_bytes, replace(path, '/', chr(0)) AS walk_key FROM corpus", CORPUS))
def corpus_scan(spark, sf_dir):
    scanned = corpus_source.corpus_scan(V.corpus(spark, sf_dir))
    return scanned.select("repo", "path", text.n_bytes("content").alias("n_bytes"), "walk_key")


@query("decode_text", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text
  ELSE regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g') END AS decoded FROM documents""")
def decode_text(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(latin)
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", text.decode("raw").alias("decoded"))


@query("ignore_rules", V.with_ctes(f"""
SELECT repo, CASE WHEN path = '.gitignore' THEN 0 ELSE 1 END AS layer,
  row_number() OVER (PARTITION BY repo ORDER BY pos) - 1 AS ord, pattern
FROM (SELECT repo, path, pos, {V.trim_sql('line')} AS pattern FROM lines) l
WHERE pattern <> '' AND NOT starts_with(pattern, '#')""",
    V.IGNORE_DOCS,
    V.doc_lines_sql("lines", "(SELECT * FROM ignore_docs WHERE path <> 'README.md') i", "content", "repo, path")))
def ignore_rules(spark, sf_dir):
    return ignore_files.ignore_rules(V.ignore_docs(spark, sf_dir))


@query("default_rules", V.with_ctes(
    "SELECT repo, 1 AS layer, ord, pattern FROM ignore_docs CROSS JOIN defaults WHERE path <> '.llmignore'",
    V.IGNORE_DOCS, V.values_sql("defaults", "pattern", C.DEFAULT_RULES_V1, ordinal=True)))
def default_rules(spark, sf_dir):
    return ignore_files.default_rules(V.ignore_docs(spark, sf_dir))


RULE_LAYERS_SQL = f"""
SELECT repo, layer, ord, pattern FROM (
  SELECT repo, CASE WHEN path = '.gitignore' THEN 0 ELSE 1 END AS layer,
    row_number() OVER (PARTITION BY repo, path ORDER BY pos) - 1 AS ord, pattern
  FROM (SELECT repo, path, pos, {V.trim_sql('line')} AS pattern FROM lines) l
  WHERE pattern <> '' AND NOT starts_with(pattern, '#'))
UNION ALL SELECT repo, 1, ord, pattern FROM repos CROSS JOIN defaults WHERE n % 4 <> 1
UNION ALL SELECT repo, 2, ord, pattern FROM repos CROSS JOIN ex
UNION ALL SELECT repo, 3, ord, '!' || pattern FROM repos CROSS JOIN inc
UNION ALL SELECT repo, 4, ord, pattern FROM repos CROSS JOIN always"""


@query("rule_layers", V.with_ctes(
    RULE_LAYERS_SQL, CORPUS, V.ENTRIES,
    V.doc_lines_sql("lines", "(SELECT * FROM entries WHERE path IN ('.gitignore', '.llmignore')) i", "content", "repo, path"),
    V.values_sql("defaults", "pattern", C.DEFAULT_RULES_V1, ordinal=True),
    V.values_sql("ex", "pattern", ["*.txt", "internal/"], ordinal=True),
    V.values_sql("inc", "pattern", ["keep/*.md"], ordinal=True),
    V.values_sql("always", "pattern", C.ALWAYS_RULES_V1, ordinal=True)))
def rule_layers(spark, sf_dir):
    return ignore_files.rule_layers(
        V.entries(spark, sf_dir), excludes=["*.txt", "internal/"], includes=["keep/*.md"]
    )


@query("path_facts", V.with_ctes(
    "SELECT doc_id, base, dir, ext, len(names) - 1 AS depth, len(names) AS parts FROM paths", CORPUS, V.PATHS))
def path_facts(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "doc_id", paths.base_name("path").alias("base"), paths.dir_name("path").alias("dir"),
        paths.extension("path").alias("ext"), paths.depth("path").alias("depth"),
        F.size(paths.parts("path")).alias("parts"),
    )


def _languages_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGES.items())
    return f"languages(key, lang) AS (VALUES {rows})"


LANG = """langs AS (
SELECT p.*, COALESCE(a.lang, b.lang, '') AS lang FROM paths p
LEFT JOIN languages a ON a.key = lower(p.ext) LEFT JOIN languages b ON b.key = p.base)"""
LANG_CTES = (CORPUS, V.PATHS, _languages_sql(), LANG)


@query("language_detect", V.with_ctes("SELECT doc_id, path, lang FROM langs", *LANG_CTES))
def language_detect(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("doc_id", "path", paths.language("path").alias("lang"))


@query("language_counts", V.with_ctes(
    "SELECT repo, lang, count(*) AS files, sum(strlen(content)) AS bytes FROM langs GROUP BY repo, lang", *LANG_CTES))
def language_counts(spark, sf_dir):
    return (
        V.corpus(spark, sf_dir)
        .select("repo", paths.language("path").alias("lang"), text.n_bytes("content").alias("n"))
        .groupBy("repo", "lang")
        .agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))
    )


def text_v1_sql(content: str) -> str:
    """Text check v1 of a valid text: the prefix is invalid when it cuts a character."""
    h = f"hex(encode({content}))"
    head = f"TRY(decode(unhex(substr({h}, 1, 2048))))"
    controls = f"(strlen({head}) - strlen(regexp_replace({head}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')))"
    signatures = ", ".join(f"'{s}'" for s in C.BINARY_SIGNATURES)
    return f"""CASE WHEN {content} = '' THEN true
  WHEN substr({h}, 2049, 1) IN ('8', '9', 'A', 'B') THEN false
  WHEN substr({h}, 1, 6) IN ({signatures}) THEN false
  ELSE {controls} <= 0.3 * least(strlen({content}), 1024) END"""


@query("text_check_v1", V.with_ctes(
    f"SELECT doc_id, {text_v1_sql('content')} AS is_text FROM corpus", CORPUS))
def text_check_v1(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("doc_id", text.is_text_v1("content").alias("is_text"))


def text_v2_sql(content: str, ext: str) -> str:
    h = f"hex(encode({content}))"
    names = ", ".join(f"'{e}'" for e in C.BINARY_EXTENSIONS)
    return f"""CASE WHEN lower({ext}) IN ({names}) THEN false
  WHEN substr({h}, 8193, 1) IN ('8', '9', 'A', 'B') THEN false
  ELSE len(string_split({content}, chr(0))) - 1 <= 2 END"""


@query("text_check_v2", V.with_ctes(
    f"SELECT doc_id, {text_v2_sql('content', 'ext')} AS is_text FROM paths", CORPUS, V.PATHS))
def text_check_v2(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("doc_id", text.is_text_v2("path", "content").alias("is_text"))


IMPORTS = "import_docs AS (SELECT doc_id, replace(replace(text, '. ', chr(10) || '  import '), ', ', chr(10) || 'export * from ') AS code FROM documents)"


def import_docs(spark, sf_dir):
    code = F.replace(F.col("text"), F.lit(". "), F.lit("\n  import "))
    code = F.replace(code, F.lit(", "), F.lit("\nexport * from "))
    return V.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


@query("import_lines", V.with_ctes(f"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no FROM lines
  WHERE starts_with({V.trim_sql('line')}, 'import ') OR starts_with({V.trim_sql('line')}, 'export * from')) l""",
    IMPORTS, V.doc_lines_sql("lines", "import_docs", "code", "doc_id")))
def import_lines(spark, sf_dir):
    return import_docs(spark, sf_dir).select(
        "doc_id", F.posexplode(text.import_lines("code")).alias("line_no", "line")
    )


@query("tool_assignment", V.with_ctes("""
SELECT doc_id, lang,
  CASE WHEN lang IN ('javascript', 'typescript', 'jsx', 'tsx') THEN 'prettier' WHEN lang = 'go' THEN 'gofmt' WHEN lang = 'python' THEN 'black' END AS formatter,
  CASE WHEN lang IN ('javascript', 'typescript', 'jsx', 'tsx') THEN 'eslint' WHEN lang = 'python' THEN 'isort' END AS linter
FROM langs""", *LANG_CTES))
def tool_assignment(spark, sf_dir):
    return V.corpus(spark, sf_dir).withColumn("lang", paths.language("path")).select(
        "doc_id", "lang", paths.formatter("lang").alias("formatter"), paths.linter("lang").alias("linter")
    )


GLOBS = {
    "src/*": r"src/[^/]*", "src/*/*": r"src/[^/]*/[^/]*", "*/??_1*.md": r"[^/]*/[^/][^/]_1[^/]*\.md",
    "docs/[a-e]*": r"docs/[a-e][^/]*", "docs/[^a-e]*": r"docs/[^a-e][^/]*", "build/*_?.*": r"build/[^/]*_[^/]\.[^/]*",
    "*/*\\.json": r"[^/]*/[^/]*\.json", "[": "[^\\s\\S]", "src/[z-a]*": "[^\\s\\S]",
}


@query("glob_match", V.with_ctes(
    "SELECT doc_id, g.pattern FROM corpus JOIN globs g ON regexp_full_match(path, g.regex)",
    CORPUS, "globs(pattern, regex) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, r in GLOBS.items()) + ")"))
def glob_match(spark, sf_dir):
    path = F.col("path")
    hits = []
    for pattern in GLOBS:
        regex = globs.path_glob_regex(pattern)
        if regex is not None:
            hits.append(F.when(path.rlike(rf"(?s)\A{regex}\z"), F.lit(pattern)))
    return V.corpus(spark, sf_dir).select(
        "doc_id", F.explode(F.array_compact(F.array(*hits))).alias("pattern")
    )


@query("ignore_verdict", V.with_ctes(
    f"SELECT doc_id, path, {RULES_CASE} = 'drop' AS ignored FROM corpus", CORPUS))
def ignore_verdict(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "doc_id", "path", ignore.ignored_v1("path", [RULES]).alias("ignored")
    )


# Rules of each repository's own files; a repository without a pack file takes the defaults.
OWN_RULES = ", ".join([
    V.values_sql("defaults", "pattern", C.DEFAULT_RULES_V1),
    """rules AS (
SELECT repo, 0 AS layer, pattern FROM repos CROSS JOIN (VALUES ('*.json'), ('docs/api/')) g(pattern) WHERE n % 3 = 0
UNION ALL SELECT repo, 1, pattern FROM repos CROSS JOIN (VALUES ('src/'), ('*.md'), ('lib/**')) g(pattern) WHERE n % 4 = 1
UNION ALL SELECT repo, 1, pattern FROM repos CROSS JOIN defaults WHERE n % 4 <> 1
UNION ALL SELECT repo, 2, pattern FROM repos CROSS JOIN (VALUES ('.git/'), ('.git/**'), ('node_modules/'), ('node_modules/**')) g(pattern))""",
])


def rule_drops_sql(path: str, base: str, pattern: str) -> str:
    """Whether one drop rule of the kinds above matches a path (pack v1)."""
    d = f"left({pattern}, length({pattern}) - 1)"
    s = f"left({pattern}, length({pattern}) - 3)"
    return f"""CASE WHEN ends_with({pattern}, '/') THEN {path} = {d} OR starts_with({path}, {pattern})
  WHEN ends_with({pattern}, '/**') THEN contains('/' || {path} || '/', '/' || {s} || '/')
  ELSE {base} GLOB {pattern} OR {base} = {pattern} END"""


ENTRY_PATHS = "entry_paths AS (SELECT *, string_split(path, '/') AS names, list_extract(string_split(path, '/'), -1) AS base FROM entries)"


@query("ignore_verdict_by_repo", V.with_ctes(f"""
SELECT e.repo, e.path, bool_or({rule_drops_sql('e.path', 'e.base', 'r.pattern')}) AS ignored
FROM entry_paths e JOIN rules r ON r.repo = e.repo GROUP BY e.repo, e.path""",
    CORPUS, V.ENTRIES, OWN_RULES, ENTRY_PATHS))
def ignore_verdict_by_repo(spark, sf_dir):
    entries = V.entries(spark, sf_dir)
    rules = ignore_files.repo_rules(entries)
    attached = ignore.rule_lookup(rules)(entries.select("repo", "path"))
    layers = [
        F.col("git_rules"), ignore.own_or_default(F.col("pack_rules"), C.DEFAULT_RULES_V1),
        C.ALWAYS_RULES_V1,
    ]
    return attached.select("repo", "path", ignore.ignored_v1("path", layers).alias("ignored"))


V2_CASE = f"""(({GIT_CASE}) = 'drop' OR regexp_matches(p, '(^|/)[^/]*\\.min\\.js(/.*)?$'))
  AND NOT regexp_matches(p, '^src/[^/]*\\.min\\.js(/.*)?$')"""
V2_ARGS = {"excludes": ["*.min.js"], "includes": ["src/*.min.js"]}


@query("ignore_verdict_v2", V.with_ctes(
    f"SELECT doc_id, path, {V2_CASE} AS ignored FROM (SELECT *, path AS p FROM corpus) c", CORPUS))
def ignore_verdict_v2(spark, sf_dir):
    verdict = ignore.ignored_v2("path", False, [GIT_LINES], **V2_ARGS)
    return V.corpus(spark, sf_dir).select("doc_id", "path", verdict.alias("ignored"))


@query("target_filter", V.with_ctes(
    "SELECT repo, path, substr(path, 6) AS relative FROM corpus WHERE starts_with(path, 'docs/')", CORPUS))
def target_filter(spark, sf_dir):
    entries = V.corpus(spark, sf_dir).withColumn("full", F.col("path"))
    inside = entries.where(paths.is_under("path", "docs"))
    return crawl.retarget(inside, "docs").select(
        "repo", F.col("full").alias("path"), F.col("path").alias("relative")
    )


@query("depth_filter", V.with_ctes(
    "SELECT repo, path FROM paths WHERE len(names) <= 2", CORPUS, V.PATHS))
def depth_filter(spark, sf_dir):
    options = CrawlOptions(max_depth=2, exclude_binary=False)
    kept = crawl.crawl_v2(V.corpus(spark, sf_dir), options)
    return kept.where(F.col("drop_reason").isNull()).select("repo", "path")


HIDDEN = """len(list_filter(list_slice(names, 1, len(names) - 1), lambda d: d IN ('node_modules', 'vendor', '.git')
  OR (starts_with(d, '.') AND d NOT IN ('.github', '.vscode')))) > 0"""


@query("hidden_dir_filter", V.with_ctes(
    f"SELECT repo, path, {HIDDEN} AS hidden, list_extract(names, 1) IN ('.git', 'node_modules') AS skipped_at_root FROM paths",
    CORPUS, V.PATHS))
def hidden_dir_filter(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "repo", "path", paths.in_hidden_dir("path").alias("hidden"),
        paths.in_skipped_root_dir("path").alias("skipped_at_root"),
    )


NODES = """dirs AS (
SELECT DISTINCT repo, array_to_string(list_slice(names, 1, i), '/') AS path
FROM (SELECT repo, names, unnest(range(1, len(names))) AS i FROM paths) a),
nodes AS (SELECT repo, path, true AS is_dir FROM dirs UNION ALL SELECT repo, path, false FROM paths)"""


@query("subtree_prune", V.with_ctes(f"""
SELECT n.repo, n.path, n.is_dir FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT repo, path, path || '/' AS p FROM dirs) d
  WHERE d.repo = n.repo AND starts_with(n.path, d.path || '/') AND ({GIT_CASE}) = 'drop')""",
    CORPUS, V.PATHS, NODES))
def subtree_prune(spark, sf_dir):
    def dropped(folder):
        return ignore.ignored_gitignore(folder, True, [GIT_LINES])

    entries = V.corpus(spark, sf_dir)
    nodes = entries.select("repo", "path", F.lit(False).alias("is_dir")).unionByName(
        crawl.directories(entries).select("repo", "path", F.lit(True).alias("is_dir"))
    )
    return nodes.where(~ignore.below_dropped_dir("path", dropped))


REASON = f"""reasons AS (
SELECT repo, path, lang, content, CASE
  WHEN (({GIT_CASE}) = 'drop') OR len(list_filter(range(1, len(names)), lambda i:
    (({GIT_CASE.replace('(p,', "(array_to_string(list_slice(names, 1, i), '/') || '/',")}) = 'drop'))) > 0 THEN 'ignored'
  WHEN {HIDDEN} THEN 'hidden_dir' WHEN lang = '' THEN 'unknown_language'
  WHEN NOT ({text_v1_sql('content')}) THEN 'binary' END AS drop_reason
FROM (SELECT *, path AS p FROM langs) l)"""
REASON_CTES = (*LANG_CTES, REASON)


def _working_set(spark, sf_dir):
    return crawl.working_set(V.corpus(spark, sf_dir), git_layers=[GIT_LINES])


@query("working_set", V.with_ctes(
    "SELECT repo, path, lang FROM reasons WHERE drop_reason IS NULL", *REASON_CTES))
def working_set(spark, sf_dir):
    return _working_set(spark, sf_dir).where(F.col("drop_reason").isNull()).select("repo", "path", "lang")


@query("walk_files", V.with_ctes(
    f"SELECT repo, path, strlen(content) AS n_bytes FROM (SELECT *, path AS p FROM corpus) c WHERE ({GIT_CASE}) <> 'drop' AND {text_v1_sql('content')}",
    CORPUS))
def walk_files(spark, sf_dir):
    found = crawl.text_files(V.corpus(spark, sf_dir), [GIT_LINES])
    return found.select("repo", "path", text.n_bytes("content").alias("n_bytes"))


@query("drop_reasons", V.with_ctes(
    "SELECT repo, COALESCE(drop_reason, 'kept') AS reason, count(*) AS files FROM reasons GROUP BY 1, 2", *REASON_CTES))
def drop_reasons(spark, sf_dir):
    return (
        _working_set(spark, sf_dir)
        .groupBy("repo", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))
        .agg(F.count("*").alias("files"))
    )


@query("doc_candidates", V.with_ctes("""
SELECT repo, path, lang = 'markdown' AS by_language,
  ends_with(lower(base), '.md') AND NOT contains(path, '.git/') AS by_suffix FROM langs
WHERE lang = 'markdown' OR (ends_with(lower(base), '.md') AND NOT contains(path, '.git/'))""", *LANG_CTES))
def doc_candidates(spark, sf_dir):
    by_language, by_suffix = paths.language("path") == "markdown", paths.is_markdown_path("path")
    return V.corpus(spark, sf_dir).where(by_language | by_suffix).select(
        "repo", "path", by_language.alias("by_language"), by_suffix.alias("by_suffix")
    )


DIFF_SQL = """changed AS (
SELECT COALESCE(o.repo, n.repo) AS repo, COALESCE(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM old_files o FULL OUTER JOIN new_files n ON o.repo = n.repo AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content)"""


@query("snapshot_diff", V.with_ctes(
    "SELECT repo, path, status FROM changed", CORPUS, V.VERSIONS, V.SNAPSHOTS, DIFF_SQL))
def snapshot_diff_query(spark, sf_dir):
    return snapshot_diff(*V.snapshots(spark, sf_dir))


@query("relevant_docs", V.with_ctes(r"""
SELECT repo, path, status FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM changed) c
WHERE (starts_with(d, 'docs') OR starts_with(d, 'doc') OR starts_with(d, 'documentation') OR starts_with(d, '.') OR d = '')
  AND regexp_matches(path, '\.(md|rst|txt|adoc|asciidoc)$')""",
    CORPUS, V.VERSIONS, V.SNAPSHOTS, DIFF_SQL))
def relevant_docs(spark, sf_dir):
    return snapshot_diff(*V.snapshots(spark, sf_dir)).where(paths.is_relevant_doc("path"))


@query("path_order", V.with_ctes(
    "SELECT repo, path, replace(path, '/', chr(0)) AS walk_key FROM corpus ORDER BY repo, walk_key", CORPUS))
def path_order(spark, sf_dir):
    # A range sort: a large repository spans many partitions.
    scanned = corpus_source.corpus_scan(V.corpus(spark, sf_dir).select("repo", "path"))
    return scanned.orderBy("repo", "walk_key")


@query("crawl_summary", V.with_ctes(f"""
SELECT repo, count(*) FILTER (WHERE NOT dropped AND is_text) AS included_count,
  count(*) FILTER (WHERE dropped OR NOT is_text) AS excluded_count
FROM (SELECT repo, ({RULES_CASE}) = 'drop' AS dropped, {text_v1_sql('content')} AS is_text
  FROM corpus WHERE NOT starts_with(path, 'node_modules/')) c GROUP BY repo""", CORPUS))
def crawl_summary(spark, sf_dir):
    return crawl.summary_v1(crawl.crawl_v1(V.corpus(spark, sf_dir), CrawlOptions(layers=[RULES])))


V2_NODES = f"""verdicts AS (
SELECT n.repo, n.path, n.is_dir, CASE WHEN {V2_CASE} THEN 'ignored' END AS ignored
FROM (SELECT *, CASE WHEN is_dir THEN path || '/' ELSE path END AS p FROM nodes) n),
visited AS (
SELECT v.*, CASE WHEN v.ignored IS NOT NULL THEN 'ignored'
  WHEN NOT v.is_dir AND NOT regexp_matches(v.path, '^src/[^/]*\\.min\\.js$')
    AND NOT ({text_v2_sql('c.content', 'c.ext')}) THEN 'binary' END AS drop_reason
FROM verdicts v LEFT JOIN paths c ON c.repo = v.repo AND c.path = v.path
WHERE NOT EXISTS (SELECT 1 FROM verdicts d WHERE d.is_dir AND d.ignored IS NOT NULL
  AND d.repo = v.repo AND starts_with(v.path, d.path || '/')))"""
V2_NODE_CTES = (CORPUS, V.PATHS, NODES, V2_NODES)
V2_OPTIONS = CrawlOptions(layers=[GIT_LINES], **V2_ARGS)


@query("crawl_summary_v2", V.with_ctes("""
SELECT repo, count(*) FILTER (WHERE drop_reason IS NULL) AS included_count,
  count(*) FILTER (WHERE drop_reason IS NOT NULL) AS excluded_count FROM visited GROUP BY repo""", *V2_NODE_CTES))
def crawl_summary_v2(spark, sf_dir):
    return crawl.summary_v2(crawl.nodes_v2(V.corpus(spark, sf_dir), V2_OPTIONS))
