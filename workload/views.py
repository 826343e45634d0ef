"""Inputs of the queries: tables that Spark derives from the given ones.

Every view exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as C

NL = "chr(10)"
WS = " || ".join(f"chr({ord(c)})" for c in C.WHITESPACE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_sql(text: str) -> str:
    return f"trim({text}, {WS})"


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- corpus: one file per document ---------------------------------------------------

CORPUS = """corpus AS (
SELECT source AS repo, doc_id,
  CASE WHEN ext = '' THEN concat(dir, '/', CAST(doc_id AS VARCHAR), '/Dockerfile')
       ELSE concat(dir, '/', lang, '_', CAST(doc_id AS VARCHAR), ext) END AS path,
  text AS content
FROM (SELECT *,
  CASE k % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.ts'
    WHEN 4 THEN '.json' WHEN 5 THEN '.txt' WHEN 6 THEN '.log' WHEN 7 THEN '.min.js'
    WHEN 8 THEN '' ELSE '.PNG' END AS ext,
  CASE (3 * k + k // 10) % 10 WHEN 0 THEN 'src' WHEN 1 THEN 'docs'
    WHEN 2 THEN 'src/app' WHEN 3 THEN 'docs/api' WHEN 4 THEN 'build'
    WHEN 5 THEN '.github/workflows' WHEN 6 THEN 'node_modules/x' WHEN 7 THEN '.cache'
    WHEN 8 THEN 'internal' ELSE 'lib/vendor' END AS dir
  FROM (SELECT *, doc_id // 20 AS k FROM documents) d) t)"""

_EXTENSIONS = [".md", ".py", ".go", ".ts", ".json", ".txt", ".log", ".min.js", "", ".PNG"]
_FOLDERS = [
    "src", "docs", "src/app", "docs/api", "build", ".github/workflows", "node_modules/x",
    ".cache", "internal", "lib/vendor",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, path, content)."""
    k = F.floor(F.col("doc_id") / 20)
    ext = _pick(_EXTENSIONS, k % 10)
    folder = _pick(_FOLDERS, (3 * k + F.floor(k / 10)) % 10)
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), "doc_id",
        F.when(ext == "", F.concat(folder, F.lit("/"), doc_id, F.lit("/Dockerfile")))
        .otherwise(F.concat(folder, F.lit("/"), F.col("lang"), F.lit("_"), doc_id, ext))
        .alias("path"),
        F.col("text").alias("content"),
    )


PATHS = """paths AS (
SELECT *, list_extract(names, -1) AS base,
  CASE WHEN len(names) = 1 THEN '.' ELSE array_to_string(list_slice(names, 1, len(names) - 1), '/') END AS dir,
  regexp_extract(list_extract(names, -1), '\\.[^.]*$') AS ext
FROM (SELECT *, string_split(path, '/') AS names FROM corpus) c)"""


# --- entries: the corpus with ignore files for some repositories ----------------------

GIT_FILE = "# generated\n*.json\n\n  docs/api/  \n!docs/api/keep.md\n"
PACK_FILE = "src/\n*.md\n\t# none\nlib/**\n"

ENTRIES = """repos AS (SELECT DISTINCT source AS repo, CAST(substr(source, 4) AS BIGINT) AS n FROM documents),
entries AS (
SELECT repo, path, content FROM corpus
UNION ALL SELECT repo, '.gitignore', '# generated' || chr(10) || '*.json' || chr(10) || chr(10) || '  docs/api/  ' || chr(10) || '!docs/api/keep.md' || chr(10)
  FROM repos WHERE n % 3 = 0
UNION ALL SELECT repo, '.llmignore', 'src/' || chr(10) || '*.md' || chr(10) || chr(9) || '# none' || chr(10) || 'lib/**' || chr(10)
  FROM repos WHERE n % 4 = 1)"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): the corpus and the ignore files."""
    names = repos(spark, sf_dir).withColumn("n", F.substring("repo", 4, 20).cast("long"))
    git = names.where(F.col("n") % 3 == 0).select(
        "repo", F.lit(".gitignore").alias("path"), F.lit(GIT_FILE).alias("content")
    )
    pack = names.where(F.col("n") % 4 == 1).select(
        "repo", F.lit(".llmignore").alias("path"), F.lit(PACK_FILE).alias("content")
    )
    return corpus(spark, sf_dir).select("repo", "path", "content").unionByName(git).unionByName(pack)


def values_sql(name: str, column: str, values: list[str], ordinal: bool = False) -> str:
    """A literal list as a CTE."""
    quoted = [v.replace("'", "''") for v in values]
    if ordinal:
        rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(quoted))
        return f"{name}(ord, {column}) AS (VALUES {rows})"
    return f"{name}({column}) AS (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in quoted)})"


# --- ignore_docs: every document as the ignore file of a repository of its own ---------

IGNORE_DOCS = """ignore_docs AS (
SELECT 'r' || CAST(doc_id AS VARCHAR) AS repo,
  CASE doc_id % 3 WHEN 0 THEN '.gitignore' WHEN 1 THEN '.llmignore' ELSE 'README.md' END AS path,
  replace(replace(text, ', ', chr(10) || '#'), '. ', ' ' || chr(10) || chr(9) || ' ') AS content
FROM documents)"""


def ignore_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(", "), F.lit("\n#"))
    text = F.replace(text, F.lit(". "), F.lit(" \n\t "))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("repo"),
        _pick([".gitignore", ".llmignore", "README.md"], F.col("doc_id") % 3).alias("path"),
        text.alias("content"),
    )


# --- versions: every document with a second version -------------------------------------

VERSIONS = """versions AS (
SELECT repo, doc_id, path, content AS old_text, array_to_string(
  CASE WHEN doc_id % 3 = 0 THEN list_slice(marked, 1, len(marked) - 1)
       WHEN doc_id % 3 = 1 THEN list_append(marked, 'added line') ELSE marked END, chr(10)) AS new_text
FROM (SELECT *, list_transform(string_split(content, chr(10)),
  lambda line, i: CASE WHEN (i - 1 + doc_id) % 5 = 0 THEN '~' || line ELSE line END) AS marked FROM corpus) m)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, path, old_text, new_text)."""
    marked = F.transform(
        F.split("content", "\n", -1),
        lambda line, i: F.when((i + F.col("doc_id")) % 5 == 0, F.concat(F.lit("~"), line)).otherwise(line),
    )
    new = (
        F.when(F.col("doc_id") % 3 == 0, F.slice(marked, F.lit(1), F.size(marked) - 1))
        .when(F.col("doc_id") % 3 == 1, F.array_append(marked, F.lit("added line")))
        .otherwise(marked)
    )
    return corpus(spark, sf_dir).select(
        "repo", "doc_id", "path", F.col("content").alias("old_text"),
        F.array_join(new, "\n").alias("new_text"),
    )


# --- snapshots: both versions, some files only on one side ----------------------------

SNAPSHOTS = """old_files AS (SELECT repo, path, doc_id, old_text AS content FROM versions WHERE doc_id % 11 <> 4),
new_files AS (SELECT repo, path, doc_id, CASE WHEN doc_id % 2 = 0 THEN new_text ELSE old_text END AS content
  FROM versions WHERE doc_id % 11 <> 7)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old files, new files): added, deleted, modified and unchanged ones."""
    v = versions(spark, sf_dir)
    old = v.where(F.col("doc_id") % 11 != 4).select("repo", "path", F.col("old_text").alias("content"))
    new = v.where(F.col("doc_id") % 11 != 7).select(
        "repo", "path",
        F.when(F.col("doc_id") % 2 == 0, F.col("new_text")).otherwise(F.col("old_text")).alias("content"),
    )
    return old, new


# --- replies: one simulated model reply per document ------------------------------------

REPLIES = """replies AS (
SELECT repo, doc_id, path, content, f, CASE doc_id % 6
  WHEN 0 THEN ' NO_UPDATE_NEEDED '
  WHEN 1 THEN '```markdown' || nl || content || nl || '```'
  WHEN 2 THEN '--- EDIT REPLACE START ---' || nl || '<<< ORIGINAL >>>' || nl || f || nl || '<<< REPLACEMENT >>>' || nl || 'replaced ' || doc_id || nl || '--- EDIT REPLACE END ---'
  WHEN 3 THEN '--- EDIT INSERT_AFTER START ---' || nl || '<<< CONTEXT_LINE >>>' || nl || f || nl || '<<< INSERTION >>>' || nl || 'inserted ' || doc_id || nl || '--- EDIT INSERT_AFTER END ---'
  WHEN 4 THEN '--- EDIT DELETE START ---' || nl || '<<< CONTENT >>>' || nl || f || nl || '--- EDIT DELETE END ---'
  ELSE content END AS response
FROM (SELECT *, split_part(content, chr(10), 1) AS f, chr(10) AS nl FROM corpus) c)"""


def edit_block(kind: str, *fields: tuple[str, Column]) -> Column:
    pieces = [F.lit(f"--- EDIT {kind} START ---\n")]
    for name, value in fields:
        pieces += [F.lit(f"<<< {name} >>>\n"), value, F.lit("\n")]
    return F.concat(*pieces, F.lit(f"--- EDIT {kind} END ---"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, path, content, response)."""
    f, doc_id = F.substring_index("content", "\n", 1), F.col("doc_id").cast("string")

    kind = F.col("doc_id") % 6
    response = (
        F.when(kind == 0, F.lit(" NO_UPDATE_NEEDED "))
        .when(kind == 1, F.concat(F.lit("```markdown\n"), F.col("content"), F.lit("\n```")))
        .when(kind == 2, edit_block("REPLACE", ("ORIGINAL", f), ("REPLACEMENT", F.concat(F.lit("replaced "), doc_id))))
        .when(kind == 3, edit_block("INSERT_AFTER", ("CONTEXT_LINE", f), ("INSERTION", F.concat(F.lit("inserted "), doc_id))))
        .when(kind == 4, edit_block("DELETE", ("CONTENT", f)))
        .otherwise(F.col("content"))
    )
    return corpus(spark, sf_dir).withColumn("response", response)


# --- long replies: four edits of each document, blocks of several lines, out of order ------

LONG_REPLIES = """long_replies AS (
SELECT doc_id, ls, array_to_string(ls, chr(10)) AS content, ls[1] || nl || ls[2] AS head, ls[len(ls)] AS last, ls[len(ls) // 2 + 1] AS middle,
  'chained ' || doc_id AS chained, 'chained ' || doc_id || nl || '  indented ' || doc_id AS replacement,
  'inserted ' || doc_id || nl || 'and more' AS insertion
FROM (SELECT doc_id, chr(10) AS nl, list_concat(
    list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i % 2 = 0 THEN '  ' || x ELSE x END),
    [string_split(content, chr(10))[1]]) AS ls
  FROM corpus WHERE content IS NOT NULL) c)"""


def long_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content, response): every second line is indented, and the first comes again as the last.

    The reply deletes the middle line, inserts behind the last line and behind one that only
    a replacement makes, and replaces the first two lines together.
    """
    own, doc_id = F.split("content", "\n", -1), F.col("doc_id").cast("string")
    indented = F.transform(own, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("  "), x)).otherwise(x))
    ls = F.col("ls")
    chained = F.concat(F.lit("chained "), doc_id)
    response = F.concat_ws(
        "\n",
        F.lit("These edits bring the file up to date."),
        edit_block("DELETE", ("CONTENT", F.get(ls, F.floor(F.size(ls) / 2).cast("int")))),
        edit_block("INSERT_AFTER", ("CONTEXT_LINE", F.element_at(ls, -1)),
                   ("INSERTION", F.concat(F.lit("inserted "), doc_id, F.lit("\nand more")))),
        F.lit("The first lines:"),
        edit_block("INSERT_AFTER", ("CONTEXT_LINE", chained), ("INSERTION", F.lit("never"))),
        edit_block("REPLACE", ("ORIGINAL", F.concat_ws("\n", F.get(ls, F.lit(0)), F.get(ls, F.lit(1)))),
                   ("REPLACEMENT", F.concat(chained, F.lit("\n  indented "), doc_id))),
    )
    return (
        corpus(spark, sf_dir).where("content IS NOT NULL")
        .select("doc_id", F.array_append(indented, F.get(own, F.lit(0))).alias("ls"))
        .select("doc_id", F.array_join("ls", "\n").alias("content"), response.alias("response"))
    )


# --- commits: the event log as a history -------------------------------------------------

COMMITS = """commits AS (
SELECT 'repo' || CAST(user_id % 10 AS VARCHAR) AS repo, ts, event_id,
  event_type || ': event ' || CAST(event_id AS VARCHAR) AS subject,
  (event_type = 'signup' AND event_id % 20 < 4) AS is_tag
FROM events)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("repo"), (F.col("user_id") % 10).cast("string")).alias("repo"),
        "ts", "event_id",
        F.concat("event_type", F.lit(": event "), F.col("event_id").cast("string")).alias("subject"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 20 < 4)).alias("is_tag"),
    )


# --- page_corpus: web pages as files -----------------------------------------------------

PAGES = """page_corpus AS (
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1), '/$', '') || '_' || CAST(page_id AS VARCHAR) || '.html' AS path,
  html AS content FROM pages)"""


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+/?([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("repo"),
        F.concat(route, F.lit("_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )


# --- lines of a text ---------------------------------------------------------------------

def doc_lines_sql(name: str, source: str, text: str, keys: str = "repo, doc_id, path") -> str:
    """CTE with one row per line: keys, pos (from 0), line."""
    return f"""{name} AS (
SELECT {keys}, unnest(string_split({text}, chr(10))) AS line,
  generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS pos FROM {source})"""
