"""Queries on trees, packs and budgeted context."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import paths, text
from corpusloom.operators import budget, crawl, ignore, joins, trees
from corpusloom.operators.crawl import CrawlOptions
from corpusloom.plans import packing
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import sinks
from workload import files as Q
from workload import views as V
from workload.registry import query

STAMP = "2024-01-01T00:00:00Z"


# --- Trees ------------------------------------------------------------------------------

def walk_tree_sql(nodes: str, dir_shift: int = 0, where: str = "true") -> str:
    return f"""SELECT repo, replace(path, '/', chr(0)) AS key,
  repeat('  ', len(string_split(path, '/')) - 1 + CASE WHEN is_dir THEN {dir_shift} ELSE 0 END)
  || CASE WHEN is_dir THEN '└── ' ELSE '├── ' END || list_extract(string_split(path, '/'), -1) AS text
FROM {nodes} WHERE {where}
UNION ALL SELECT DISTINCT repo, '', repo FROM {nodes}"""


@query("file_tree_plain", V.with_ctes(walk_tree_sql("nodes", 1), V.CORPUS, V.PATHS, Q.NODES))
def file_tree_plain(spark, sf_dir):
    return trees.file_tree_plain(V.corpus(spark, sf_dir))


# Plan-time rules, at most three levels, directories pruned.
TREE_V1 = f"""rule_hits AS (SELECT repo, path, ({Q.RULES_CASE}) = 'drop' AS dropped FROM nodes),
shown AS (
SELECT n.* FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM rule_hits d WHERE d.dropped AND d.repo = n.repo
    AND (n.path = d.path OR starts_with(n.path, d.path || '/')))
  AND NOT (n.path = 'node_modules' OR starts_with(n.path, 'node_modules/'))
  AND len(string_split(n.path, '/')) - 1 < 2)"""


@query("file_tree_v1", V.with_ctes(
    walk_tree_sql("shown"), V.CORPUS, V.PATHS, Q.NODES, TREE_V1))
def file_tree_v1(spark, sf_dir):
    return trees.file_tree_v1(
        V.corpus(spark, sf_dir), CrawlOptions(layers=[Q.RULES], max_depth=2)
    )


def tree_v2_ctes(included: str) -> str:
    """CTEs for tree v2 over (repo, path, is_dir) rows."""
    key = """array_to_string(list_transform(string_split(path, '/'), lambda name, i:
    CASE WHEN i = len(string_split(path, '/')) AND NOT is_dir THEN '1' ELSE '0' END || lower(name) || chr(0) || name || chr(0)), '')"""
    return f"""keyed AS (
SELECT repo, path, is_dir, {key} AS key,
  CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent FROM {included}),
ranked AS (
SELECT *, row_number() OVER (PARTITION BY repo, parent ORDER BY key DESC) = 1 AS is_last FROM keyed),
above AS (
SELECT n.repo, n.path, count(*) AS found,
  string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY length(a.path)) AS prefix
FROM ranked n JOIN ranked a ON a.is_dir AND a.repo = n.repo AND starts_with(n.path, a.path || '/') GROUP BY 1, 2),
tree AS (
SELECT n.repo, n.key, COALESCE(a.prefix, '') || CASE WHEN n.is_last THEN '└── ' ELSE '├── ' END
  || list_extract(string_split(n.path, '/'), -1) || CASE WHEN n.is_dir THEN '/' ELSE '' END AS text
FROM ranked n LEFT JOIN above a ON a.repo = n.repo AND a.path = n.path
WHERE COALESCE(a.found, 0) = len(string_split(n.path, '/')) - 1
UNION ALL SELECT DISTINCT source, '', source || '/' FROM documents)"""


@query("file_tree_v2", V.with_ctes(
    "SELECT * FROM tree", *Q.V2_NODE_CTES, tree_v2_ctes("(SELECT * FROM visited WHERE drop_reason IS NULL) v")))
def file_tree_v2(spark, sf_dir):
    entries = V.corpus(spark, sf_dir)
    nodes = crawl.nodes_v2(entries, Q.V2_OPTIONS).persist(StorageLevel.MEMORY_AND_DISK)
    nodes = nodes.where(F.col("drop_reason").isNull())
    return trees.file_tree_v2(nodes, V.repos(spark, sf_dir))


# --- Packs ------------------------------------------------------------------------------

ENTRY_NODES = """entry_dirs AS (
SELECT DISTINCT repo, array_to_string(list_slice(names, 1, i), '/') AS path
FROM (SELECT repo, names, unnest(range(1, len(names))) AS i FROM entry_paths) a),
entry_nodes AS (
SELECT repo, path, true AS is_dir, list_extract(string_split(path, '/'), -1) AS base FROM entry_dirs
UNION ALL SELECT repo, path, false, base FROM entry_paths)"""

PACK_V1 = f"""hits AS (
SELECT e.repo, e.path, e.is_dir, bool_or({Q.rule_drops_sql('e.path', 'e.base', 'r.pattern')}) AS dropped
FROM entry_nodes e JOIN rules r ON r.repo = e.repo GROUP BY 1, 2, 3),
shown AS (
SELECT h.repo, h.path, h.is_dir FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM hits d WHERE d.dropped AND d.repo = h.repo AND (h.path = d.path OR starts_with(h.path, d.path || '/')))
  AND NOT (h.path = 'node_modules' OR starts_with(h.path, 'node_modules/'))),
files AS (
SELECT e.repo, e.path, e.content FROM entry_paths e JOIN hits h ON h.repo = e.repo AND h.path = e.path AND NOT h.is_dir
WHERE NOT h.dropped AND NOT starts_with(e.path, 'node_modules/') AND {Q.text_v1_sql('e.content')}),
tree AS ({walk_tree_sql('shown')})"""
PACK_V1_CTES = (V.CORPUS, V.ENTRIES, Q.OWN_RULES, Q.ENTRY_PATHS, ENTRY_NODES, PACK_V1)


@query("pack_v1", V.with_ctes(r"""
SELECT repo, 0 AS section, '' AS key, 0 AS part, NULL AS path, '# Project Structure' || chr(10) || chr(10) AS text FROM repos
UNION ALL SELECT repo, 1, key, 0, NULL, text || chr(10) FROM tree
UNION ALL SELECT repo, 2, '', 0, NULL, chr(10) || chr(10) || '# File Contents' || chr(10) || chr(10) FROM repos
UNION ALL SELECT repo, 3, replace(path, '/', chr(0)), 0, path,
  '## ' || path || chr(10) || chr(10) || content || chr(10) || chr(10) FROM files""", *PACK_V1_CTES))
def pack_v1(spark, sf_dir):
    return packing.pack_v1(V.entries(spark, sf_dir)).sections


# The packs as texts, written and read again.
@query("pack_text", V.with_ctes(r"""
SELECT repo, string_agg(text, '' ORDER BY section, key) AS text FROM (
SELECT repo, 0 AS section, '' AS key, '# Project Structure' || chr(10) || chr(10) AS text FROM repos
UNION ALL SELECT repo, 1, key, text || chr(10) FROM tree
UNION ALL SELECT repo, 2, '', chr(10) || chr(10) || '# File Contents' || chr(10) || chr(10) FROM repos
UNION ALL SELECT repo, 3, replace(path, '/', chr(0)), '## ' || path || chr(10) || chr(10) || content || chr(10) || chr(10) FROM files) s
GROUP BY repo""", *PACK_V1_CTES))
def pack_text(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark)}/packs-{uuid.uuid4().hex}"
    sinks.replace_pack_text(packing.pack_v1(V.entries(spark, sf_dir)).sections, folder)
    return joins.assemble(sinks.read_pack_text(spark, folder), ["repo"], ["part"])


@query("pack_sections", V.with_ctes(
    "SELECT repo, count(*) AS files, sum(strlen('## ' || path) + strlen(content) + 4) AS bytes FROM files GROUP BY repo",
    *PACK_V1_CTES))
def pack_sections(spark, sf_dir):
    sections = packing.pack_v1(V.entries(spark, sf_dir), include_header=False).sections
    return sections.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes")
    )


# Gitignore rules of the entries, by kind: a folder name, a name glob, or a literal path.
PACK_V2_RULES = ", ".join([
    V.values_sql("defaults2", "pattern", C.DEFAULT_RULES_V2),
    V.values_sql("always2", "pattern", C.ALWAYS_RULES_V2),
    """lines2 AS (
SELECT repo, pattern FROM repos CROSS JOIN (VALUES ('*.json'), ('docs/api/')) g(pattern) WHERE n % 3 = 0
UNION ALL SELECT repo, pattern FROM repos CROSS JOIN (VALUES ('src/'), ('*.md'), ('lib/**')) g(pattern) WHERE n % 4 = 1
UNION ALL SELECT repo, pattern FROM repos CROSS JOIN defaults2 WHERE n % 4 <> 1
UNION ALL SELECT repo, pattern FROM repos CROSS JOIN always2),
rules2 AS (
SELECT DISTINCT repo, regexp_replace(regexp_replace(pattern, '^\\*\\*/', ''), '/(\\*\\*)?$', '') AS body,
  ends_with(pattern, '/') AS folder_only FROM lines2)""",
])
PACK_V2 = f"""marks AS (
SELECT e.repo, e.path, e.is_dir, bool_or(CASE
  WHEN contains(r.body, '/') AND r.folder_only THEN contains('/' || e.path || CASE WHEN e.is_dir THEN '/' ELSE '' END, '/' || r.body || '/')
  WHEN contains(r.body, '/') THEN contains('/' || e.path || '/', '/' || r.body || '/')
  WHEN r.folder_only THEN list_contains(CASE WHEN e.is_dir THEN string_split(e.path, '/') ELSE list_slice(string_split(e.path, '/'), 1, len(string_split(e.path, '/')) - 1) END, r.body)
  ELSE len(list_filter(string_split(e.path, '/'), lambda name: name GLOB r.body)) > 0 END) AS dropped
FROM entry_nodes e JOIN rules2 r ON r.repo = e.repo GROUP BY 1, 2, 3),
alive AS (
SELECT m.repo, m.path, m.is_dir, e.content FROM marks m
LEFT JOIN entry_paths e ON e.repo = m.repo AND e.path = m.path
WHERE NOT m.dropped AND m.path <> 'llm.txt' AND NOT EXISTS (
  SELECT 1 FROM marks d WHERE d.is_dir AND d.dropped AND d.repo = m.repo AND starts_with(m.path, d.path || '/'))
  AND (m.is_dir OR {Q.text_v2_sql('e.content', "regexp_extract(e.base, '[.][^.]*$')")})),
{tree_v2_ctes('alive')},
files AS (
SELECT repo, path, content, row_number() OVER (PARTITION BY repo ORDER BY path DESC) = 1 AS last,
  regexp_extract(path, '[.]([^./]*)$', 1) AS hint FROM alive WHERE NOT is_dir)"""


@query("pack_v2", V.with_ctes(f"""
SELECT repo, 0 AS section, '' AS key, 0 AS part, NULL AS path, repeat('=', 60) || nl || 'Project Root: ' || repo || nl
  || 'Generated At: {STAMP}' || nl || repeat('=', 60) || nl || nl AS text FROM repos, (SELECT chr(10) AS nl) x
UNION ALL SELECT repo, 1, '', 0, NULL, '## File Tree Structure' || chr(10) || chr(10) || '```' || chr(10) FROM repos
UNION ALL SELECT repo, 2, key, 0, NULL, text || chr(10) FROM tree
UNION ALL SELECT repo, 3, '', 0, NULL, '```' || nl || nl || repeat('=', 60) || nl || nl || '## File Contents' || nl || nl
  FROM repos, (SELECT chr(10) AS nl) x
UNION ALL SELECT repo, 4, path, 0, path, '### File: ' || path || nl || nl || '```' || hint || nl || content || nl || '```'
  FROM files, (SELECT chr(10) AS nl) x
UNION ALL SELECT repo, 4, path, 1, path, chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM files WHERE NOT last""",
    V.CORPUS, V.ENTRIES, Q.ENTRY_PATHS, ENTRY_NODES, PACK_V2_RULES, PACK_V2))
def pack_v2(spark, sf_dir):
    return packing.pack_v2(V.entries(spark, sf_dir), generated_at=STAMP).sections


@query("page_pack", V.with_ctes(f"""
SELECT repo, count(*) AS files, sum(strlen(content)) AS bytes, max(path) AS last_path FROM page_corpus
WHERE {Q.text_v1_sql('content')} GROUP BY repo""", V.PAGES))
def page_pack(spark, sf_dir):
    pack = packing.pack_v1(
        V.page_corpus(spark, sf_dir), CrawlOptions(layers=[C.ALWAYS_RULES_V1]), include_header=False
    )
    return pack.included.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"),
        F.max("path").alias("last_path"),
    )


# --- Budgeted context -----------------------------------------------------------------------

BUDGET_SQL = f"""picked AS (
SELECT repo, path, lang, content, CASE WHEN doc_id % 11 = 5 THEN 'deleted' WHEN doc_id % 13 = 7 THEN 'error' ELSE 'live' END AS state
FROM langs WHERE ({Q.RULES_CASE}) <> 'drop' AND {Q.text_v1_sql('content')}),
sized AS (
SELECT *, strlen(path) + 16 AS head, CASE WHEN state = 'live' THEN strlen(path) + 16 + strlen(content) ELSE 0 END AS cost FROM picked),
totals AS (
SELECT *, COALESCE(sum(cost) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sized),
ends AS (SELECT repo, min(path) AS stop FROM totals WHERE state = 'live' AND used + cost > 100000 GROUP BY repo),
room AS (
SELECT t.*, e.stop, 100000 - used - head - 20 AS left_over FROM totals t LEFT JOIN ends e ON e.repo = t.repo
WHERE e.stop IS NULL OR t.path <= e.stop),
acted AS (
SELECT *, CASE WHEN state <> 'live' THEN state WHEN path = stop THEN 'cut' ELSE 'full' END AS action FROM room
WHERE NOT (stop IS NOT NULL AND path = stop AND left_over <= 0)),
hexed AS (
SELECT *, hex(encode(content)) AS h, CAST(left_over AS BIGINT) AS n FROM acted),
backed AS (
SELECT *, n - CASE WHEN substr(h, 2 * n + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0
  WHEN substr(h, 2 * n - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1
  WHEN substr(h, 2 * n - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS keep FROM hexed)"""


@query("budgeted_context", V.with_ctes("""
SELECT repo, path, lang, action, CASE WHEN state = 'live' THEN used END AS used_before,
  CASE action WHEN 'full' THEN strlen(content) WHEN 'cut' THEN n ELSE 0 END AS content_bytes,
  CASE action WHEN 'full' THEN chr(10) || '--- File: ' || path || ' ---' || chr(10) || content
    WHEN 'cut' THEN chr(10) || '--- File: ' || path || ' ---' || chr(10) || decode(unhex(substr(h, 1, 2 * keep))) || chr(10) || '... (file truncated)' || chr(10)
    WHEN 'deleted' THEN chr(10) || '--- File (Deleted): ' || path || ' ---' || chr(10)
    ELSE chr(10) || '--- File (Error): ' || path || ' ---' || chr(10) || 'Error reading file: ' || chr(10) END AS text
FROM backed""", *Q.LANG_CTES, BUDGET_SQL))
def budgeted_context(spark, sf_dir):
    kept = (
        V.corpus(spark, sf_dir)
        .withColumn("lang", paths.language("path"))
        .where(~ignore.ignored_v1("path", [Q.RULES]))
        .where(text.is_text_v1("content"))
        .withColumn(
            "state",
            F.when(F.col("doc_id") % 11 == 5, F.lit("deleted"))
            .when(F.col("doc_id") % 13 == 7, F.lit("error")).otherwise(F.lit("live")),
        )
    )
    return budget.budgeted_context(kept).select(
        "repo", "path", paths.language("path").alias("lang"), "action", "used_before",
        "content_bytes", "text",
    )
