"""Queries on diffs, replies, edits, rules, prompts, batches and history."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom import prompt_texts as P
from corpusloom.functions import paths, text
from corpusloom.operators import batch, diffs, edits, history, outcomes, prompts, rules
from corpusloom.plans import commits as commit_plan
from corpusloom.plans import replies as reply_plan
from corpusloom.session import ensure_checkpoint_dir, shared_prefixes, wide_rows
from corpusloom.sources.standards import parse_standards
from workload import files as Q
from workload import views as V
from workload.packs import BUDGET_SQL
from workload.registry import query

NL = "chr(10)"
VERSION_CTES = (V.CORPUS, V.VERSIONS)

LINE_DIFF = ", ".join([
    V.doc_lines_sql("old_lines", "versions", "old_text"),
    V.doc_lines_sql("new_lines", "versions", "new_text"),
    """sides AS (
SELECT COALESCE(o.repo, n.repo) AS repo, COALESCE(o.path, n.path) AS path, COALESCE(o.doc_id, n.doc_id) AS doc_id,
  COALESCE(o.pos, n.pos) AS line_no, o.line AS old_line, n.line AS new_line
FROM old_lines o FULL OUTER JOIN new_lines n ON o.doc_id = n.doc_id AND o.pos = n.pos),
ops AS (
SELECT repo, path, doc_id, line_no, 1 AS side, CASE WHEN old_line = new_line THEN ' ' ELSE '-' END AS op, old_line AS line
  FROM sides WHERE old_line IS NOT NULL
UNION ALL SELECT repo, path, doc_id, line_no, 2, '+', new_line FROM sides
  WHERE new_line IS NOT NULL AND (old_line IS NULL OR old_line <> new_line))""",
])


@query("line_diff", V.with_ctes("SELECT repo, path, line_no, op, line FROM ops", *VERSION_CTES, LINE_DIFF))
def line_diff(spark, sf_dir):
    return diffs.line_diff(V.versions(spark, sf_dir), ["repo", "path"], "old_text", "new_text")


@query("render_diff", V.with_ctes(
    "SELECT doc_id, string_agg(op || ' ' || line || chr(10), '' ORDER BY line_no, side) AS text FROM ops GROUP BY doc_id",
    *VERSION_CTES, LINE_DIFF))
def render_diff(spark, sf_dir):
    return V.versions(spark, sf_dir).select(
        "doc_id", diffs.render_diff("old_text", "new_text").alias("text")
    )


@query("patch_numstat", V.with_ctes("""
SELECT repo, path, count(*) FILTER (WHERE op = '+') AS added, count(*) FILTER (WHERE op = '-') AS deleted
FROM ops GROUP BY repo, path""", *VERSION_CTES, LINE_DIFF))
def patch_numstat(spark, sf_dir):
    # One patch text per pair of documents of a repository.
    path = F.col("path")
    body = F.array_join(
        F.transform(diffs.diff_ops("old_text", "new_text"), lambda e: F.concat(e["op"], e["line"], F.lit("\n"))), ""
    )
    patch = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2 100644\n--- a/"), path,
        F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), F.size(text.lines("old_text")).cast("string"),
        F.lit(" +1,"), F.size(text.lines("new_text")).cast("string"), F.lit(" @@\n"), body,
    )
    pairs = (
        V.versions(spark, sf_dir)
        .select("repo", F.floor(F.col("doc_id") / 40).alias("pair"), "path", patch.alias("patch"))
        .groupBy("repo", "pair")
        .agg(F.array_join(F.sort_array(F.collect_list("patch")), "").alias("patch"))
    )
    return diffs.patch_numstat(pairs, ["repo"])


# --- Replies and edits ----------------------------------------------------------------------

FENCED = """fenced AS (
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '```typescript' || nl || text || nl || '```'
  WHEN 1 THEN '```js' || nl || text || nl || '```' WHEN 2 THEN '```json' || nl || text || nl || '```'
  WHEN 3 THEN nl || '```markdown' || nl || text || '```' || nl WHEN 4 THEN '```' || text || '```'
  WHEN 5 THEN '```Python title' || nl || text || nl || '```' WHEN 6 THEN text || nl || '```' ELSE '  ' || text || ' ' END AS reply
FROM documents, (SELECT chr(10) AS nl) x)"""


def _fenced(spark, sf_dir):
    kind, t, nl, fence = F.col("doc_id") % 8, F.col("text"), F.lit("\n"), F.lit("```")
    reply = (
        F.when(kind == 0, F.concat(F.lit("```typescript\n"), t, nl, fence))
        .when(kind == 1, F.concat(F.lit("```js\n"), t, nl, fence))
        .when(kind == 2, F.concat(F.lit("```json\n"), t, nl, fence))
        .when(kind == 3, F.concat(F.lit("\n```markdown\n"), t, fence, nl))
        .when(kind == 4, F.concat(fence, t, fence))
        .when(kind == 5, F.concat(F.lit("```Python title\n"), t, nl, fence))
        .when(kind == 6, F.concat(t, nl, fence))
        .otherwise(F.concat(F.lit("  "), t, F.lit(" ")))
    )
    return V.table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


def closing_sql(opened: str) -> str:
    cut = V.trim_sql(f"left({opened}, length({opened}) - 3)")
    return f"CASE WHEN ends_with({opened}, '```') THEN {cut} ELSE {opened} END"


def editor_sql(t: str) -> str:
    arms = " ".join(
        f"WHEN starts_with({t}, '{f}') THEN {V.trim_sql(f'substr({t}, {len(f) + 1})')}" for f in C.EDITOR_FENCES
    )
    return f"CASE {arms} ELSE {t} END"


@query("fence_clean", V.with_ctes(f"""
SELECT doc_id, {closing_sql('opened')} AS cleaned FROM (
  SELECT doc_id, {editor_sql('t')} AS opened FROM (SELECT doc_id, {V.trim_sql('reply')} AS t FROM fenced) a) b""", FENCED))
def fence_clean(spark, sf_dir):
    return _fenced(spark, sf_dir).select("doc_id", text.strip_fence_editor("reply").alias("cleaned"))


@query("fence_clean_general", V.with_ctes(f"""
SELECT doc_id, {closing_sql('opened')} AS cleaned FROM (
  SELECT doc_id, CASE WHEN NOT starts_with(t, '```') THEN t ELSE
    {V.trim_sql("CASE WHEN contains(rest, chr(10)) THEN substr(rest, strpos(rest, chr(10))) ELSE rest END")} END AS opened
  FROM (SELECT doc_id, t, substr(t, length(regexp_extract(t, '(?i)^(?:{'|'.join(C.GENERAL_FENCES)})')) + 1) AS rest
    FROM (SELECT doc_id, {V.trim_sql('reply')} AS t FROM fenced) a) b) c""", FENCED))
def fence_clean_general(spark, sf_dir):
    return _fenced(spark, sf_dir).select("doc_id", text.strip_fence_general("reply").alias("cleaned"))


LIMIT = 300


@query("limit_text", f"""
WITH hexed AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
cut AS (SELECT doc_id, text, decode(unhex(substr(h, 1, 2 * ({LIMIT} - CASE
  WHEN substr(h, {2 * LIMIT + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 0
  WHEN substr(h, {2 * LIMIT - 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 1
  WHEN substr(h, {2 * LIMIT - 3}, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END)))) AS head FROM hexed),
tail AS (SELECT *, list_extract(string_split(head, chr(10)), -1) AS last_line FROM cut)
SELECT doc_id, CASE WHEN strlen(text) <= {LIMIT} THEN text
  WHEN strlen(head) - strlen(last_line) - 1 > {LIMIT // 2} THEN left(head, length(head) - length(last_line) - 1) || '...'
  ELSE head || '...' END AS limited FROM tail""")
def limit_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", text.limit_text("text", LIMIT).alias("limited"))


REPLY_CTES = (V.CORPUS, V.REPLIES)


@query("parse_edits", V.with_ctes(f"""
SELECT doc_id, 0 AS edit_no, CASE doc_id % 6 WHEN 2 THEN 'REPLACE' WHEN 3 THEN 'INSERT_AFTER' ELSE 'DELETE' END AS type,
  CASE WHEN doc_id % 6 = 2 THEN {V.trim_sql('f')} END AS original,
  CASE WHEN doc_id % 6 = 2 THEN 'replaced ' || doc_id END AS replacement,
  CASE WHEN doc_id % 6 = 3 THEN {V.trim_sql('f')} END AS context_line,
  CASE WHEN doc_id % 6 = 3 THEN 'inserted ' || doc_id END AS insertion,
  CASE WHEN doc_id % 6 = 4 THEN {V.trim_sql('f')} END AS content
FROM replies WHERE doc_id % 6 IN (2, 3, 4)""", *REPLY_CTES))
def parse_edits(spark, sf_dir):
    return V.replies(spark, sf_dir).select(
        "doc_id", F.posexplode(edits.parse_edits("response")).alias("edit_no", "edit")
    ).select("doc_id", "edit_no", "edit.*")


@query("edit_anchors", V.with_ctes(f"""
SELECT l.doc_id, 0 AS edit_no, CASE l.doc_id % 6 WHEN 2 THEN 'REPLACE' WHEN 3 THEN 'INSERT_AFTER' ELSE 'DELETE' END AS edit_type, l.pos AS line_no
FROM lines l JOIN replies r ON r.doc_id = l.doc_id WHERE r.doc_id % 6 IN (2, 3, 4) AND l.line = {V.trim_sql('r.f')}""",
    *REPLY_CTES, V.doc_lines_sql("lines", "replies", "content")))
def edit_anchors(spark, sf_dir):
    rows = V.replies(spark, sf_dir).withColumn("edits", edits.parse_edits("response"))
    return edits.edit_anchors(rows, ["doc_id"])


# The document after its edit; for whole-file replies the cleaned reply.
PROPOSALS = ", ".join([
    V.doc_lines_sql("lines", "replies", "content"),
    f"""edited AS (
SELECT r.doc_id, COALESCE(string_agg(CASE WHEN l.line <> {V.trim_sql('r.f')} THEN l.line
    WHEN r.doc_id % 6 = 2 THEN 'replaced ' || r.doc_id ELSE l.line || chr(10) || 'inserted ' || r.doc_id END, chr(10) ORDER BY l.pos)
  FILTER (WHERE r.doc_id % 6 <> 4 OR l.line <> {V.trim_sql('r.f')}), '') AS new_text
FROM replies r JOIN lines l ON l.doc_id = r.doc_id WHERE r.doc_id % 6 IN (2, 3, 4) GROUP BY r.doc_id),
whole AS (
SELECT doc_id, {closing_sql('opened')} AS new_text FROM (
  SELECT doc_id, {editor_sql('t')} AS opened FROM (
    SELECT doc_id, {V.trim_sql('response')} AS t FROM replies WHERE doc_id % 6 NOT IN (2, 3, 4)) a) b),
proposals AS (
SELECT r.repo, r.path, r.doc_id, r.content, r.response, p.new_text AS proposal
FROM replies r JOIN (SELECT * FROM edited UNION ALL SELECT * FROM whole) p ON p.doc_id = r.doc_id)""",
])


@query("apply_edits", V.with_ctes("SELECT doc_id, proposal AS new_text FROM proposals", *REPLY_CTES, PROPOSALS))
def apply_edits(spark, sf_dir):
    return reply_plan.with_proposals(V.replies(spark, sf_dir)).select("doc_id", F.col("proposal").alias("new_text"))


# Several edits in one reply, as the format promises: blocks of lines, indented ones, none tried on what another made.
def _edge_newlines_sql(field: str) -> str:
    return f"trim({field}, chr(10))"


LONG_CTES = (V.CORPUS, V.LONG_REPLIES)


@query("parse_edits_intended", V.with_ctes(f"""
SELECT doc_id, 0 AS edit_no, 'REPLACE' AS type, {_edge_newlines_sql('head')} AS original, replacement,
  NULL AS context_line, NULL AS insertion, NULL AS content FROM long_replies
UNION ALL SELECT doc_id, 1, 'INSERT_AFTER', NULL, NULL, last, insertion, NULL FROM long_replies
UNION ALL SELECT doc_id, 2, 'INSERT_AFTER', NULL, NULL, chained, 'never', NULL FROM long_replies
UNION ALL SELECT doc_id, 3, 'DELETE', NULL, NULL, NULL, NULL, middle FROM long_replies""", *LONG_CTES))
def parse_edits_intended(spark, sf_dir):
    return V.long_replies(spark, sf_dir).select(
        "doc_id", F.posexplode(edits.parse_edits("response", compat="intended")).alias("edit_no", "edit")
    ).select("doc_id", "edit_no", "edit.*")


# One step for each place that no earlier edit took: which edit applies there, and where the next place is.
STEPS = f"""blocks AS (
SELECT doc_id, ls, replacement, insertion, last, middle, string_split({_edge_newlines_sql('head')}, chr(10)) AS head FROM long_replies),
steps AS (
SELECT doc_id, 0 AS pos, 1 AS next, '' AS made, FALSE AS kept FROM blocks
UNION ALL
SELECT doc_id, pos, pos + CASE hit WHEN 'r' THEN len(head) ELSE 1 END,
  CASE hit WHEN 'r' THEN replacement WHEN 'i' THEN ls[pos] || chr(10) || insertion ELSE ls[pos] END, hit <> 'd'
FROM (
  SELECT b.*, s.next AS pos, CASE WHEN head <> [''] AND ls[s.next:s.next + len(head) - 1] = head THEN 'r'
    WHEN last <> '' AND ls[s.next] = last THEN 'i' WHEN middle <> '' AND ls[s.next] = middle THEN 'd' ELSE 'n' END AS hit
  FROM steps s JOIN blocks b ON b.doc_id = s.doc_id WHERE s.next <= len(b.ls)) t)"""


@query("apply_edits_multi", "WITH RECURSIVE " + ",\n".join((*LONG_CTES, STEPS)) + """
SELECT doc_id, coalesce(string_agg(made, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS new_text FROM steps GROUP BY doc_id""")
def apply_edits_multi(spark, sf_dir):
    found = edits.parse_edits("response", compat="intended")
    return V.long_replies(spark, sf_dir).withColumn("edits", found).select(
        "doc_id", edits.apply_edits("content", "edits", compat="intended").alias("new_text"))


@query("outcome_status", V.with_ctes(f"""
SELECT doc_id, {V.trim_sql('response')} = 'NO_UPDATE_NEEDED' AS no_update,
  {V.trim_sql('response')} NOT IN ('', 'NO_UPDATE_NEEDED') AS needs_update,
  strlen(proposal) < 10 OR contains(lower(proposal), 'no changes needed') OR proposal = content AS no_change
FROM proposals""", *REPLY_CTES, PROPOSALS))
def outcome_status(spark, sf_dir):
    rows = reply_plan.with_proposals(V.replies(spark, sf_dir))
    return rows.select(
        "doc_id", outcomes.is_no_update("response").alias("no_update"),
        outcomes.doc_update("response")["needs_update"].alias("needs_update"),
        outcomes.is_no_change("proposal", "content").alias("no_change"),
    )


# --- Reply pipelines ---------------------------------------------------------------------------

PIPELINE_LANG = """typed AS (SELECT l.doc_id, l.lang FROM langs l)"""
PIPELINE_CTES = (*Q.LANG_CTES, V.REPLIES, PROPOSALS, PIPELINE_LANG)
DOCS_STATUS = f"""docs_status AS (
SELECT p.repo, p.path, p.doc_id, p.proposal, CASE WHEN t.lang <> 'markdown' THEN 'not_markdown'
  WHEN p.doc_id % 17 = 3 THEN 'error' WHEN {V.trim_sql('p.response')} = 'NO_UPDATE_NEEDED' THEN 'no_update'
  WHEN p.proposal = '' THEN 'processed' WHEN COALESCE(b.quality, 0) = 1 THEN 'changed' ELSE 'skipped' END AS status
FROM proposals p JOIN typed t ON t.doc_id = p.doc_id LEFT JOIN labels b ON b.doc_id = p.doc_id)"""


def _files_and_responses(spark, sf_dir):
    rows = V.replies(spark, sf_dir)
    failed = F.col("doc_id") % 17 == 3
    responses = rows.select(
        F.col("doc_id").alias("request_id"),
        F.when(~failed, F.col("response")).alias("response"),
        F.when(failed, F.lit("timeout")).alias("error"),
    )
    confirmed = V.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"), (F.col("quality") == 1).alias("confirmed")
    )
    files = V.corpus(spark, sf_dir).select(
        "repo", "path", "content", F.col("doc_id").alias("request_id"), paths.language("path").alias("lang")
    )
    return files.join(confirmed, "request_id", "left"), responses


@query("docs_pipeline", V.with_ctes("""
SELECT repo, path, doc_id AS request_id, status, CASE WHEN status = 'changed' THEN proposal END AS new_content FROM docs_status""",
    *PIPELINE_CTES, DOCS_STATUS))
def docs_pipeline(spark, sf_dir):
    return reply_plan.docs_pipeline(*_files_and_responses(spark, sf_dir)).drop("old_content")


@query("commit_docs", V.with_ctes(f"""
SELECT repo, path, doc_id AS request_id, status, CASE WHEN status = 'changed' THEN t END AS new_content FROM (
  SELECT *, {V.trim_sql('response')} AS t, CASE WHEN doc_id % 17 = 3 THEN 'error'
    WHEN {V.trim_sql('response')} IN ('', 'NO_UPDATE_NEEDED') THEN 'no_update' ELSE 'changed' END AS status
  FROM replies WHERE ends_with(lower(path), '.md') AND NOT contains(path, '.git/')) r""", *REPLY_CTES))
def commit_docs(spark, sf_dir):
    files, responses = _files_and_responses(spark, sf_dir)
    return reply_plan.commit_docs(files.where(paths.is_markdown_path("path")), responses).drop("old_content")


@query("run_summary", V.with_ctes("""
SELECT repo, count(*) FILTER (WHERE status <> 'not_markdown') AS processed, count(*) FILTER (WHERE status = 'changed') AS changed,
  count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status IN ('not_markdown', 'no_update', 'skipped')) AS skipped
FROM docs_status GROUP BY repo""", *PIPELINE_CTES, DOCS_STATUS))
def run_summary(spark, sf_dir):
    return outcomes.run_summary(reply_plan.docs_pipeline(*_files_and_responses(spark, sf_dir)))


REFACTOR = """refactored AS (
SELECT *, CASE WHEN doc_id % 17 = 3 THEN 'error' WHEN proposal <> '' THEN 'changed' ELSE 'processed' END AS status FROM proposals)"""


@query("refactor_pipeline", V.with_ctes("""
SELECT repo, path, doc_id AS request_id, status, CASE WHEN status = 'changed' THEN proposal END AS new_content FROM refactored""",
    *PIPELINE_CTES, REFACTOR))
def refactor_pipeline(spark, sf_dir):
    return reply_plan.refactor_pipeline(*_files_and_responses(spark, sf_dir)).drop("old_content")


@query("refactor_results", V.with_ctes("""
SELECT repo, path, doc_id AS request_id, CASE WHEN NOT failed THEN CASE WHEN nothing THEN content ELSE proposal END END AS proposed_content,
  NOT failed AND doc_id % 6 NOT IN (2, 3, 4) AND proposal <> '' AS is_full_replacement,
  NOT failed AND NOT nothing AS needs_confirmation, CASE WHEN failed THEN 'timeout' END AS reply_error
FROM (SELECT *, doc_id % 17 = 3 AS failed, proposal = '' OR strlen(proposal) < 10
  OR contains(lower(proposal), 'no changes needed') OR proposal = content AS nothing FROM proposals) p""", *PIPELINE_CTES))
def refactor_results(spark, sf_dir):
    return reply_plan.refactor_results(*_files_and_responses(spark, sf_dir))


# --- Standards and configurations ------------------------------------------------------------------

STANDARDS = {
    "version": 1,
    "llm_rules_general": [
        {"id": "g1", "applies_to": ["src/*.ts", "docs/*"]},
        {"id": "g2"},
        {"id": "g1", "language": "markdown", "applies_to": ["*.md"]},
        {"id": "g3", "applies_to": ["[", "build/{en,de}_*"]},
        {"id": "g4", "applies_to": ["["]},
    ],
    "languages": {
        "python": {"llm_rules": [{"id": "p1"}, {"id": "g2"}, {"id": "p1", "applies_to": ["src/*"]}]},
        "typescript": {"llm_rules": [{"id": "t1", "applies_to": ["src/[!a-m]*"]}, {"id": "g1"}]},
    },
}

RULES_SQL = r"""
SELECT repo, path, lang, scope, id FROM (
  SELECT *, 'general' AS scope, unnest(list_filter([
    CASE WHEN regexp_full_match(path, '(src/.*\.ts|docs/.*)') THEN 'g1' END, 'g2',
    CASE WHEN lang = 'markdown' AND regexp_full_match(path, '.*\.md') THEN 'g1' END,
    CASE WHEN regexp_full_match(path, 'build/(en|de)_.*') THEN 'g3' END], lambda x: x IS NOT NULL)) AS id FROM langs
  UNION ALL SELECT *, 'language', 'p1' FROM langs WHERE lang = 'python'
  UNION ALL SELECT *, 'language', 't1' FROM langs WHERE lang = 'typescript' AND regexp_full_match(path, 'src/[^a-m].*')
  UNION ALL SELECT *, 'language', 'g1' FROM langs WHERE lang = 'typescript' AND NOT regexp_full_match(path, '(src/.*\.ts|docs/.*)')) r"""


def _typed(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("repo", "path", paths.language("path").alias("lang"))


@query("applicable_rules", V.with_ctes(RULES_SQL, *Q.LANG_CTES))
def applicable_rules(spark, sf_dir):
    return rules.applicable_rules(_typed(spark, sf_dir), STANDARDS).drop("ord")


@query("applicable_rules_by_repo", V.with_ctes(RULES_SQL, *Q.LANG_CTES))
def applicable_rules_by_repo(spark, sf_dir):
    # Every repository carries its own standards text, here with equal content.
    import json

    per_repo = V.repos(spark, sf_dir).select("repo", parse_standards(F.lit(json.dumps(STANDARDS))).alias("s"))
    return rules.applicable_rules_by_repo(_typed(spark, sf_dir), per_repo.select("repo", "s.*")).drop("ord")


@query("standards_flatten", V.with_ctes("""
SELECT doc_id, 'general' AS scope, 0 AS ord, 'g' || doc_id AS id, lang AS description, content AS prompt, NULL AS language, ['docs/*', path] AS applies_to FROM langs
UNION ALL SELECT doc_id, 'general', 1, 'shared', NULL, NULL, CASE WHEN lang <> '' THEN lang END, NULL FROM langs
UNION ALL SELECT doc_id, lang, 0, 'l' || doc_id, 'only ' || lang, NULL, NULL, [path] FROM langs WHERE lang <> ''""", *Q.LANG_CTES))
def standards_flatten(spark, sf_dir):
    files = V.corpus(spark, sf_dir).withColumn("lang", paths.language("path"))
    doc_id, lang = F.col("doc_id").cast("string"), F.col("lang")
    general = F.array(
        F.struct(
            F.concat(F.lit("g"), doc_id).alias("id"), lang.alias("description"), F.col("content").alias("prompt"),
            F.lit(None).cast("string").alias("language"), F.array(F.lit("docs/*"), F.col("path")).alias("applies_to"),
        ),
        F.struct(
            F.lit("shared").alias("id"), F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("prompt"), F.when(lang != "", lang).alias("language"),
            F.lit(None).cast("array<string>").alias("applies_to"),
        ),
    )
    own = F.struct(
        F.concat(F.lit("l"), doc_id).alias("id"), F.concat(F.lit("only "), lang).alias("description"),
        F.array(F.col("path")).alias("applies_to"),
    )
    languages = F.when(
        lang != "", F.map_from_arrays(F.array(lang), F.array(F.struct(F.array(own).alias("llm_rules"))))
    )
    config = F.to_json(F.struct(
        F.lit(1).alias("version"), general.alias("llm_rules_general"), languages.alias("languages")
    ))
    parsed = files.select("doc_id", parse_standards(config).alias("s")).select("doc_id", "s.*")
    return rules.standards_flatten(parsed, ["doc_id"])


@query("nearest_config", V.with_ctes("""
SELECT repo, path, CASE WHEN n % 2 = 0 AND starts_with(path, 'docs/api/') THEN 'docs/api/tsconfig.json'
  WHEN n % 2 = 0 AND starts_with(path, 'src/') THEN 'src/tsconfig.json' WHEN n % 2 = 0 THEN 'tsconfig.json' END AS config
FROM (SELECT *, CAST(substr(repo, 4) AS BIGINT) AS n FROM corpus) c""", V.CORPUS))
def nearest_config(spark, sf_dir):
    configs = V.repos(spark, sf_dir).where(F.substring("repo", 4, 20).cast("long") % 2 == 0).select(
        "repo",
        F.explode(F.array(*map(F.lit, ["tsconfig.json", "src/tsconfig.json", "docs/api/tsconfig.json"]))).alias("path"),
    )
    return rules.nearest_config(V.corpus(spark, sf_dir).select("repo", "path"), configs)


# --- Prompts and batches ---------------------------------------------------------------------------

def fill_sql(template: str, **slots: str) -> str:
    out = "'" + template.replace("{marker}", C.MARKER).replace("'", "''") + "'"
    for name, value in slots.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


REPO_DIFFS = """file_ops AS (
SELECT COALESCE(o.repo, n.repo) AS repo, COALESCE(o.path, n.path) AS path, o.content AS old_text, n.content AS new_text, 0 AS doc_id
FROM old_files o FULL OUTER JOIN new_files n ON o.repo = n.repo AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content),
""" + ", ".join([
    V.doc_lines_sql("fo", "file_ops", "old_text"), V.doc_lines_sql("fn", "file_ops", "new_text"),
    """fops AS (
SELECT COALESCE(o.repo, n.repo) AS repo, COALESCE(o.path, n.path) AS path, COALESCE(o.pos, n.pos) AS pos, o.line AS a, n.line AS b
FROM fo o FULL OUTER JOIN fn n ON o.repo = n.repo AND o.path = n.path AND o.pos = n.pos),
file_texts AS (
SELECT repo, path, '--- ' || path || chr(10) || string_agg(CASE WHEN a = b THEN '  ' || a || chr(10)
  ELSE COALESCE('- ' || a || chr(10), '') || COALESCE('+ ' || b || chr(10), '') END, '' ORDER BY pos) AS text FROM fops GROUP BY repo, path),
repo_diffs AS (SELECT repo, string_agg(text, '' ORDER BY path) AS diff FROM file_texts GROUP BY repo)""",
])
DIFF_CTES = (V.CORPUS, V.VERSIONS, V.SNAPSHOTS, REPO_DIFFS)


@query("commit_prompts", V.with_ctes(
    f"SELECT repo, {fill_sql(P.COMMIT_PROMPT, diff='diff')} AS prompt FROM repo_diffs", *DIFF_CTES))
def commit_prompts(spark, sf_dir):
    diff = commit_plan.repo_diffs(*V.snapshots(spark, sf_dir))
    return diff.select("repo", prompts.commit_prompt("diff").alias("prompt"))


BEFORE_DIFF, AFTER_DIFF = (f"'{t}'" for t in P.COMMIT_PROMPT.replace("{marker}", C.MARKER).replace("'", "''").split("{diff}"))
CHANGED_FILES = """picked AS (
SELECT c.repo, c.path, n.content, CASE WHEN c.status = 'deleted' THEN 'deleted' WHEN n.content IS NULL THEN 'error' ELSE 'live' END AS state
FROM changed c LEFT JOIN new_files n ON n.repo = c.repo AND n.path = c.path),
""" + BUDGET_SQL[BUDGET_SQL.index("sized AS"):]


@query("commit_contexts", V.with_ctes(f"""
SELECT DISTINCT repo, 0 AS section, '' AS path, 0 AS part, {BEFORE_DIFF} AS text FROM changed
UNION ALL SELECT repo, 1, path, 0, text FROM file_texts
UNION ALL SELECT DISTINCT repo, 2, '', 0, chr(10) FROM changed
UNION ALL SELECT repo, 3, path, 0, CASE action WHEN 'full' THEN chr(10) || '--- File: ' || path || ' ---' || chr(10) || content
    WHEN 'cut' THEN chr(10) || '--- File: ' || path || ' ---' || chr(10) || decode(unhex(substr(h, 1, 2 * keep))) || chr(10) || '... (file truncated)' || chr(10)
    WHEN 'deleted' THEN chr(10) || '--- File (Deleted): ' || path || ' ---' || chr(10)
    ELSE chr(10) || '--- File (Error): ' || path || ' ---' || chr(10) || 'Error reading file: ' || chr(10) END FROM backed
UNION ALL SELECT DISTINCT repo, 4, '', 0, {AFTER_DIFF} FROM changed""", *DIFF_CTES, Q.DIFF_SQL, CHANGED_FILES))
def commit_contexts(spark, sf_dir):
    return commit_plan.commit_sections(*V.snapshots(spark, sf_dir), compat="intended")


DOCS_DIFF_CTES = (*Q.LANG_CTES, V.VERSIONS, V.SNAPSHOTS, REPO_DIFFS)


@query("docs_prompts", V.with_ctes(f"""
SELECT doc_id, {fill_sql(P.DOCS_PROMPT, goal="'" + P.DEFAULT_DOCS_GOAL + "'", context="COALESCE(d.diff, '')", target='content')} AS prompt,
  {fill_sql(P.DOCS_PROMPT, goal="COALESCE(d.diff, '')", context='content', target="'%!s(MISSING)'")} AS shifted_prompt
FROM langs l LEFT JOIN repo_diffs d ON d.repo = l.repo WHERE lang = 'markdown'""", *DOCS_DIFF_CTES))
def docs_prompts(spark, sf_dir):
    wide_rows(spark)
    shared_prefixes(spark, ["prompt", "shifted_prompt"])
    docs = V.corpus(spark, sf_dir).where(paths.language("path") == "markdown")
    with_diff = prompts.attach_diff(docs, commit_plan.repo_diffs(*V.snapshots(spark, sf_dir)))
    return with_diff.select(
        "doc_id", prompts.docs_prompt("content", "diff").alias("prompt"),
        prompts.docs_prompt("content", "diff", compat="reference").alias("shifted_prompt"),
    )


# As docs_prompts, but every repository's documents get the diff text itself.
@query("docs_prompts_diff", V.with_ctes(f"""
SELECT doc_id, {fill_sql(P.DOCS_PROMPT, goal="'" + P.DEFAULT_DOCS_GOAL + "'", context="COALESCE(d.diff, '')", target='content')} AS prompt,
  {fill_sql(P.DOCS_PROMPT, goal="COALESCE(d.diff, '')", context='content', target="'%!s(MISSING)'")} AS shifted_prompt
FROM langs l LEFT JOIN repo_diffs d ON d.repo = l.repo WHERE lang = 'markdown'""", *Q.LANG_CTES, V.VERSIONS, V.SNAPSHOTS, REPO_DIFFS))
def docs_prompts_diff(spark, sf_dir):
    wide_rows(spark)
    shared_prefixes(spark, ["prompt", "shifted_prompt"])
    docs = V.corpus(spark, sf_dir).where(paths.language("path") == "markdown")
    with_diff = prompts.attach_diff(docs, commit_plan.repo_diffs(*V.snapshots(spark, sf_dir)))
    return with_diff.select(
        "doc_id", prompts.docs_prompt("content", "diff").alias("prompt"),
        prompts.docs_prompt("content", "diff", compat="reference").alias("shifted_prompt"),
    )


# The prompts of docs_prompts with every text once: rows of references, and the texts by hash.
DOCS_PIECES = [t.replace("'", "''") for t in re.split(
    r"\{context\}|\{target\}", P.DOCS_PROMPT.replace("{marker}", C.MARKER).replace("{goal}", P.DEFAULT_DOCS_GOAL))]


@query("docs_prompt_refs", V.with_ctes(f"""
SELECT 'doc/' || doc_id AS owner, CAST(seq AS INTEGER) AS seq, '' AS key, CASE seq WHEN 1 THEN 'diff/' || repo WHEN 3 THEN sha256(content)
  ELSE sha256(fixed) END AS part, NULL AS text FROM targets, (VALUES (0, '{DOCS_PIECES[0]}'), (1, ''), (2, '{DOCS_PIECES[1]}'), (3, ''), (4, '{DOCS_PIECES[2]}')) f(seq, fixed)
UNION ALL SELECT 'diff/' || repo, 0, path, sha256(text), NULL FROM file_texts
UNION ALL SELECT DISTINCT NULL, CAST(NULL AS INTEGER), NULL, sha256(text), text FROM (
  SELECT content AS text FROM targets UNION SELECT text FROM file_texts
  UNION SELECT unnest(['{DOCS_PIECES[0]}', '{DOCS_PIECES[1]}', '{DOCS_PIECES[2]}'])) t""",
    *DOCS_DIFF_CTES, "targets AS (SELECT doc_id, repo, content FROM langs WHERE lang = 'markdown')"))
def docs_prompt_refs(spark, sf_dir):
    docs = V.corpus(spark, sf_dir).where(paths.language("path") == "markdown")
    old, new = V.snapshots(spark, sf_dir)
    refs, parts = prompts.docs_prompt_refs(docs, commit_plan.file_diffs(old, new, diffs.snapshot_diff(old, new)))
    return refs.unionByName(parts, allowMissingColumns=True)


GOAL = "Convert to functional style"
IMPORT_TEXT = f"""imports AS (
SELECT d.doc_id, d.code, COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE starts_with({V.trim_sql('line')}, 'import ')
  OR starts_with({V.trim_sql('line')}, 'export * from')), '') AS found
FROM import_docs d JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.code)"""


@query("refactor_prompts", V.with_ctes(f"""
SELECT doc_id, {fill_sql(P.REFACTOR_PROMPT, goal="'" + GOAL + "'", context="'Imports:' || chr(10) || found || chr(10)", target='code')} AS prompt,
  'File: f' || doc_id || '.ts' || chr(10) || chr(10) || 'Content:' || chr(10) || code || chr(10) || chr(10) || 'Changes:' || chr(10) AS file_prompt
FROM imports""", Q.IMPORTS, V.doc_lines_sql("lines", "import_docs", "code", "doc_id"), IMPORT_TEXT))
def refactor_prompts(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return Q.import_docs(spark, sf_dir).select(
        "doc_id", prompts.refactor_prompt("code", GOAL).alias("prompt"),
        prompts.file_prompt(name, "code", F.lit(""), GOAL).alias("file_prompt"),
    )


TURNS = "turns AS (SELECT conv_id * 1000 + turn AS request_id, text AS prompt, CASE turn % 3 WHEN 0 THEN 'task-model' WHEN 1 THEN '' END AS task_model, CASE WHEN conv_id % 2 = 0 THEN 'team-model' ELSE '' END AS default_model FROM conversations)"
MODEL_SQL = "COALESCE(NULLIF(task_model, ''), NULLIF(default_model, ''), 'gpt-4o')"


def _requests(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("prompt"),
        F.when(F.col("turn") % 3 == 0, F.lit("task-model")).when(F.col("turn") % 3 == 1, F.lit("")).alias("task_model"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("team-model")).otherwise("").alias("default_model"),
    )
    return prompts.chat_requests(turns, model=prompts.routed_model("task_model", "default_model"))


@query("chat_requests", V.with_ctes(f"""
SELECT request_id, {MODEL_SQL} AS model, 'system' AS first_role, '{C.SYSTEM_MESSAGE}' AS system_text, 'user' AS second_role,
  prompt AS user_text, 0.2::DOUBLE AS temperature, 4096 AS max_tokens, 0.95::DOUBLE AS top_p,
  0::DOUBLE AS frequency_penalty, 0::DOUBLE AS presence_penalty FROM turns""", TURNS))
def chat_requests(spark, sf_dir):
    m = F.col("messages")
    return _requests(spark, sf_dir).select(
        "request_id", "model", m[0]["role"].alias("first_role"), m[0]["content"].alias("system_text"),
        m[1]["role"].alias("second_role"), m[1]["content"].alias("user_text"),
        "temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty",
    )


REQUEST_JSON = (
    """'{"model":' || to_json(""" + MODEL_SQL + """) || ',"messages":[{"role":"system","content":' || to_json('""" + C.SYSTEM_MESSAGE.replace("'", "''")
    + """') || '},{"role":"user","content":' || to_json(prompt) || '}],"temperature":0.2,"max_tokens":4096,"top_p":0.95,"""
    + """"frequency_penalty":0.0,"presence_penalty":0.0}'"""
)


@query("request_json", V.with_ctes(f"SELECT request_id, {REQUEST_JSON} AS value FROM turns", TURNS))
def request_json(spark, sf_dir):
    return prompts.request_json(_requests(spark, sf_dir))


@query("request_sizes", V.with_ctes(
    "SELECT doc_id, strlen(old_text) AS diff_bytes, strlen(new_text) AS context_bytes FROM versions", *VERSION_CTES))
def request_sizes(spark, sf_dir):
    return prompts.request_sizes(V.versions(spark, sf_dir), ["doc_id"], "old_text", "new_text")


def local_reply(request: dict) -> str | None:
    """A deterministic stand-in for a model."""
    user = request["messages"][1]["content"]
    kind = request["request_id"] % 7
    if kind == 3:
        raise TimeoutError("busy")
    if kind == 4:
        raise ValueError("bad request")
    return None if kind == 5 else f"{request['model']}: {user}"


@query("batch_generate", V.with_ctes(f"""
SELECT request_id, CASE WHEN request_id % 7 NOT IN (3, 4, 5) THEN {MODEL_SQL} || ': ' || prompt END AS response,
  CASE request_id % 7 WHEN 3 THEN 'failed after 3 attempts: TimeoutError: busy' WHEN 4 THEN 'failed after 1 attempts: ValueError: bad request'
    WHEN 5 THEN 'no choices' END AS error,
  CASE WHEN request_id % 7 = 3 THEN 3 ELSE 1 END AS attempts FROM turns""", TURNS))
def batch_generate(spark, sf_dir):
    return batch.generate(_requests(spark, sf_dir), local_reply, waits=(), only_timeouts=True)


# The same, kept in a store: the first half of the requests, then all of them, which asks only for the rest.
@query("batch_generate_stored", V.with_ctes(f"""
SELECT request_id, CASE WHEN request_id % 7 NOT IN (3, 4, 5) THEN {MODEL_SQL} || ': ' || prompt END AS response,
  CASE request_id % 7 WHEN 3 THEN 'failed after 3 attempts: TimeoutError: busy' WHEN 4 THEN 'failed after 1 attempts: ValueError: bad request'
    WHEN 5 THEN 'no choices' END AS error,
  CASE WHEN request_id % 7 = 3 THEN 3 ELSE 1 END AS attempts FROM turns""", TURNS))
def batch_generate_stored(spark, sf_dir):
    store = f"{ensure_checkpoint_dir(spark)}/replies-{uuid.uuid4().hex}"
    requests = _requests(spark, sf_dir)
    middle = requests.agg(F.avg("request_id").alias("middle")).scalar()
    for some in (requests.where(F.col("request_id") < middle), requests):
        replies = batch.generate_stored(some, local_reply, store, waits=(), only_timeouts=True)
    return replies


def describe(repo: str, path: str, lang: str, content: str) -> str:
    return f"{repo}/{path}:{lang}:{len(content)}"


@query("map_files", V.with_ctes(
    "SELECT repo, path, repo || '/' || path || ':' || lang || ':' || length(content) AS result FROM langs", *Q.LANG_CTES))
def map_files(spark, sf_dir):
    return batch.map_files(V.corpus(spark, sf_dir).withColumn("lang", paths.language("path")), describe)


# --- Checks of input -----------------------------------------------------------------------------------

@query("has_changes", V.with_ctes("""
SELECT repo || '/' || path AS repo, CASE WHEN doc_id % 11 IN (4, 7) OR (doc_id % 2 = 0 AND old_text <> new_text)
  THEN 'changes' ELSE 'no changes' END AS outcome FROM versions""", *VERSION_CTES))
def has_changes(spark, sf_dir):
    # Every file as a repository of its own, so that both outcomes occur.
    name = F.concat("repo", F.lit("/"), "path").alias("repo")
    old, new = (side.select(name, "path", "content") for side in V.snapshots(spark, sf_dir))
    return diffs.has_changes(V.corpus(spark, sf_dir).select(name), diffs.snapshot_diff(old, new))


@query("standards_warnings", """
SELECT doc_id, version, 'Unsupported standards config version ' || chr(39) || COALESCE(version, 0) || chr(39) || '. Expected version 1.' AS warning
FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 3 AS INTEGER) END AS version FROM documents) d
WHERE COALESCE(version, 0) <> 1""")
def standards_warnings(spark, sf_dir):
    doc_id = F.col("doc_id")
    version = F.when(doc_id % 4 != 3, (doc_id % 3).cast("int")).alias("version")
    config = F.to_json(F.struct(version))  # without the field where it is null
    parsed = V.table(spark, sf_dir, "documents").select("doc_id", parse_standards(config).alias("s"))
    return rules.standards_warnings(parsed.select("doc_id", "s.*"), ["doc_id"])


# --- History -----------------------------------------------------------------------------------------

@query("last_n_commits", V.with_ctes("""
SELECT repo, commit_no, ts, event_id, subject FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) AS commit_no FROM commits) c
WHERE commit_no <= 25""", V.COMMITS))
def last_n_commits(spark, sf_dir):
    return history.last_n_commits(V.commits(spark, sf_dir), 25)


BACK = 10
COMMIT_FILES = """commit_files AS (
SELECT repo, path, 3 + doc_id % 30 AS commit_no, old_text AS content, false AS is_deleted FROM versions
UNION ALL SELECT repo, path, 1 + doc_id % 30, CASE WHEN doc_id % 2 = 0 THEN new_text ELSE old_text END, doc_id % 11 = 7 FROM versions)"""


def at_sql(name: str, first: int) -> str:
    return f"""{name} AS (SELECT repo, path, content FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY commit_no) AS k
FROM commit_files WHERE commit_no >= {first}) c WHERE k = 1 AND NOT is_deleted)"""


@query("net_change", V.with_ctes("""
SELECT COALESCE(o.repo, n.repo) AS repo, COALESCE(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM at_old o FULL OUTER JOIN at_new n ON o.repo = n.repo AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content""",
    *VERSION_CTES, COMMIT_FILES, at_sql("at_old", BACK + 1), at_sql("at_new", 1)))
def net_change(spark, sf_dir):
    v, doc_id = V.versions(spark, sf_dir), F.col("doc_id")
    first = v.select("repo", "path", (3 + doc_id % 30).alias("commit_no"), F.col("old_text").alias("content"), F.lit(False).alias("is_deleted"))
    second = v.select(
        "repo", "path", (1 + doc_id % 30).alias("commit_no"),
        F.when(doc_id % 2 == 0, F.col("new_text")).otherwise(F.col("old_text")).alias("content"), (doc_id % 11 == 7).alias("is_deleted"),
    )
    return history.net_change(first.unionByName(second), BACK)


CHANGELOG = """sectioned AS (
SELECT *, min(CASE WHEN is_tag THEN ts END) OVER w AS tag_ts,
  min(CASE WHEN is_tag THEN {'ts': ts, 'event_id': event_id} END) OVER w AS tag
FROM commits WINDOW w AS (PARTITION BY repo ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("changelog", V.with_ctes("""
SELECT repo, 'v' || tag.event_id AS version, tag.ts AS tag_ts, ts, event_id, '- ' || subject AS line FROM sectioned""", V.COMMITS, CHANGELOG))
def changelog(spark, sf_dir):
    return history.changelog(V.commits(spark, sf_dir))


@query("changelog_headers", V.with_ctes("""
SELECT DISTINCT repo, 'v' || tag.event_id AS version, tag.ts AS tag_ts,
  '## v' || tag.event_id || ' (' || strftime(tag.ts, '%Y-%m-%d') || ')' AS header FROM sectioned WHERE tag IS NOT NULL""", V.COMMITS, CHANGELOG))
def changelog_headers(spark, sf_dir):
    return history.changelog_headers(history.changelog(V.commits(spark, sf_dir)))
