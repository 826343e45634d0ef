"""Replies to results: parse, apply, classify, diff and count in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import edits as E
from corpusloom.operators import outcomes
from corpusloom.operators.diffs import diff_ops


def with_proposals(
    files: DataFrame, marker: str = C.MARKER, compat: str = "reference"
) -> DataFrame:
    """Adds ``edits`` and ``proposal`` to rows with content and response.

    A whole-file reply is the proposal; otherwise the edits are applied. A null reply
    proposes nothing.
    """
    proposal = F.when(
        F.col("response").isNotNull(),
        F.when(F.coalesce("whole", F.lit("")) != "", F.col("whole"))
        .when(F.size("edits") > 0, E.apply_edits("content", "edits", compat))
        .otherwise(""),
    )
    return (
        files.withColumn("edits", E.parse_edits("response", marker, compat))
        .withColumn("whole", E.full_content("response", "edits", compat))
        .withColumn("proposal", proposal)
        .drop("whole")
    )


def docs_pipeline(
    files: DataFrame, responses: DataFrame, dry_run: bool = False, force: bool = False,
    marker: str = C.MARKER, compat: str = "reference",
) -> DataFrame:
    """Outcome rows (repo, path, request_id, status, new_content) of a docs run.

    ``files`` has repo, path, lang, content, request_id and confirmed; ``responses`` has
    request_id, response and error. Only Markdown files are joined to their reply; the
    others are decided in the scan and never shuffled.
    """
    is_doc = F.col("lang") == "markdown"
    answered = files.where(is_doc).join(
        responses.select("request_id", "response", "error"), "request_id", "left"
    )
    docs = _outcome_rows(
        with_proposals(answered, marker, compat),
        outcomes.docs_status(
            "lang", "response", "error", "proposal", "confirmed", dry_run, force
        ),
    )
    others = files.where(~is_doc).select(
        "repo", "path", "request_id", F.lit("not_markdown").alias("status"),
        F.lit(None).cast("string").alias("new_content"), F.col("content").alias("old_content"),
    )
    return docs.unionByName(others)


def commit_docs(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome rows of the documentation pass of a commit.

    A reply is taken as the whole new document, without looking for edits. ``docs`` has
    repo, path, content and request_id.
    """
    answered = docs.join(
        responses.select("request_id", "response", "error"), "request_id", "left"
    ).withColumn("update", outcomes.doc_update("response"))
    status = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("update.needs_update"), F.lit("changed")).otherwise(F.lit("no_update"))
    )
    return _outcome_rows(answered.withColumn("proposal", F.col("update.content")), status)


def refactor_pipeline(
    files: DataFrame, responses: DataFrame, marker: str = C.MARKER, compat: str = "reference",
) -> DataFrame:
    """Outcome rows of a refactor run over directories: every proposal is applied."""
    answered = files.join(
        responses.select("request_id", "response", "error"), "request_id", "left"
    )
    return _outcome_rows(
        with_proposals(answered, marker, compat), outcomes.refactor_status("error", "proposal")
    )


def refactor_results(
    files: DataFrame, responses: DataFrame, marker: str = C.MARKER, compat: str = "reference",
) -> DataFrame:
    """Result record per file: proposal, full-replacement flag, whether to confirm, reply error.

    A proposal that changes nothing falls back to the original and needs no confirmation.
    """
    answered = files.join(
        responses.select("request_id", "response", "error"), "request_id", "left"
    )
    rows = with_proposals(answered, marker, compat)
    nothing = (F.col("proposal") == "") | outcomes.is_no_change("proposal", "content")
    failed = F.col("error").isNotNull()
    return rows.select(
        "repo", "path", "request_id",
        F.when(~failed, F.when(nothing, F.col("content")).otherwise(F.col("proposal"))).alias(
            "proposed_content"
        ),
        (~failed & (F.size("edits") == 0) & (F.col("proposal") != "")).alias("is_full_replacement"),
        (~failed & ~nothing).alias("needs_confirmation"),
        F.col("error").alias("reply_error"),
    )


def _outcome_rows(rows: DataFrame, status) -> DataFrame:
    return rows.withColumn("status", status).select(
        "repo", "path", "request_id", "status",
        F.when(F.col("status") == "changed", F.col("proposal")).alias("new_content"),
        F.col("content").alias("old_content"),
    )


def outcome_diffs(outcomes_df: DataFrame) -> DataFrame:
    """Line diffs of the changed files."""
    return outcomes_df.where(F.col("status") == "changed").select(
        "repo", "path", "request_id", F.inline(diff_ops("old_content", "new_content"))
    )
