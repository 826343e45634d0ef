"""Outcomes of replies and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import as_column, n_bytes, trim


def doc_update(reply) -> Column:
    """struct<needs_update, content> of a docs reply: the sentinel and an empty reply need none."""
    text = trim(reply)
    needs = (text != "") & (text != C.NO_UPDATE)
    return F.struct(
        needs.alias("needs_update"),
        F.when(text == C.NO_UPDATE, F.lit("")).otherwise(text).alias("content"),
    )


def commit_message(reply) -> Column:
    """The proposed commit message: the reply without white space around it."""
    return trim(reply)


def is_no_update(reply) -> Column:
    return trim(reply) == C.NO_UPDATE


def is_no_change(proposal, original) -> Column:
    """A refactor proposal that changes nothing: tiny, says so, or equals the original."""
    proposal = as_column(proposal)
    return (
        (n_bytes(proposal) < C.MIN_PROPOSAL_BYTES)
        | F.contains(F.lower(proposal), F.lit(C.NO_CHANGES_PHRASE))
        | (proposal == as_column(original))
    )


def docs_status(
    lang, reply, error, proposal, confirmed, dry_run: bool = False, force: bool = False
) -> Column:
    """skipped, error, changed or processed for one file of a docs run."""
    if dry_run or force:
        applied = F.lit("changed")
    else:
        applied = F.when(F.coalesce(as_column(confirmed), F.lit(False)), F.lit("changed")).otherwise("skipped")
    return (
        F.when(as_column(lang) != "markdown", F.lit("not_markdown"))
        .when(as_column(error).isNotNull(), F.lit("error"))
        .when(is_no_update(reply), F.lit("no_update"))
        .when(F.coalesce(as_column(proposal), F.lit("")) == "", F.lit("processed"))
        .otherwise(applied)
    )


def refactor_status(error, proposal) -> Column:
    """error, changed or processed for one file of a refactor run over a directory."""
    return (
        F.when(as_column(error).isNotNull(), F.lit("error"))
        .when(F.coalesce(as_column(proposal), F.lit("")) != "", F.lit("changed"))
        .otherwise("processed")
    )


def run_summary(outcomes: DataFrame, keys: list[str] = ("repo",)) -> DataFrame:
    """Processed, changed, error and skipped counts; ``status`` as in the functions above."""
    status = F.col("status")
    return outcomes.groupBy(*keys).agg(
        F.count_if(status != "not_markdown").alias("processed"),
        F.count_if(status == "changed").alias("changed"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(status.isin("not_markdown", "no_update", "skipped")).alias("skipped"),
    )
