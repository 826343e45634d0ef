"""One query for each operator of this subpackage, and the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers

from corpusloom.llm import oracles
from corpusloom.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}
PIECE_MODEL = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    sql = getattr(oracles, fn.__name__, None)
    if sql:
        ORACLES[fn.__name__] = sql()
    return fn


@query
def op2_token_counts(spark, sf_dir):
    from corpusloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@query
def op5_sentencepiece(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.llm.piece_coding import code_documents

    coded = code_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_toxicity(spark, sf_dir):
    from corpusloom.llm.toxicity import fit, grade_documents

    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_language_id(spark, sf_dir):
    from corpusloom.llm.languages import fit, predict_languages

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs))


@query
def op4_quality_rules(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.llm.quality_rules import CURRENT, judged

    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed",
        F.lit(CURRENT).alias("policy"))


@query
def quality_ablations(spark, sf_dir):
    from corpusloom.llm.quality_rules import ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents")))


@query
def op10_license_scan(spark, sf_dir):
    from corpusloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.llm.secrets import fit, scan_secrets

    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op1_decontamination(spark, sf_dir):
    from corpusloom.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_near_dedup(spark, sf_dir):
    from corpusloom.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op6_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.llm.substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_lexical_search(spark, sf_dir):
    from corpusloom.llm.lexical import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_resampling(spark, sf_dir):
    from corpusloom.llm.resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_quality_classifier(spark, sf_dir):
    from corpusloom.llm.quality_model import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
