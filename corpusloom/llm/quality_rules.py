"""Quality rules as a ledger: measurements and one bit for each failed rule, once.

Policies are sets of rules with a version; applying one, or asking what a rule changes,
reads the bits and never the texts. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Rules by bit: name and the condition under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * word_chars"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("under_50_words", "n_words < 50"),
    ("over_100000_words", "n_words > 100000"),
    ("short_mean_word", "word_chars < 3 * n_words"),
    ("long_mean_word", "word_chars > 10 * n_words"),
    ("words_without_letters", "10 * n_letter_words < 8 * n_words"),
    ("few_stop_words", "n_stop_words < 2"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("some_symbols", "10 * n_symbols > word_chars"),
    ("some_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_distinct_words", "n_words >= 100 AND 10 * n_distinct_words < n_words"),
]
#: The usual English stop words, and the starts of bullet lines and ends of cut ones (of whole lines).
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
BULLET = "^[\\x20\\x09]*[-*\u2022]"
ELLIPSIS = "(\\.\\.\\.|\u2026)[\\x20\\x09\\x0D]*\\z"
LETTER = "\\p{L}"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_letter_words", "n_bullet_lines",
    "n_ellipsis_lines", "n_distinct_words", "n_repeat_words",
)
BASE = ("few_words", "repeated_words")
#: Rules of each version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "1": BASE,
    "2": (*BASE, "symbols", "repeated_lines", "long_words"),
    # For English prose; the stop words reject other languages.
    "3": (
        *BASE, "under_50_words", "over_100000_words", "short_mean_word", "long_mean_word", "words_without_letters",
        "few_stop_words", "bullet_lines", "ellipsis_lines", "some_symbols", "some_repeated_lines", "few_distinct_words"),
}
CURRENT = "2"


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(version: str) -> int:
    return sum(bit(rule) for rule in POLICIES[version])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``. Words, lines and windows are told apart by 64-bit hashes or whole."""
    keep = [F.col(f"d.{c}") for c in docs.columns]
    whole = F.coalesce(F.col(f"d.{text}").cast("string"), F.lit(""))
    # All measures travel in one struct, so that no column of the input can clash.
    words = docs.alias("d").select(*keep, F.struct(
        whole.alias("text"), F.array_remove(F.split(whole, SPACES), "").alias("words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    ).alias("__m"))
    m = lambda name: F.col("__m")[name]
    names = list(docs.columns)
    counted = words.select(*map(_quoted, names), F.struct(
        F.size(m("words")).cast("long").alias("n_words"),
        F.length(F.array_join(m("words"), "")).cast("long").alias("word_chars"),
        (F.size(F.split(m("text"), SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        F.size(m("lines")).cast("long").alias("n_lines"),
        (F.size(m("lines")) - F.size(F.array_distinct(m("lines")))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(m("words"), lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(m("words"), lambda w: w.rlike(LETTER))).cast("long").alias("n_letter_words"),
        F.size(F.filter(m("lines"), lambda line: line.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(m("lines"), lambda line: line.rlike(ELLIPSIS))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.array_distinct(m("words"))).cast("long").alias("n_distinct_words"),
        F.transform(m("words"), lambda w: F.xxhash64(w)).alias("hashes"),
    ).alias("__m"))
    kept = [name for name in MEASURES if name != "n_repeat_words"]
    starts = F.sequence(F.lit(0), F.size(m("hashes")) - WINDOW)
    windows = F.when(
        F.size(m("hashes")) > WINDOW,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(m("hashes"), i + j) for j in range(WINDOW)])),
    )
    carry = lambda: [m(k).alias(k) for k in kept]
    gram = counted.select(*map(_quoted, names), F.struct(*carry(), windows.alias("windows")).alias("__m"))
    # Only texts in which some window comes again are sorted.
    again = F.size(F.array_distinct(m("windows"))) < F.size(m("windows"))
    ordered = F.when(again, F.sort_array(F.transform(m("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    pairs = gram.select(*map(_quoted, names), F.struct(*carry(), ordered.alias("pairs")).alias("__m"))
    last = F.size(m("pairs")) - 1

    def repeated(pair: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(m("pairs"), k - 1)["h"] == pair["h"])
        return before | ((k < last) & (F.get(m("pairs"), k + 1)["h"] == pair["h"]))

    places = F.sort_array(F.transform(F.filter(m("pairs"), repeated), lambda pair: pair["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda done, i: F.struct((done["n"] + F.least(F.lit(WINDOW), i - done["last"])).alias("n"), i.alias("last")),
        lambda done: done["n"],
    )
    return pairs.select(
        *map(_quoted, names), *carry(), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def failed_bits() -> Column:
    """The bits of all rules, from the columns of ``measured``."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for one in bits[1:]:
        failed = failed.bitwiseOR(one)
    return failed.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, failed): every rule evaluated once on every whole text.

    ``failed`` has bit k set if rule k fails. A null text has no words and fails
    ``few_words``; an empty text likewise. Repeated rows give a row each, a null doc_id
    stays. Other columns of the input aren't read.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.select("doc_id", *MEASURES, failed_bits().alias("failed"))


def passes(failed: Column | str, version: str = CURRENT) -> Column:
    """Whether the bits have none of the rules of a policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without) from the bits of a ledger.

    ``n_only`` documents are rejected because of this rule alone; ``n_kept_without`` would
    be kept if the policy lacked it. Bits are counted first, one row for each
    combination, at most 2 to the number of rules.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    entries = [
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"),
                 F.lit(mask(v)).cast("long").alias("mask"))
        for v, rules in POLICIES.items() for r in rules
    ]
    each = counts.select("failed", "n", F.explode(F.array(*entries)).alias("e")).select("failed", "n", "e.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    return each.groupBy("policy", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0, "n_failed"),
        total(hit == F.col("bit"), "n_only"),
        total(hit.bitwiseAND(F.bitwise_not("bit")) == 0, "n_kept_without"),
    )


def judged(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept (no base failure, no failure of the policy)."""
    rows = ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(sum(map(bit, BASE))).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & passes("failed", version))
