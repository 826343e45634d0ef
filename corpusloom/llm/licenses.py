"""License scans: phrases, and an exact set-similarity join of text blocks to templates.

A block is any run of words of the text, up to twice as long as the template; line breaks
don't matter. A template is contained in a block if enough of its distinct words are:
words are ordered by how rare they are in the whole corpus, so that a block must have one
of the few rarest words of a template (prefix filter). The distinct words around each of
those must be as many as the template needs (length filter), and those that come after it
in the order must be enough for the rest (positional filter), before the blocks there are
counted. Column expressions and joins only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_by_size, written

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
CONTAINMENT = 0.92
#: Words of a block, at most, for each word of the template.
STRETCH = 2

#: Phrases and their labels, as the contract fixes them.
PHRASES: dict[str, str] = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Well-known notices and sentences of them, by label.
TEMPLATES: dict[str, str] = {
    "agpl-3.0": "licensed under the GNU Affero General Public License, version 3",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. The software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, "
        "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether "
        "in an action of contract, negligence or other tortious action, arising out of or in connection with the use or "
        "performance of this software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. The Software is provided as is, without warranty of any kind, express or implied, including but not "
        "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event "
        "shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
        "of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other "
        "dealings in the Software."
    ),
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-release": "Released under the MIT License",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions"
    ),
}


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(_text_words(text))) for label, text in templates.items()}


def _text_words(text: str) -> list[str]:
    import re

    return re.findall("[0-9a-z]+", text.lower())


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATORS), "")


def word_ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The vocabulary of the templates, rarest first, each with the number of documents that have it.

    Every document is counted; what comes back has a row for each word of the vocabulary.
    """
    has = F.array_intersect(F.array(*map(F.lit, vocabulary)), _words(_lowered(F.col("text"))))
    counts = docs.select(F.explode(has).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return {w: found.get(w, 0) for w in sorted(vocabulary, key=lambda w: (found.get(w, 0), w))}


def similar_blocks(docs: DataFrame, templates: dict[str, str], containment: float = CONTAINMENT) -> DataFrame:
    """(key, at, label, share): places of ``docs`` (key, text) where a block contains enough of a template.

    ``at`` is the place of a rare word of the template, ``share`` the largest of a block near it.
    A template without words is in no block.
    """
    words = {label: ws for label, ws in template_words(templates).items() if ws}
    spark = docs.sparkSession
    spans = {label: STRETCH * len(_text_words(templates[label])) for label in words}
    counts = word_ranks(docs, sorted({w for ws in words.values() for w in ws})) if words else {}
    rank = {w: i for i, w in enumerate(counts)}
    entries = []
    for label, ws in sorted(words.items()):
        ws = sorted(ws, key=rank.__getitem__)
        need = math.ceil(containment * len(ws) - 1e-9)
        prefix = ws[:len(ws) - need + 1]
        # A word that no document has starts nothing, but it is one of the words that may be missing.
        entries += [(w, label, spans[label], need, len(ws) - 1 - k, ws) for k, w in enumerate(prefix) if counts[w]]
    if not entries:
        return docs.where("false").select("key", F.lit(0).alias("at"), F.lit("").alias("label"), F.lit(0.0).alias("share"))
    index = spark.createDataFrame(entries, "word string, label string, span int, need int, after int, words array<string>")
    starts = sorted({e[0] for e in entries})
    # How far a block with this word reaches, and the fewest words it must have: the least of its templates'.
    reach = {w: max(e[2] for e in entries if e[0] == w) for w in starts}
    least = min(e[3] for e in entries)
    order = F.array(*map(F.lit, counts))
    low = docs.select("key", _lowered(F.col("text")).alias("low"))

    def may_have_one(text: str) -> Column:  # cheap, before anything is split
        return _any([F.contains(F.col(text), F.lit(w)) for w in starts])

    def reached(word: Column) -> Column:
        wide = F.lit(max(reach.values()))
        for r in sorted(set(reach.values()) - {max(reach.values())}):
            wide = F.when(word.isin([w for w in starts if reach[w] == r]), F.lit(r)).otherwise(wide)
        return wide

    places = F.transform("all", lambda w, i: F.when(w.isin(starts), F.struct(i.alias("at"), w.alias("word"))))
    rare = (
        low.where(may_have_one("low")).select("key", _words(F.col("low")).alias("all"))
        .where(F.arrays_overlap("all", F.array(*map(F.lit, starts))))
        .select("key", "all", F.explode(F.array_compact(places)).alias("place"))
        .select("key", "all", "place.at", "place.word", reached(F.col("place.word")).alias("reach"))
        .select("key", "at", "word", F.slice(
            "all", F.greatest(F.lit(1), F.col("at") + 2 - F.col("reach")),
            F.least(F.col("at") + 1, F.col("reach")) + F.col("reach") - 1).alias("near"))
        # Distinct words near, rarest first, as templates are.
        .withColumn("ordered", F.array_intersect(order, "near")).where(F.size("ordered") >= least)
        .withColumn("follow", F.size("ordered") - F.array_position("ordered", F.col("word")).cast("int"))
    )
    # Where a block has none of the rarer words of the template, its overlap is this word and what follows
    # in both orders; where it has one, that word's place finds it.
    position = F.least(F.col("after"), F.col("follow")) + 1 >= F.col("need")
    close = (
        rare.join(F.broadcast(index), "word").where((F.size("ordered") >= F.col("need")) & position)
        .where(F.size(F.array_intersect("words", "ordered")) >= F.col("need"))
    )
    # A fullest block can start at a word of the template, or is the last whole one.
    begin = F.filter(
        F.transform("near", lambda w, i: F.when(F.array_contains("words", w), i + 1)), lambda i: i.isNotNull())
    blocks = F.transform(begin, lambda i: F.size(F.array_intersect("words", F.slice("near", i, F.col("span")))))
    return (
        close.withColumn("overlap", F.array_max(blocks)).where(F.col("overlap") >= F.col("need"))
        .select("key", "at", "label", (F.col("overlap") / F.size("words")).alias("share"))
    )


def phrase_places(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word and base (array of labels)."""
    low = _lowered(F.col("text"))
    ends = {p.split()[-1] for p in PHRASES}
    words = F.when(_any([F.contains(low, F.lit(e)) for e in sorted(ends)]), _words(low))
    columns = list(docs.columns)
    counted = docs.select(*columns, F.size(_words(low)).cast("long").alias("n_words"), words.alias("__w"))
    w = F.col("__w")
    found = {}
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        last = F.size(w) - len(parts)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last))
        found[label] = F.coalesce(F.filter(starts, _starts_with(w, parts)), F.array().cast("array<int>"))
    placed = counted.select(*columns, "n_words", *[v.alias(f"__{k}") for k, v in found.items()])
    every = F.concat(*[F.col(f"__{k}") for k in found])
    labels = F.array_compact(F.array(*[F.when(F.size(f"__{k}") > 0, F.lit(k)) for k in sorted(found)]))
    return placed.select(
        *columns, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))


def _starts_with(words: Column, parts: list[str]):
    return lambda i: _all([F.get(words, i + k) == part for k, part in enumerate(parts)])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for one in conditions[1:]:
        out = out | one
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for one in conditions[1:]:
        out = out & one
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``labels`` adds those of all templates that some block contains to ``containment``;
    ``score`` is 1 with a phrase, else the largest share of a template found, else 0.
    Null and empty texts have no words and no labels. Rows with equal id and text get
    equal results, a null doc_id stays.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Whole rows are the key: id, whether there is one, and a hash of the text.
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("text"))
    matches = (
        similar_blocks(rows.select(key.alias("key"), "text"), templates or TEMPLATES, containment).groupBy("key")
        .agg(F.sort_array(F.collect_set("label")).alias("more"), F.max("share").alias("share"))
    )
    matches = written(matches, "licenses")  # read twice below
    placed = phrase_places(rows).withColumn("key", key).drop("text")
    joined = join_by_size(placed, matches, ["key"], F.lit(256), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
