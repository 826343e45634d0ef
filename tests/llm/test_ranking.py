"""Lexical search, resampling and its sort, quality classifier: edge cases, and each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical, quality_model, resampling
from corpusloom.llm.common import table
from corpusloom.llm.sample_sort import ranks

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score long, rank int, high long, low long, "
          "run long, place long, segment int, key long, item long, label long, held_out boolean, n_words long")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def best_documents(docs, items):
    """The contract of the ranked search, plainly."""
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in rows:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scored.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(s for s in scored if s[0] < 0)[:10], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


def test_search_as_plain(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(400)] + ["Straße", "日本", "a1", "THE"]
    text = lambda n: " ".join(draw.choice(words) + draw.choice(["", ".", "-"]) for _ in range(n))
    copies = text(30)
    docs = [(i, text(int(draw.paretovariate(0.7)) % 3000)) for i in range(700)]
    docs += [(1000 + i, copies) for i in range(60)] + [(7, None), (None, copies), (8, ""), (9, "  .\x00"), (1000, copies), (None, None)]
    items = [(i, text(draw.randint(1, 40))) for i in range(25)] + [(90, copies), (90, copies), (91, None), (92, ""), (None, "the"), (93, "nowhere2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = best_documents(docs, items)
    for block_bytes, block_docs, seeds, query_terms in ((1 << 21, 1024, 16, 1 << 17), (3000, 7, 1, 60)):
        index = lexical.build_index(frame, block_bytes, block_docs)
        got = lexical.search(index, asked, query_terms, seeds).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_bounds_hold_and_exclude():
    draw = random.Random(5)
    docs = []
    for i in range(300):
        words = [b"t%d" % int(draw.paretovariate(0.5)) for _ in range(draw.randint(1, 400))]
        memo = lexical.word_memo()
        docs.append((i, len(words), *np.unique(lexical.word_hashes(words, memo), return_counts=True)))
    names = lexical._INDEX.replace(",", "").split()[::2]
    row = dict(zip(names, lexical._block(docs, max(lexical._width(d[3]) for d in docs))))
    asked = np.unique(lexical.word_hashes([b"t5", b"t77", b"t120", b"t3000", b"absent"], lexical.word_memo()))
    queries = lexical.Queries([1], asked, [np.arange(len(asked))]).weighted(np.array([3, 40, 2, 9, 0]), 300, sum(d[1] for d in docs))
    best = [lexical._Best(0)]
    scored = lexical.search_block(row, queries, best)
    assert scored < len(docs) / 2  # most documents are excluded by their bounds
    exact = []
    for i, size, own, counts in docs:
        reach = [lexical._reach(int(counts[own == t][0]), 8 * (10 + 90 * size * 300 // queries.n_terms)) if (own == t).any() else 0 for t in asked]
        exact.append((-int((queries.weights * reach).sum()), i))
    want = [(-s, i) for s, i in sorted(exact)[:10] if s]
    assert list(zip(best[0].scores.tolist(), best[0].ids.tolist())) == want


@pytest.mark.parametrize("rows, first, segments, run_rows, sample_keys", [
    (5000, None, 13, 300, 1 << 19), (5000, 1234, 13, 300, 40), (900, 0, 4, 1 << 20, 1 << 19), (3, None, 8, 1, 1 << 19), (0, 5, 4, 10, 10)])
def test_ranks(spark, rows, first, segments, run_rows, sample_keys):
    draw = random.Random(rows)
    keys = [(draw.choice([0, 0, 0, draw.randint(-9, 9)]), draw.randint(0, 50), i) for i in range(rows)]  # a hot key
    frame = spark.createDataFrame(keys, "high long, low long, own long").repartition(6)
    out = ranks(frame, first, segments, run_rows, sample_keys)
    got = out.collect()
    assert sorted(r["own"] for r in got) == list(range(rows))
    given = sorted((r["rank"], r["high"], r["low"]) for r in got if r["rank"] is not None)
    want = sorted(k[:2] for k in keys)[:rows if first is None else first]
    assert given == [(i + 1, *k) for i, k in enumerate(want)]


def test_segments_are_even_whatever_the_keys(spark):
    frame = spark.createDataFrame([(0, 0, i) for i in range(20_000)], "high long, low long, own long").repartition(4)
    out = ranks(frame, segments=10, run_rows=1000)
    sizes = out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).filter(bool).collect()
    assert max(sizes) <= 3200 and out.count() == 20_000


def test_resampling_as_plain(spark):
    draw = random.Random(9)
    words = [f"x{draw.randint(0, 300)}" for _ in range(200)] + ["É", "日本語", "9"]
    text = lambda n: " ".join(draw.choice(words).upper() + draw.choice(["", ",", "?"]) for _ in range(n))
    docs = [(i, text(draw.randint(0, 60))) for i in range(400)] + [(5, None), (None, text(40)), (None, None), (3, ""), (900, "one"), (3, text(30))]
    target = [(1, text(50)), (2, None), (3, "x1 x2 x3")]

    def features(t):
        w = terms(t)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    own, aim = Counter(b for _, t in docs for b in features(t)), Counter(b for _, t in target for b in features(t))
    s, t = sum(own.values()), sum(aim.values())
    rows = []
    for doc_id, body in docs:
        f = features(body)
        gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(terms(body)), len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for rank, row in enumerate(able[:25 * len(able) // 100], 1):
        row[5] = rank
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = resampling.resampled(frame, spark.createDataFrame(target, "item_id long, text string")).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, rows))


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_model.fit(docs, labels)
    got = quality_model.score_documents(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in unseen) >= 0.95 * len(unseen)
    poor = [r for r in unseen if r["quality"] == 0]
    assert sum(r["predicted"] == 0 for r in poor) >= 0.85 * len(poor)
    # Labels of held-out rows don't matter.
    flipped = labels.withColumn("quality", labels.quality.cast("int") * 0 + 1).where(quality_model.held_out()).unionByName(labels.where(~quality_model.held_out()))
    again = quality_model.fit(docs, flipped)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.layers[0], again.layers[0])


def test_word_vectors_as_plain(spark):
    texts = ["a b c a a a", "c a b", "b, b", None, "", "zz Zz ZZ 12 a1"]
    vocabulary = quality_model.Vocabulary([b"a", b"b", b"c", b","])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(1)
    index, memo = vocabulary.index_vectors(), vocabulary.memo()
    want = np.zeros((len(vocabulary.words), quality_model.DIMENSIONS))
    seen = Counter()
    for text in texts:
        numbers = [memo[t] for t in quality_model.tokens_of(text.encode() if text else None)]
        for i, w in enumerate(numbers):
            seen[w] += 1
            for j in range(max(0, i - 2), min(len(numbers), i + 3)):
                if i != j:
                    want[w] += index[numbers[j]]
    for w, n in seen.items():
        want[w] += 2 * ((n + 1) // 2) * index[w]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(quality_model.word_vectors(frame, vocabulary), want / np.where(length > 0, length, 1), atol=1e-6)


LONG = " ".join(f"w{i % 997} the" for i in range(30_000))


def test_edge_cases(spark):
    texts = [None, "", "   \n", "one", "x " * 40, LONG, "y" * 100_000, "日本語\u0000😀 ▁ a  b ", LONG]
    clash = (None, None, None, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, True, 1)
    rows = [(i, t, *clash) for i, t in enumerate(texts)] + [(5, LONG, *clash), (None, LONG, *clash), (None, None, *clash)]
    docs, empty = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (1, LONG)], "item_id long, text string")
    none = items.limit(0)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert lexical.ranked_documents(empty, items).count() == 0 and lexical.ranked_documents(docs, none).count() == 0
    found = lexical.ranked_documents(docs, items).collect()
    assert [(r["item_id"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 5), (1, 5), (1, 8), (1, None)]
    for target in (items, none):
        assert resampling.resampled(empty, target).count() == 0
        got = resampling.resampled(docs, target).collect()
        assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == [1]
    for truth in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality_model.fit(docs, truth)
        assert quality_model.score_documents(empty, model).count() == 0
        got = quality_model.score_documents(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert isinstance(quality_model.fit(empty, labels), float)
