"""SQL (DuckDB) for the rows of those queries that SQL can express."""

from __future__ import annotations


def _ledger() -> str:
    from corpusloom.llm.quality_rules import BULLET, ELLIPSIS, LETTER, RULES, STOP_WORDS

    failed = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w) t
), again AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) t WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM again) t GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(ws, lambda x: list_contains({list(STOP_WORDS)!r}, x))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '{LETTER}'))) AS BIGINT) AS n_letter_words,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{BULLET}'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, CAST({failed} AS BIGINT) AS failed, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)"""


def op4_quality_rules() -> str:
    from corpusloom.llm.quality_rules import CURRENT, mask

    return f"""{_ledger()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (failed & {mask(CURRENT)}) = 0) AS kept, failed, '{CURRENT}' AS policy
FROM f"""


def quality_ablations() -> str:
    from corpusloom.llm.quality_rules import POLICIES, bit, mask

    rules = ", ".join(f"('{v}', '{r}', {bit(r)}, {mask(v)})" for v, own in POLICIES.items() for r in own)
    return f"""{_ledger()}
SELECT policy, rule, count(*) FILTER ((failed & b) <> 0) AS n_failed, count(*) FILTER ((failed & m) = b) AS n_only,
  count(*) FILTER ((failed & m & ~b) = 0) AS n_kept_without
FROM f, (VALUES {rules}) r(policy, rule, b, m) GROUP BY policy, rule"""


def op10_license_scan() -> str:
    from math import ceil

    from corpusloom.llm.licenses import CONTAINMENT, PHRASES, STRETCH, TEMPLATES, _text_words, template_words

    values = ", ".join(
        f"('{label}', {words!r}, {STRETCH * len(_text_words(TEMPLATES[label]))}, {ceil(CONTAINMENT * len(words) - 1e-9)})"
        for label, words in template_words(TEMPLATES).items())
    place = {
        label: f"list_filter(generate_series(1, len(ws) - {phrase.count(' ')}), lambda i: "
        + " AND ".join(f"ws[i + {k}] = '{part}'" for k, part in enumerate(phrase.split())) + ")"
        for phrase, label in PHRASES.items()
    }
    every = "list_concat(" * 2 + "mit, apache), gpl)"
    base = ", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in sorted(place))
    return rf"""
WITH t(label, tokens, span, need) AS (VALUES {values}), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), p AS (
  SELECT r, doc_id, len(ws) AS n, {", ".join(f"{sql} AS {label}" for label, sql in place.items())} FROM d
), b AS (
  SELECT r, label, span, need, tokens, ws FROM d, t WHERE len(list_intersect(tokens, ws)) >= need
), w AS (
  SELECT r, label, span, need, len(tokens) AS size, i, ws[i] AS word
  FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM b) x WHERE list_contains(tokens, ws[i])
), s AS (
  SELECT a.r, a.label, a.i, any_value(a.need) AS need, count(DISTINCT z.word) / any_value(a.size) AS share, count(DISTINCT z.word) AS got
  FROM w a JOIN w z ON a.r = z.r AND a.label = z.label AND z.i >= a.i AND z.i < a.i + a.span GROUP BY a.r, a.label, a.i
), h AS (
  SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM s WHERE got >= need GROUP BY r
), f AS (
  SELECT *, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p LEFT JOIN h USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM f"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_lexical_search() -> str:
    terms = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {terms} AS ws FROM documents
), s AS (
  SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d
), i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct({terms}) AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark) t
), q AS (
  SELECT item, item_id, unnest(ts) AS term FROM i
), tf AS (
  SELECT r, doc_id, size, term, count(*) AS tf
  FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS size, unnest(ws) AS term FROM d) t
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, n, l, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) t, s
), scored AS (
  SELECT item, item_id, r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def op12_resampling() -> str:
    from corpusloom.llm.resampling import BUCKETS, MIN_WORDS, PERCENT, SEED

    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH c AS (  -- the table of the checksum, one entry for each byte
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b) x
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents
), f AS (
  SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d
), b AS (
  SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f
  FROM (SELECT {words} AS ws FROM benchmark) t
), h AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1),
    lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)), lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)]))) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM b) u) v, c
), src AS (
  SELECT bucket, count(*) AS n FROM f JOIN h USING (f) GROUP BY bucket
), tgt AS (
  SELECT bucket, count(*) AS n FROM b JOIN h USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(tgt.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM src), 0) + {BUCKETS})::DOUBLE)
    / ((src.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM tgt), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM src LEFT JOIN tgt USING (bucket)
), m AS (
  SELECT r, count(*) AS n_features, sum(gain) AS total FROM f JOIN h USING (f) JOIN g USING (bucket) GROUP BY r
), s AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce(floor(total::DOUBLE / n_features::DOUBLE), 0) AS BIGINT) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (r)
), e AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s
), k AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
    {PERCENT} * count(*) FILTER (n_words >= {MIN_WORDS}) OVER () // 100 AS drawn
  FROM e
)
SELECT doc_id, n_words, n_features, weight, score,
  CAST(CASE WHEN n_words >= {MIN_WORDS} AND place <= drawn THEN place END AS BIGINT) AS rank
FROM k"""
