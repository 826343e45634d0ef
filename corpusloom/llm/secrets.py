"""Secret scans: patterns, and a small character convolutional network for what they miss.

Every token as long as the shortest finding is a candidate. The network sees the token
with its surroundings, a long one in overlapping windows. It is fitted on the values of
findings (labelled 1) and on other candidates (labelled 0). A candidate never has what the
patterns look for, so the key word and the fixed prefix of a finding are cut out, and its
value also appears in other alphabets, behind other names and in other surroundings, as
ordinary words do in the forms that identifiers, paths and dates have. All labelled tokens
of all rows take part: shards of them are learned by tasks, and the mean of their networks
goes on to the next round. The output is calibrated on tokens held back, and the threshold keeps a stated share of those; what is
found of a kind that was not learned is measured by ``unseen_kinds``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, text_batches, written

#: The patterns and least lengths of the contract.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "net")

#: As long as the shortest finding; a dot at either end belongs to the sentence.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")
BEFORE, INSIDE, AFTER = 24, 40, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a labelled row; a token with more of them is several rows.
LEARNED_WINDOWS = 3
#: Forms in which each token that is held back is scored.
FORMS = 4
#: Labelled tokens that one task learns from, about, in each round, and those it takes at a time.
SHARD_TOKENS, CHUNK = 80_000, 4096
#: Learning rates of the rounds, and forms that a shard with few tokens learns in a round at least.
RATES, LEAST_FORMS = (0.01, 0.003), 60_000
#: Outputs are counted in steps of this part for calibration.
STEPS = 1024
RECALL = 0.98
FILTERS, REACH, EMBEDDING = 16, 5, 8
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens that may be secrets and that no pattern span touches."""
    return [(start, end) for start, end, touched in _tokens(text, base) if not touched]


def _tokens(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a pattern span touches it) of every token that is long enough."""
    k, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:  # by start
            reach = max(reach, base[k][1])
            k += 1
        yield start, end, reach > start


def windows_of(text: str, start: int, end: int, most: int | None = None) -> list[bytes]:
    """Windows that overlap by half and together see the whole token (the first ``most``)."""
    last = max(start, end - INSIDE)
    at = [*range(start, last, INSIDE // 2), last][:most]
    return [window(text, i, min(i + INSIDE, end)) for i in at]


def window(text: str, start: int, end: int) -> bytes:
    """A token with its surroundings, of fixed width; other characters than ASCII are 0x7f.

    Surroundings have the high bit set, so that the network can tell them from the token.
    """
    before, inside, after = _parts(text, start, end)
    return before.translate(_OUTSIDE) + inside[:INSIDE].ljust(INSIDE) + after.translate(_OUTSIDE)


def _parts(text: str, start: int, end: int) -> tuple[bytes, bytes, bytes]:
    """What stands before a token, the token, and what stands after it, in the network's characters."""
    around = text[max(0, start - BEFORE):start].rjust(BEFORE), text[start:end], text[end:end + AFTER].ljust(AFTER)
    return tuple(part.translate(_PLAIN).encode("ascii", "replace") for part in around)


class _Plain(dict):
    def __missing__(self, c):
        return 0x7F if c > 126 else c


_PLAIN = _Plain()
_OUTSIDE = bytes(c | 128 for c in range(256))


@dataclass
class SecretNet:
    embedding: np.ndarray  # characters, inside and outside, x EMBEDDING
    kernel: np.ndarray  # REACH * EMBEDDING x FILTERS
    offset: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the output
    threshold: float = 1.1

    def _forward(self, x: np.ndarray):
        parts = self.embedding[x]
        patches = np.lib.stride_tricks.sliding_window_view(parts, REACH, axis=1)
        flat = patches.transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - REACH + 1, -1)
        maps = flat @ self.kernel + self.offset
        top = maps.argmax(1)
        pooled = np.maximum(np.take_along_axis(maps, top[:, None, :], 1)[:, 0], 0)
        return flat, top, pooled, pooled @ self.out + self.bias

    def probability(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.empty(0)
        raw = np.concatenate([self._forward(_codes(windows[i:i + 256]))[3] for i in range(0, len(windows), 256)])
        return _sigmoid(self.scale[0] * raw + self.scale[1])


def _codes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), WIDTH).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


_WEIGHTS = ("embedding", "kernel", "offset", "out")


def _new_net() -> SecretNet:
    draw = np.random.default_rng(7)
    return SecretNet(draw.normal(0, 0.3, (256, EMBEDDING)), draw.normal(0, 0.2, (REACH * EMBEDDING, FILTERS)),
                     np.zeros(FILTERS), draw.normal(0, 0.3, FILTERS))


class _Adam:
    """Steps on the log loss that change a network in place."""

    def __init__(self, net: SecretNet, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in _WEIGHTS}

    def learn(self, x: np.ndarray, labels: np.ndarray, share: np.ndarray) -> None:
        net, n = self.net, len(x)
        flat, top, pooled, raw = net._forward(x)
        pull = (_sigmoid(raw) - labels) * share / n
        back = pull[:, None] * net.out * (pooled > 0)  # rows x filters
        picked = flat[np.arange(n)[:, None], top]  # rows x filters x patch
        patch = (back[:, :, None] * net.kernel.T[None]).reshape(n, FILTERS, REACH, EMBEDDING)
        where = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(REACH)]
        spread = np.zeros_like(net.embedding)
        np.add.at(spread, where, patch)
        slopes = {"embedding": spread, "kernel": np.einsum("rf,rfp->pf", back, picked),
                  "offset": back.sum(0), "out": pooled.T @ pull}
        self.step += 1
        for k in _WEIGHTS:
            first, second = self.state[k]
            first += 0.1 * (slopes[k] - first)
            second += 0.001 * (slopes[k]**2 - second)
            change = (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.999**self.step)) + 1e-8)
            getattr(net, k)[...] -= self.rate * change
        net.bias -= self.rate * pull.sum()


def train(windows: list[bytes], labels: np.ndarray, epochs: int = 15, batch: int = 100, rate: float = 0.01) -> SecretNet:
    """A network by Adam on the log loss; the same rows give the same network."""
    draw, net = np.random.default_rng(7), _new_net()
    codes, steps = _codes(windows), _Adam(net, rate)
    share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            steps.learn(codes[rows], labels[rows], share[rows])
    return net


def calibrate(net: SecretNet, windows: list[bytes], labels: np.ndarray, recall: float = RECALL) -> None:
    """Scale the output to probabilities, and set the largest threshold with this recall.

    Each row is a token: its windows, one after the other; the largest output counts.
    """
    raw = _largest(net._forward(_codes(_apart(windows)))[3], [len(w) // WIDTH for w in windows])
    _scale(net, raw, labels, np.ones(len(raw)), recall)


def _scale(net: SecretNet, raw: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float) -> None:
    """``calibrate`` from outputs that come ``counts`` times each."""
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the log loss, held near one by a weak prior
        p = _sigmoid(a * raw + b)
        w, d = counts * (p * (1 - p) + 1e-6), counts * (p - labels)
        g = np.array([(d * raw).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a - da), b - db
    net.scale = (float(a), float(b))
    found = np.argsort(raw[labels > 0], kind="stable")
    many = np.cumsum(counts[labels > 0][found])
    k = np.searchsorted(many, np.floor((1 - recall) * many[-1] + 1e-9), "right")
    net.threshold = float(_sigmoid(a * raw[labels > 0][found[k]] + b))


def _apart(tokens: list[bytes]) -> list[bytes]:
    return [t[i:i + WIDTH] for t in tokens for i in range(0, len(t), WIDTH)]


def _largest(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """The largest of each run of ``counts`` values."""
    return np.maximum.reduceat(values, np.cumsum([0, *counts[:-1]])) if counts else np.empty(0)


def _finding_parts(text: str, span: tuple[int, int, str]) -> tuple[bytes, bytes, bytes]:
    """A finding without what its pattern looks for: before, value, after."""
    start, end, kind = span
    value = ASSIGN.match(text, start).start(2) if kind == "assign" else start + 4 if kind == "access" else start
    before, _, _ = _parts(text, start, start)
    _, inside, after = _parts(text, value, end)
    return before, inside, after


def _stretches(before: bytes, inside: bytes, after: bytes) -> Iterator[tuple[bytes, bytes, bytes]]:
    """A token as (before, stretch, after) for each ``LEARNED_WINDOWS`` of its windows, all of them."""
    step, at = LEARNED_WINDOWS * (INSIDE // 2), 0
    length = step + INSIDE // 2
    whole = before + inside + after
    while True:
        end = min(at + length, len(inside))
        yield whole[at:at + BEFORE], inside[at:end], whole[BEFORE + end:BEFORE + end + AFTER]
        if end == len(inside):
            return
        at = min(at + step, len(inside) - INSIDE)


_LABELLED = "kind int, token binary, rank long"


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, token, rank): the distinct labelled tokens of all rows, all of them, with their hash as rank.

    ``kind`` is the place in KINDS, the last one that of other candidates; a token has its
    surroundings in front. A long token is a row for each stretch of windows, whose surroundings
    are the token itself as in a scan, so that all its windows take part.
    """
    texts = docs.select(F.col("text").cast("string")).where("text IS NOT NULL")
    schema = arrow_schema(_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = {}

            def add(kind: int, parts: tuple[bytes, bytes, bytes]) -> None:
                for before, inside, after in _stretches(*parts):
                    found[kind, before + after + inside] = None

            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for span in base:
                    add(KINDS.index(span[2]), _finding_parts(text, span))
                for start, end in candidates(text, base):
                    add(3, _parts(text, start, end))
            ranks = [xxhash.xxh64_intdigest(token) - (1 << 63) for _, token in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind for kind, _ in found], pa.int32()), pa.array([token for _, token in found], pa.binary()),
                 pa.array(ranks, pa.int64())], schema=schema)

    return written(texts.mapInArrow(run, _LABELLED).distinct(), "secret-tokens")


def _token_parts(token: bytes) -> tuple[bytes, bytes, bytes]:
    return token[:BEFORE], token[BEFORE + AFTER:], token[BEFORE:BEFORE + AFTER]


_ALPHABETS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0123456789", b"0123456789ABCDEF",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
)


def _secret_form(parts, k: int, names: list[bytes], draw: np.random.Generator):
    """The k-th form of a value: as it is, then in other alphabets and lengths, behind names, in other surroundings."""
    before, inside, after = parts
    if k == 0:
        return parts
    if k > 1:
        letters = np.frombuffer(_ALPHABETS[draw.integers(len(_ALPHABETS))], np.uint8)
        codes = np.frombuffer(inside, np.uint8).astype(int)
        # The place counts as well, so that 16 characters become those of the whole alphabet.
        inside = letters[(codes * 7 + draw.integers(0, 1 << 16, len(codes))) % len(letters)].tobytes()
        inside = inside[:int(draw.integers(min(ASSIGN_VALUE, len(inside)), len(inside) + 1))]
    name = names[draw.integers(len(names))].lower()[:int(draw.integers(2, 9))]
    lead = (b"", b"", name + b"=", name + b"_", name + b"-", name[:3] + b"_" + name[3:] + b"=")[draw.integers(6)]
    around = (before, b" " * BEFORE, name + b": ", name + b' = "')[draw.integers(4)]
    return around.rjust(BEFORE)[-BEFORE:], lead + inside, after


def _ordinary_form(parts, k: int, names: list[bytes], draw: np.random.Generator):
    """The k-th form of an ordinary token: as it is, then joined with others as identifiers, paths, names and dates are."""
    before, inside, after = parts
    if k == 0:
        return parts
    one, two, three = (names[i].lower() for i in draw.integers(len(names), size=3))
    year, part = b"%d" % draw.integers(1950, 2050), b"%d" % draw.integers(100)
    inside = (
        one + b"_" + two, one + b"-" + two + b"-" + three, one + b"/" + two + b"." + three[:4], one.title() + two.title(),
        one + two.title() + part, one.upper() + b"_" + two.upper(), one + b"=" + two, year + b"-" + part + b"-" + one,
        one + b"_" + part, b"/".join((one, year, part, two)), inside.upper(), inside.title(), one + b"-" + year,
    )[draw.integers(13)]
    around = (before, b" " * BEFORE, one + b": ", two + b' = "')[draw.integers(4)]
    return around.rjust(BEFORE)[-BEFORE:], inside, after


def _cut_up(parts) -> bytes:
    """The windows of a token, one after the other."""
    text = b"".join(parts).decode("latin-1")
    return b"".join(windows_of(text, len(parts[0]), len(parts[0]) + len(parts[1]), LEARNED_WINDOWS))


def _by_chunk(rows: DataFrame, work, out: str) -> DataFrame:
    """``work(shard, chunks)`` for each shard of labelled tokens, which gives rows of ``out``.

    Shards and the chunks of a shard, lists of (kind, parts), follow from the rows alone,
    however these are partitioned. A task holds one chunk at a time.
    """
    shards = max(1, math.ceil(rows.count() / SHARD_TOKENS))
    schema = arrow_schema(out)
    shard = F.pmod(F.xxhash64("rank"), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), "kind", "token", "rank").repartition(shards, "shard").sortWithinPartitions(
        "shard", "rank", "token", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "token"))) for batch in batches)
        for shard, own in groupby(chain.from_iterable(columns), key=lambda row: row[0]):
            parts = ((kind, _token_parts(token)) for _, kind, token in own)
            yield pa.RecordBatch.from_pylist(list(work(shard, iter(lambda: list(islice(parts, CHUNK)), []))), schema=schema)

    return dealt.mapInArrow(run, out)


def _names(chunk) -> list[bytes]:
    return [p[1].strip(b"_-=+/.") or b"name" for kind, p in chunk if kind == 3] or [b"name"]


def _round(net: SecretNet, rows: DataFrame, turn: int, forms: int, secret_forms: int, weights: tuple[float, float]) -> SecretNet:
    """The mean of the networks that the shards make of ``net``, each by one pass over all its tokens."""

    def work(shard: int, chunks):
        own = SecretNet(*(getattr(net, k).copy() for k in _WEIGHTS), net.bias)
        draw, steps, n = np.random.default_rng([11, turn, shard]), _Adam(own, RATES[turn]), 0
        for chunk in chunks:
            names, n = _names(chunk), n + len(chunk)
            for k in range(forms):
                # The first form is the token as it is.
                cut = [(kind < 3, _cut_up(_ordinary_form(p, k + turn, names, draw) if kind == 3 else _secret_form(p, k + turn + i, names, draw)))
                       for kind, p in chunk for i in range(1 if kind == 3 else secret_forms)]
                codes = _codes(_apart([w for _, w in cut]))
                labels = np.repeat([float(x) for x, _ in cut], [len(w) // WIDTH for _, w in cut])
                share, order = np.where(labels > 0, weights[1], weights[0]), draw.permutation(len(labels))
                for at in range(0, len(order), 100):
                    some = order[at:at + 100]
                    steps.learn(codes[some], labels[some], share[some])
        values = np.concatenate([*(getattr(own, k).ravel() for k in _WEIGHTS), [own.bias]])
        yield {"shard": shard, "n": n, "weights": values.tobytes()}

    made = sorted(_by_chunk(rows, work, "shard int, n long, weights binary").collect())
    mean = np.average([np.frombuffer(r["weights"]) for r in made], axis=0, weights=[r["n"] for r in made])
    new, at = SecretNet(*(getattr(net, k).copy() for k in _WEIGHTS), float(mean[-1])), 0
    for k in _WEIGHTS:
        value = getattr(new, k)
        value[...] = mean[at:at + value.size].reshape(value.shape)
        at += value.size
    return new


def _learn(tokens: DataFrame, recall: float = RECALL) -> SecretNet | None:
    """A network of all labelled tokens: seven of ten are learned, the others calibrate it."""
    secret, held = F.col("kind") < 3, F.pmod("rank", F.lit(10)) < 3
    counts = {(r["secret"], r["held"]): r["count"] for r in tokens.groupBy(secret.alias("secret"), held.alias("held")).count().collect()}
    if len({label for label, _ in counts}) < 2:
        return None
    # Where a label has too few for both, they are learned from and held back.
    both = (secret & F.lit((True, True) not in counts or (True, False) not in counts)) | (
        ~secret & F.lit((False, True) not in counts or (False, False) not in counts))
    rows = tokens.where(~held | both)
    secrets, others = (counts.get((x, False), 0) or counts[x, True] for x in (True, False))
    secret_forms = max(1, round(others / (4 * secrets)))
    forms = max(1, math.ceil(LEAST_FORMS / (others + secrets * secret_forms)))
    total = others + secrets * secret_forms
    weights = total / (2 * others), total / (2 * secrets * secret_forms)
    net = _new_net()
    for turn in range(len(RATES)):
        net = _round(net, rows, turn, forms, secret_forms, weights)

    def work(shard: int, chunks):
        draw, seen = np.random.default_rng([12, shard]), Counter()
        for chunk in chunks:
            names = _names(chunk)
            cut = [(kind < 3, _cut_up((_ordinary_form if kind == 3 else _secret_form)(p, k, names, draw))) for kind, p in chunk for k in range(FORMS)]
            windows = _apart([w for _, w in cut])
            raw = np.concatenate([net._forward(_codes(windows[i:i + 256]))[3] for i in range(0, len(windows), 256)])
            steps = np.floor(_largest(raw, [len(w) // WIDTH for _, w in cut]) * STEPS).astype(int).tolist()
            seen.update(zip((x for x, _ in cut), steps))
        for (label, step), n in seen.items():
            yield {"secret": label, "step": step, "n": n}

    scored = _by_chunk(tokens.where(held | both), work, "secret boolean, step long, n long")
    # As many rows as there are steps in the range of outputs, whatever the number of tokens.
    steps = scored.groupBy("secret", "step").agg(F.sum("n").alias("n")).orderBy("secret", "step").collect()
    raw, labels, n = (np.array([float(r[c]) for r in steps]) for c in ("step", "secret", "n"))
    _scale(net, raw / STEPS, labels, n, recall)
    return net


def fit(docs: DataFrame) -> SecretNet | None:
    """A network of all labelled tokens of all rows; None without a token of either label.

    Every distinct finding and every other candidate is learned or calibrates the network;
    none is left out. Tasks learn a shard each, and the mean of their networks goes into
    the next round. Without a finding there is nothing to learn from, and without another
    token nothing to score.
    """
    return _learn(labelled(docs))


def unseen_kinds(docs: DataFrame) -> dict[str, tuple[int, float, float]]:
    """For each kind of pattern with findings: their number, the share that a network of the other
    kinds finds, and the share of other candidates that it takes for secrets."""
    tokens, out = labelled(docs), {}
    for kind in range(3):
        net = _learn(tokens.where(F.col("kind") != kind))
        if net is None:
            continue

        def work(shard: int, chunks, net=net):
            for chunk in chunks:
                cut = [_cut_up(p) for _, p in chunk]
                taken = _largest(net.probability(_apart(cut)), [len(t) // WIDTH for t in cut]) >= net.threshold
                yield from ({"kind": kind, "taken": bool(x)} for (kind, _), x in zip(chunk, taken))

        shares = {r["kind"]: (r["n"], r["share"]) for r in _by_chunk(
            tokens.where(F.col("kind").isin(kind, 3)), work, "kind int, taken boolean").groupBy("kind").agg(
                F.count("*").alias("n"), F.avg(F.col("taken").cast("double")).alias("share")).collect()}
        if kind in shares:
            out[KINDS[kind]] = (*shares[kind], shares[3][1])
    return out


def spans_of(texts: list[str], net: SecretNet | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: those of the patterns, and candidates the network takes."""
    spans = [base_spans(t) for t in texts]
    if net is not None:
        asked = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, spans[i])]
        windows = [windows_of(texts[i], s, e) for i, s, e in asked]
        scores = _largest(net.probability([w for own in windows for w in own]), [len(own) for own in windows])
        for (i, s, e), p in zip(asked, scores):
            if p >= net.threshold:
                spans[i].append((s, e, "net"))
    return [in_order(s) for s in spans]


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan_secrets(docs: DataFrame, net: SecretNet | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every row, whole texts.

    Spans are kind:start:end in code points, comma-joined. Null and empty texts have
    none; repeated rows are scanned row by row; a null doc_id stays. Without a network
    (no finding to learn from) there are the spans of the patterns alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = arrow_schema(_SCHEMA)

    def joined(spans) -> str:
        return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            spans = spans_of([t or "" for t in batch.column("text").to_pylist()], shared.value)
            counts = [pa.array([sum(s[2] == kind for s in own) for own in spans], pa.int64()) for kind in KINDS[:3]]
            base = [joined([s for s in own if s[2] != "net"]) for own in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(map(joined, spans), pa.string())],
                schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def redacted(docs: DataFrame, net: SecretNet | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mask; n_chars follows where there is one.

    Overlapping spans are masked together. Null texts stay null, other columns as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def masked(text: str | None, spans) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], MASK]
            at = max(at, end)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            spans = spans_of([t or "" for t in texts], shared.value)
            columns = batch.columns
            columns[at] = pa.array(list(map(masked, texts, spans)), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
