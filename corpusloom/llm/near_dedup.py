"""Near duplicates: SuperMinHash signatures, banding, verification, union-find groups.

Rows with equal shingle sets are one class from the start. Classes that share a band are
candidates; links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import (
    Memo, arrow_schema, gram_hashes, mix, semi_by_size, shingle_set, text_batches, word_hashes, word_memo, words_of, written,
)
from corpusloom.llm.components import components

BANDS, ROWS = 25, 4
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree this much less than the threshold aren't verified: more
#: than five standard errors at 100 slots.
SLACK = 0.2
ELEMENTS = 1 << 15
#: Rows and shingles in a part of a bucket, about.
PART_ROWS, PART_SHINGLES = 1500, 1_500_000


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of 64-bit hashes.

    Each element visits the slots in an order of its own and brings the value ``step`` plus
    a fraction; a slot keeps its least. As all values of a step are larger than those of
    the step before, it ends once every slot has been reached.
    """
    least = np.full(slots, np.inf)
    for start in range(0, len(elements), ELEMENTS):
        _visit(elements[start:start + ELEMENTS], least)
    return least


def _visit(elements: np.ndarray, least: np.ndarray) -> None:
    slots, n = len(least), len(elements)
    order = np.broadcast_to(np.arange(slots, dtype=np.int16), (n, slots))
    rows = np.arange(n)
    for step in range(slots):
        if least.max() < step:
            return
        draw = mix(elements + np.uint64(2 * step + 1))
        fraction = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = step + (mix(draw) % np.uint64(slots - step)).astype(np.int64)
        if step == 0:
            slot = pick
            order = order.copy()
            order[rows, pick] = 0
        else:
            slot = order[rows, pick]
            order[rows, pick] = order[:, step]
        np.minimum.at(least, slot, step + fraction)


def signature_of(elements: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(two bytes for each slot, one 64-bit key for each band)."""
    bits = mix(super_minhash(elements).view(np.uint64))
    bands = mix(gram_hashes(bits, ROWS)[::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return bits.astype(np.uint16).tobytes(), bands.view(np.int64)


def _sets(texts: list[str | None], words: int, memo: Memo) -> list[np.ndarray]:
    return [shingle_set(word_hashes(words_of(t, lower=True), memo), words) for t in texts]


def _class_key(elements: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(elements.tobytes())


_SIGNED = "row_id long, class binary, n_shingles long, signature binary, bands array<long>"


def signed(rows: DataFrame, words: int) -> DataFrame:
    """(row_id, class, n_shingles, signature, bands) of (row_id, text); class null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memo = arrow_schema(_SIGNED), word_memo()
        for batch in text_batches(batches):
            sets = _sets(batch.column("text").to_pylist(), words, memo)
            signatures = [signature_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("row_id"), pa.array([_class_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(map(len, sets), pa.int64()), pa.array([s for s, _ in signatures], pa.binary()),
                pa.array([b for _, b in signatures], pa.list_(pa.int64())),
            ], schema=schema)

    return rows.mapInArrow(run, _SIGNED)


def _full_sets(rows: DataFrame, wanted: DataFrame, words: int, at_most: int) -> DataFrame:
    """(class, shingles) of the classes in ``wanted`` (row_id of one row of each; ``at_most`` so many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memo = arrow_schema("class binary, shingles array<long>"), word_memo()
        for batch in text_batches(batches):
            sets = _sets(batch.column("text").to_pylist(), words, memo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_class_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                schema=schema)

    return semi_by_size(rows, wanted, ["row_id"], at_most=at_most).mapInArrow(run, "class binary, shingles array<long>")


def _agreeing(pairs: DataFrame, signatures: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``share`` of the slots at least."""
    one = signatures.select(F.col("class").alias("a"), F.col("signature").alias("sa"))
    other = signatures.select(F.col("class").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sa", "sb")]
            same = (sides[0] == sides[1]).mean(1) >= share
            yield batch.select(["a", "b"]).filter(pa.array(same))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union on the full sets."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("xa"))
    other = sets.select(F.col("class").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return (
        pairs.join(one, "a").join(other, "b")
        .select("a", "b", both.alias("both"), (F.size("xa") + F.size("xb") - both).alias("either"))
    )


def _across(
    buckets: DataFrame, leaders: DataFrame, groups: DataFrame, classes: DataFrame, percent: int,
) -> tuple[DataFrame, DataFrame]:
    """What buckets with several groups still have to compare.

    (pairs (a, b) of different groups whose signatures agree enough, which may repeat, rows of dense cells).
    A bucket is cut into parts of bounded rows and shingles; a cell is two of its parts,
    compared by signature in one task. A pair counts in the first band it shares. A cell
    with many such pairs gives its rows (cell, class, root, side) and no pairs: they are
    linked by ``_dense_links``, which needs no row for each pair.
    """
    member = (
        buckets.join(leaders.select("key", "k", "total"), "key")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .select("key", "k", "total", "class", F.coalesce("root", "class").alias("root"))
    )
    mixed = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    parts = F.ceil(F.greatest(F.col("k") / PART_ROWS, F.col("total") / PART_SHINGLES)).cast("int")
    placed = (
        member.join(mixed, "key").withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("class", "key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("class", "root", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                (F.col("part") > F.col("other")).cast("long").alias("side"))
    )
    cells = placed.join(classes.select("class", "n", "signature", "bands"), "class")
    out = "a binary, b binary, key long, i int, j int, class binary, root binary, side long, n long, signature binary"
    kinds = arrow_schema(out)

    def compare(cell: pa.Table) -> pa.Table:
        c = {k: cell.column(k).combine_chunks() for k in cell.column_names}
        names, n, side = c["class"].to_pylist(), c["n"].to_numpy(), c["side"].to_numpy()
        low, high = _candidate_pairs(cell, percent, c["key"][0].as_py())
        if len(low) <= 4 * len(names) + 1000:
            data = {"a": [names[i] for i in low], "b": [names[i] for i in high]}
            return pa.table({f.name: pa.array(data.get(f.name, [None] * len(low)), f.type) for f in kinds})
        used = np.unique(np.concatenate([low, high]))
        return pa.table({f.name: c[f.name].take(pa.array(used)) if f.name in c else pa.nulls(len(used), f.type) for f in kinds})

    found = written(cells.groupBy("key", "i", "j").applyInArrow(compare, out), "across")
    pairs = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, found.where("a IS NULL").drop("a", "b")


def _candidate_pairs(cell: pa.Table, percent: int, key: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a cell of different groups that may be linked; of two sides if it has two."""
    column = lambda k: cell.column(k).combine_chunks()
    n, side = column("n").to_numpy(), column("side").to_numpy()
    root = np.unique(np.array(column("root").to_pylist(), object), return_inverse=True)[1]
    marks = np.frombuffer(b"".join(column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
    crossing = column("i")[0].as_py() != column("j")[0].as_py()
    before = None
    if key is not None:
        bands = column("bands").flatten().to_numpy().reshape(-1, BANDS)
        before = bands[:, :int(np.flatnonzero((bands == key).all(0))[0])]
    least = int(np.ceil((percent / 100 - SLACK) * SLOTS))
    lows, highs = [], []
    for start in range(0, len(n), 32):
        rows = np.arange(start, min(start + 32, len(n)))
        size = np.minimum(n[rows, None], n) * 100 >= percent * np.maximum(n[rows, None], n)
        able = size & (root[rows, None] != root) & (rows[:, None] < np.arange(len(n)))
        if crossing:
            able &= side[rows, None] != side
        x, y = np.nonzero(able)
        if not len(x):
            continue
        for at in range(0, len(x), 100_000):
            i, j = rows[x[at:at + 100_000]], y[at:at + 100_000]
            good = (marks[i] == marks[j]).sum(1) >= least
            if before is not None and before.shape[1]:
                good[good] &= ~(before[i[good]] == before[j[good]]).any(1)
            lows.append(i[good])
            highs.append(j[good])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *lows]), np.concatenate([none, *highs])


def _dense_links(dense: DataFrame, rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of dense cells that join groups, confirmed on full sets.

    In a cell the pairs go from the most alike on; one whose ends are already in one group
    is skipped, every other one is compared on the full sets, so that what comes out joins
    all that is linked, with fewer links than rows.
    """
    asked = dense.select("class").distinct()
    ids = classes.join(asked, "class", "left_semi").select("row_id").where("row_id IS NOT NULL").distinct()
    sets = _full_sets(rows, ids, words, dense.count()).dropDuplicates(["class"]).join(asked, "class", "left_semi")

    def link(cell: pa.Table) -> pa.Table:
        names = cell.column("class").to_pylist()
        sets = [x.values.to_numpy() for x in cell.column("shingles")]
        marks = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
        low, high = _candidate_pairs(cell, percent, None)
        alike = np.concatenate([np.empty(0, np.int64)] + [
            (marks[low[at:at + 100_000]] == marks[high[at:at + 100_000]]).sum(1) for at in range(0, len(low), 100_000)])
        roots = np.unique(np.array(cell.column("root").to_pylist(), object), return_inverse=True)[1]
        parent = list(range(int(roots.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for k in np.argsort(-alike, kind="stable"):
            i, j = int(low[k]), int(high[k])
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(x, y)] = min(x, y)
                found.append((names[i], names[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return written(dense.join(sets, "class").groupBy("key", "i", "j").applyInArrow(link, "a binary, b binary"), "dense")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups at a Jaccard similarity.

    Shingles are ``words`` words, A-Z lower-cased; rows are linked if their sets have
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id
    reachable. Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows are one class and get a row each. A row without a doc_id stays and has
    the group of the rows with an equal set, if any has an id; else it is linked with nothing.

    Links inside a bucket go to its smallest class first; whatever a bucket still has
    in several groups is then compared across the groups, so that no link is lost.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string"))
    table = written(signed(rows, words), "signed")
    classes = written(
        table.where("class IS NOT NULL").groupBy("class")
        .agg(F.min("row_id").alias("row_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
             F.first("bands").alias("bands")),
        "classes")
    signatures = classes.select("class", "signature")
    buckets = classes.select("class", "n", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(
        F.min(F.struct("class", "n")).alias("low"), F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    near_size = "100 * least(n, m) >= {0} * greatest(n, m)".format(percent)
    stars = (
        buckets.join(leaders.select("key", F.col("low.class").alias("b"), F.col("low.n").alias("m")), "key")
        .where("class != b").where(near_size).select(F.col("class").alias("a"), "b").distinct()
    )
    share = percent / 100 - SLACK
    checked = written(_agreeing(stars, signatures, share), "stars")
    link = 100 * F.col("both") >= percent * F.col("either")

    def confirm(pairs: DataFrame, n: int) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        ids = classes.join(asked, "class", "left_semi").select("row_id").where("row_id IS NOT NULL").distinct()
        sets = written(_full_sets(rows, ids, words, 2 * n).dropDuplicates(["class"]).join(asked, "class", "left_semi"), "sets")
        return written(_verified(pairs, sets).where(link).select("a", "b"), "links")

    links = confirm(checked, checked.count())
    groups = written(components(links), "groups")
    rest, dense = _across(buckets, leaders, groups, classes, percent)
    n = rest.count()
    more = [confirm(rest.distinct(), n)] if n else []
    if dense.limit(1).count():
        more.append(_dense_links(dense, rows, classes, words, percent))
    if more:
        for part in more:
            links = links.unionByName(part)
        groups = written(components(links), "groups")
    named = (
        classes.select("class", "row_id").join(groups.withColumnRenamed("node", "class"), "class")
        .groupBy("root").agg(F.min("row_id").alias("component"))
    )
    of_class = groups.join(named, "root").select(F.col("node").alias("class"), "component")
    own = classes.select("class", F.col("row_id").alias("own"))
    return (
        table.select("row_id", "class", "n_shingles").join(own, "class", "left").join(of_class, "class", "left")
        .select(F.col("row_id").alias("doc_id"), "n_shingles", F.coalesce("component", "own", "row_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
