"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with itself.

The columns (n-gram hashes) are cut into hash ranges. Two rows whose Jaccard similarity reaches the threshold differ in at
most ``k`` columns, a bound that their sizes give; with more than ``k`` ranges they agree on a whole range. So only
rows that agree on a range are multiplied, all other products stay below the bound and are never formed. For the pairs that
remain, overlap counts are accumulated range by range and a pair is dropped once its count plus all that
the remaining ranges could add is below the overlap it needs.

Equal rows are one row from the start. Inside a group of rows that agree on a range, the row that agrees with most others is
multiplied with all others of the group; rows that have come into one component need no further product with each other.
Small groups in which different components remain are multiplied out; the larger ones are the second step. Their rows' n-grams
are ordered by how many of these rows have
them, the rarest first. Two linked rows share one of their first n-grams, as many as the overlap they need leaves
room for, so copies with many edits of their own are parted without a product. Groups of rows that share such an n-gram are taken up in
rounds with four times as many pivots each, the members of small components first, until every pair of a group has been
multiplied, lies in one component or is ruled out by a bound. Components are therefore those of all links, and a group of n copies
costs about n products.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import broadcast_if_small, cut

from .components import components
from .words import WordHashes, as_long, mix, shingles, split_words, texts_of

#: Groups of at most this many rows are multiplied out in one round.
GROUP = 16
#: Documents and pairs that a task holds at a time.
BATCH_ROWS = 1000
#: Rows of at most this many n-grams are grouped by combinations of their first n-grams instead of by ranges.
SMALL = 16
_PART = np.uint64(0xD6E8FEB86659FD93)


class Bounds:
    """What the threshold ``num / den`` and two sizes say about overlap and difference, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold lies between 0 and 1")
        self.num, self.den = num, den
        #: The smaller of two different linked rows has at least this many n-grams.
        self.least = max(1, -(-num // (den - num)))
        self.taken = min(3, -(-num * self.least // den))

    def needed(self, a: int, b: int) -> int:
        """The least overlap with which sizes ``a`` and ``b`` are linked."""
        return -(-self.num * (a + b) // (self.den + self.num))

    @cache
    def group(self, g: int) -> tuple[int, int, int, int, int]:
        """Size range, number of ranges, spare ranges and the most n-grams of a thin range for size group ``g``.

        With ``spare`` ranges more than the difference bound asks for, ``spare + 1`` ranges agree. Hence a row with at
        most ``spare`` thin ranges is found by a range that is not thin; only rows with more of them
        are grouped by their thin ranges too, and among themselves.
        """
        low = SMALL + 1 if g == 0 else self.group(g - 1)[1] + 1
        high = max(low, low * self.den**2 // self.num**2)
        k = 2 * high - 2 * self.needed(high, high)
        spare = max(1, math.ceil(0.15 * (k + 1)))
        parts, thin, mean = k + 1 + spare, 0, low / (k + 1 + spare)
        for most in range(1, 4):
            share = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(most + 1))
            if parts * share + 2 * math.sqrt(parts * share) <= spare:
                thin = most
        return low, high, parts, spare, thin

    @cache
    def groups(self, size: int) -> list[tuple[int, int, int, int]]:
        """Size groups in which a row of ``size`` may be the larger or the smaller of a linked pair."""
        found = []
        for g in itertools.count():
            low, high, parts, spare, thin = self.group(g)
            if low * self.num > size * self.den:
                return found
            if size > SMALL and high >= size:
                found.append((g, parts, spare, thin))

    def keys(self, row: np.ndarray) -> np.ndarray:
        """Group keys of one row of sorted n-gram hashes; linked different rows share at least one."""
        size, found = len(row), []
        if size < self.least:
            return np.empty(0, np.uint64)
        if size * self.num <= SMALL * self.den:
            first = row[: size - -(-self.num * size // self.den) + self.taken]
            picks = np.array(list(itertools.combinations(range(len(first)), self.taken)))
            found.append(mix(mix(first)[picks].sum(axis=1, dtype=np.uint64)))
        for g, parts, spare, thin in self.groups(size):
            part = ((row >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            held = np.bincount(part.astype(np.int64), minlength=parts)
            sums = np.zeros(parts, np.uint64)
            full = np.flatnonzero(held)
            starts = np.concatenate(([0], np.cumsum(held)[:-1]))[full]
            sums[full] = np.add.reduceat(mix(row), starts)
            keep = held > thin
            if parts - np.count_nonzero(keep) > spare:
                keep[:] = True
            at = np.flatnonzero(keep)
            found.append(mix(sums[at] ^ mix((at + (g + 1) * (1 << 40)).astype(np.uint64) * _PART)))
        return np.concatenate(found) if found else np.empty(0, np.uint64)


def _rows(batch: pa.RecordBatch, hashes: WordHashes, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for text in texts_of(batch):
        yield np.unique(shingles(hashes.of(split_words(text or b"")), width))


def row_sizes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2``: the size of each row and a 128-bit digest of its n-gram hashes."""

    def measure(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, digests = [], []
            for row in _rows(batch, hashes, width):
                sizes.append(len(row))
                digests.append(xxhash.xxh128_digest(row.tobytes()))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                names=["doc_id", "n_shingles", "d1", "d2"],
            )

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, n_shingles long, d1 long, d2 long")


def group_keys(docs: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    """``key, doc_id``: one row per document and group. Equal rows of one task are sent once, as the first of them."""

    def sent(ids, counts, found):
        return pa.RecordBatch.from_arrays([as_long(np.concatenate(found)), pa.array(np.repeat(np.array(ids, np.int64), counts))], names=["key", "doc_id"])

    def emit(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            ids, counts, found, held = [], [], [], 0
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), _rows(batch, hashes, width), strict=True):
                if doc_id is None or len(row) < bounds.least:
                    continue
                digest = xxhash.xxh128_digest(row.tobytes())
                if digest in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(digest)
                keys = bounds.keys(row)
                ids.append(doc_id)
                counts.append(len(keys))
                found.append(keys)
                held += len(keys)
                if held > 200_000:  # no batch grows with the texts
                    yield sent(ids, counts, found)
                    ids, counts, found, held = [], [], [], 0
            if found:
                yield sent(ids, counts, found)

    return docs.select("doc_id", "text").mapInArrow(emit, "key long, doc_id long")


def shared_groups(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key another document has, read off the sorted keys one batch at a time."""

    def runs(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            key = batch.column("key").to_numpy() if batch is not None else np.empty(0, np.int64)
            ids = batch.column("doc_id").to_numpy() if batch is not None else np.empty(0, np.int64)
            if held is not None:
                key, ids = np.append(held[0], key), np.append(held[1], ids)
            # the last row waits for the next batch, with a note whether the row before it has its key
            same = key[1:] == key[:-1]
            shared = np.append(same, False) | np.insert(same, 0, False) if len(key) else np.empty(0, bool)
            if batch is not None:
                shared[-1] = False
            if held is not None and held[2]:
                shared[0] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(ids[shared])], names=["key", "doc_id"])
            if len(key):
                held = key[-1:], ids[-1:], len(key) > 1 and bool(same[-1])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "key long, doc_id long")


def pivot_pairs(work: DataFrame, pivots: int, bounds: Bounds) -> DataFrame:
    """The rows of ``work`` with ``pivot`` and ``partners``: each row's products with the first ``pivots`` rows of its group.

    ``work`` has ``key, node, size, own, pos, comp, turn``. ``own`` n-grams of a row cannot be part of an overlap, ``pos`` n-grams come
    before the one that makes the group, and rows take their ``turn`` as pivots. Rows of the same component and rows that a
    bound keeps apart are no partners.
    """

    def walk(batches):
        at, first = None, []
        for batch in batches:
            out = []
            for key, node, size, own, pos, comp in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "size", "own", "pos", "comp")), strict=True):
                if key != at:
                    at, first = key, []
                partners = []
                for n, s, o, p, c in first:
                    # of two linked rows, the first common n-gram leaves room for the needed overlap in both
                    if c != comp and bounds.needed(s, size) <= min(s - max(o, p), size - max(own, pos)):
                        partners.append(n)
                is_pivot = len(first) < pivots
                if is_pivot:
                    first.append((node, size, own, pos, comp))
                out.append((key, node, size, own, pos, is_pivot, partners))
            if out:
                kinds = *(pa.int64(),) * 5, pa.bool_(), pa.list_(pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "size", "own", "pos", "pivot", "partners"])

    order = work.select("key", "node", "size", "own", "pos", "comp", "turn").repartition("key").sortWithinPartitions("key", "turn", "node")
    return order.mapInArrow(walk, "key long, node long, size long, own long, pos long, pivot boolean, partners array<long>")


def rare_grams(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """``key, node, size, own, pos``: the first n-grams of each row of ``rows (node, row)``, the rarest among these rows first."""
    grams = rows.select("node", F.explode("row").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = grams.join(counts.hint("merge"), "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    size = F.size("g").cast("long")
    own = F.size(F.filter("g", lambda x: x["n"] == 1)).cast("long")
    most = F.size("g") - F.ceil(size * bounds.num / bounds.den).cast("int") + 1
    first = ordered.select("node", size.alias("size"), own.alias("own"), F.posexplode(F.slice("g", 1, most)).alias("pos", "x"))
    return first.where("x.n > 1").select(F.col("x.gram").alias("key"), "node", "size", "own", F.col("pos").cast("long").alias("pos"))


def overlap_reaches(a: np.ndarray, b: np.ndarray, needed: int, ranges: int = 8) -> bool:
    """Accumulate the overlap of two sorted rows range by range; stop once the bound can't be reached any more."""
    if len(a) > len(b):
        a, b = b, a
    if needed > len(a):
        return False
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
    cuts_a = [0, *np.searchsorted(a, edges).tolist(), len(a)]
    cuts_b = [0, *np.searchsorted(b, edges).tolist(), len(b)]
    count = 0
    for i in range(ranges):
        x, y = a[cuts_a[i] : cuts_a[i + 1]], b[cuts_b[i] : cuts_b[i + 1]]
        if len(x) and len(y):
            count += int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
        if count + min(len(a) - cuts_a[i + 1], len(b) - cuts_b[i + 1]) < needed:
            return False
    return count >= needed


def linked(pairs: DataFrame, rows: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs ``a, b`` whose rows reach the threshold."""

    def decide(batches):
        for batch in batches:
            keep = []
            left, right = batch.column("row_a"), batch.column("row_b")
            for x, y in zip(left, right, strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                keep.append(overlap_reaches(x, y, bounds.needed(len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = [rows.select(F.col("node").alias(side), F.col("row").alias(f"row_{side}")) for side in "ab"]
    partners = named[0].join(broadcast_if_small(pairs.select("a").distinct()), "a", "left_semi")
    return named[1].join(broadcast_if_small(pairs), "b").join(partners, "a").select("a", "b", "row_a", "row_b").mapInArrow(decide, "a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, comp)`` after the linked nodes' components have become one."""
    ends = [labels.withColumnsRenamed({"node": s, "comp": f"c{s}"}) for s in "ab"]
    joins = components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return cut(labels.join(joins.withColumnsRenamed({"id": "comp"}), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


@contextmanager
def _batches(spark, rows: int):
    """Arrow batches of at most ``rows`` rows inside the block, so that long texts and rows stay within a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text, ...)``.

    Two documents are linked when ``den`` times the overlap of their sets of ``width``-word shingles is at least ``num`` times
    their union; ``component_id`` is the smallest doc_id that links reach. A text with fewer words is one shingle; a
    null, empty or blank text has none and is linked with nothing. Rows with a null doc_id are returned with a null
    component. Rows that repeat a doc_id stand for one document, whose
    near copies are those of its greatest text. An empty table gives an empty result.
    """
    with _batches(docs.sparkSession, BATCH_ROWS):
        return _components(docs, width, Bounds(num, den))


def _components(docs: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    sizes = cut(row_sizes(docs, width))
    classes = cut(sizes.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")))
    of = sizes.where("n_shingles > 0").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "node", F.col("n_shingles").alias("size"))
    shared = cut(shared_groups(group_keys(docs, width, bounds)))
    nodes = shared.join(of, "doc_id").select("key", "node", "size").distinct()
    several = nodes.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    work = cut(nodes.join(several, "key", "left_semi"))
    labels = cut(work.select("node", F.col("node").alias("comp")).distinct())
    ids = labels.select(F.col("node").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    repeated = broadcast_if_small(cut(sizes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")))
    greatest = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = cut(incidence(texts.join(repeated, "doc_id", "left_anti").unionByName(greatest), width))
    members = work.groupBy("key").agg(F.count("*").alias("members"))
    central = work.join(members, "key").groupBy("node").agg((-F.sum("members")).alias("turn"))
    nothing = F.lit(0).cast("long")
    work = cut(work.join(central, "node").withColumns({"own": nothing, "pos": nothing, "comp": F.col("node")}))
    tested, pivots = [], 1
    while not work.isEmpty():
        walked = cut(pivot_pairs(work, pivots, bounds))
        votes = walked.select(F.explode("partners").alias("p"), "node").groupBy("node", "p").agg(F.count("*").alias("votes"))
        found = votes.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"), "node", "votes")
        for earlier in tested:
            found = found.join(earlier, ["a", "b"], "left_anti")
        found = cut(found)
        # each row meets the partner it shares most groups with; then only pairs that still lie in two components are left
        best = cut(found.groupBy("node").agg(F.max(F.struct("votes", "a", "b")).alias("best")).select("best.a", "best.b").distinct())
        labels = _merged(labels, linked(best, rows, bounds))
        ends = [labels.withColumnsRenamed({"node": s, "comp": f"c{s}"}) for s in "ab"]
        pairs = found.select("a", "b").distinct()
        tested.append(pairs)
        apart = cut(pairs.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti"))
        if not apart.isEmpty():
            labels = _merged(labels, linked(apart, rows, bounds))
        rest = _still_open(walked.where("not pivot").drop("pivot", "partners"), labels)
        if pivots == 1:
            # small groups are multiplied out as they are; rows of larger ones go over to their rarest n-grams
            rest = cut(rest)
            many = rest.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key")
            left = cut(rest.join(many, "key", "left_semi").select("node").distinct())
            rare = _still_open(rare_grams(rows.join(left, "node", "left_semi"), bounds), labels)
            rest = rest.join(many, "key", "left_anti").unionByName(rare)
        work = cut(rest)
        pivots = max(4 * pivots, GROUP)
    named = classes.join(labels, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    out = sizes.join(named, ["d1", "d2", "n_shingles"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def _still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups that hold several components, with their component; small components take their turn first."""
    rows = rows.join(labels, "node")
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    sizes = labels.groupBy("comp").agg(F.count("*").alias("turn"))
    return rows.join(several, "key", "left_semi").join(sizes, "comp")


def incidence(docs: DataFrame, width: int) -> DataFrame:
    """``node, row``: the sorted n-gram hashes of each document, as the join's matrix holds them."""

    def build(batches):
        hashes = WordHashes()
        for batch in batches:
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), _rows(batch, hashes, width), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row.view(np.int64)], pa.list_(pa.int64()))], names=["node", "row"])

    return docs.select("doc_id", "text").mapInArrow(build, "node long, row array<long>")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents without the later members of each component: the smallest doc_id of a component stays.

    Rows with a null doc_id stay. The columns of ``docs`` are returned as they are.
    """
    found = jaccard_components(docs, **settings)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
