"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A window of as many words as the item can only be similar to it if they share a word shingle, so fingerprints are made for the
windows that hold a shingle of an item of their size. Fingerprints of 64 bits are looked up in eight tables of
one byte each. Two fingerprints that differ in at most ``RADIUS`` bits differ in at most two bits of some byte, and each table lists the
items for every byte within two bits of theirs, so every item within the radius becomes a candidate. The exact weighted
Jaccard similarity of the shingles then decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PUNCTUATION, PlainWords, shingles, split_words, texts_of

RADIUS, BYTES, NEAR = 23, 8, 2
#: Characters of benchmark text that one pass over the documents takes to its tasks.
SLICE_CHARS = 16_000_000


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).view("<u8").ravel().astype(np.uint64)


def _weighted(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles with their summed weights."""
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(at, weights, len(keys))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle bags."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][at_a], b[1][at_b]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


class Text:
    """A text's words with punctuation stripped: hashes, lengths and weighted shingles of one width."""

    def __init__(self, text: bytes, hashes: PlainWords):
        words = split_words(text)
        self.hashes = hashes.of(words)
        self.kept = np.flatnonzero(self.hashes)
        self.hashes = self.hashes[self.kept]
        self.words = words

    def lengths(self) -> np.ndarray:
        return np.array([len(PUNCTUATION.sub(b"", self.words[i]).decode("utf-8", "replace")) for i in self.kept], np.int32)

    def weights(self, width: int) -> np.ndarray:
        """Characters of each shingle's words, so that a shingle of long words counts more than one of short ones."""
        total = np.concatenate(([0], np.cumsum(self.lengths())))
        width = min(width, len(self.hashes))
        return (total[width:] - total[:-width]).astype(np.int32) if width else np.empty(0, np.int32)


class Items:
    """Benchmark items of one pass: shingle table, fingerprints by size and the byte tables over them."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.width, hashes = width, PlainWords()
        self.ids, self.bags, self.sizes, prints = [], [], [], []
        for item_id, text in rows:
            body = Text((text or "").encode(), hashes)
            if item_id is None or not len(body.hashes):
                continue
            found, weights = shingles(body.hashes, width), body.weights(width)
            self.ids.append(item_id)
            self.bags.append(_weighted(found, weights))
            self.sizes.append(len(body.hashes))
            prints.append(_pack((_signs(found) * weights[:, None]).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint64)
        held = [np.column_stack([b[0], np.full(len(b[0]), s, np.uint64)]) for b, s in zip(self.bags, self.sizes, strict=True)]
        pairs = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), np.uint64)
        #: Shingles by the width they were made with, and the item sizes each occurs in.
        self.by_width = {}
        for w in sorted({min(width, s) for s in self.sizes}):
            own = pairs[np.minimum(pairs[:, 1], width) == w]
            quick = np.zeros(1 << 20, bool)
            quick[(own[:, 0] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[w] = np.ascontiguousarray(own[:, 0]), own[:, 1].astype(np.int64), quick
        near = [[v for v in range(256) if (v ^ u).bit_count() <= NEAR] for u in range(256)]
        self.tables = {}
        for size in sorted(set(self.sizes)):
            of = [i for i, s in enumerate(self.sizes) if s == size]
            table = np.zeros((BYTES, 256, (len(of) + 7) // 8), np.uint8)
            for at, i in enumerate(of):
                for k, value in enumerate(int(self.prints[i]).to_bytes(8, "little")):
                    table[k, near[value], at // 8] |= np.uint8(1 << (at % 8))
            self.tables[size] = np.array(of), table

    def hits(self, found: np.ndarray, width: int) -> dict[int, np.ndarray]:
        """Positions of item shingles by item size."""
        keys, sizes, quick = self.by_width[width]
        near = np.flatnonzero(quick[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(near):
            return {}
        lo, hi = np.searchsorted(keys, found[near], "left"), np.searchsorted(keys, found[near], "right")
        out: dict[int, list[int]] = {}
        for p, i, j in zip(near.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for size in sizes[i:j].tolist():
                out.setdefault(size, []).append(p)
        return {size: np.array(at) for size, at in out.items()}

    def leaks(self, text: bytes, hashes: PlainWords, least: float) -> list[tuple[int, int, int, int, float]]:
        """``item_id, first word, words, bits that differ, similarity`` of the best window for each leaked item."""
        body, best = Text(text, hashes), {}
        for width in self.by_width:
            if len(body.hashes) < width:
                continue
            found = shingles(body.hashes, width)
            hits, weights = self.hits(found, width), None
            for size, at in hits.items():
                span = size - width
                # shorter texts than the item are one window; others have a window for each start that holds a hit
                last = max(0, len(body.hashes) - size)
                starts = np.unique(np.clip(at[:, None] - np.arange(span + 1)[None, :], 0, last))
                weights = body.weights(width) if weights is None else weights
                for first, run in self._runs(starts, span):
                    signs = _signs(found[first : run[-1] + span + 1]) * weights[first : run[-1] + span + 1, None]
                    sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signs, axis=0, dtype=np.int64)))
                    ends = np.minimum(run - first + span + 1, len(sums) - 1)
                    prints = _pack(sums[ends] - sums[run - first])
                    for start, item, bits in self._candidates(size, run, prints):
                        bag = _weighted(found[start : start + span + 1], weights[start : start + span + 1])
                        value = similarity(bag, self.bags[item])
                        if value >= least and value > best.get(item, (0,))[-1]:
                            best[item] = start, size, bits, value
        return [(self.ids[item], *row) for item, row in sorted(best.items())]

    @staticmethod
    def _runs(starts: np.ndarray, span: int):
        """Window starts in pieces of bounded length without long gaps."""
        breaks = np.flatnonzero(np.diff(starts) > span + 1) + 1
        for run in np.split(starts, breaks):
            for k in range(0, len(run), 4096):
                yield int(run[k]), run[k : k + 4096]

    def _candidates(self, size: int, starts: np.ndarray, prints: np.ndarray):
        of, table = self.tables[size]
        masks = np.zeros((len(prints), table.shape[2]), np.uint8)
        for k in range(BYTES):
            masks |= table[k][((prints >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
        rows, cols = np.nonzero(np.unpackbits(masks, axis=1, bitorder="little"))
        bits = np.bitwise_count(prints[rows] ^ self.prints[of[cols]])
        for row, col, b in zip(rows[bits <= RADIUS].tolist(), cols[bits <= RADIUS].tolist(), bits[bits <= RADIUS].tolist(), strict=True):
            yield int(starts[row]), int(of[col]), int(b)


def _passes(benchmark: DataFrame, width: int):
    """The items in pieces of bounded size; each is one pass over the documents."""
    rows = benchmark.select("item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / SLICE_CHARS))
    for i in range(slices):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i) if slices > 1 else rows
        yield rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], width))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, bits, similarity``: the best window for each leaked item of each document.

    Words are lower-cased (A-Z) and lose punctuation at their ends; words of punctuation alone don't count. Items and texts with
    fewer words than ``width`` are one shingle. Null or empty texts and items leak nothing; rows with a null item_id are
    no items; repeated rows give repeated results. Ties go to the earliest window. Either table may be empty.
    """
    out = None
    for items in _passes(benchmark, width):

        def scan(batches, items=items):
            hashes = PlainWords()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                    rows += [(doc_id, *leak) for leak in items.value.leaks(text or b"", hashes, least)]
                if rows:
                    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()
                    names = ["doc_id", "item_id", "start_word", "n_words", "bits", "similarity"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        schema = "doc_id long, item_id long, start_word long, n_words long, bits long, similarity double"
        one = docs.select("doc_id", "text").mapInArrow(scan, schema)
        out = one if out is None else out.union(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents in which :func:`find_leaks` finds nothing, decided row by row where they are read."""
    for items in _passes(benchmark, width):

        def keep(batches, items=items):
            hashes = PlainWords()
            for batch in batches:
                yield batch.filter(pa.array([not items.value.leaks(text or b"", hashes, least) for text in texts_of(batch)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
