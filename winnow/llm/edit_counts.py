"""Edit-aware token counts: a segment tree of pre-token counts for each document.

The text is cut by the tokenizer's own pre-token pattern; leaves hold the token counts of ``LEAF`` pre-tokens, inner nodes the sums of
their children. After an edit only the leaves that it touches are read again, from a leaf start so far before it that the
pattern cannot have looked into the edit, up to the first pre-token boundary after it that is an old leaf start: from there on the
pattern sees the same text from the same place. The sums above the changed leaves are made anew, all other sums are reused.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .words import texts_of

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
#: The pattern decides on a pre-token by at most so many characters behind its end.
LOOK = 2
Edit = tuple[int, int, str]


class Counter(dict):
    """Token counts of pre-tokens, remembered up to a fixed number for each task."""

    LIMIT = 500_000

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass
class Tree:
    """Leaf starts (code points), leaf token counts and, from the bottom up, the sums of pairs."""

    starts: list[int]
    counts: list[int]
    levels: list[list[int]]

    @property
    def total(self) -> int:
        return self.levels[-1][0] if self.levels else sum(self.counts)


def _sums(counts: list[int], old: list[list[int]] | None = None, first: int = 0) -> list[list[int]]:
    """Levels above the leaves; sums of leaves before ``first`` are taken from ``old``."""
    levels, below = [], counts
    while len(below) > 1:
        first //= 2
        kept = old[len(levels)][:first] if old and len(levels) < len(old) else []
        level = kept + [sum(below[i : i + 2]) for i in range(2 * len(kept), len(below), 2)]
        levels.append(level)
        below = level
    return levels


def _leaves(text: str, at: int, counter: Counter) -> tuple[list[int], list[int]]:
    pieces = counter.pattern.findall(text)
    starts, counts = [], []
    for i in range(0, len(pieces), LEAF):
        leaf = pieces[i : i + LEAF]
        starts.append(at)
        counts.append(sum(map(counter.__getitem__, leaf)))
        at += sum(map(len, leaf))
    return starts, counts


def build(text: str, counter: Counter) -> Tree:
    starts, counts = _leaves(text, 0, counter)
    return Tree(starts, counts, _sums(counts))


def apply_edits(text: str, edits: list[Edit]) -> str:
    """``start, stop, put`` in code points of the text, in order and without overlap."""
    out, at = [], 0
    for start, stop, put in edits:
        out += [text[at:start], put]
        at = stop
    return "".join([*out, text[at:]])


def update(tree: Tree, text: str, edits: list[Edit], counter: Counter) -> tuple[Tree, str, int]:
    """The tree of the edited text, that text, and how many of its characters were read again."""
    new = apply_edits(text, edits)
    if not edits:
        return tree, new, 0
    starts, counts, shift, at, read, k, first = [], [], 0, 0, 0, 0, None
    while k < len(edits):
        low = max(0, bisect_right(tree.starts, edits[k][0] - LOOK) - 1) if tree.starts else 0
        if low < at:
            low = at
        starts += [s + shift for s in tree.starts[at:low]]
        counts += tree.counts[at:low]
        first = len(counts) if first is None else first
        begin = (tree.starts[low] if low < len(tree.starts) else len(text)) + shift
        pieces, piece_starts, place, meet, stop = [], [], begin, None, None
        while meet is None:
            # take in the edit and those that the place read so far comes near to, then look for an old leaf start
            if k < len(edits) and (stop is None or place >= edits[k][0] + shift - LOOK):
                stop, shift = edits[k][1], shift + len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
                continue
            if place - shift >= stop:
                j = bisect_left(tree.starts, place - shift)
                if j < len(tree.starts) and tree.starts[j] == place - shift:
                    meet = j
                    break
            m = counter.pattern.match(new, place)
            if m is None:
                meet = len(tree.starts)
                break
            pieces.append(m.group())
            piece_starts.append(place)
            place = m.end()
        for i in range(0, len(pieces), LEAF):
            starts.append(piece_starts[i])
            counts.append(sum(map(counter.__getitem__, pieces[i : i + LEAF])))
        read += place - begin
        at = meet
    starts += [s + shift for s in tree.starts[at:]]
    counts += tree.counts[at:]
    return Tree(starts, counts, _sums(counts, tree.levels, first or 0)), new, read


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a usual cleaning step: runs of six and more digits become ``#``, lines equal to an earlier line go."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "#") for m in _DIGITS.finditer(line)]
        at += len(line) + 1
    return edits


_DIGITS = regex.compile("[0-9]{6,}")


def token_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, starts, counts, levels`` for every row of ``docs (doc_id, text, ...)``; a null text has an empty tree."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            trees = [build((raw or b"").decode("utf-8", "replace"), counter) for raw in texts_of(batch)]
            columns = [pa.array([t.total for t in trees], pa.int64()), pa.array([t.starts for t in trees], pa.list_(pa.int64())), pa.array([t.counts for t in trees], pa.list_(pa.int64())), pa.array([t.levels for t in trees], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "starts", "counts", "levels"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n_tokens long, starts array<long>, counts array<long>, levels array<array<long>>")


def recount(trees: DataFrame, edits_of=cleaning_edits, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens, n_tokens_after, n_edits, n_chars_after, n_chars_read`` for rows of ``doc_id, text, starts, counts, levels``.

    ``trees`` are stored trees beside their texts, ``edits_of`` gives a text's edits. A row without a tree (null
    ``starts``) gets one first. A null text is an empty one. Edits come in order and do not overlap.
    """
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_chars_after", "n_chars_read"]

    def change(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            rows = []
            stored = zip(*(batch.column(c) for c in ("starts", "counts", "levels")), strict=True)
            for raw, (starts, counts, levels) in zip(texts_of(batch), stored, strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                tree = build(text, counter) if not starts.is_valid else Tree(starts.as_py(), counts.as_py(), levels.as_py())
                edits = edits_of(text)
                after, new, read = update(tree, text, edits, counter)
                rows.append((tree.total, after.total, len(edits), len(new), read))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return trees.select("doc_id", "text", "starts", "counts", "levels").mapInArrow(change, ", ".join(f"{n} long" for n in names))
