"""Line deduplication by pairwise alignment: shared runs of lines pair documents, patience diff aligns them.

A run that can start a match is one line of at least ``seed_words`` words, or several shorter non-blank lines on end with as many together. Of all documents
that hold it the first one keeps it, and every later one is aligned with that first holder only. So the pairs are as many as there are
later holders: a run of n documents makes n - 1 pairs, never all n (n - 1) / 2, and no run is too frequent to be looked at.

An alignment numbers repeated lines within each document, so that every line is unique in both, and takes the longest run of
common lines in the same order (patience diff); common lines off that run are blocks that have moved. Aligned
lines without a gap in either document are a block. Blocks of at least ``block_words`` words are deleted from the later document, and so are
runs of as many words that both hold but that the numbers of repeated lines or blank lines between them keep apart.

Joins ask for the sort-merge form, whose cost follows the input alike at every size, and which adaptive execution splits at hot keys.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import cut

from .words import as_long, mix


def runs(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and hash of runs of lines with at least ``least`` words; the lines hold a word each.

    From each line on: the shortest run, and the longer ones whose lines after the first have fewer words. Every line of a common
    passage of that many words is then in a run that lies in the passage, and there are at most two runs for each line.
    """
    n = len(lines)
    sums = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(sums, sums[:-1] + least)  # one past the last line of the shortest run from each line on
    stops = np.minimum(np.maximum(ends, np.append(ends[1:], n + 1) - 1), n)
    count = np.where(ends <= n, stops - ends + 1, 0)
    first = np.repeat(np.arange(n), count)
    last = np.repeat(ends - np.cumsum(count) + count, count) + np.arange(len(first))
    state, size = lines.astype(np.int64).view(np.uint64), last - first
    out = state[first]
    for step in range(1, int(size.max(initial=1))):
        more = size > step
        out[more] = mix(out[more] + np.uint64(step)) ^ state[first[more] + step]
    return first, last - 1, out


def seeds(lines: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the lines of at least ``least`` words and of the runs of shorter lines."""
    first, last, keys = runs(lines, words, least)
    long = np.concatenate(([0], np.cumsum(words >= least)))
    return keys[(first == last) | (long[last + 1] == long[first])]


def _longest(at: list[int]) -> list[int]:
    """Positions in ``at`` of its longest strictly increasing subsequence (patience sorting with back pointers)."""
    tops, piles, back = [], [], [0] * len(at)
    for i, value in enumerate(at):
        k = bisect_left(tops, value)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [value], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _numbered(lines: list[int], of: Counter | None = None) -> list[tuple[int, int]]:
    """Each line with the number of its repeat, counted around when ``of`` has fewer of them."""
    seen: Counter = Counter()
    out = []
    for line in lines:
        out.append((line, seen[line] % of[line] if of and of[line] else seen[line]))
        seen[line] += 1
    return out


def _blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of pairs that go on by one line in both documents."""
    out: list[list[int]] = []
    last = None
    for pair in pairs:
        if last and pair == (last[0] + 1, last[1] + 1):
            out[-1].append(pair[0])
        else:
            out.append([pair[0]])
        last = pair
    return out


def aligned_blocks(later: list[int], first: list[int], words: list[int], least: int) -> list[int]:
    """Line numbers of ``later`` in common blocks of at least ``least`` words."""
    place = {key: i for i, key in enumerate(_numbered(first))}
    pairs = [(i, place[key]) for i, key in enumerate(_numbered(later, Counter(first))) if key in place]
    chain = [pairs[k] for k in _longest([j for _, j in pairs])]
    used = set(chain)
    blocks = _blocks(chain) + _blocks([pair for pair in pairs if pair not in used])
    return [i for block in blocks if sum(words[i] for i in block) >= least for i in block]


def common_runs(later: list[int], first: list[int], words: list[int], first_words: list[int], least: int) -> list[int]:
    """Line numbers of ``later`` in runs of non-blank lines with at least ``least`` words that ``first`` holds too, and of blank lines inside them."""

    def found(lines, counts):
        places = np.flatnonzero(np.array(counts, np.int64) > 0)
        return places, *runs(np.array(lines, np.int64)[places], np.array(counts, np.int64)[places], least)

    places, starts, ends, keys = found(later, words)
    held = np.isin(keys, found(first, first_words)[3])
    return sorted({i for a, b in zip(places[starts[held]].tolist(), places[ends[held]].tolist(), strict=True) for i in range(a, b + 1)})


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, lines, words``: hash and word count of every line of each document with an id, in order."""
    lines = F.split("text", "\n", -1)
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", lines.alias("l"))
    hashes = F.transform("l", lambda x: F.xxhash64(x))
    counts = F.transform("l", lambda x: F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")))
    return rows.select("doc_id", hashes.alias("lines"), counts.alias("words"))


def repeated_lines(docs: DataFrame, seed_words: int = 8, block_words: int = 8) -> DataFrame:
    """``doc_id, gone``: the line numbers (from 0) that each document loses; documents that lose none are left out."""
    table = cut(line_table(docs))

    def seeds_of(batches):
        for batch in batches:
            ids, keys = [], []
            for k, row in enumerate(batch.select(["lines", "words"]).to_pylist()):
                words = np.array(row["words"], np.int64)
                lines = np.array(row["lines"], np.int64)[words > 0]
                found = np.unique(np.concatenate([seeds(lines, words[words > 0], least) for least in sorted({max(1, seed_words), max(1, block_words)})]))
                ids.append(np.full(len(found), k))
                keys.append(found)
            at = pa.array(np.concatenate(ids or [np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), as_long(np.concatenate(keys or [np.empty(0, np.uint64)]))], names=["doc_id", "line"])

    held = table.mapInArrow(seeds_of, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, line long")
    holders = cut(held.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("line", "first"))
    pairs = cut(held.join(holders.hint("merge"), "line").where("first < doc_id").select("doc_id", "first").distinct())
    later = table.join(pairs.hint("merge"), "doc_id")
    firsts = table.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines"), F.col("words").alias("first_words"))

    def align(batches):
        for batch in batches:
            gone = []
            for row in batch.select(["lines", "first_lines", "words", "first_words"]).to_pylist():
                blocks = aligned_blocks(row["lines"], row["first_lines"], row["words"], block_words)
                gone.append(sorted({*blocks, *common_runs(row["lines"], row["first_lines"], row["words"], row["first_words"], max(1, block_words))}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])

    found = later.join(firsts.hint("merge"), "first").select("doc_id", "lines", "first_lines", "words", "first_words").mapInArrow(align, "doc_id long, gone array<int>")
    return found.where(F.size("gone") > 0).select("doc_id", F.explode("gone").alias("i")).distinct().groupBy("doc_id").agg(F.collect_list("i").alias("gone"))


def dedup_lines(docs: DataFrame, seed_words: int = 8, block_words: int = 8) -> DataFrame:
    """The columns of ``docs`` with shortened texts, and ``n_lines``, ``n_gone_lines`` (long).

    The later document of a pair is the one with the larger doc_id. Rows without an id or a text are returned as they are (0 lines for a
    null text); rows that repeat a doc_id stand for one document and lose the same line numbers only if their texts
    are equal, else the lines found for either. A text may become empty. Repeats inside one document
    are left alone. Columns of ``docs`` named like an output are replaced.
    """
    gone = cut(repeated_lines(docs, seed_words, block_words))
    rows = docs.join(gone.select("doc_id", F.col("gone").alias("_gone_lines")).hint("merge"), "doc_id", "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone_lines", i)), "\n")
    text = F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(kept)
    counts = {"n_lines": F.size(lines), "n_gone_lines": F.size("_gone_lines")}
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return rows.select(*out, *(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias(c) for c, n in counts.items()))
