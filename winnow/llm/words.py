"""Words, their hashes and word shingles, shared by the operators that work on whole texts in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
#: Runs of ASCII punctuation at either end of a word.
PUNCTUATION = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


class WordHashes(dict):
    """64-bit word hashes, remembered up to a fixed number of words per task."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class PlainWords(WordHashes):
    """Hashes of words without punctuation at their ends; a word of punctuation alone has hash 0."""

    def __missing__(self, word: bytes) -> int:
        plain = PUNCTUATION.sub(b"", word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(plain) if plain else 0
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def split_words(text: bytes) -> list[bytes]:
    """Words are the runs between the six ASCII white-space characters; A-Z are lower-cased, nothing else is."""
    return text.lower().split()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all word windows in text order; a text with fewer words than ``width`` is one window."""
    width = min(width, len(words))
    if not width:
        return np.empty(0, np.uint64)
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for j in range(width):
        out = (out ^ words[j : j + count]) * _MULT
        out ^= out >> _SHIFT
    return mix(out)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """UTF-8 bytes of each text, one at a time; null stays None."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py()


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())
