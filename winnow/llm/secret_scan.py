"""Secret scan: fixed forms first, then character Markov models of random strings and ordinary identifiers.

The models are second-order chains over a reduced alphabet (a-z, A-Z, digits, the marks of base64). Random strings have a chain for each
alphabet that keys are written in, trained on drawn strings labelled as such, and one for what the fixed forms found. Ordinary
strings have one for words of the scanned texts with drawn numbers and times, one for these words in capitals and one for identifiers
joined from them. An unbroken token of eight and more characters that no fixed form covers becomes a span when the ratio of its whole
likelihood by the best random chain to that by the best ordinary chain passes a threshold, so a short token needs clearer
characters than a long one.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import cut

from .words import texts_of

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of the tokens that the models look at, and the fewest of them.
_TOKEN = "A-Za-z0-9+/_=-"
SHORTEST = 8
TOKEN = re.compile(rf"(?<![{_TOKEN}])[{_TOKEN}]{{{SHORTEST},}}")
KINDS = ("assign", "access", "hex", "markov")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODE = np.full(128, len(_ALPHABET) - 1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = range(len(_ALPHABET))
_IN_TOKEN = np.array([re.match(f"[{_TOKEN}]", chr(i)) is not None for i in range(128)])
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """``kind, start, end`` of the fixed forms, leftmost and without overlap inside a kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


class Chain:
    """Second-order character probabilities of one class, each order drawn towards the one below it."""

    def __init__(self, samples: list[str]):
        n = len(_ALPHABET)
        one, two, three = np.full(n, 0.5), np.zeros((n, n)), np.zeros((n * n, n))
        for sample in samples:
            codes = _codes(sample)
            np.add.at(one, codes, 1)
            np.add.at(two, (codes[:-1], codes[1:]), 1)
            np.add.at(three, (codes[:-2] * n + codes[1:-1], codes[2:]), 1)
        one = one / one.sum()
        first = self._drawn(two, one)
        #: Logarithms for the first character, the second, and each later one.
        self.logs = np.log(one), np.log(first), np.log(self._drawn(three, np.tile(first, (n, 1))))

    @staticmethod
    def _drawn(counts: np.ndarray, below: np.ndarray, pull: float = 8.0) -> np.ndarray:
        return (counts + pull * below) / (counts.sum(axis=1, keepdims=True) + pull)


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


#: Alphabets of the drawn random strings.
ALPHABETS = {
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
    "letters": string.ascii_letters,
    "lower": string.ascii_lowercase + string.digits,
    "upper": string.ascii_uppercase + string.digits,
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
}


def drawn_strings(each: int = 3000, seed: int = 7) -> dict[str, list[str]]:
    """``each`` labelled random strings of 8 to 64 characters for each alphabet, the same for a seed."""
    source = random.Random(seed)
    return {name: ["".join(source.choices(letters, k=source.randint(8, 64))) for _ in range(each)] for name, letters in ALPHABETS.items()}


def drawn_numbers(n: int = 2000, seed: int = 7) -> list[str]:
    """``n`` labelled ordinary strings of digits: plain and grouped numbers, dates and times of day."""
    source, found = random.Random(seed), []
    for i in range(n):
        digits = [f"{source.randrange(10**4):04d}" for _ in range(6)]
        day = f"{source.randint(1900, 2099)}-{source.randint(1, 12):02d}-{source.randint(1, 28):02d}"
        forms = "".join(digits)[: source.randint(8, 24)], "-".join(digits[: source.randint(2, 5)]), day, f"{day}T{source.randint(0, 23):02d}", day.replace("-", "/")
        found.append(forms[i % len(forms)])
    return found


def joined_words(ordinary: list[str], seed: int = 7) -> list[str]:
    """Labelled ordinary identifiers in the usual spellings, each joined from two or three drawn words of ``ordinary``."""
    source, found = random.Random(seed), []
    words = [w for token in ordinary for w in re.findall("[A-Za-z]{2,}", token)]
    for i in range(len(ordinary) if words else 0):
        parts = [w.lower() for w in source.choices(words, k=source.randint(2, 3))]
        spelled = parts[0] + "".join(w.capitalize() for w in parts[1:]), "".join(w.capitalize() for w in parts), "_".join(parts), "_".join(parts).upper(), "-".join(parts), "/".join(parts)
        found.append(spelled[i % len(spelled)])
    return found


class Models:
    """Chains of random strings, one for each list in ``drawn`` and one for ``found``, against chains of ordinary ones.

    ``ordinary`` are tokens of the texts; their capitals and the identifiers joined from them have chains of their own.
    """

    def __init__(self, found: list[str], ordinary: list[str], threshold: float = 12.0, drawn: dict[str, list[str]] | None = None):
        randoms = [strings for strings in (found, *(drawn or {}).values()) if strings]
        usual = [ordinary + drawn_numbers(), [w.upper() for w in ordinary], joined_words(ordinary)]
        chains = [Chain(strings).logs for strings in randoms + usual]
        #: For each place in a token, the logarithms of every chain: the random ones first.
        self.logs = tuple(np.stack([logs[i] for logs in chains], axis=-1) for i in range(3))
        self.n_random, self.threshold = len(randoms), threshold
        self.trained = bool(randoms) and bool(ordinary)

    def ratios(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each token, of three and more characters, by its places in ``codes``."""
        n, (one, two, three) = len(_ALPHABET), self.logs
        lengths = ends - starts - 2
        first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        at = np.arange(lengths.sum()) - np.repeat(first - starts, lengths)
        later = np.add.reduceat(three[codes[at] * n + codes[at + 1], codes[at + 2]], first, axis=0)
        logs = one[codes[starts]] + two[codes[starts], codes[starts + 1]] + later
        return logs[:, : self.n_random].max(axis=1) - logs[:, self.n_random :].max(axis=1)

    def ratio(self, token: str) -> float:
        return float(self.ratios(_codes(token), np.array([0]), np.array([len(token)]))[0])

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Tokens without a character of a base span whose ratio passes the threshold."""
        if not self.trained or len(text) < SHORTEST:
            return []
        points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _IN_TOKEN[points], [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        passed = self.ratios(_CODE[points], starts, ends) > self.threshold
        found = zip(starts[passed].tolist(), ends[passed].tolist(), strict=True)
        return [(3, start, end) for start, end in found if not any(start < e and s < end for _, s, e in base)]


def samples(docs: DataFrame, rows: int = 5000) -> tuple[list[str], list[str]]:
    """At most ``rows`` distinct labelled strings of each class, the first in the order of a digest.

    Random strings are the values of fixed forms. Ordinary ones are tokens of eight and more
    characters, one for each text, that no fixed form covers. Both are taken whole.
    """

    def collect(batches):
        for batch in batches:
            found = []
            for raw in texts_of(batch):
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text)
                for kind, start, end in base:
                    value = ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]
                    found.append((1, value))
                at = len(text) and int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest()) % len(text)
                word = next((m for m in TOKEN.finditer(text, at) if not any(s < m.end() and m.start() < e for _, s, e in base)), None)
                if word:
                    found.append((0, word.group()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], names=["random", "sample"])

    drawn = cut(docs.select("text").mapInArrow(collect, "random int, sample string").distinct())
    order = F.md5("sample")
    parts = [[r[0] for r in drawn.where(F.col("random") == k).orderBy(order, "sample").limit(rows).select("sample").collect()] for k in (1, 0)]
    return parts[0], parts[1]


def fit(docs: DataFrame, rows: int = 5000) -> Models:
    """Models trained on :func:`samples` and on drawn strings and numbers; without ordinary samples they add no spans."""
    found, ordinary = samples(docs, rows)
    return Models(found, ordinary, drawn=drawn_strings())


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` for every row of ``docs (doc_id, text, ...)``.

    A null text is an empty one: no spans, and the digest of an empty string. Offsets count code points. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def find(batches):
        for batch in batches:
            rows = []
            for raw in texts_of(batch):
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text)
                added = shared.value.spans(text, base)
                every = sorted(base + added, key=lambda s: (s[1], s[0]))
                counts = [sum(kind == k for kind, _, _ in every) for k in range(4)]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)
