"""Toxicity by class-conditional Kneser-Ney bigram models of toxic and ordinary texts.

Each class has a discounted bigram model that backs off to the number of contexts a word follows in that class, and from there to the
same number over both classes. The weight of the first back-off belongs to the context and is shared by the
classes. An expression whose counts in the two classes do not tell them apart (by chance, or by a small factor) is taken from the shared counts, alike in both classes, so it says nothing. What is left is one
log-likelihood ratio for each expression (a bigram, or a word for the bigrams that are not listed), and a text's score is the mean
ratio over its distinct bigrams, put through a logistic curve. A bigram counts once for each text, and equal training texts count
once, so that neither a word repeated over and over nor a copied text passes for evidence.

Counts come from labelled texts of the training folds and are joined and aggregated by Spark. Expressions seen at least ``least`` times
are listed. The ``most`` most frequent ones at most reach the tasks as a broadcast of a fixed bound; the rest stay a table, which is joined to the
expressions of the texts, so that every listed expression counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import cut

from .words import PlainWords, as_long, split_words, texts_of

#: Folds by crc32(doc_id) mod 4: these two are counted, this one sets the curve, the one that is left is held out.
COUNTED, CURVE, HELD_OUT = (0, 1), 3, 2
DISCOUNT = 0.75
_START = 1
_QUICK = 22


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


def _ids(text: bytes, hashes: PlainWords) -> np.ndarray:
    """31-bit word ids of the words with a letter or digit, after a mark for the start."""
    found = hashes.of(split_words(text))
    found = found[found != 0] >> np.uint64(33)
    return np.concatenate((np.array([_START], np.uint64), found))


def _bigrams(ids: np.ndarray) -> np.ndarray:
    return (ids[:-1] << np.uint64(32)) | ids[1:]


def bigram_counts(texts: DataFrame) -> DataFrame:
    """``v, w, toxic, ordinary``: texts of either class (``text, toxic``) in which word ``w`` follows word ``v``."""

    def count(batches):
        hashes = PlainWords()
        for batch in batches:
            grams = {0: [], 1: []}
            for label, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
                if text is not None and label in grams:
                    grams[label].append(np.unique(_bigrams(_ids(text, hashes))))
            for label, found in grams.items():
                keys, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
                n = pa.array(n.astype(np.int64), pa.int64())
                none = pa.array(np.zeros(len(keys), np.int64))
                yield pa.RecordBatch.from_arrays([as_long(keys), n if label else none, none if label else n], names=["key", "toxic", "ordinary"])

    rows = texts.select("text", "toxic").mapInArrow(count, "key long, toxic long, ordinary long")
    sums = rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return sums.select(F.shiftrightunsigned("key", 32).alias("v"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("w"), "toxic", "ordinary")


def _cutoff(counts: DataFrame, least: int, most: int) -> int:
    """The smallest count from ``least`` on that at most ``most`` rows of ``counts (n)`` reach."""
    ladder = F.least(F.col("n"), F.lit(1 << 20))
    kept = counts.where(F.col("n") >= least).groupBy(ladder.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).collect()
    total = 0
    for row in kept:
        total += row["rows"]
        if total > most:
            return row["n"] + 1
    return least


def _telling(t, o, all_t, all_o, evidence: float, contrast: float):
    """Whether two counts differ by more than chance (G2) and their shares by a factor of ``contrast`` at least."""
    both, every = t + o, F.greatest(all_t + all_o, F.lit(1))

    def term(n, expected):
        return F.when((n > 0) & (expected > 0), n * F.log(n / expected)).otherwise(0.0)

    g2 = 2 * (term(t, both * all_t / every) + term(o, both * all_o / every))
    factor = F.abs(F.log((t + 0.5) / F.greatest(all_t, F.lit(1))) - F.log((o + 0.5) / F.greatest(all_o, F.lit(1))))
    return (g2 >= evidence) & (factor >= math.log(contrast))


def expression_ratios(counts: DataFrame, least: int = 5, evidence: float = 24.0, contrast: float = 3.0) -> DataFrame:
    """``key, n, ratio``: the log-likelihood ratio of each listed word (its id) and bigram (both ids), and how many texts have it."""
    d = F.lit(DISCOUNT)
    seen = [(F.col(c) > 0).cast("long") for c in ("toxic", "ordinary")]
    words = cut(counts.groupBy("w").agg(F.sum(seen[0]).alias("after_t"), F.sum(seen[1]).alias("after_o"), F.count("*").alias("after"), F.sum("toxic").alias("n_t"), F.sum("ordinary").alias("n_o")).withColumn("n", F.col("n_t") + F.col("n_o")))
    totals = words.agg(
        F.sum("n_t").alias("sum_t"), F.sum("n_o").alias("sum_o"),
        F.sum("after_t").alias("all_t"), F.sum("after_o").alias("all_o"), F.sum("after").alias("all"), F.count("*").alias("vocabulary"),
        F.sum((F.col("after_t") > 0).cast("long")).alias("types_t"), F.sum((F.col("after_o") > 0).cast("long")).alias("types_o"),
    )
    contexts = counts.groupBy("v").agg(F.sum("toxic").alias("v_t"), F.sum("ordinary").alias("v_o"), F.count("*").alias("next"))
    words = words.crossJoin(F.broadcast(totals))
    shared = F.greatest(F.col("after") - d, F.lit(0.25)) / F.greatest(F.col("all"), F.lit(1))

    def backed(c: str):
        every = F.greatest(F.col(f"all_{c}"), F.lit(1))
        return F.greatest(F.col(f"after_{c}") - d, F.lit(0.0)) / every + d * F.col(f"types_{c}") / every * shared + F.lit(1e-12)

    words = words.withColumn("p_t", backed("t")).withColumn("p_o", backed("o"))
    plain = ~_telling(F.col("n_t"), F.col("n_o"), F.col("sum_t"), F.col("sum_o"), evidence, contrast)
    words = words.withColumn("p_t", F.when(plain, shared).otherwise(F.col("p_t"))).withColumn("p_o", F.when(plain, shared).otherwise(F.col("p_o")))
    words = cut(words.where(F.col("n") >= least).select("w", "n", "p_t", "p_o", F.log(F.col("p_t") / F.col("p_o")).alias("ratio")))
    sums = counts.agg(F.sum("toxic").alias("sum_t"), F.sum("ordinary").alias("sum_o"))
    pairs = counts.withColumn("n", F.col("toxic") + F.col("ordinary")).where(F.col("n") >= least).crossJoin(F.broadcast(sums))
    pairs = pairs.where(_telling(F.col("toxic"), F.col("ordinary"), F.col("sum_t"), F.col("sum_o"), evidence, contrast))
    pairs = pairs.join(words.drop("n", "ratio"), "w").join(contexts, "v")
    share = d * F.col("next") / (F.col("v_t") + F.col("v_o"))

    def whole(c: str, column: str):
        return F.greatest(F.col(column) - d, F.lit(0.0)) / F.greatest(F.col(f"v_{c}"), F.lit(1)) + share * F.col(f"p_{c}")

    key = F.shiftleft("v", 32).bitwiseOR(F.col("w"))
    pairs = pairs.select(key.alias("key"), "n", F.log(whole("t", "toxic") / whole("o", "ordinary")).alias("ratio"))
    words = words.where("ratio <> 0")
    return cut(words.select(F.col("w").alias("key"), "n", "ratio").union(pairs))


def _rest(rows: DataFrame, cutoff: int) -> DataFrame:
    """``key, ratio`` of the expressions seen less than ``cutoff`` times; a bigram's is what it adds to the ratio of its second word."""
    words = rows.where("key < 4294967296").select(F.col("key").alias("w"), F.col("ratio").alias("own"))
    less = rows.where(F.col("n") < cutoff).withColumn("w", F.when(F.col("key") >= 1 << 32, F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))
    return cut(less.join(words, "w", "left").select("key", (F.col("ratio") - F.coalesce("own", F.lit(0.0))).alias("ratio")))


class Model:
    """The listed expressions in the tasks: sorted keys, ratios and a bitmap that rules most other keys out."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[order]
        self.quick = np.zeros(1 << _QUICK, bool)
        self.quick[self._spot(self.keys)] = True
        self.slope, self.offset = slope, offset
        self.rest = None

    def __getstate__(self):
        return self.__dict__ | {"rest": None}

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _QUICK)).astype(np.int64)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` that are listed, and their ratios."""
        at = np.flatnonzero(self.quick[self._spot(keys)])
        if not len(at) or not len(self.keys):
            return at[:0], self.ratios[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        return at[hit], self.ratios[place[hit]]

    def _values(self, text: bytes, hashes: PlainWords):
        """Distinct bigrams of the text, their ratios and the positions of the bigrams that are listed themselves."""
        grams = np.unique(_bigrams(_ids(text, hashes)))
        values = np.zeros(len(grams))
        at, single = self._look(grams & np.uint64((1 << 32) - 1))
        values[at] = single
        at, double = self._look(grams)
        values[at] = double
        return grams, values, at

    def mean_ratio(self, text: bytes, hashes: PlainWords, extra: float = 0.0) -> float:
        """Mean log-likelihood ratio of the distinct bigrams of the text; 0 for a text without words. ``extra``: what ``rest`` adds to the sum."""
        values = self._values(text, hashes)[1]
        return float((values.sum() + extra) / len(values)) if len(values) else 0.0

    def others(self, text: bytes, hashes: PlainWords) -> tuple[np.ndarray, np.ndarray]:
        """Expressions of the text that ``rest`` may list, and how often they count."""
        grams, _, listed = self._values(text, hashes)
        grams = np.delete(grams, listed)
        words, times = np.unique(grams & np.uint64((1 << 32) - 1), return_counts=True)
        return np.concatenate((words, grams)), np.concatenate((times, np.ones(len(grams), np.int64)))

    def with_rest(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``__extra``, the sum of ``rest`` over each text; as they are if all expressions are in the tasks."""
        if self.rest is None:
            return docs
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def expressions(batches):
            hashes = PlainWords()
            for batch in batches:
                for place, text in zip(batch.column("place"), texts_of(batch), strict=True):
                    keys, times = shared.value.others(text or b"", hashes)
                    yield pa.RecordBatch.from_arrays([pa.repeat(place, len(keys)), as_long(keys), pa.array(times)], names=["place", "key", "times"])

        # A text's sum depends on the text alone, so equal ones are looked up once.
        texts = docs.select(F.sha2("text", 256).alias("place"), "text").where("text is not null").dropDuplicates(["place"])
        found = texts.mapInArrow(expressions, "place string, key long, times long").join(self.rest, "key")
        sums = found.groupBy("place").agg(F.sum(F.col("ratio") * F.col("times")).alias("__extra")).withColumnRenamed("place", "__place")
        return docs.withColumn("__place", F.sha2("text", 256)).join(sums, "__place", "left").drop("__place").withColumn("__extra", F.coalesce("__extra", F.lit(0.0)))

    def score(self, text: bytes | None, hashes: PlainWords, extra: float = 0.0) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.mean_ratio(text or b"", hashes, extra) + self.offset, -30, 30))))


def _with_extra(batch):
    """The texts of a batch, each with what the table of the rest adds."""
    extra = batch.column("__extra").to_pylist() if "__extra" in batch.schema.names else [0.0] * batch.num_rows
    return zip(texts_of(batch), extra, strict=True)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a slight pull to zero; the prior alone if a class is missing."""
    if not len(y):
        return 0.0, -4.0
    scale = float(np.std(x)) or 1.0
    rows, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, least: int = 5, most: int = 500_000, curve_rows: int = 100_000) -> Model:
    """Train on the labelled texts outside the held-out fold.

    ``docs (doc_id, text, ...)``, ``labels (doc_id, toxic, ...)``. All labelled texts of the counted folds are counted; the two
    numbers of the curve are fitted on at most ``curve_rows`` texts of another fold. Rows whose label is null or not
    0 or 1 are left out; of repeated labels of one document the largest counts. Without labels every score is the same.
    """
    spark = docs.sparkSession
    marks = cut(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != HELD_OUT))
    small = marks.count() <= 2_000_000
    marked = docs.select("doc_id", "text").where(fold() != HELD_OUT).join(F.broadcast(marks) if small else marks, "doc_id")
    once = marked.where(fold().isin(*COUNTED)).withColumn("h", F.xxhash64("text")).select("h", "toxic", "text").dropDuplicates(["h", "toxic"])
    counts = cut(bigram_counts(once))
    rows = expression_ratios(counts, least)
    cutoff = _cutoff(rows, least, most)
    listed = rows.where(F.col("n") >= cutoff).toPandas()
    model = Model(listed["key"].to_numpy(np.int64).view(np.uint64), listed["ratio"].to_numpy(float))
    if cutoff > least:
        model.rest = _rest(rows, cutoff)
    shared = spark.sparkContext.broadcast(model)

    def ratios(batches):
        hashes = PlainWords()
        for batch in batches:
            found = [shared.value.mean_ratio(text or b"", hashes, extra) for text, extra in _with_extra(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.float64())], names=["doc_id", "toxic", "x"])

    held = model.with_rest(marked.where(fold() == CURVE).select("doc_id", "text", "toxic")).mapInArrow(ratios, "doc_id long, toxic int, x double")
    sample = held.orderBy(F.crc32(F.concat(F.lit("curve"), F.col("doc_id").cast("string"))), "doc_id", "x").limit(curve_rows).toPandas()
    model.slope, model.offset = _logistic(sample["x"].to_numpy(float), sample["toxic"].to_numpy(float))
    return model


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts are scored as texts without words.

    A null doc_id counts as held out, as no label can belong to it. Extra columns are ignored; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        hashes = PlainWords()
        for batch in batches:
            found = [shared.value.score(text, hashes, extra) for text, extra in _with_extra(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = model.with_rest(docs.select("doc_id", "text")).mapInArrow(scores, "doc_id long, score double")
    held = F.coalesce(fold() == HELD_OUT, F.lit(True))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below ``threshold``, decided row by row where they are read."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches):
        hashes = PlainWords()
        for batch in batches:
            kept = pa.array([shared.value.score(text, hashes, extra) < threshold for text, extra in _with_extra(batch)], pa.bool_())
            yield batch.select(columns).filter(kept)

    return model.with_rest(docs).mapInArrow(keep, docs.schema)
