"""Versioned embedding spaces: pending rows, coverage, upsert and exact top-k cosine search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..session import cut, require_empty, spread
from .catalog import available
from .ranking import first_n

_SPACE = re.compile(r"^[0-9a-fA-F]{64}$")
FINGERPRINT = ("mtime", "size_bytes")


def check_space(space: str) -> str:
    if not _SPACE.match(space):
        raise ValueError("a vector space is named by 64 hexadecimal characters")
    return space


def _fresh(entities: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    stored = vectors.filter(F.col("space_key") == check_space(space)).select(
        "photo_id", *FINGERPRINT, F.lit(True).alias("indexed")
    )
    return available(entities).join(stored, ["photo_id", *FINGERPRINT], "left")


def pending(entities: DataFrame, vectors: DataFrame, *, space: str) -> DataFrame:
    """Available rows without a vector of this space for their current fingerprint."""
    return (
        _fresh(entities, vectors, space)
        .filter(F.col("indexed").isNull())
        .select("project_id", "photo_id", *FINGERPRINT)
    )


def coverage(entities: DataFrame, vectors: DataFrame, *, space: str) -> DataFrame:
    return (
        _fresh(entities, vectors, space)
        .groupBy("project_id")
        .agg(F.count("*").alias("total"), F.count("indexed").alias("indexed"))
        .withColumn("pending", F.col("total") - F.col("indexed"))
    )


def save_vectors(stored: DataFrame, rows: DataFrame, entities: DataFrame, *, space: str) -> DataFrame:
    """Vector table after an all-or-nothing upsert of normalised rows from unchanged sources."""
    check_space(space)
    ready = rows.withColumn("vector", normalize("vector")).withColumn("dimensions", F.size("vector"))
    bad = ready.filter(F.col("vector").isNull() | ~F.col("dimensions").between(2, 2048)).select("photo_id")
    require_empty(bad, "invalid vector")
    same = available(entities).select("photo_id", *FINGERPRINT)
    require_empty(
        ready.select("photo_id", *FINGERPRINT).join(same, ["photo_id", *FINGERPRINT], "left_anti"),
        "source changed during indexing",
    )
    fresh = ready.select("photo_id", F.lit(space).alias("space_key"), *FINGERPRINT, "dimensions", "vector")
    return stored.join(fresh.select("photo_id"), "photo_id", "left_anti").unionByName(fresh)


def searchable(entities: DataFrame, vectors: DataFrame, *, space: str, dimensions: int) -> DataFrame:
    """Live, fresh, well-formed unit vectors of one space."""
    live = available(entities).select("project_id", "photo_id", *FINGERPRINT)
    return (
        vectors.filter((F.col("space_key") == check_space(space)) & (F.col("dimensions") == dimensions))
        .join(live, ["photo_id", *FINGERPRINT])
        .select("project_id", "photo_id", normalize("vector", dimensions).alias("vector"))
        .filter(F.col("vector").isNotNull())
    )


def search(vectors: DataFrame, query: Sequence[float], *, k: int, id: str = "photo_id", vector: str = "vector") -> DataFrame:
    """Exact top-k for one query: a narrow scan and a bounded top-k, no shuffle of vectors."""
    q = np.asarray(query, dtype=np.float32)
    if not 1 <= k <= 200 or not 2 <= q.size <= 2048:
        raise ValueError("invalid search dimensions or limit")
    length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    if not np.isfinite(q).all() or not length > 1e-12:
        raise ValueError("query vector must be finite and non-zero")
    unit = (q.astype(np.float64) / length).astype(np.float32)
    terms = F.array(*[F.lit(float(x)) for x in unit])
    product = F.aggregate(
        F.zip_with(vector, terms, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x
    )
    return (
        vectors.select(id, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)).alias("similarity"))
        .orderBy(F.col("similarity").desc(), F.col(id).asc())
        .limit(k)
    )


QUERY_BLOCK_BYTES = 64 * 1024 * 1024

#: Queries of a task where queries are many.
QUERY_ROWS = 4_096


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int, dimensions: int, id: str = "photo_id", vector: str = "vector", query_id: str = "query_id", exclude_self: bool = False, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Exact top-k for many queries, without joining queries to vectors.

    Both sides are counted first. Queries that are few beside the vectors and fit ``block_bytes`` are broadcast
    once and the vectors scanned; the shuffle then carries tasks x queries x k narrow rows. Otherwise the queries stay where they
    are, and the vectors are broadcast in blocks of that size, split by hash: the shuffle carries blocks x queries x k narrow
    rows. Vectors are never shuffled beside queries, and the driver and a task hold one block at a time.
    """
    if not 1 <= k <= 200 or not 2 <= dimensions <= 2048:
        raise ValueError("invalid search dimensions or limit")
    ready = queries.select(
        F.col(query_id).alias("q"), normalize(vector, dimensions).alias("v")
    ).filter(F.col("v").isNotNull())
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    asked, held = ready.count(), rows.count()
    q_type = queries.schema[query_id].dataType.simpleString()
    id_type = vectors.schema[id].dataType.simpleString()
    schema = f"q {q_type}, id {id_type}, similarity double"
    context = rows.sparkSession.sparkContext
    if asked * dimensions * 8 <= block_bytes and asked * 10 <= held:
        shared = context.broadcast(_matrix(ready.toPandas(), "q"))
        partial = rows.mapInPandas(_scan(shared, k, exclude_self), schema)
    else:
        ready, rows = spread(cut(ready), "q", rows=QUERY_ROWS), cut(rows)
        blocks = max(1, -(-held * dimensions * 8 // block_bytes))
        parts = []
        for block in range(blocks):
            mine = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else rows
            shared = context.broadcast(_matrix(mine.toPandas(), "id"))
            # Written before the next block is fetched, so that the driver and the tasks hold one block at a time.
            parts.append(cut(ready.mapInPandas(_ask(shared, k, exclude_self), schema)))
            shared.destroy()
        partial = reduce(DataFrame.unionByName, parts)
    order = [F.col("similarity").desc(), F.col("id").asc()]
    return first_n(partial, key=["q"], order=order, n=k, name="rank").select(
        F.col("q").alias(query_id), F.col("id").alias(id), "similarity", "rank"
    )


#: Numbers that a task holds of one product of queries and vectors (8 MiB of doubles), and vectors that meet a slice of queries at a time.
SLICE_NUMBERS, MET = 1024 * 1024, 2_048
#: Pairs whose similarity is summed at a time, and what a product may be off from that sum.
PAIRS, SLACK = 65_536, 1e-9


class _Best:
    """The k most similar rows of each query so far, the smaller id first among equals."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool):
        self.names, self.queries, self.exclude_self = names, queries, exclude_self
        self.sims, self.ids = np.full((len(names), k), -np.inf), None

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.empty(self.sims.shape, ids.dtype)
        step = max(1, SLICE_NUMBERS // MET)
        for at in range(0, len(self.names), step):
            for low in range(0, len(ids), MET):
                self._slice(slice(at, at + step), ids[low : low + MET], vectors[low : low + MET])

    def _slice(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> None:
        names, queries, best, k = self.names[part], self.queries[part], self.sims[part], self.sims.shape[1]
        products = queries @ vectors.T
        bound = best[:, -1]
        if np.isneginf(bound).any():
            # The k-th of these rows bounds the result until k rows are known.
            own = np.where(np.isfinite(products), np.clip(products, -1.0, 1.0), -np.inf)
            if self.exclude_self:
                own[names[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                bound = np.maximum(bound, np.partition(own, len(ids) - k, axis=1)[:, len(ids) - k])
        slack = SLACK * np.sqrt(np.nanmax((vectors * vectors).sum(axis=1), initial=1.0))
        x, y = np.nonzero(products >= np.where(bound > -1, bound - slack, -np.inf)[:, None])
        if self.exclude_self:
            other = names[x] != ids[y]
            x, y = x[other], y[other]
        if not len(x):
            return
        # Summed in one order wherever a pair stands, so that equal vectors are equally similar.
        sims = np.concatenate([(queries[x[i : i + PAIRS]] * vectors[y[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(x), PAIRS)])
        sims, found = np.clip(sims, -1.0, 1.0), ids[y]
        rows = np.unique(x)
        kept = np.isfinite(best[rows])
        x = np.concatenate([x, np.repeat(rows, kept.sum(axis=1))])
        sims, found = np.concatenate([sims, best[rows][kept]]), np.concatenate([found, self.ids[part][rows][kept]])
        order = np.lexsort((found, -sims, x))
        order = order[np.isfinite(sims[order])]
        x, sims, found = x[order], sims[order], found[order]
        first = np.searchsorted(x, x, "left")
        rank = np.arange(len(x)) - first
        top = rank < k
        best[x[top], rank[top]] = sims[top]
        self.ids[part][x[top], rank[top]] = found[top]

    def frame(self) -> pd.DataFrame:
        kept = np.isfinite(self.sims)
        return pd.DataFrame({"q": np.repeat(self.names, kept.sum(axis=1)), "id": self.ids[kept], "similarity": self.sims[kept]})


def _matrix(block: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Names and vectors of a block."""
    return block[name].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float64) if len(block) else None


def _scan(shared, k: int, exclude_self: bool):
    """Task body: running k best per query over the vectors of one partition."""

    def work(batches):
        names, queries = shared.value
        best = None if queries is None else _Best(names, queries, k, exclude_self)
        for pdf in batches:
            if best is not None and len(pdf):
                best.meet(*_matrix(pdf, "id"))
        if best is not None and best.ids is not None:
            yield best.frame()

    return work


def _ask(shared, k: int, exclude_self: bool):
    """Task body: k best per query of one partition over a block of vectors."""

    def work(batches):
        ids, vectors = shared.value
        for pdf in batches:
            if vectors is not None and len(pdf):
                best = _Best(*_matrix(pdf, "q"), k, exclude_self)
                best.meet(ids, vectors)
                yield best.frame()

    return work
