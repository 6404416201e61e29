"""Corpus statistics: weighted means, mean vector, covariance and distance from a fitted corpus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_mean(df: DataFrame, *, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean of observed values; a missing value takes its weight out."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("mean"))


def covariance(df: DataFrame, *, vector: str, size: int) -> DataFrame:
    """(i, j, mean_i, mean_j, covariance) for i <= j over all rows.

    Each task folds its rows into one size x size moment matrix, so the shuffle
    carries tasks x size^2 / 2 numbers whatever the row count. Moments are taken
    about each task's own mean and combined exactly afterwards.
    """

    def moments(batches):
        n, mean, m2 = 0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            rows = [v for v in pdf["v"] if v is not None and len(v) == size]
            if not rows:
                continue
            x = np.stack(rows).astype(np.float64)
            k, mu = len(x), x.mean(axis=0)
            d = mu - mean
            c = x - mu
            m2 += c.T @ c + np.outer(d, d) * (n * k / (n + k))
            mean += d * (k / (n + k))
            n += k
        if n:
            i, j = np.triu_indices(size)
            yield pd.DataFrame(
                {"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n, "mi": mean[i], "mj": mean[j], "c": m2[i, j]}
            )

    parts = df.select(F.col(vector).alias("v")).mapInPandas(moments, "i int, j int, n long, mi double, mj double, c double")
    total = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("mean_i"),
        (F.sum(F.col("n") * F.col("mj")) / F.sum("n")).alias("mean_j"),
        F.sum(F.col("c") + F.col("n") * F.col("mi") * F.col("mj")).alias("raw"),
    )
    n = F.col("n")
    return total.select(
        "i",
        "j",
        "mean_i",
        "mean_j",
        ((F.col("raw") - n * F.col("mean_i") * F.col("mean_j")) / (n - 1)).alias("covariance"),
    )


def fit(df: DataFrame, *, vector: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance matrix; size^2 numbers reach the driver, never rows."""
    mean, cov = np.zeros(size), np.zeros((size, size))
    for r in covariance(df, vector=vector, size=size).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["covariance"]
        mean[r["i"]], mean[r["j"]] = r["mean_i"], r["mean_j"]
    return mean, cov


def distance_from(blocks: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float | None:
    """Distance of a row's feature blocks from the fitted corpus; lower is more natural.

    Each feature is averaged over its finite values; the covariance needs blocks in which all features are finite.
    """
    finite = np.isfinite(blocks)
    whole = blocks[finite.all(axis=1)]
    if len(whole) < 2 or not finite.any(axis=0).all():
        return None
    mu = np.where(finite, blocks, 0.0).sum(axis=0) / finite.sum(axis=0)
    diff = mu - mean
    value = float(diff @ np.linalg.pinv((np.cov(whole, rowvar=False) + cov) / 2) @ diff)
    return float(np.sqrt(max(value, 0.0))) if np.isfinite(value) else None


def distances(df: DataFrame, mean: np.ndarray, cov: np.ndarray, *, id: str, blocks: str) -> DataFrame:
    """``id, distance`` of every row's ``blocks`` (array of feature arrays) from a fitted corpus; null where it can't be told."""
    kind = df.schema[id].dataType.simpleString()

    def measure(batches):
        for pdf in batches:
            found = [None if b is None or not len(b) else distance_from(np.stack(b).astype(np.float64), mean, cov) for b in pdf["blocks"]]
            yield pd.DataFrame({id: pdf[id], "distance": pd.Series(found, dtype="float64")})

    return df.select(F.col(id).alias(id), F.col(blocks).alias("blocks")).mapInPandas(measure, f"{id} {kind}, distance double")
