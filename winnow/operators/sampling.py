"""Dataset curation: per-key picks, systematic group samples, seeded samples, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_n, global_position


def per_key_top(df: DataFrame, *, key: Sequence[str], order: Sequence[Column], n: int, distinct: str | None = None) -> DataFrame:
    """First ``n`` rows per key, at most one per ``distinct`` value inside a key."""
    rows = df
    if distinct:
        rows = first_n(rows, key=[*key, distinct], order=order, n=1)
    return first_n(rows, key=key, order=order, n=n)


def systematic_groups(df: DataFrame, *, group: str, n: int) -> DataFrame:
    """All rows of ``n`` groups evenly spread over the sorted group names."""
    names = df.select(group).distinct()
    placed = global_position(names, [F.col(group)])
    total = placed.count()
    picks = sorted({i * total // n for i in range(n)}) if total else []
    chosen = placed.filter(F.col("position").isin(*picks)).select(group)
    return df.join(F.broadcast(chosen), group, "left_semi")  # at most n names


def hash_sample(df: DataFrame, *, key: Sequence[str], seed: int, n: int) -> DataFrame:
    """``n`` rows without replacement in seeded hash order: repeatable and auditable."""
    if n <= 0:
        raise ValueError("n must be positive")
    return (
        df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])))
        .orderBy("__h", *key)
        .limit(n)
        .drop("__h")
    )


def eligible_portraits(df: DataFrame, *, id: str = "page_id", max_bytes: int = 6 * 1024 * 1024, max_pixels: int = 20_000_000, min_edge: int = 640) -> DataFrame:
    """Licence allowlist without NC/ND, size bounds, minimum edge, one row per id."""
    lic = F.col("license")
    free = lic.startswith("CC BY") | lic.startswith("CC0") | (lic == "Public domain")
    keep = (
        F.lower("title").rlike(r"\.jpe?g$")
        & free
        & ~lic.contains("NC")
        & ~lic.contains("ND")
        & (F.col("size") <= max_bytes)
        & (F.col("width").cast("long") * F.col("height") <= max_pixels)
        & (F.greatest("width", "height") >= min_edge)
    )
    return df.filter(keep).dropDuplicates([id])
