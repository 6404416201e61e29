"""Catalog queries: freshness, stale masking, filters, stable order and pages."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, require_empty
from .ranking import global_position

# Beyond this many leading rows a page is cut out of a range-partitioned order
# instead of being gathered by a single top-k task.
TOP_K_ROWS = 100_000


@dataclass(frozen=True)
class PageFilter:
    decision: str | None = None
    color_label: str | None = None
    format: str | None = None
    verdict: str | None = None
    rating: int | None = None
    photo_id: int | None = None
    include_missing: bool = False
    sort: str = "name"
    descending: bool = False
    offset: int = 0
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.sort not in ("name", "score", "suggestion", "size", "date"):
            raise ValueError("unsupported sort")
        if self.rating is not None and not 0 <= self.rating <= 5:
            raise ValueError("rating must be between 0 and 5")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("offset and limit must not be negative")

    @classmethod
    def parse(cls, data: dict) -> "PageFilter":
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter fields: {sorted(unknown)}")
        return cls(**data)


def freshness(analyses: DataFrame, *, version: str, settings_key: str) -> DataFrame:
    """Adds ``status`` current/stale and masks what a stale result may expose.

    Stale rows stay visible with score -1 and no verdict.
    """
    current = (
        F.col("version").eqNullSafe(F.lit(version))
        & F.col("settings_key").eqNullSafe(F.lit(settings_key))
        & ~F.coalesce("source_invalid", F.lit(False))
    )
    return (
        analyses.withColumn("status", F.when(current, "current").otherwise("stale"))
        .withColumn("score", F.when(current, F.col("score")).otherwise(F.lit(-1.0)))
        .withColumn("verdict", F.when(current, F.col("verdict")))
    )


def candidates(entities: DataFrame, analyses: DataFrame) -> DataFrame:
    """Entities with their masked analysis columns; no analysis means status ``missing``."""
    narrow = analyses.select("photo_id", "score", "verdict", "status")
    return (
        entities.join(narrow, "photo_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("missing")))
        .withColumn("score", F.coalesce("score", F.lit(-1.0)))
    )


def page_predicate(f: PageFilter) -> Column:
    keep = F.lit(True)
    if not f.include_missing:
        keep = keep & ~F.col("missing") & ~F.col("quarantined")
    for name in ("decision", "color_label", "format", "verdict", "rating", "photo_id"):
        value = getattr(f, name)
        if value is not None:
            keep = keep & (F.col(name) == F.lit(value))
    return keep


def page_order(f: PageFilter) -> list[Column]:
    """Total order with explicit id ties; ``descending`` reverses every component."""

    def way(column: Column, up: bool = True) -> Column:
        return column.asc() if up != f.descending else column.desc()

    tie = way(F.col("photo_id"))
    if f.sort == "name":
        return [way(F.col("path")), tie]
    if f.sort in ("score", "suggestion"):
        return [way(F.col("score"), up=False), tie]
    if f.sort == "size":
        return [way(F.col("size_bytes")), tie]
    return [way(F.coalesce("taken_at", F.lit(""))), way(F.col("mtime")), tie]


def catalog_page(rows: DataFrame, f: PageFilter, *, scene_members: DataFrame | None = None) -> DataFrame:
    """One filtered, stably ordered page of a candidate view."""
    if f.limit == 0:
        return rows.limit(0)
    kept = rows.filter(page_predicate(f))
    if scene_members is not None:
        kept = kept.join(scene_members.select("photo_id"), "photo_id", "left_semi")
    order = page_order(f)
    end = None if f.limit is None else f.offset + f.limit
    if end is not None and end <= TOP_K_ROWS:
        return kept.orderBy(*order).offset(f.offset).limit(f.limit)
    if f.offset == 0 and f.limit is None:
        return kept.orderBy(*order)
    placed = global_position(kept, order).filter(F.col("position") >= f.offset)
    if end is not None:
        placed = placed.filter(F.col("position") < end)
    return placed.orderBy("position").drop("position")


def attach_payload(page: DataFrame, payloads: DataFrame, f: PageFilter, key: str = "photo_id") -> DataFrame:
    """Late materialisation: only the page's ids meet the wide table."""
    if f.limit is not None and f.limit <= TOP_K_ROWS:
        ids = F.broadcast(page)  # at most TOP_K_ROWS narrow rows
    else:
        ids = broadcast_if_small(page)
    return payloads.join(ids, key).orderBy(*page_order(f))


def available(entities: DataFrame) -> DataFrame:
    return entities.filter(~F.col("missing") & ~F.col("quarantined"))


def require_available(requested: DataFrame, entities: DataFrame, *, key=("project_id", "photo_id")) -> None:
    """Every requested row exists in its project and is available, or the request fails whole."""
    require_empty(unavailable(requested, entities, key=key), "rows are unknown or unavailable")


def unavailable(requested: DataFrame, entities: DataFrame, *, key=("project_id", "photo_id")) -> DataFrame:
    return requested.select(*key).distinct().join(available(entities).select(*key), list(key), "left_anti")


def readiness(entities: DataFrame, analyses: DataFrame, *, engine_version: str) -> DataFrame:
    """Active rows without a current-engine analysis, counted for all projects at once."""
    current = analyses.filter(F.col("version") == engine_version).select(
        "photo_id", F.lit(True).alias("__current")
    )
    return (
        available(entities)
        .join(current, "photo_id", "left")
        .groupBy("project_id")
        .agg(
            F.count("*").alias("active"),
            F.count_if(F.col("__current").isNull()).alias("pending_analysis"),
        )
    )
