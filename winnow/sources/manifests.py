"""Content manifests: digests, validation before acting, storage usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_empty


def manifest(rows: DataFrame, *, key: str = "path", content: str = "content", extra: Sequence[str] = ()) -> DataFrame:
    """Path, size and sha256 of every selected row."""
    body = F.col(content).cast("binary")
    return rows.select(
        key, *extra, F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("sha256")
    )


def check_manifest(stored: DataFrame, current: DataFrame, *, key: str = "path", decision: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Status of every manifest row against what exists now; anything but ok must stop the action."""
    now = current.select(
        key,
        F.col("size_bytes").alias("now_size"),
        F.col("sha256").alias("now_sha"),
        *([F.col(decision).alias("now_decision")] if decision else []),
    )
    rows = stored.join(now, key, "left")
    status = F.when(F.col("now_sha").isNull(), "missing")
    if decision:
        status = status.when(~F.col(decision).eqNullSafe(F.col("now_decision")), "decision_changed")
    status = status.when(F.col("size_bytes") != F.col("now_size"), "size_changed").when(
        F.col("sha256") != F.col("now_sha"), "content_changed"
    )
    if targets is not None:
        rows = rows.join(targets.select(key, F.lit(True).alias("taken")), key, "left")
        status = status.when(F.coalesce("taken", F.lit(False)), "target_exists")
    return rows.withColumn("status", status.otherwise("ok")).select(key, "status")


def require_current(checked: DataFrame) -> None:
    require_empty(checked.filter(F.col("status") != "ok"), "manifest is stale")


def storage_usage(files: DataFrame, *, by: Sequence[str] = (), length: str = "size_bytes") -> DataFrame:
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")
    )
