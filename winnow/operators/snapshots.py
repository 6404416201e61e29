"""Incremental snapshot maintenance: diff, missing marks, scoping, reports, invalidation, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def diff_snapshot(prior: DataFrame, current: DataFrame, *, key: Sequence[str], fingerprint: Sequence[str], keep_flag: str | None = None) -> DataFrame:
    """Full outer comparison: added / changed / unchanged / unseen per key.

    A prior row carrying ``keep_flag`` (quarantined) always counts as changed
    when it is seen again.
    """
    p = prior.select(
        *key,
        *[F.col(c).alias(f"prior_{c}") for c in fingerprint],
        (F.col(keep_flag) if keep_flag else F.lit(False)).alias("__kept"),
        F.lit(True).alias("__in_prior"),
    )
    c = current.select(*key, *fingerprint, F.lit(True).alias("__in_current"))
    same = F.lit(True)
    for name in fingerprint:
        same = same & F.col(name).eqNullSafe(F.col(f"prior_{name}"))
    status = (
        F.when(F.col("__in_prior").isNull(), "added")
        .when(F.col("__in_current").isNull(), "unseen")
        .when(same & ~F.col("__kept"), "unchanged")
        .otherwise("changed")
    )
    return (
        p.join(c, list(key), "full")
        .withColumn("status", status)
        .select(*key, *[f"prior_{n}" for n in fingerprint], *fingerprint, "status")
    )


def mark_missing(prior: DataFrame, current: DataFrame, failures: DataFrame, *, key: Sequence[str], project: str = "project_id", scope: DataFrame | None = None, cancelled: bool = False) -> DataFrame:
    """Prior rows that were in scope and not seen; none where the scan failed.

    ``failures`` holds one row per failed path; a project with any failure
    marks nothing missing, nor does a cancelled scan. Quarantined rows are exempt.
    """
    if cancelled:
        return prior.limit(0)
    gone = prior.filter(~F.col("quarantined") & ~F.col("missing")).join(
        current.select(*key), list(key), "left_anti"
    )
    if scope is not None:
        gone = in_scope(gone, scope, project=project)
    broken = failures.select(project).distinct()
    return gone.join(broken, project, "left_anti")


def in_scope(rows: DataFrame, scope: DataFrame, *, project: str = "project_id", path: str = "path") -> DataFrame:
    """Rows at or below any scope path, by exact prefix keys rather than a theta join.

    Every row lists its own ancestor prefixes; membership is then an equi join.
    """
    roots = scope.select(project, F.col(path).alias("__prefix")).distinct()
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    hit = (
        rows.select(project, path, F.explode(prefixes).alias("__prefix"))
        .join(broadcast_if_small(roots), [project, "__prefix"], "left_semi")
        .select(project, path)
        .distinct()
    )
    return rows.join(hit, [project, path], "left_semi")


def scan_report(classified: DataFrame, failures: DataFrame, *, project: str = "project_id") -> DataFrame:
    """Counts per project and its failed paths as separate counted rows."""
    counts = classified.groupBy(project).agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if(F.col("status") == "unseen").alias("unseen"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    failed = failures.groupBy(project).agg(F.count("*").alias("failed"))
    return counts.join(failed, project, "full").na.fill(0)


def invalidate(children: DataFrame, changed: DataFrame, *, key: str | Sequence[str]) -> DataFrame:
    """Children that survive: none whose parent changed or failed."""
    keys = [key] if isinstance(key, str) else list(key)
    return children.join(changed.select(*keys).distinct(), keys, "left_anti")


def next_snapshot(prior: DataFrame, current: DataFrame, missing: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """The catalog after a scan: seen rows replaced, unseen rows kept, missing ones flagged."""
    kept = prior.join(current.select(*key), list(key), "left_anti")
    gone = missing.select(*key, F.lit(True).alias("__gone"))
    flagged = (
        kept.join(gone, list(key), "left")
        .withColumn("missing", F.col("missing") | F.coalesce("__gone", F.lit(False)))
        .drop("__gone")
    )
    return flagged.unionByName(current, allowMissingColumns=True)


def upsert(base: DataFrame, rows: DataFrame, *, key: str, seq: str) -> DataFrame:
    """Latest row per key of base and new rows together."""
    merged = base.unionByName(rows)
    others = [c for c in merged.columns if c not in (key, seq)]
    return (
        merged.groupBy(key)
        .agg(F.max_by(F.struct(*others, seq), seq).alias("__row"))
        .select(key, *[f"__row.{c}" for c in others], f"__row.{seq}")
    )


def explode_items(analyses: DataFrame, *, key: str = "photo_id", items: str = "faces") -> DataFrame:
    """One row per nested item with its position."""
    return analyses.select(key, F.posexplode(items).alias("item_index", "item")).select(
        key, "item_index", "item.*"
    )


def group_inputs_digest(rows: DataFrame, *, project: str = "project_id", columns: Sequence[str]) -> DataFrame:
    """Order-independent digest of everything grouping reads, per project.

    Row digests are summed as decimals, so the map side already collapses a
    project's rows and no project is gathered.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"__d{i}")
        for i in range(2)
    ]
    return (
        rows.groupBy(project)
        .agg(F.count("*").alias("rows"), *parts)
        .select(
            project,
            "rows",
            F.concat_ws("-", F.col("__d0").cast("string"), F.col("__d1").cast("string")).alias("digest"),
        )
    )


def dirty_projects(before: DataFrame, after: DataFrame, *, project: str = "project_id") -> DataFrame:
    """Projects whose grouping inputs differ from the stored digest, or are new."""
    old = before.select(project, F.col("digest").alias("__old"))
    return (
        after.join(old, project, "left")
        .filter(~F.col("digest").eqNullSafe(F.col("__old")))
        .select(project)
    )
