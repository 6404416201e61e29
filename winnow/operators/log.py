"""Curation log: decisions, marks, undo, bulk adoption and idempotent replay.

Every operation returns the rows it would append and the rows that forbid it;
``commit`` refuses the whole batch when a violation exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_empty
from .latest import open_session

SOURCES = ("human", "batch_adopt", "csv_import")


def _locked(rows: DataFrame, locks: DataFrame) -> DataFrame:
    flag = locks.select("photo_id").distinct().withColumn("__lock", F.lit(True))
    return rows.join(flag, "photo_id", "left").withColumn(
        "locked", F.coalesce("__lock", F.lit(False))
    ).drop("__lock")


def apply_decisions(requests: DataFrame, state: DataFrame, locks: DataFrame, *, source: str) -> tuple[DataFrame, DataFrame]:
    """(log rows, refused rows) for requested actions.

    ``requests``: project_id, photo_id, action. ``state``: project_id, photo_id,
    decision. Only rows whose decision changes are logged, with the previous
    value. A non-keep on a locked row is refused; callers treat it as an error
    for people and as a reported conflict for bulk adoption.
    """
    if source not in SOURCES:
        raise ValueError("invalid decision source")
    joined = _locked(requests.join(state, ["project_id", "photo_id"], "left"), locks)
    changed = joined.filter(F.col("decision").isNotNull() & (F.col("action") != F.col("decision")))
    guarded = F.col("locked") & (F.col("action") != "keep")
    log = changed.filter(~guarded).select(
        "project_id",
        "photo_id",
        "action",
        F.col("decision").alias("previous_action"),
        F.lit(source).alias("source"),
    )
    unknown = joined.filter(F.col("decision").isNull()).select(
        "project_id", "photo_id", "action", F.lit("unknown_row").alias("reason")
    )
    refused = changed.filter(guarded).select(
        "project_id", "photo_id", "action", F.lit("locked").alias("reason")
    )
    return log, unknown.unionByName(refused)


def commit(log: DataFrame, violations: DataFrame, *, session_id: str, source: str) -> DataFrame:
    """Stamp one session on the log rows; bulk adoption tolerates lock conflicts, people do not."""
    fatal = violations if source != "batch_adopt" else violations.filter(F.col("reason") != "locked")
    require_empty(fatal, "decision batch refused")
    return log.withColumn("session_id", F.lit(session_id))


def expand_variants(requests: DataFrame, entities: DataFrame, state: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, conflicts) when a decision also covers the other variants of a capture.

    Requests are collapsed to one row per (project, variant, action) first, so a
    variant shared by many requests does not multiply its siblings.
    """
    named = requests.select("project_id", "photo_id", "action").distinct()
    members = entities.select("project_id", "photo_id", "capture_variant_id")
    wanted = (
        named.join(members, ["project_id", "photo_id"])
        .filter(F.col("capture_variant_id").isNotNull())
        .groupBy("project_id", "capture_variant_id", "action")
        .agg(F.count_distinct("photo_id").alias("__askers"), F.min("photo_id").alias("__asker"))
    )
    reached = members.join(wanted, ["project_id", "capture_variant_id"]).filter(
        (F.col("__askers") > 1) | (F.col("photo_id") != F.col("__asker"))
    )
    explicit = requests.select("project_id", "photo_id").distinct().withColumn("__named", F.lit(True))
    judged = _locked(
        reached.join(state.select("project_id", "photo_id", "decision"), ["project_id", "photo_id"], "left")
        .join(explicit, ["project_id", "photo_id"], "left"),
        locks,
    ).withColumn("decision", F.coalesce("decision", F.lit("pending")))
    other = (F.col("decision") != "pending") & (F.col("decision") != F.col("action"))
    held = (
        F.col("__named").isNull()
        & (F.col("action") != "keep")
        & (F.col("action") != F.col("decision"))
        & F.col("locked")
    )
    conflicts = judged.filter(other | held).select("project_id", "photo_id", "action").distinct()
    changes = (
        named.unionByName(judged.filter(~(other | held)).select("project_id", "photo_id", "action"))
        .distinct()
    )
    return changes, conflicts


def first_wins(requests: DataFrame, *, key: str = "photo_id", position: str = "pos") -> DataFrame:
    """Each id once, at its first position in the request."""
    return requests.groupBy(key).agg(F.min(position).alias(position))


def apply_marks(requests: DataFrame, state: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decision log, mark log, violations); omitted (NULL) fields stay unchanged.

    ``requests``: project_id, photo_id, decision?, rating?, color_label?.
    """
    asked = requests.select(
        "project_id",
        "photo_id",
        F.col("decision").alias("new_decision"),
        F.col("rating").alias("new_rating"),
        F.col("color_label").alias("new_color"),
    )
    joined = _locked(asked.join(state, ["project_id", "photo_id"], "left"), locks)
    full = (
        joined.withColumn("new_decision", F.coalesce("new_decision", "decision"))
        .withColumn("new_rating", F.coalesce("new_rating", "rating"))
        .withColumn("new_color", F.coalesce("new_color", "color_label"))
    )
    known = F.col("decision").isNotNull()
    moved = F.col("new_decision") != F.col("decision")
    guarded = F.col("locked") & moved & (F.col("new_decision") != "keep")
    violations = full.filter(
        ~known | guarded | ~F.col("new_rating").between(0, 5)
    ).select(
        "project_id",
        "photo_id",
        F.when(~known, "unknown_row").when(guarded, "locked").otherwise("invalid_rating").alias("reason"),
    )
    decisions = full.filter(known & moved & ~guarded).select(
        "project_id", "photo_id", F.col("new_decision").alias("action"), F.col("decision").alias("previous_action")
    )
    marks = full.filter(
        known
        & ((F.col("new_rating") != F.col("rating")) | (F.col("new_color") != F.col("color_label")))
    ).select(
        "project_id", "photo_id", F.col("new_rating").alias("rating"), F.col("new_color").alias("color_label")
    )
    return decisions, marks, violations


def undo_latest(sessions: DataFrame, decisions: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones, report): void each project's newest open session and count distinct rows touched."""
    target = open_session(sessions)
    touched = (
        decisions.select("session_id", "photo_id")
        .union(marks.select("session_id", "photo_id"))
        .distinct()
    )
    report = (
        target.join(touched, "session_id", "left")
        .groupBy("project_id", "session_id")
        .agg(F.count("photo_id").alias("changed"))
    )
    return target.select("project_id", "session_id"), report


def adopt(candidates: DataFrame, locks: DataFrame, constraints: DataFrame, *, category: str = "all", live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, violations) of adopting suggestions in bulk.

    ``candidates``: project_id, photo_id, filename, decision, verdict, closed_eye,
    status, mtime, size_bytes. ``constraints``: photo_id, allowed. ``live`` holds the
    fingerprints seen now; a difference is a violation like a stale result.
    """
    if category not in ("all", "recommend", "reject_suggest"):
        raise ValueError("unknown category")
    rows = _locked(candidates.filter(F.col("decision") == "pending"), locks).join(
        constraints.select("photo_id", "allowed"), "photo_id", "left"
    )
    keeps = category in ("all", "recommend")
    locked_keep = F.col("locked") & F.lit(keeps)
    suggested = F.when(
        F.lit(keeps) & (F.col("verdict") == "recommend"), "keep"
    ).when(F.lit(category in ("all", "reject_suggest")) & (F.col("verdict") == "reject_suggest"), "reject")
    blocked = (suggested == "keep") & ~F.coalesce("allowed", F.lit(True))
    action = F.when(locked_keep, "keep").when(
        suggested.isNotNull() & ~F.coalesce(blocked, F.lit(False)) & ~F.coalesce("closed_eye", F.lit(False)),
        suggested,
    )
    chosen = rows.withColumn("action", action).filter(F.col("action").isNotNull())
    stale = ~locked_keep & (F.col("status") != "current")
    if live is not None:
        now = live.select("photo_id", F.col("mtime").alias("__m"), F.col("size_bytes").alias("__s"))
        chosen = chosen.join(now, "photo_id", "left")
        moved = ~(F.col("mtime").eqNullSafe(F.col("__m")) & F.col("size_bytes").eqNullSafe(F.col("__s")))
    else:
        moved = F.lit(False)
    violations = chosen.filter(stale | moved).select(
        "project_id",
        "photo_id",
        F.when(stale, "stale_analysis").otherwise("source_changed").alias("reason"),
    )
    return chosen.select("project_id", "photo_id", "action"), violations


def replay_guard(requests: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh requests, mismatches) against a journal of request_id and arguments.

    The same id with the same arguments is a no-op; with others it is an error.
    """
    seen = journal.groupBy("request_id").agg(
        F.min("arguments").alias("__lo"), F.max("arguments").alias("__hi")
    )
    asked = requests.groupBy("request_id").agg(
        F.min("arguments").alias("arguments"), F.max("arguments").alias("__arg_hi")
    )
    both = asked.join(seen, "request_id", "left")
    clash = (F.col("arguments") != F.col("__arg_hi")) | (
        F.col("__lo").isNotNull()
        & ((F.col("__lo") != F.col("arguments")) | (F.col("__hi") != F.col("arguments")))
    )
    fresh = both.filter(F.col("__lo").isNull() & ~clash).select("request_id", "arguments")
    return fresh, both.filter(clash).select("request_id")
