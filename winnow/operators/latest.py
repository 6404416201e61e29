"""Latest-wins state over append-only logs (no windows, no correlated scans)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The enumerations of the decision and mark logs.
ACTIONS = ("pending", "keep", "reject", "flag")
COLORS = ("none", "red", "yellow", "green", "blue", "purple")


def encode(value: Column, codes: Sequence[str]) -> Column:
    """Position of an enumerated string, NULL when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in codes]), value).cast("int"), F.lit(0))


def decode(code: Column, codes: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in codes]), code)


def latest_by(
    log: DataFrame,
    *,
    key: str | Sequence[str],
    seq: str,
    values: Sequence[str],
    void: str | None = None,
    codes: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The newest non-void row's ``values`` per ``key``.

    Enumerated strings named in ``codes`` travel as small integers, which keeps
    the aggregation buffers fixed-width: Spark then hash-aggregates on the map
    side instead of sorting, and one hot key collapses before the shuffle.
    Keys with only void rows are absent; callers apply defaults after the join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    codes = codes or {}
    live = log.filter(F.col(void).isNull()) if void else log
    aggs = []
    for name in values:
        value = encode(F.col(name), codes[name]) if name in codes else F.col(name)
        aggs.append(F.max_by(value, F.col(seq)).alias(name))
    out = live.groupBy(*keys).agg(*aggs)
    for name in values:
        if name in codes:
            out = out.withColumn(name, decode(F.col(name), codes[name]))
    return out


def decision_state(log: DataFrame, *, key: str = "photo_id", seq: str = "seq") -> DataFrame:
    return latest_by(
        log, key=key, seq=seq, values=["action"], void="undone_at", codes={"action": ACTIONS}
    ).withColumnRenamed("action", "decision")


def mark_state(log: DataFrame, *, key: str = "photo_id", seq: str = "seq") -> DataFrame:
    return latest_by(
        log,
        key=key,
        seq=seq,
        values=["rating", "color_label"],
        void="undone_at",
        codes={"color_label": COLORS},
    )


def with_state(entities: DataFrame, decisions: DataFrame | None, marks: DataFrame | None, key: str = "photo_id") -> DataFrame:
    """Entities with current decision, stars and colour, defaults filled."""
    out = entities
    if decisions is not None:
        out = out.join(decisions, key, "left").withColumn(
            "decision", F.coalesce("decision", F.lit("pending"))
        )
    if marks is not None:
        out = (
            out.join(marks, key, "left")
            .withColumn("rating", F.coalesce("rating", F.lit(0)))
            .withColumn("color_label", F.coalesce("color_label", F.lit("none")))
        )
    return out


def open_session(sessions: DataFrame, *, project: str = "project_id", session: str = "session_id", seq: str = "seq", void: str = "undone_at") -> DataFrame:
    """Most recent session per project that has not been undone."""
    return (
        sessions.filter(F.col(void).isNull())
        .groupBy(project)
        .agg(F.max_by(session, seq).alias(session))
    )


def recent_first(history: DataFrame, *, order: str, tie: str, n: int) -> DataFrame:
    return history.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)
