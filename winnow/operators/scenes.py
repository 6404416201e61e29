"""Scene partition: time-and-appearance sessions against a scene's first row.

A scene depends on its anchor, so rows must be folded in order. The order is
(project, time, id), cut by range into chunks whatever the keys look like: a
project with a third of all rows is simply many chunks. A task reads its chunk
as sorted Arrow batches and holds one batch and the state of the open scene. The
state at each chunk's start is corrected in rounds from its left neighbour until
no chunk's outgoing state changes, which gives the sequential answer exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import all_finite
from ..session import cut, require_empty

#: Rows of a chunk at most; a task streams its chunk, so this bounds the chunks that the driver keeps a state of.
CHUNK_ROWS = 250_000


@dataclass(frozen=True)
class SceneLimits:
    gap: int = 90
    span: int = 600
    max_distance: int = 20
    max_structure: float = 0.04
    structure_size: int = 64


def scene_members(df: DataFrame, *, project: str = "project_id", id: str = "photo_id", time: str = "taken_s", hash: str = "phash", structure: str = "structure", overrides: DataFrame | None = None, limits: SceneLimits = SceneLimits(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(project, id, kind, anchor_id): scene membership named by the scene's first row.

    Manual rows leave the sequence before gaps are measured; rows without a time
    stay alone.
    """
    rows = df.select(
        F.col(project).alias("project"),
        F.col(id).alias("id"),
        F.col(time).cast("long").alias("t"),
        F.col(hash).cast("long").alias("h"),
        F.col(structure).alias("s"),
    )
    manual = None
    if overrides is not None:
        assigned = overrides.select(
            F.col(project).alias("project"), F.col(id).alias("id"), F.col("scene_id").alias("manual_id")
        )
        tagged = rows.join(assigned, ["project", "id"], "left")
        manual = tagged.filter(F.col("manual_id").isNotNull()).select(
            "project", "id", F.lit("manual").alias("kind"), F.lit(None).cast("long").alias("anchor_id"), "manual_id"
        )
        rows = tagged.filter(F.col("manual_id").isNull()).drop("manual_id")
    single = rows.filter(F.col("t").isNull()).select(
        "project", "id", F.lit("unsequenced").alias("kind"), F.col("id").cast("long").alias("anchor_id")
    )
    timed = rows.filter(F.col("t").isNotNull())
    folded = _fold(timed, limits, chunk_rows).select(
        "project", "id", F.lit("scene_candidate").alias("kind"), F.col("anchor_id")
    )
    out = folded.unionByName(single).withColumn("manual_id", F.lit(None).cast("string"))
    if manual is not None:
        out = out.unionByName(manual)
    return out.select(F.col("project").alias(project), F.col("id").alias(id), "kind", "anchor_id", "manual_id")


def scenes(df: DataFrame, **options) -> DataFrame:
    """Membership with scene ids: a digest of project, first row, size and member set, or the manual id.

    The member set enters as the sum of its members' digests, so no scene is ever collected in one place.
    """
    project = options.get("project", "project_id")
    id = options.get("id", "photo_id")
    # Narrow rows, written once: the digests, the names and the manual rows all read them.
    members = cut(scene_members(df, **options))
    auto = members.filter(F.col("manual_id").isNull())
    part = F.conv(F.substring(F.sha2(F.col(id).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    counted = auto.groupBy(project, "anchor_id").agg(F.count("*").alias("n"), F.sum(part).alias("d"))
    text = F.concat_ws(":", F.lit("scene-v1"), F.col(project).cast("string"), F.col("anchor_id").cast("string"), F.col("n").cast("string"), F.col("d").cast("string"))
    ids = counted.select(project, "anchor_id", F.concat(F.lit("scene-"), F.sha2(text, 256)).alias("scene_id"))
    named = auto.join(ids, [project, "anchor_id"]).select(project, id, "kind", "scene_id")
    return named.unionByName(
        members.filter(F.col("manual_id").isNotNull()).select(project, id, "kind", F.col("manual_id").alias("scene_id"))
    )


def correct_scenes(overrides: DataFrame, requested: DataFrame, entities: DataFrame, *, scene_id: str | None, limit: int | None = None) -> DataFrame:
    """Override table after assigning the requested rows to ``scene_id``, or resetting them (None).

    ``limit`` refuses larger requests; an interactive caller takes 50 000.
    """
    if requested.isEmpty() or (limit is not None and requested.limit(limit + 1).count() > limit):
        raise ValueError("select at least one row" + (f" and at most {limit}" if limit is not None else ""))
    require_empty(
        requested.groupBy("project_id", "photo_id").count().filter("count > 1"), "duplicate ids"
    )
    active = entities.filter(~F.col("missing") & ~F.col("quarantined")).select("project_id", "photo_id")
    require_empty(requested.join(active, ["project_id", "photo_id"], "left_anti"), "rows are unavailable")
    kept = overrides.join(requested, ["project_id", "photo_id"], "left_anti")
    if scene_id is None:
        return kept
    return kept.unionByName(requested.select("project_id", "photo_id", F.lit(scene_id).alias("scene_id")))


def _fold(timed: DataFrame, limits: SceneLimits, chunk_rows: int) -> DataFrame:
    usable = F.coalesce(F.col("h").isNotNull() & (F.size("s") == limits.structure_size) & all_finite("s"), F.lit(False))
    laid = timed.select(
        "project", "id", "t", usable.alias("ok"), F.coalesce("h", F.lit(0)).alias("h"),
        F.when(usable, F.col("s")).otherwise(F.array().cast("array<float>")).cast("array<float>").alias("s"),
    )
    chunks = max(1, -(-timed.count() // chunk_rows))
    kind = laid.schema["project"].dataType.simpleString()
    wide = "chunk int, project {0}, id long, t long, ok boolean, h long, s array<float>".format(kind)
    state = "struct<anchor_id:bigint,anchor_t:bigint,last_t:bigint,ok:boolean,h:bigint,s:array<float>>"
    order = ["project", "t", "id"]
    # The only shuffle of whole rows. What is written keeps them for the rows that a state from the left can still change.
    placed = laid.repartitionByRange(chunks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("chunk"), "*")
    first = cut(placed.mapInArrow(_folder(limits, {}), f"{wide}, anchor_id long, opening boolean, state {state}"))
    opening = first.where("opening").select("chunk", "project", "id", "t", "ok", "h", "s")

    def folded(rows: DataFrame, states: dict[int, dict]) -> DataFrame:
        ordered = rows.repartitionById(chunks, "chunk").sortWithinPartitions("chunk", *order)
        return ordered.mapInArrow(_folder(limits, states), f"{wide}, anchor_id long, opening boolean, state {state}")

    def handed(states: list[dict]) -> dict[int, dict]:
        """Each chunk's state at its left edge: that of the last chunk before it that has rows. One narrow row for each chunk."""
        ordered = sorted(states, key=lambda r: r["chunk"])
        return {b["chunk"]: a for a, b in zip(ordered, ordered[1:], strict=False)}

    def last(rows: DataFrame) -> dict[int, dict]:
        found = rows.where("state is not null").select("chunk", "project", "opening", "state").collect()
        return {r["chunk"]: {"chunk": r["chunk"], "project": r["project"], "whole": r["opening"]} | r["state"].asDict() for r in found}

    # A chunk without a left neighbour starts without a state; the state of a chunk with a break in it is final.
    states = last(first) if chunks > 1 else {}
    active = {c for c in handed(list(states.values())) if states[c]["whole"]}
    while active:
        left = handed(list(states.values()))
        moved = last(folded(opening.where(F.col("chunk").isin(sorted(active))), {c: left[c] for c in active}))
        changed = {c for c, r in moved.items() if r["anchor_id"] != states[c]["anchor_id"]}
        states |= moved
        active = {b for b, a in handed(list(states.values())).items() if a["chunk"] in changed and states[b]["whole"]}
    left = handed(list(states.values()))
    if not left:
        return first.select("project", "id", "anchor_id")
    again = folded(opening, left).select("project", "id", "anchor_id")
    return first.where("not opening").select("project", "id", "anchor_id").unionByName(again)


class SceneFold:
    """Folds rows of (project, time, id) order, batch by batch; ``state`` is the open scene after the last row."""

    def __init__(self, limits: SceneLimits, state: dict | None = None):
        self.limits, self.state = limits, state

    def add(self, project: np.ndarray, ids: np.ndarray, t: np.ndarray, h: np.ndarray, good: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Anchor id of each row of a batch."""
        limits, n = self.limits, len(ids)
        bits = h.view(np.uint64)
        hard = np.ones(n, dtype=bool)
        hard[1:] = (project[1:] != project[:-1]) | (np.diff(t) > limits.gap)
        stops = np.append(np.flatnonzero(hard), n)

        def reach(start: int, stop: int, at: int, ah: np.uint64, a_s: np.ndarray, ok: bool) -> int:
            """First position in start..stop that cannot join the anchor."""
            step = 64
            while ok and start < stop:
                end = min(stop, start + step)
                diff = (s[start:end] - a_s).astype(np.float64)
                joins = good[start:end] & (t[start:end] - at <= limits.span) & (np.bitwise_count(bits[start:end] ^ ah) <= limits.max_distance)
                joins &= (diff * diff).sum(axis=1) / limits.structure_size < limits.max_structure
                if not joins.all():
                    return start + int(joins.argmin())
                start, step = end, step * 2
            return start

        anchors, i, open_ = np.empty(n, dtype=np.int64), 0, self.state
        if open_ is not None and open_["project"] == project[0] and t[0] - open_["last_t"] <= limits.gap:
            a_s = np.asarray(open_["s"], np.float32) if open_["ok"] else np.zeros(limits.structure_size, np.float32)
            i = reach(0, int(stops[np.searchsorted(stops, 1)]), open_["anchor_t"], np.int64(open_["h"]).view(np.uint64), a_s, open_["ok"])
            anchors[:i] = open_["anchor_id"]
        last = None
        while i < n:
            stop = int(stops[np.searchsorted(stops, i + 1)])
            j = max(i + 1, reach(i + 1, stop, t[i], bits[i], s[i], bool(good[i])))
            anchors[i:j], last, i = ids[i], i, j
        if last is not None:
            whole = bool(good[last])
            open_ = {"project": project[last], "anchor_id": int(ids[last]), "anchor_t": int(t[last]), "ok": whole, "h": int(h[last]), "s": s[last].tolist() if whole else []}
        self.state = open_ | {"last_t": int(t[-1])}
        return anchors


def arrays_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """project, id, t, h, ok and the structures of an Arrow batch, zeros where a row has none."""
    good = np.asarray(batch.column("ok").to_pylist(), dtype=bool)
    s = np.zeros((batch.num_rows, size), dtype=np.float32)
    if good.any():
        # Rows that are not ok have empty structures, so the values are those of the others in order.
        s[good] = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    project = np.array(batch.column("project").to_pylist(), dtype=object)
    return project, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "t", "h")), good, s


def _folder(limits: SceneLimits, states: dict[int, dict]):
    """One pass over the sorted batches of a partition: the rows with their anchors, on a chunk's last row its last state.

    ``opening`` marks the rows before a chunk's first break in project or time, which a state from the left may change;
    the others are passed on without what is only needed to fold them once more.
    """
    kept = ["anchor_id", "anchor_t", "last_t", "ok", "h", "s"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float32())]
    state_type = pa.struct(list(zip(kept, kinds, strict=True)))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, fold, open_, end, held = None, None, True, None, None

        def told(state: dict | None) -> pa.RecordBatch:
            """The rows held back, the last one with the chunk's state if it ends there."""
            part, anchors, marks = held
            n, ends = part.num_rows, [None] * (part.num_rows - 1) + [state and {c: state[c] for c in kept}]
            wide = pa.array(marks)
            columns = [pc.if_else(wide, part.column(c), pa.scalar(None, part.column(c).type)) for c in ("t", "ok", "h")]
            s = part.column("s") if marks.all() else pa.array([v if m else None for v, m in zip(part.column("s").to_pylist(), marks, strict=True)], pa.list_(pa.float32())) if marks.any() else pa.nulls(n, pa.list_(pa.float32()))
            columns = [part.column("chunk"), part.column("project"), part.column("id").cast(pa.int64()), *columns, s, pa.array(anchors), wide, pa.array(ends, state_type)]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "project", "id", "t", "ok", "h", "s", "anchor_id", "opening", "state"])

        for batch in batches:
            at = batch.column("chunk").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if held is not None:
                    yield told(fold.state if at[start] != chunk else None)
                if at[start] != chunk:
                    chunk, open_, end = int(at[start]), True, None
                    fold = SceneFold(limits, states.get(chunk))
                part = batch.slice(start, stop - start)
                project, ids, t, *rest = arrays_of(part, limits.structure_size)
                anchors = fold.add(project, ids, t, *rest)
                marks = np.full(len(ids), open_)
                if open_:
                    before, since = (project[0], t[0]) if end is None else end
                    broken = (project != np.concatenate([np.array([before], dtype=object), project[:-1]])) | (np.diff(t, prepend=since) > limits.gap)
                    marks = np.cumsum(broken) == 0
                    open_, end = bool(marks.all()), (project[-1], t[-1])
                held = (part, anchors, marks)
        if held is not None:
            yield told(fold.state)

    return rows_of
