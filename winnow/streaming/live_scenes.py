"""Scenes on a live stream: rows wait in keyed state until the watermark has passed them, then are folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import all_finite
from ..operators.scenes import SceneFold, SceneLimits

ROW = "id long, t long, h long, ok boolean, s binary"
OPEN = "anchor_id long, anchor_t long, last_t long, ok boolean, h long, s array<float>"


class LiveScenes(StatefulProcessor):
    """Per project, the rows that the watermark has not passed and the open scene. A timer at the earliest waiting row wakes a
    project that gets no more rows."""

    def __init__(self, limits: SceneLimits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in ("id", "t", "h", "ok", "s")) for r in rows]
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs(), [])

    def settle(self, key, watermark: int, new: list[tuple]) -> Iterator[Row]:
        held = list(self.waiting.get())
        rows = sorted(held + new, key=lambda r: (r[1], r[0]))
        ripe = [r for r in rows if r[1] * 1000 <= watermark]
        later = rows[len(ripe) :]
        if later:
            self.handle.registerTimer(later[0][1] * 1000 + 1)
        # Rows that are folded at once never enter the state.
        if not ripe:
            if new:
                self.waiting.appendList(new)
            return
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        state = None
        if self.open.exists():
            names = ("anchor_id", "anchor_t", "last_t", "ok", "h", "s")
            state = dict(zip(names, self.open.get(), strict=True)) | {"project": key[0]}
        fold, size = SceneFold(self.limits, state), self.limits.structure_size
        good = np.array([r[3] for r in ripe], dtype=bool)
        s = np.frombuffer(b"".join(r[4] if r[3] else bytes(4 * size) for r in ripe), dtype=np.float32).reshape(-1, size)
        project = np.array([key[0]] * len(ripe), dtype=object)
        ids, t, h = (np.array([r[i] for r in ripe], dtype=np.int64) for i in range(3))
        anchors = fold.add(project, ids, t, h, good, s)
        now = fold.state
        self.open.update((now["anchor_id"], now["anchor_t"], now["last_t"], now["ok"], now["h"], now["s"]))
        for id, anchor in zip(ids.tolist(), anchors.tolist(), strict=True):
            yield Row(project=key[0], id=id, anchor_id=anchor)

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Structures as bytes: as lists, each number would be a Python object wherever a row is read or kept."""
    for batch in batches:
        s = batch.column("s")
        ends = np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False)) * 4
        places = np.concatenate([[0], ends]).astype(np.int32)
        numbers = s.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        packed = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(places), pa.py_buffer(numbers)])
        yield pa.RecordBatch.from_arrays([packed if name == "s" else batch.column(name) for name in batch.schema.names], names=batch.schema.names)


def live_scenes(stream: DataFrame, *, project: str = "project_id", id: str = "photo_id", time: str = "taken_s", hash: str = "phash", structure: str = "structure", limits: SceneLimits = SceneLimits(), delay: int = 600) -> DataFrame:
    """``project, id, anchor_id`` of timed rows, as the batch partition names them, once no earlier row can come.

    Rows may be out of order by ``delay`` seconds; later ones are dropped by the watermark. Rows without a time belong to no sequence and
    are left to the batch form. A project's waiting rows, those of the last ``delay`` seconds, are held by one task. Start the query inside
    ``keyed_state``; what the watermark has not passed stays in the checkpoint for the next run.
    """
    s = F.col(structure)
    ok = F.coalesce(F.col(hash).isNotNull() & (F.size(s) == limits.structure_size) & all_finite(structure), F.lit(False))
    rows = stream.where(F.col(time).isNotNull()).select(
        F.col(project).alias("project"), F.timestamp_seconds(F.col(time)).alias("at"), F.col(id).cast("long").alias("id"), F.col(time).cast("long").alias("t"),
        F.coalesce(F.col(hash).cast("long"), F.lit(0)).alias("h"), ok.alias("ok"), F.when(ok, s.cast("array<float>")).otherwise(F.array().cast("array<float>")).alias("s"),
    )
    kind = rows.schema["project"].dataType.simpleString()
    rows = rows.mapInArrow(_packed, f"project {kind}, at timestamp, id long, t long, h long, ok boolean, s binary")
    keyed = rows.withWatermark("at", f"{delay} seconds").groupBy("project")
    return keyed.transformWithState(statefulProcessor=LiveScenes(limits), outputStructType=f"project {kind}, id long, anchor_id long", outputMode="Append", timeMode="EventTime")
