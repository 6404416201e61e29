"""Feature jobs: image rows in, measurement rows out. Spark partitions, each task handles one batch at a time.

Input rows follow Spark's image source: path, height, width, nChannels, data (BGR bytes).
A row that cannot be measured becomes a row with an error, never a failed task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import below
from . import pixels

FEATURES = (
    "path string, width int, height int, sharpness_lap double, sharpness_fft double, mean double, shadow_clip double,"
    "highlight_clip double, phash long, structure array<float>, naturalness array<array<double>>, error string"
)


def rgb_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels; grey is repeated and alpha is laid over white."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    rgb = raw[:, :, 2::-1]
    if channels == 4:
        alpha = raw[:, :, 3:].astype(np.uint32)
        return ((rgb.astype(np.uint32) * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def run(images: DataFrame, measure: Callable[[np.ndarray, tuple], dict], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``measure(rgb, row)`` to every image row; failures carry their message in ``error``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                base = blank | {"path": r.path}
                try:
                    out.append(base | measure(rgb_array(r.height, r.width, r.nChannels, r.data), r) | {"error": None})
                except Exception as error:  # noqa: BLE001 - isolation per row
                    out.append(base | {"error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = [c.split()[0] for c in _split(schema)]
    blank = dict.fromkeys(names)
    return images.select("path", "height", "width", "nChannels", "data", *extra).mapInPandas(work, schema)


def _split(schema: str) -> list[str]:
    parts, depth, word = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(word)
            word = ""
        else:
            word += ch
    return [*parts, word]


def extract_features(images: DataFrame, *, naturalness: bool = True) -> DataFrame:
    """Spatial, spectral, hash, structure and naturalness features of every image."""

    def measure(rgb: np.ndarray, _) -> dict:
        blocks = pixels.naturalness_features(pixels.gray(rgb)) if naturalness else None
        return pixels.spatial(rgb) | {
            "width": rgb.shape[1],
            "height": rgb.shape[0],
            "sharpness_fft": pixels.high_frequency_ratio(rgb),
            "phash": pixels.perceptual_hash(rgb),
            "structure": pixels.structure(rgb),
            "naturalness": None if blocks is None else blocks.tolist(),
        }

    return run(images, measure, FEATURES)


def measure_regions(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Quality of every box of every image (pixels: x, y, w, h); boxes join to their image by path.

    An image with very many boxes is measured in several rows of about 500 boxes.
    """
    sizes = boxes.groupBy("path").agg(F.ceil(F.count("*") / 500).alias("lots"))
    split = boxes.join(sizes, "path").withColumn("lot", F.pmod(F.xxhash64("box_id"), F.col("lots")))
    listed = split.groupBy("path", "lot").agg(F.collect_list(F.struct("box_id", "x", "y", "w", "h")).alias("boxes"))

    def measure(rgb: np.ndarray, r) -> dict:
        found = [(b["box_id"], pixels.region(rgb, b["x"], b["y"], b["w"], b["h"])) for b in r.boxes]
        return {"regions": [{"box_id": i, **m} for i, m in found if m]}

    kind = "struct<box_id:long,sharpness_lap:double,mean:double,shadow_clip:double,highlight_clip:double,crop_width:int,crop_height:int>"
    out = run(images.join(listed, "path"), measure, f"path string, regions array<{kind}>, error string", ("boxes",))
    return out.select("path", F.explode("regions").alias("r")).select("path", "r.*")


def scope_rows(images: DataFrame) -> DataFrame:
    """Histograms and clip shares per image."""

    def measure(rgb: np.ndarray, _) -> dict:
        s = pixels.scopes(rgb)
        return {k: v.tolist() for k, v in s["histogram"].items()} | {
            "clip_low": s["clip_low"], "clip_high": s["clip_high"], "peak": pixels.display_peak(s["histogram"])
        }

    schema = "path string, r array<long>, g array<long>, b array<long>, l array<long>, clip_low double, clip_high double, peak long, error string"
    return run(images, measure, schema)


def measure_details(images: DataFrame, requests: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Native-region detail keyed by the digest of the request; finished requests are skipped."""
    keyed = requests.withColumn(
        "request_key", F.sha2(F.concat_ws(":", "path", "x", "y", "w", "h"), 256)
    )
    if done is not None:
        keyed = keyed.join(done.select("request_key"), "request_key", "left_anti")

    def measure(rgb: np.ndarray, r) -> dict:
        return {"request_key": r.request_key} | pixels.detail(rgb, r.x, r.y, r.w, r.h)

    schema = "path string, request_key string, state string, crop_width int, crop_height int, sharpness_lap double, mean double, shadow_clip double, highlight_clip double, error string"
    return run(images.join(keyed, "path"), measure, schema, ("request_key", "x", "y", "w", "h"))


def render_previews(images: DataFrame, *, edges=(320, 1280, 2560), existing: DataFrame | None = None) -> DataFrame:
    """Bounded RGB previews, one row per (path, edge) not already present."""
    wanted = images.withColumn("edge", F.explode(F.array(*[F.lit(e) for e in edges])))
    if existing is not None:
        wanted = wanted.join(existing.select("path", "edge"), ["path", "edge"], "left_anti")

    def measure(rgb: np.ndarray, r) -> dict:
        small = pixels.bounded(rgb, int(r.edge))
        return {"edge": int(r.edge), "preview_width": small.shape[1], "preview_height": small.shape[0], "pixels": small.tobytes()}

    return run(wanted, measure, "path string, edge int, preview_width int, preview_height int, pixels binary, error string", ("edge",))


def batch_infer(rows: DataFrame, *, open_session: Callable[[], object], infer: Callable[[object, list], list], inputs: str, schema: str, key: str = "photo_id", artifact: str | None = None, sha256: str | None = None) -> DataFrame:
    """Run a model over a column, one session per task; ``schema`` is ``key, vector, error``.

    With ``artifact`` the file shipped by ``SparkContext.addFile`` must have the
    pinned digest before a session opens. A failing row is retried alone and
    then recorded with its error.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if artifact is not None:
            from pyspark import SparkFiles

            with open(SparkFiles.get(artifact), "rb") as f:
                if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
                    raise ValueError("model file does not match its pinned digest")
        session = open_session()

        def one(value):
            try:
                return infer(session, [value])[0], None
            except Exception as error:  # noqa: BLE001 - isolation per row
                return None, str(error)

        for pdf in batches:
            values = pdf["value"].tolist()
            try:
                done = [(v, None) for v in infer(session, values)]
            except Exception:  # noqa: BLE001
                done = [one(v) for v in values]
            yield pd.DataFrame({key: pdf[key], "vector": [v for v, _ in done], "error": [e for _, e in done]})

    return rows.select(key, F.col(inputs).alias("value")).mapInPandas(work, schema)


def hide_occluded(rows: DataFrame, *, minimum: float) -> DataFrame:
    """An eye below the visible minimum, or without a reading, is hidden; none is ever restored."""
    hidden = below("visible_fraction", minimum) | F.col("visible_fraction").isNull()
    reason = F.when(F.col("visible_fraction").isNull(), "visibility unavailable").otherwise("visible fraction below threshold")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & hidden, reason).otherwise(F.col("reason"))).withColumn(
        "state", F.when(~hidden, F.col("state"))
    )
