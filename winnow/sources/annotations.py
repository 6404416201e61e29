"""Annotation templates for independent human review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalized_box

ANNOTATION_SCHEMA = (
    "photo_id long, path string, mtime long, size_bytes long, annotation_complete boolean,"
    "ground_truth struct<faces: array<struct<bbox: array<double>, left_eye: string, right_eye: string,"
    "left_eye_ungradable_reason: string, right_eye_ungradable_reason: string>>>"
)


def annotation_template(rows: DataFrame, *, suggestions: bool = False) -> DataFrame:
    """One incomplete record per row; suggested boxes are predictions, never truth."""
    out = rows.select(
        "photo_id",
        "path",
        "mtime",
        "size_bytes",
        F.lit(False).alias("annotation_complete"),
        F.struct(F.array().cast("array<string>").alias("faces")).alias("ground_truth"),
        *(["faces", "width", "height"] if suggestions else []),
    )
    if not suggestions:
        return out
    boxes = F.transform(
        F.coalesce("faces", F.array().cast(rows.schema["faces"].dataType)),
        lambda f: normalized_box(f.bbox, F.col("width"), F.col("height")),
    )
    return (
        out.withColumn("suggested_boxes", boxes)
        .withColumn("suggestions_are_ground_truth", F.lit(False))
        .drop("faces", "width", "height")
    )


def group_template(groups: DataFrame) -> DataFrame:
    return groups.withColumn("annotation_complete", F.lit(False)).withColumn(
        "acceptable_photo_ids", F.array().cast("array<long>")
    )


def write_template(records: DataFrame, destination: str) -> None:
    records.write.json(destination, mode="error")
