"""Stored analysis payloads: JSON text of unknown validity to narrow typed query columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import scoring_settings_key


def json_kind(variant: Column, path: str) -> Column:
    """Type of a JSON value: object, array, text, number, boolean, null, or NULL when absent."""
    name = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return (
        F.when(name.isNull(), F.lit(None).cast("string"))
        .when(name == "STRING", "text")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def project_payload(raw: DataFrame, *, id: str = "photo_id", json: str = "data", version: str = "$.version", settings: str = "$.settings", invalid: str = "$.source_invalid", score: str = "$.composite_score", verdict: str = "$.verdict") -> DataFrame:
    """Narrow catalog columns of a payload; invalid JSON reads as an empty object.

    Text fields only from JSON text, ``source_invalid`` only from JSON true, score
    only from a JSON number (else -1): "12" in quotes is not a score.
    """
    v = F.try_parse_json(json)
    rows = raw.select(id, F.col(json).alias("__text"), v.alias("__v"))

    def text(path: str) -> Column:
        return F.when(json_kind(F.col("__v"), path) == "text", F.try_variant_get("__v", path, "string"))

    is_number = json_kind(F.col("__v"), score) == "number"
    settings_text = F.when(F.col("__v").isNotNull(), F.get_json_object("__text", settings))
    return rows.select(
        id,
        text(version).alias("version"),
        scoring_settings_key(settings_text).alias("settings_key"),
        (
            F.coalesce(json_kind(F.col("__v"), invalid) == "boolean", F.lit(False))
            & F.coalesce(F.try_variant_get("__v", invalid, "boolean"), F.lit(False))
        ).alias("source_invalid"),
        F.when(is_number, F.try_variant_get("__v", score, "double")).otherwise(F.lit(-1.0)).alias("score"),
        text(verdict).alias("verdict"),
    )


def readable(raw: DataFrame, *, json: str = "data") -> DataFrame:
    """Rows whose payload parses to an object; unreadable history is skipped, not fatal."""
    return raw.filter(F.coalesce(json_kind(F.try_parse_json(json), "$") == "object", F.lit(False)))
