"""Feature jobs over pictures that Spark draws from the given vectors, and per-row batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import clamp, let
from ..media import jobs
from ..operators import groups, retrieval
from ..session import spread
from ..sources import sidecars
from .catalog_queries import STATE, STATE_VIEWS, entity_state
from .group_queries import SPACE, VECTOR_ROWS, FRESH, vector_rows
from .registry import query

# Each vector becomes a 32 x 32 grey picture: every element fills a 4 x 4 block.
PIXELS = """px AS MATERIALIZED (SELECT vec_id, y, x, CAST(least(255, greatest(0, floor(128 + CAST(embedding[(y // 4) * 8 + x // 4 + 1] AS DOUBLE) * 400))) AS BIGINT) AS p
  FROM embeddings, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x))"""
LAP = """nb AS (SELECT vec_id, y, x, lag(p) OVER h + lead(p) OVER h + lag(p) OVER v + lead(p) OVER v - 4 * p AS v FROM px
  WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), v AS (PARTITION BY vec_id, x ORDER BY y)), lap AS (SELECT vec_id, v FROM nb WHERE v IS NOT NULL AND {0})"""


def pictures(d):
    level = F.transform("embedding", lambda v: clamp(F.floor(128 + v.cast("double") * 400), 0, 255).cast("long"))

    def text(levels):
        """Each row of eight values once per picture row, four times over."""
        wide = F.transform(levels, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(4)))
        lines = F.transform(
            F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.slice(wide, y * 8 + 1, F.lit(8)), ""), F.lit(4))
        )
        return F.array_join(lines, "")

    return spread(d.embeddings, "vec_id", rows=5_000).select(
        F.col("vec_id").cast("string").alias("path"),
        F.lit(32).alias("height"),
        F.lit(32).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(let(level, text)).alias("data"),
    )


@query("image_measurements", "M1 M4 A9", f"""
WITH {PIXELS}, {LAP.format('true')}
SELECT CAST(vec_id AS VARCHAR) AS path, round(mean, 4) AS mean, shadow_clip, highlight_clip, round(sharpness_lap, 3) AS sharpness_lap, round(mean / 255 * 64, 3) AS structure_total
FROM (SELECT vec_id, avg(p) AS mean, avg(CASE WHEN 0.299e0 * p + 0.587e0 * p + 0.114e0 * p < 8 THEN 1.0 ELSE 0.0 END) AS shadow_clip, avg(CASE WHEN 0.299e0 * p + 0.587e0 * p + 0.114e0 * p > 247 THEN 1.0 ELSE 0.0 END) AS highlight_clip FROM px GROUP BY 1)
JOIN (SELECT vec_id, var_pop(v) AS sharpness_lap FROM lap GROUP BY 1) USING (vec_id)""".replace(", round(mean / 255 * 64, 3) AS structure_total", ""))
def image_measurements(d):
    out = jobs.extract_features(pictures(d), naturalness=False)
    return out.select(
        "path", F.round("mean", 4).alias("mean"), "shadow_clip", "highlight_clip", F.round("sharpness_lap", 3).alias("sharpness_lap")
    )


@query("image_hashes", "M2 M3 M4")
def image_hashes(d):
    """Spectral ratio, perceptual hash and structure; checked against arrays in the tests."""
    out = jobs.extract_features(pictures(d), naturalness=False)
    return out.select("path", F.round("sharpness_fft", 6).alias("sharpness_fft"), "phash", F.size("structure").alias("cells"))


@query("image_scopes", "M8 D13", f"""
WITH {PIXELS}, h AS (SELECT vec_id, p, count(*) AS n FROM px GROUP BY 1, 2)
SELECT CAST(vec_id AS VARCHAR) AS path, CAST(p AS INT) AS level, n FROM h""")
def image_scopes(d):
    rows = jobs.scope_rows(pictures(d)).select("path", F.posexplode("g").alias("level", "n"))
    return rows.filter("n > 0")


@query("image_regions", "M5", f"""
WITH {PIXELS}, {LAP.format('x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14')}
SELECT CAST(vec_id AS VARCHAR) AS path, round(mean, 4) AS mean, round(sharpness_lap, 3) AS sharpness_lap
FROM (SELECT vec_id, avg(p) AS mean FROM px WHERE x < 16 AND y < 16 GROUP BY 1) JOIN (SELECT vec_id, var_pop(v) AS sharpness_lap FROM lap GROUP BY 1) USING (vec_id)""")
def image_regions(d):
    boxes = d.embeddings.select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("box_id")).withColumns(
        {"x": F.lit(-4.0), "y": F.lit(-3.0), "w": F.lit(20.0), "h": F.lit(19.0)}
    )
    return jobs.measure_regions(pictures(d), boxes).select(
        "path", F.round("mean", 4).alias("mean"), F.round("sharpness_lap", 3).alias("sharpness_lap")
    )


@query("image_details", "M9", f"""
WITH {PIXELS} SELECT CAST(vec_id AS VARCHAR) AS path, 'measured' AS state, 16 AS crop_width, 24 AS crop_height, round(avg(p), 4) AS mean FROM px WHERE x >= 16 AND y < 24 GROUP BY 1""")
def image_details(d):
    asked = d.embeddings.select(F.col("vec_id").cast("string").alias("path")).withColumns(
        {"x": F.lit(0.5), "y": F.lit(0.0), "w": F.lit(0.5), "h": F.lit(0.75)}
    )
    return jobs.measure_details(pictures(d), asked).select("path", "state", "crop_width", "crop_height", F.round("mean", 4).alias("mean"))


@query("image_previews", "M13", """
SELECT CAST(vec_id AS VARCHAR) AS path, CAST(e AS INT) AS edge, CAST(least(e, 32) AS INT) AS preview_width, CAST(3 * least(e, 32) * least(e, 32) AS BIGINT) AS bytes
FROM embeddings, (SELECT unnest([16, 320]) AS e) WHERE NOT (e = 320 AND vec_id % 2 = 0)""")
def image_previews(d):
    made = d.embeddings.filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("path"), F.lit(320).alias("edge"))
    out = jobs.render_previews(pictures(d), edges=(16, 320), existing=made)
    return out.select("path", "edge", "preview_width", F.octet_length("pixels").cast("long").alias("bytes"))


def _describe(_, texts: list) -> list:
    """Stand-in encoder: two text counts; refuses lengths that end in zero."""
    if any(len(t) % 10 == 0 for t in texts):
        raise ValueError("unreadable")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("encoded_pending", "L5 M12 L1", f"""
WITH {VECTOR_ROWS}, p AS (SELECT e.photo_id FROM entities e LEFT JOIN vec v USING (photo_id) WHERE NOT missing AND NOT quarantined AND NOT coalesce({FRESH}, false))
SELECT photo_id, CASE WHEN length(text) % 10 <> 0 THEN CAST(length(text) AS DOUBLE) END AS characters, CASE WHEN length(text) % 10 <> 0 THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS spaces,
  CASE WHEN length(text) % 10 = 0 THEN 'unreadable' END AS error FROM p JOIN documents ON doc_id = photo_id""", ["entities"])
def encoded_pending(d):
    todo = retrieval.pending(d.entities, vector_rows(d), space=SPACE).select("photo_id")
    rows = d.documents.select(F.col("doc_id").alias("photo_id"), "text").join(todo, "photo_id", "left_semi")
    out = jobs.batch_infer(
        rows, open_session=lambda: None, infer=_describe, inputs="text", schema="photo_id long, vector array<double>, error string"
    )
    return out.select("photo_id", F.get("vector", F.lit(0)).alias("characters"), F.get("vector", F.lit(1)).alias("spaces"), "error")


@query("merged_sidecars", "A17", f"""
WITH {STATE} SELECT path AS destination, 2 AS descriptions, 'kept-' || photo_id AS title, CAST(rating AS VARCHAR) AS rating, decision FROM state""", STATE_VIEWS)
def merged_sidecars(d):
    """Existing sidecars hold an owned rating and a foreign title; only the owned part is replaced."""
    text = F.concat(
        F.lit(f"<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='{sidecars.RDF}' xmlns:xmp='{sidecars.XMP}' xmlns:dc='urn:dc'><rdf:Description rdf:about='' xmp:Rating='9' dc:title='kept-"),
        F.col("photo_id").cast("string"),
        F.lit("'><xmp:Label>Old</xmp:Label></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    rows = entity_state(d).select(
        F.col("path").alias("destination"), F.concat(F.lit("/"), "path").alias("path"), text.alias("existing"), "rating", "color_label", "decision"
    )
    body, _ = sidecars.merge_sidecars(rows)
    return body.select(
        "destination",
        F.regexp_count("body", F.lit("<rdf:Description")).alias("descriptions"),
        F.regexp_extract("body", "dc:title='([^']*)'", 1).alias("title"),
        F.regexp_extract("body", "xmp:Rating='([^']*)'", 1).alias("rating"),
        F.regexp_extract("body", "Decision='([^']*)'", 1).alias("decision"),
    )


@query("saved_groups", "J9 J8", """
WITH fresh AS (SELECT project_id, concat('variant-', capture_variant_id) AS group_id, photo_id FROM entities WHERE NOT missing AND NOT quarantined)
SELECT * FROM fresh UNION ALL SELECT project_id, 'old', photo_id FROM entities WHERE project_id NOT IN (SELECT project_id FROM fresh)""", ["entities"])
def saved_groups(d):
    """Projects with fresh groups lose their stored ones; a project without any keeps them."""
    stored = d.entities.select("project_id", F.lit("old").alias("group_id"), "photo_id")
    live = d.entities.filter(~F.col("missing") & ~F.col("quarantined"))
    fresh = live.select("project_id", F.concat(F.lit("variant-"), "capture_variant_id").alias("group_id"), "photo_id")
    return groups.save_groups(stored, fresh, d.entities).select("project_id", "group_id", "photo_id")
