"""Queries over scoring, evidence, settings changes, group assessment and selection plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, measures
from ..operators import scoring, selection
from ..session import cut
from ..settings import Settings
from .registry import query

DEFAULT = Settings()
STRICT = Settings(recommend_threshold=60.0, sharpness_weight=50.0, reject_threshold=30.0)


def sql_lap(x: str) -> str:
    return f"greatest(0, least(100, 100 * ln(1 + greatest({x}, 0)) / ln(1001)))"


def sql_exposure(s: str, h: str) -> str:
    return f"greatest(0, least(100, 100 - (greatest({s} - 0.02, 0) + greatest({h} - 0.02, 0)) * 100))"


QUALITY = f"({sql_lap('q_lap')} * 0.5 + {sql_exposure('q_shadow', 'q_high')} * 0.3 + least(1, least(q_w, q_h) / 128) * 20)"
EYE = "CASE {0} WHEN 'open' THEN 100.0 WHEN 'uncertain' THEN 50.0 WHEN 'closed' THEN 0.0 END"
THIRDS = ", ".join(f"sqrt(pow(cx - {tx}, 2) + pow(cy - {ty}, 2))" for tx in ("1e0/3", "2e0/3") for ty in ("1e0/3", "2e0/3"))


def scored_sql(name: str, s: Settings) -> str:
    """Components, score and verdict by plain aggregation over exploded faces."""
    w = {c: float(getattr(s, f"{c}_weight")) for c in scoring.COMPONENTS}
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {v} END" for c, v in w.items())
    summed = " + ".join(f"coalesce({c}, 0) * {v}" for c, v in w.items())
    return f"""
 {name}_f AS (SELECT photo_id, (coalesce(sum({EYE.format('left_state')}), 0) + coalesce(sum({EYE.format('right_state')}), 0)) / nullif(count(left_state) + count(right_state), 0) AS eyes,
   avg(CASE WHEN q_lap IS NOT NULL THEN {QUALITY} END) AS face, avg(smile * 100) AS smile, bool_or(coalesce(left_state = 'closed', false)) AS closed,
   bool_and(coalesce(left_state = 'open', false) AND coalesce(right_state = 'open', false)) AS all_open, bool_or(left_state IS NULL OR right_state IS NULL OR left_state = 'uncertain' OR right_state = 'uncertain') AS unsure,
   bool_or(q_lap IS NULL OR least(q_w, q_h) < 32) AS small_face,
   sum((bx + bw / 2) / 4000 * bw * bh * confidence) FILTER (confidence >= 0.55) / sum(bw * bh * confidence) FILTER (confidence >= 0.55) AS cx,
   sum((bys + bh / 2) / 3000 * bw * bh * confidence) FILTER (confidence >= 0.55) / sum(bw * bh * confidence) FILTER (confidence >= 0.55) AS cy
   FROM faces GROUP BY photo_id),
 {name}_c AS (SELECT s.*, f.eyes, f.face, f.smile, coalesce(f.closed, false) AS closed, coalesce(f.all_open, true) AS all_open, coalesce(unsure, false) AS unsure, coalesce(small_face, false) AS small_face,
   CASE WHEN niqe IS NULL THEN {sql_lap('sharpness_lap')} * 0.75 + 100 * sqrt(sharpness_fft) * 0.25
        ELSE {sql_lap('sharpness_lap')} * 0.6 + 100 * sqrt(sharpness_fft) * 0.2 + greatest(0, least(100, 100 - greatest(niqe - 2, 0) * 12.5)) * 0.2 END AS sharpness,
   CASE WHEN cx IS NULL THEN {sql_exposure('shadow_clip', 'highlight_clip')} ELSE {sql_exposure('shadow_clip', 'highlight_clip')} * 0.75
        + 0.25 * greatest(0, least(100, 100 * (1 - least(sqrt(pow(cx - 0.5, 2) + pow(cy - 0.5, 2)), {THIRDS}) / (sqrt(2) / 3)))) END AS exposure
   FROM shots s LEFT JOIN {name}_f f USING (photo_id)),
 {name}_s AS (SELECT *, ({summed}) / ({total}) AS score FROM {name}_c),
 {name} AS (SELECT *, CASE WHEN closed THEN 'review'
    WHEN sharpness_lap < 8 AND (exposure_mean < 35 OR exposure_mean > 225 OR shadow_clip > 0.65 OR highlight_clip > 0.65) AND score < {s.reject_threshold} AND preview_source NOT LIKE 'raw\\_%' ESCAPE '\\' THEN 'reject_suggest'
    WHEN all_open AND NOT omitted AND sharpness_lap >= 8 AND score >= {s.recommend_threshold} AND shadow_clip <= 0.1 AND highlight_clip <= 0.1 THEN 'recommend' ELSE 'review' END AS verdict,
    NOT closed AND NOT unsure AND NOT small_face AND NOT omitted AND sharpness_lap >= 8 AS good FROM {name}_s)"""


SCORED = scored_sql("scored", DEFAULT)


def scored(d, settings: Settings = DEFAULT):
    return scoring.rescore(d.measured, settings)


def component(name: str):
    return F.get(F.filter("components", lambda c: c["id"] == name), F.lit(0)).score


@query("score_components", "I1 I2 D15 H8 H9 H10 H11 H12 D16", f"""
WITH {SCORED} SELECT photo_id, round(eyes, 6) AS eyes, round(sharpness, 6) AS sharpness, round(face, 6) AS face, round(exposure, 6) AS exposure, round(smile, 6) AS smile, round(score, 6) AS score FROM scored""", ["shots", "faces"])
def score_components(d):
    rows = scored(d)
    return rows.select(
        "photo_id", *[F.round(component(c), 6).alias(c) for c in scoring.COMPONENTS], F.round("score", 6).alias("score")
    )


@query("verdicts", "I3 I4", f"WITH {SCORED} SELECT photo_id, verdict, good AND verdict <> 'reject_suggest' AS usable FROM scored", ["shots", "faces"])
def verdicts(d):
    return scored(d).select("photo_id", "verdict", "usable")


@query("evidence_codes", "I5", f"""
WITH {SCORED}, r AS (SELECT photo_id, unnest([
 {{'code': 'preview_measurement', 'kind': 'context', 'hit': true}}, {{'code': 'no_face_detected', 'kind': 'context', 'hit': n_faces = 0}},
 {{'code': 'closed_eye_review', 'kind': 'observation', 'hit': closed}}, {{'code': 'eye_evidence_limited', 'kind': 'limitation', 'hit': unsure}},
 {{'code': 'face_detail_limited', 'kind': 'limitation', 'hit': small_face}}, {{'code': 'tonal_style_review', 'kind': 'context', 'hit': exposure_mean < 60 OR exposure_mean > 200}},
 {{'code': 'preview_shadow_clip', 'kind': 'observation', 'hit': shadow_clip > 0.1}}, {{'code': 'preview_highlight_clip', 'kind': 'observation', 'hit': highlight_clip > 0.1}},
 {{'code': 'raw_recovery_unknown', 'kind': 'limitation', 'hit': preview_source = 'raw_embedded'}}, {{'code': 'low_preview_detail', 'kind': 'observation', 'hit': sharpness_lap < 8}},
 {{'code': 'omitted_faces', 'kind': 'limitation', 'hit': omitted}}]) AS e FROM scored)
SELECT photo_id, e.code AS code, e.kind AS kind FROM r WHERE e.hit""", ["shots", "faces"])
def evidence_codes(d):
    return scored(d).select("photo_id", F.explode("evidence").alias("e")).select("photo_id", "e.code", "e.kind")


@query("settings_impact", "I7 D3", f"""
WITH {SCORED}, {scored_sql('strict', STRICT)} SELECT a.verdict AS before, b.verdict AS after, count(*) AS n FROM scored a JOIN strict b USING (photo_id) GROUP BY 1, 2""", ["shots", "faces"])
def settings_impact(d):
    return scoring.settings_impact(d.measured, DEFAULT, STRICT)


@query("settings_applied", "I6", f"""
WITH {scored_sql('strict', STRICT)} SELECT photo_id, verdict, round(score, 6) AS score, 'kept' AS fate FROM strict WHERE k % 3 <> 0
UNION ALL SELECT photo_id, NULL, NULL, 'dropped' FROM strict WHERE k % 3 = 0""", ["shots", "faces"])
def settings_applied(d):
    key = F.when(F.col("k") % 3 == 0, F.lit("old settings")).otherwise(F.lit(DEFAULT.canonical()))
    stored = scored(d).withColumn("settings_key", key)
    kept, dropped = scoring.apply_settings(stored, DEFAULT, STRICT)
    return kept.select("photo_id", "verdict", F.round("score", 6).alias("score"), F.lit("kept").alias("fate")).unionByName(
        dropped.select("photo_id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit("dropped").alias("fate"))
    )


@query("score_audit", "I9", "SELECT photo_id FROM shots WHERE k % 37 = 0", ["shots"])
def score_audit(d):
    """Finds exactly the rows whose stored total was tampered with."""
    rows = scored(d).withColumn("score", F.col("score") + F.when(F.col("k") % 37 == 0, 0.001).otherwise(0.0))
    return scoring.audit_scores(rows).select("photo_id")


@query("measurement_validity", "B10", """
SELECT photo_id, v BETWEEN 0 AND 1 AND k % 3 <> 0 AND k % 5 <> 0 AS valid FROM (SELECT photo_id, k, shadow_clip * 2 AS v FROM shots)""", ["shots"])
def measurement_validity(d):
    from ..functions.numeric import measurements_valid

    k = F.col("k")
    rows = d.shots.withColumn("shadow_clip", F.col("shadow_clip") * 2).withColumn(
        "sharpness_lap",
        F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("sharpness_lap")),
    )
    return rows.select("photo_id", measurements_valid(["sharpness_lap", "shadow_clip"], ["shadow_clip"]).alias("valid"))


@query("measure_mappings", "H8 H9 H10 H16", f"""
SELECT photo_id, round({sql_lap('sharpness_lap')}, 6) AS lap, round({sql_exposure('shadow_clip', 'highlight_clip')}, 6) AS exposure, round(100 * sqrt(sharpness_fft), 6) AS fft,
  CASE WHEN niqe IS NOT NULL THEN round(greatest(0, least(100, 100 - greatest(niqe - 2, 0) * 12.5)), 6) END AS niqe,
  CASE WHEN exposure_mean < 70 OR shadow_clip > 0.35 THEN 'underexposed' WHEN exposure_mean > 188 OR highlight_clip > 0.25 THEN 'overexposed' ELSE 'normal' END AS class FROM shots""", ["shots"])
def measure_mappings(d):
    return d.shots.select(
        "photo_id",
        F.round(measures.lap_score("sharpness_lap"), 6).alias("lap"),
        F.round(measures.exposure_score("shadow_clip", "highlight_clip"), 6).alias("exposure"),
        F.round(measures.fft_score("sharpness_fft"), 6).alias("fft"),
        F.when(F.col("niqe").isNotNull(), F.round(measures.niqe_score("niqe"), 6)).alias("niqe"),
        measures.exposure_class("exposure_mean", "shadow_clip", "highlight_clip").alias("class"),
    )


@query("eye_states", "H14 H13", """
SELECT doc_id, CASE WHEN b > 0.58 AND e < 0.18 THEN 'closed' WHEN b < 0.42 AND e > 0.23 THEN 'open' ELSE 'uncertain' END AS state, round((e * 4 + e * 4) / (2 * 4), 6) AS ear
FROM (SELECT doc_id, (n_chars % 101) / 1e2 AS b, (n_chars % 43) / 1e2 AS e FROM documents)""")
def eye_states(d):
    """Eye states from two channels; the aspect ratio is measured on six built landmarks."""
    e = (F.col("n_chars") % 43) / 100.0
    zero, four = F.lit(0.0), F.lit(4.0)
    points = F.array(
        F.array(zero, zero), F.array(F.lit(1.0), e * 2), F.array(F.lit(3.0), e * 2), F.array(four, zero),
        F.array(F.lit(3.0), -e * 2), F.array(F.lit(1.0), -e * 2),
    )
    ear = geometry.eye_aspect_ratio(points, (0, 1, 2, 3, 4, 5))
    return d.documents.select(
        "doc_id", geometry.eye_state((F.col("n_chars") % 101) / 100.0, e).alias("state"), F.round(ear, 6).alias("ear")
    )


@query("landmark_reliability", "H15", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN least(l_quantity * 10, l_partkey % 300) < 64 THEN 'small face (<64 preview pixels)' WHEN l_suppkey % 200 < 45 THEN 'low face luminance'
 WHEN abs(l_partkey % 101 - 50) > 35 OR abs(l_suppkey % 97 - 48) > 35 OR abs(l_partkey % 127 - 63) > 40 THEN 'oblique head pose' END AS reason FROM lineitem""")
def landmark_reliability(d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    reason = geometry.landmark_reliability(
        F.col("l_quantity") * 10, (p % 300).cast("double"), (s % 200).cast("double"), (p % 101 - 50).cast("double"),
        (s % 97 - 48).cast("double"), (p % 127 - 63).cast("double"),
    )
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@query("requested_regions", "H23 H24", """
SELECT row_id, round(x0, 6) AS x, round(y0, 6) AS y, round(greatest(0, least(1, px + pw)) - x0, 6) AS w, round(greatest(0, least(1, py + ph)) - y0, 6) AS h,
  greatest(0, least(1, px + pw)) - x0 > 0 AND greatest(0, least(1, py + ph)) - y0 > 0 AS valid
FROM (SELECT *, greatest(0, least(1, px)) AS x0, greatest(0, least(1, py)) AS y0 FROM (SELECT row_id, (x - 0.1) * 800 / 400 AS px, y * 900 / 300 AS py, w * 800 / 400 AS pw, h * 900 / 300 AS ph FROM boxes WHERE NOT is_truth))
UNION ALL SELECT row_id, 0.25, 0.25, 0.5, 0.5, true FROM boxes WHERE is_truth""", ["boxes"])
def requested_regions(d):
    box = F.struct(
        ((F.col("x") - 0.1) * 800).alias("x"), (F.col("y") * 900).alias("y"), (F.col("w") * 800).alias("w"), (F.col("h") * 900).alias("h")
    )
    region = geometry.requested_region(F.when(~F.col("is_truth"), box), F.lit(400), F.lit(300))
    return d.boxes.select("row_id", region.alias("r")).select(
        "row_id", *[F.round(f"r.{c}", 6).alias(c) for c in "xywh"], geometry.region_valid("r").alias("valid")
    )


# Groups are customers, members are their orders.
def members(d):
    rows = scored(d)
    quality = F.get(F.filter("faces", lambda f: f.index == 0), F.lit(0)).quality
    return rows.select(
        "group_id",
        "photo_id",
        "project_id",
        "k",
        "decision",
        "score",
        "verdict",
        "usable",
        "valid",
        F.size("faces").alias("face_count"),
        component("face").alias("face_score"),
        component("sharpness").alias("sharpness_score"),
        F.col("exposure.mean").alias("exposure_mean"),
        measures.region_quality(
            quality.sharpness_lap, quality.shadow_clip, quality.highlight_clip, quality.crop_width, quality.crop_height
        ).alias("main_score"),
    )


REFS = """ok AS (SELECT *, good AND verdict <> 'reject_suggest' AS usable FROM scored),
 refs AS (SELECT group_id, arg_min(photo_id, (-score, photo_id)) AS reference_id, max(score) AS reference_score, arg_min(n_faces, (-score, photo_id)) AS ref_faces,
   arg_min(coalesce(face, -1), (-score, photo_id)) AS ref_face, arg_min(sharpness, (-score, photo_id)) AS ref_sharp FROM ok WHERE usable GROUP BY 1)"""


@query("best_references", "E7", f"WITH {SCORED}, {REFS} SELECT group_id, reference_id, round(reference_score, 6) AS reference_score FROM refs", ["shots", "faces"])
def best_references(d):
    out = selection.best_reference(cut(members(d).select("group_id", "photo_id", "score", "usable")), group=["group_id"])
    return out.select("group_id", "reference_id", F.round("reference_score", 6).alias("reference_score"))


ASSESS = f"""{SCORED}, {REFS}, a AS (SELECT ok.*, reference_id, reference_score, greatest(reference_score - score, 0) AS gap,
  list_filter([CASE WHEN NOT usable OR verdict = 'review' THEN 'review_observations' END, CASE WHEN photo_id = reference_id THEN 'technical_reference' END,
   CASE WHEN photo_id <> reference_id AND greatest(reference_score - score, 0) <= 5 AND usable THEN 'close_quality' END,
   CASE WHEN ref_face >= 0 AND face + 10 < ref_face THEN 'face_detail_lower' END, CASE WHEN ref_face >= 0 AND ref_face + 10 < face THEN 'face_detail_higher' END,
   CASE WHEN sharpness + 10 < ref_sharp THEN 'preview_detail_lower' END, CASE WHEN ref_sharp + 10 < sharpness THEN 'preview_detail_higher' END,
   CASE WHEN n_faces <> ref_faces THEN 'different_face_count' END], lambda x: x IS NOT NULL) AS reasons,
  coalesce(usable AND reference_score - score <= 5, false) AS candidate FROM ok LEFT JOIN refs USING (group_id))"""


@query("group_assessment", "J11", f"WITH {ASSESS} SELECT group_id, photo_id, round(gap, 6) AS score_gap, array_to_string(reasons, ',') AS reasons, candidate FROM (SELECT *, CASE WHEN reference_id IS NULL THEN NULL ELSE gap END AS g FROM a)".replace("round(gap, 6)", "round(g, 6)"), ["shots", "faces"])
def group_assessment(d):
    rows, _ = selection.assess_groups(members(d), group=["group_id"])
    return rows.select("group_id", "photo_id", F.round("score_gap", 6).alias("score_gap"), F.array_join("reasons", ",").alias("reasons"), "candidate")


@query("group_assessment_summary", "J11", f"""
WITH {ASSESS} SELECT group_id, max(reference_id) AS reference_id, count(*) FILTER (candidate) AS candidates,
  bool_or(NOT usable OR verdict <> 'recommend' OR list_contains(reasons, 'different_face_count')) AS needs_review FROM a GROUP BY 1""", ["shots", "faces"])
def group_assessment_summary(d):
    return selection.assess_groups(members(d), group=["group_id"])[1]


@query("comparison_report", "J12", f"""
WITH {SCORED}, {REFS}, r AS (SELECT group_id, coalesce(reference_id, first_id) AS reference_id FROM (SELECT group_id, min(photo_id) AS first_id FROM scored GROUP BY 1) LEFT JOIN refs USING (group_id))
SELECT s.group_id AS request_id, s.photo_id, r.reference_id, round(s.score - b.score, 6) AS score_delta, round(s.exposure_mean - b.exposure_mean, 6) AS exposure_delta, CAST(s.n_faces AS INT) AS face_count
FROM scored s JOIN r USING (group_id) JOIN scored b ON b.photo_id = r.reference_id""", ["shots", "faces"])
def comparison_report(d):
    rows = members(d).withColumnRenamed("group_id", "request_id").withColumn("pos", F.col("photo_id"))
    out = selection.compare_members(rows)
    return out.withColumns({"score_delta": F.round("score_delta", 6), "exposure_delta": F.round("exposure_delta", 6)})


POINTS = """pts AS (SELECT photo_id, group_id, i, (bx + bw / 2) / 4000 AS x, (bys + bh / 2) / 3000 AS y, bw * bh / 4000 / 3000 AS area FROM faces WHERE confidence >= 0.55),
 firsts AS (SELECT group_id, min(photo_id) AS ref FROM shots GROUP BY 1),
 ab AS (SELECT b.group_id, b.photo_id, a.i AS face_a, b.i AS face_b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
   FROM firsts f JOIN pts a ON a.photo_id = f.ref JOIN pts b ON b.group_id = f.group_id AND b.photo_id <> f.ref WHERE a.area / b.area BETWEEN 0.5 AND 2),
 near_a AS (SELECT photo_id, face_a, arg_min(face_b, d) AS face_b FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, face_a ORDER BY d) AS n, lead(d) OVER (PARTITION BY photo_id, face_a ORDER BY d) AS second FROM ab)
   WHERE n = 1 AND d <= 0.15 AND (second IS NULL OR second - d >= 0.05) GROUP BY 1, 2),
 near_b AS (SELECT photo_id, face_b, arg_min(face_a, d) AS face_a FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, face_b ORDER BY d) AS n, lead(d) OVER (PARTITION BY photo_id, face_b ORDER BY d) AS second FROM ab)
   WHERE n = 1 AND d <= 0.15 AND (second IS NULL OR second - d >= 0.05) GROUP BY 1, 2)"""


def correspondences(d):
    """Faces of each group's first member against every other member."""
    first = d.shots.groupBy("group_id").agg(F.min("photo_id").alias("ref"))
    points = selection.face_points(d.measured, keys=["group_id", "photo_id"])
    targets = d.shots.select("group_id", F.col("photo_id").alias("member")).join(first, "group_id").filter("member <> ref")
    ref_points = points.withColumnRenamed("photo_id", "ref").join(targets, ["group_id", "ref"]).drop("ref").withColumnRenamed("member", "photo_id")
    other = points.join(targets.select("group_id", F.col("member").alias("photo_id")), ["group_id", "photo_id"], "left_semi")
    return selection.mutual_nearest(ref_points, other, pair=["group_id", "photo_id"])


@query("face_correspondences", "C11", f"WITH {POINTS} SELECT photo_id, CAST(face_a AS INT) AS face_a, CAST(face_b AS INT) AS face_b FROM near_a JOIN near_b USING (photo_id, face_a, face_b)", ["shots", "faces"])
def face_correspondences(d):
    return correspondences(d).select("photo_id", "face_a", "face_b")


def intents(d):
    seg = F.col("c_mktsegment")
    return d.customer.select(
        F.col("c_custkey").alias("group_id"),
        (F.col("c_custkey") % 4 + 1).cast("int").alias("target_keep"),
        (seg == "HOUSEHOLD").alias("has_main"),
    )


def plan_locks(d):
    return d.shots.filter("k % 11 = 0 AND decision IN ('pending', 'keep')").select("photo_id")


PLAN = f"""{SCORED}, it AS (SELECT c_custkey AS group_id, CAST(c_custkey % 4 + 1 AS INT) AS target_keep, c_mktsegment = 'HOUSEHOLD' AS has_main FROM customer),
 q0 AS (SELECT photo_id, CASE WHEN q_lap IS NOT NULL THEN {QUALITY} END AS main_score FROM faces WHERE i = 0),
 m AS (SELECT s.group_id, s.photo_id, s.decision, s.score, good AND verdict <> 'reject_suggest' AS usable, coalesce(target_keep, 1) AS target, coalesce(has_main, false) AS has_main,
   CASE WHEN coalesce(has_main, false) THEN main_score ELSE 0 END AS quality, s.decision = 'keep' OR (s.k % 11 = 0 AND s.decision = 'pending') AS fixed
   FROM scored s LEFT JOIN it USING (group_id) LEFT JOIN q0 USING (photo_id)),
 e AS (SELECT *, CASE WHEN NOT fixed AND decision = 'pending' AND usable AND quality IS NOT NULL THEN row_number() OVER (PARTITION BY group_id, NOT fixed AND decision = 'pending' AND usable AND quality IS NOT NULL ORDER BY quality DESC, score DESC, photo_id) END AS place,
   count(*) FILTER (fixed) OVER (PARTITION BY group_id) AS fixed_n FROM m),
 plan AS (SELECT *, fixed OR coalesce(place <= target - fixed_n, false) AS recommended FROM e)"""


@query("selection_plan", "J13 E6", f"WITH {PLAN} SELECT group_id, photo_id, recommended, recommended AND decision = 'pending' AS pending_keep FROM plan", ["shots", "faces"])
def selection_plan(d):
    return selection.plan_selection(members(d), intents(d), plan_locks(d), group=["group_id"])[0]


@query("selection_summary", "J13", f"""
WITH {PLAN}, t AS (SELECT group_id, count(*) FILTER (recommended) AS recommended_n, count(*) FILTER (recommended AND decision = 'pending') AS pending_n, max(target) AS target FROM plan GROUP BY 1)
SELECT group_id, recommended_n, pending_n, greatest(target - recommended_n, 0) AS remaining_slots, greatest(recommended_n - target, 0) AS over_target, target <> recommended_n AS needs_review FROM t""", ["shots", "faces"])
def selection_summary(d):
    return selection.plan_selection(members(d), intents(d), plan_locks(d), group=["group_id"])[1]


@query("keep_constraints", "J16", f"""
WITH {PLAN} SELECT photo_id, bool_and(recommended) AS allowed FROM plan WHERE group_id IN (SELECT group_id FROM it) GROUP BY 1""", ["shots", "faces"])
def keep_constraints(d):
    plan, _ = selection.plan_selection(members(d), intents(d), plan_locks(d), group=["group_id"])
    return selection.keep_constraints(plan, intents(d), group=["group_id"])


@query("accepted_keeps", "K7", f"WITH {PLAN} SELECT s.project_id, photo_id, 'keep' AS action FROM plan JOIN shots s USING (photo_id) WHERE recommended AND plan.decision = 'pending'", ["shots", "faces"])
def accepted_keeps(d):
    plan, _ = selection.plan_selection(members(d), intents(d), plan_locks(d), group=["group_id"])
    entities = d.shots.select("project_id", "photo_id", F.lit(0).alias("mtime"), F.col("k").alias("size_bytes"))
    return selection.accept_plan(plan, entities, entities.select("photo_id", "mtime", "size_bytes"))


def group_intents(d):
    """Intents with requested locks, the baseline a client saw and a target."""
    listed = d.shots.groupBy("group_id").agg(
        F.min("photo_id").alias("lo"), F.max("photo_id").alias("hi"), F.count("*").alias("n")
    )
    g = F.col("group_id")
    return listed.select(
        "group_id",
        F.when(g % 10 == 0, (F.col("n") + 1).cast("int")).when(g % 10 == 1, 0).otherwise(1).alias("target_keep"),
        F.array_distinct(F.array("lo", F.when(g % 7 == 0, F.col("hi") + 1_000_000_000).otherwise(F.col("hi")))).alias("locked_ids"),
        F.array(F.when(g % 5 == 0, F.col("lo") + 2_000_000_000).otherwise(F.col("lo"))).alias("baseline_ids"),
    )


INTENTS = """i AS (SELECT group_id, CASE WHEN group_id % 10 = 0 THEN count(*) + 1 WHEN group_id % 10 = 1 THEN 0 ELSE 1 END AS target, count(*) AS n,
   list_distinct([min(photo_id), CASE WHEN group_id % 7 = 0 THEN max(photo_id) + 1000000000 ELSE max(photo_id) END]) AS locked,
   [CASE WHEN group_id % 5 = 0 THEN min(photo_id) + 2000000000 ELSE min(photo_id) END] AS base FROM shots GROUP BY group_id)"""


@query("intent_violations", "J15 G5", f"""
WITH {INTENTS}, l AS (SELECT group_id, unnest(locked) AS photo_id, 'lock' AS what FROM i UNION ALL SELECT group_id, unnest(base), 'baseline' FROM i),
j AS (SELECT l.*, s.decision FROM l LEFT JOIN shots s ON s.group_id = l.group_id AND s.photo_id = l.photo_id)
SELECT group_id, NULL AS photo_id, 'target_out_of_range' AS reason FROM i WHERE target NOT BETWEEN 1 AND n
UNION ALL SELECT group_id, photo_id, what || '_not_in_group' FROM j WHERE decision IS NULL
UNION ALL SELECT group_id, photo_id, 'lock_on_decided_row' FROM j WHERE what = 'lock' AND decision = 'reject'""", ["shots"])
def intent_violations(d):
    return selection.intent_violations(group_intents(d), d.shots, group=["group_id"])


@query("lock_changes", "J15", f"""
WITH {INTENTS} SELECT group_id, unnest(list_filter(locked, lambda x: NOT list_contains(base, x))) AS photo_id, 'lock' AS change FROM i
UNION ALL SELECT group_id, unnest(list_filter(base, lambda x: NOT list_contains(locked, x))), 'unlock' FROM i""", ["shots"])
def lock_changes(d):
    return selection.lock_changes(group_intents(d), group=["group_id"])


@query("face_states", "J14", f"""
WITH {POINTS}, g AS (SELECT group_id, min(photo_id) AS main_id FROM shots GROUP BY 1),
x AS (SELECT s.group_id, s.photo_id, s.k, s.n_faces, g.main_id, m.n_faces > 0 AND m.k % 9 <> 0 AS anchor_ok, s.k % 8 < 3 AS chosen, s.k % 8 = 0 AS choice_absent, s.k % 8 = 1 AND s.k % 3 = 0 AS choice_stale, nb.face_b AS matched
  FROM shots s JOIN g USING (group_id) JOIN shots m ON m.photo_id = g.main_id LEFT JOIN (SELECT photo_id, face_a, face_b FROM near_a JOIN near_b USING (photo_id, face_a, face_b)) nb ON nb.photo_id = s.photo_id AND nb.face_a = 0)
SELECT group_id, photo_id, CASE WHEN NOT anchor_ok THEN 'stale' WHEN photo_id = main_id THEN 'reference' WHEN chosen AND choice_absent THEN 'absent'
  WHEN chosen AND (choice_stale OR n_faces = 0) THEN 'stale' WHEN chosen THEN 'manual' WHEN matched IS NOT NULL THEN 'geometry_candidate' ELSE 'uncertain' END AS state FROM x""", ["shots", "faces"])
def face_states(d):
    rows = d.measured.select(
        "group_id", "photo_id", F.concat(F.lit("key"), F.col("k").cast("string")).alias("analysis_key"),
        F.transform("faces", lambda f: f.index).alias("face_indices"), "k",
    )
    first = rows.groupBy("group_id").agg(F.min("photo_id").alias("main_id"))
    mains = first.join(rows.select(F.col("photo_id").alias("main_id"), "analysis_key", "k"), "main_id").select(
        "group_id", "main_id", F.lit(0).alias("main_face"),
        F.when(F.col("k") % 9 == 0, F.lit("stale")).otherwise(F.col("analysis_key")).alias("main_key"),
    )
    choices = rows.filter("k % 8 < 3").select(
        "group_id", "photo_id", F.when(F.col("k") % 8 != 0, F.lit(0)).alias("face"),
        F.when((F.col("k") % 8 == 1) & (F.col("k") % 3 == 0), F.lit("stale")).otherwise(F.col("analysis_key")).alias("choice_key"),
    )
    matches = correspondences(d).select("group_id", "photo_id", F.col("face_a").alias("main_face"), F.col("face_b").alias("face"))
    return selection.face_states(rows, mains, choices, matches, group=["group_id"]).select("group_id", "photo_id", "state")


