"""Queries over evaluation, audits, percentiles and content identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, identity, vectors
from ..operators import audits, corpus, evaluate, ranking
from .registry import query
from .score_queries import DEFAULT, scored, scored_sql

IOU = """greatest(0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y))
 / (p.w * p.h + t.w * t.h - greatest(0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y)))"""


def box_sides(d):
    """Predicted boxes and labelled boxes per image; labels are drawn from the same image's boxes, shifted."""
    rows = d.boxes.select("row_id", "image", "is_truth", "x", "y", "w", "h")
    pred = rows.select("image", F.col("row_id").alias("pred_id"), F.struct("x", "y", "w", "h").alias("box"))
    shift = F.when(F.col("row_id") % 3 == 0, 0.01).otherwise(0.03)
    truth = rows.filter(F.col("is_truth") | (F.col("row_id") % 2 == 0)).select(
        "image", F.col("row_id").alias("truth_id"), F.struct((F.col("x") + shift).alias("x"), "y", "w", "h").alias("box")
    )
    return pred, truth


SIDES = """p AS (SELECT image, row_id AS pred_id, x, y, w, h FROM boxes), t AS (SELECT image, row_id AS truth_id, x + CASE WHEN row_id % 3 = 0 THEN 0.01e0 ELSE 0.03e0 END AS x, y, w, h FROM boxes WHERE is_truth OR row_id % 2 = 0),
 e AS MATERIALIZED (SELECT * FROM (SELECT p.image, pred_id, truth_id, {iou} AS overlap FROM p JOIN t ON p.image = t.image) WHERE overlap >= LIMIT_)""".replace("{iou}", IOU)


@query("box_overlaps", "N1 H7", f"WITH {SIDES.replace('LIMIT_', '0.3')} SELECT image, pred_id, truth_id, round(overlap, 6) AS overlap FROM e", ["boxes"])
def box_overlaps(d):
    pred, truth = box_sides(d)
    return evaluate.box_edges(pred, truth, image="image", threshold=0.3).withColumn("overlap", F.round("overlap", 6))


@query("box_matches", "N1", f"""
RECURSIVE {SIDES.replace('LIMIT_', '0.6')}, pn AS (SELECT image, pred_id, row_number() OVER (PARTITION BY image ORDER BY pred_id) AS n FROM (SELECT DISTINCT image, pred_id FROM e)),
 w AS (SELECT DISTINCT image, 0::BIGINT AS n, []::BIGINT[] AS used, 0::BIGINT AS size, 0::DOUBLE AS total FROM e
   UNION ALL
   SELECT w.image, w.n + 1, CASE WHEN c.truth_id IS NULL THEN used ELSE list_append(used, c.truth_id) END, size + CASE WHEN c.truth_id IS NULL THEN 0 ELSE 1 END, total + coalesce(c.overlap, 0)
   FROM w JOIN pn ON pn.image = w.image AND pn.n = w.n + 1
   JOIN (SELECT image, pred_id, truth_id, overlap FROM e UNION ALL SELECT DISTINCT image, pred_id, NULL, NULL FROM e) c ON c.image = pn.image AND c.pred_id = pn.pred_id
   WHERE c.truth_id IS NULL OR NOT list_contains(used, c.truth_id)),
 best AS (SELECT image, max((size, total)) AS b FROM w GROUP BY image)
SELECT image, b[1] AS matched, round(b[2], 5) AS total_overlap FROM best""", ["boxes"])
def box_matches(d):
    pred, truth = box_sides(d)
    pairs = evaluate.match_boxes(pred, truth, image="image", threshold=0.6)
    return pairs.groupBy("image").agg(F.count("*").alias("matched"), F.round(F.sum("overlap"), 5).alias("total_overlap"))


def label_pairs(d):
    """Human states (toxic = closed) against a rule's states, with abstentions and withheld rows."""
    n = F.col("n_chars")
    said = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n < 500, "uncertain").when(n % 7 < 2, "closed").otherwise("open")
    return d.labels.join(d.documents, "doc_id").select(
        "doc_id",
        "lang",
        F.when(n % 4 == 0, "ungradable").when(F.col("toxic") == 1, "closed").otherwise("open").alias("truth"),
        said.alias("prediction"),
        F.when(n % 3 == 0, "blur").when(n % 3 == 1, "pose").alias("reason"),
        (n % 6 != 0).alias("matched"),
    )


LABELLED = """l AS (SELECT doc_id, lang, CASE WHEN n_chars % 4 = 0 THEN 'ungradable' WHEN toxic = 1 THEN 'closed' ELSE 'open' END AS truth,
  CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars < 500 THEN 'uncertain' WHEN n_chars % 7 < 2 THEN 'closed' ELSE 'open' END AS prediction,
  CASE n_chars % 3 WHEN 0 THEN 'blur' WHEN 1 THEN 'pose' END AS reason, n_chars % 6 <> 0 AS matched FROM labels JOIN documents USING (doc_id))"""


@query("detection_report", "N2", f"""
WITH RECURSIVE l AS (SELECT 1)
SELECT p.lang, count(*) FILTER (hit) AS tp, count(*) FILTER (is_p AND NOT hit) AS fp, count(*) FILTER (is_t AND NOT hit) AS fn,
  CAST(count(*) FILTER (hit) AS DOUBLE) / nullif(count(*) FILTER (is_p), 0) AS precision, CAST(count(*) FILTER (hit) AS DOUBLE) / nullif(count(*) FILTER (is_t), 0) AS recall
FROM (SELECT lang, n_chars % 5 <> 0 AS is_p, n_chars % 3 <> 0 AS is_t, n_chars % 5 <> 0 AND n_chars % 3 <> 0 AS hit FROM documents) p GROUP BY 1""")
def detection_report(d):
    n = F.col("n_chars")
    return evaluate.detection_counts(
        d.documents.filter(n % 5 != 0), d.documents.filter(n % 3 != 0), d.documents.filter((n % 5 != 0) & (n % 3 != 0)), by=["lang"]
    )


@query("abstention_report", "N3", f"""
WITH {LABELLED} SELECT lang, count(*) AS gradable, count(*) FILTER (prediction IN ('open', 'closed')) AS answered, count(*) FILTER (prediction = truth) AS correct,
 count(*) FILTER (prediction IN ('open', 'closed') AND prediction <> truth) AS incorrect, count(*) FILTER (prediction IS NULL OR prediction = 'uncertain') AS abstained,
 CAST(count(*) FILTER (prediction IN ('open', 'closed')) AS DOUBLE) / count(*) AS coverage,
 CAST(count(*) FILTER (prediction = truth) AS DOUBLE) / nullif(count(*) FILTER (prediction IN ('open', 'closed')), 0) AS accuracy_when_answered,
 CAST(count(*) FILTER (prediction = truth) AS DOUBLE) / count(*) AS end_to_end_rate
FROM l WHERE truth <> 'ungradable' GROUP BY 1""")
def abstention_report(d):
    return evaluate.abstention_report(label_pairs(d), by=["lang"])


@query("confusion_matrix", "N3", f"""
WITH {LABELLED} SELECT truth, CASE WHEN prediction IN ('open', 'closed') THEN prediction ELSE 'abstain' END AS prediction, count(*) AS n FROM l WHERE truth <> 'ungradable' GROUP BY 1, 2""")
def confusion_matrix(d):
    return evaluate.confusion(label_pairs(d))


@query("ungradable_report", "N4", f"""
WITH {LABELLED}, g AS (SELECT coalesce(reason, 'unspecified') AS reason, matched, prediction FROM l WHERE truth = 'ungradable'),
r AS (SELECT * FROM g UNION ALL SELECT '(all)', matched, prediction FROM g)
SELECT reason, count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS missing, count(*) FILTER (matched AND prediction IN ('open', 'closed')) AS determinate,
 count(*) FILTER (matched AND prediction = 'uncertain') AS uncertain, count(*) FILTER (matched AND prediction IS NULL) AS hidden,
 CAST(count(*) FILTER (matched AND prediction IN ('open', 'closed')) AS DOUBLE) / nullif(count(*) FILTER (matched), 0) AS determinate_rate,
 CAST(count(*) FILTER (matched AND prediction IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER (matched), 0) AS display_rate FROM r GROUP BY 1""")
def ungradable_report(d):
    return evaluate.ungradable_report(label_pairs(d).filter("truth = 'ungradable'"))


@query("group_success", "N5 G5", """
SELECT source AS group_id, arg_min(doc_id, (-n_chars, doc_id)) AS top_id, arg_min(doc_id, (-n_chars, doc_id)) IN (SELECT doc_id FROM labels WHERE quality = 1) AS success FROM documents GROUP BY 1""")
def group_success(d):
    docs = d.documents.select(F.col("source").alias("group_id"), F.col("doc_id").alias("photo_id"), "n_chars")
    top = ranking.rank_within(docs, group=["group_id"], order=[F.col("n_chars").desc(), F.col("photo_id")], at_most=1)
    good = d.labels.filter("quality = 1").select(F.col("doc_id").alias("photo_id")).join(docs, "photo_id")
    return evaluate.group_success(top, good, group=["group_id"])


TERMS = ("laplacian", "fft", "niqe")
PREFS = f"""{scored_sql('scored', DEFAULT)}, tm AS (SELECT photo_id, k, greatest(0, least(100, 100 * ln(1 + sharpness_lap) / ln(1001))) AS lap, 100 * sqrt(sharpness_fft) AS fft,
   greatest(0, least(100, 100 - greatest(niqe - 2, 0) * 12.5)) AS nq, niqe IS NOT NULL AS has FROM scored),
 vs AS (SELECT photo_id, k, unnest([{{'variant': 'full', 'score': CASE WHEN has THEN lap * 0.6 + fft * 0.2 + nq * 0.2 ELSE lap * 0.75 + fft * 0.25 END}},
   {{'variant': 'without_laplacian', 'score': CASE WHEN has THEN (fft * 0.2 + nq * 0.2) / 0.4 ELSE fft END}}, {{'variant': 'without_fft', 'score': CASE WHEN has THEN (lap * 0.6 + nq * 0.2) / 0.8 ELSE lap END}},
   {{'variant': 'without_niqe', 'score': CASE WHEN has THEN (lap * 0.6 + fft * 0.2) / 0.8 ELSE lap * 0.75 + fft * 0.25 END}}], recursive := false) AS v FROM tm),
 pr AS (SELECT a.v.variant AS variant, CASE a.k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' ELSE 'ungradable' END AS preference,
   CASE WHEN abs(a.v.score - b.v.score) <= 1e-9 THEN 'tie' WHEN a.v.score > b.v.score THEN 'a' ELSE 'b' END AS said, a.photo_id FROM vs a JOIN vs b ON b.photo_id = a.photo_id + 1 AND b.v.variant = a.v.variant),
 fu AS (SELECT pr.*, f.said AS full_said FROM pr JOIN pr f ON f.photo_id = pr.photo_id AND f.variant = 'full' WHERE pr.preference <> 'ungradable')"""


@query("preference_report", "N6", f"""
WITH {PREFS} SELECT 'sharpness' AS dimension, variant, count(*) AS gradable, count(*) AS answered, count(*) FILTER (said = preference) AS correct, count(*) AS paired,
 count(*) FILTER (said = preference) AS variant_correct, count(*) FILTER (full_said = preference) AS full_correct FROM fu GROUP BY 2""".replace(", recursive := false", ""), ["shots", "faces"])
def preference_report(d):
    terms = F.get(F.filter("components", lambda c: c.id == "sharpness"), F.lit(0)).terms
    rows = scored(d).select("photo_id", "k", terms.alias("terms"))
    rows = rows.select("photo_id", "k", evaluate.ablation_scores(F.col("terms"), TERMS).alias("variants"))
    other = rows.select((F.col("photo_id") - 1).alias("photo_id"), F.col("variants").alias("variants_b"))
    k = F.col("k") % 4
    pairs = rows.withColumnRenamed("variants", "variants_a").join(other, "photo_id").select(
        F.lit("sharpness").alias("dimension"),
        F.when(k == 0, "a").when(k == 1, "b").when(k == 2, "tie").otherwise("ungradable").alias("preference"),
        "variants_a",
        "variants_b",
    )
    return evaluate.preference_report(pairs).select(
        "dimension", "variant", "gradable", "answered", "correct", "paired", "variant_correct", "full_correct"
    )


@query("value_percentiles", "N7 D6", """
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def value_percentiles(d):
    out = evaluate.percentiles(d.events, value="value", quantiles=[0.5, 0.95], by=["event_type"])
    return out.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("nearest_rank", "D7", """
SELECT q AS quantile, v AS value FROM (SELECT unnest([0.5e0, 0.95e0, 0.99e0]) AS q), LATERAL (SELECT CAST(greatest(ceil(q * count(*)) - 1, 0) AS BIGINT) AS i FROM lineitem) AS n,
LATERAL (SELECT v FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r FROM lineitem) AS o WHERE r = i) AS h""")
def nearest_rank(d):
    return ranking.nearest_rank(d.lineitem, value="l_extendedprice", quantiles=[0.5, 0.95, 0.99])


@query("label_violations", "N8 C14", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'label_missing' WHEN d.doc_id IS NULL THEN 'label_extra' WHEN NOT l.complete THEN 'incomplete' WHEN l.n <> d.n_chars THEN 'fingerprint_differs' END AS reason
FROM (SELECT * FROM documents WHERE n_chars % 3 <> 0) d FULL JOIN (SELECT doc_id, n_chars + CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS n, n_chars % 7 <> 0 AS complete FROM labels JOIN documents USING (doc_id)) l ON l.doc_id = d.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR NOT l.complete OR l.n <> d.n_chars""")
def label_violations(d):
    n = F.col("n_chars")
    marked = d.labels.join(d.documents, "doc_id").select(
        "doc_id", (n + F.when(n % 5 == 0, 1).otherwise(0)).alias("n_chars"), (n % 7 != 0).alias("complete")
    )
    return evaluate.label_violations(d.documents.filter(n % 3 != 0), marked, key="doc_id", fingerprint=["n_chars"])


@query("truth_box_violations", "N8", """
SELECT row_id, CASE WHEN x + 0.5 + w > 1 + 1e-9 OR y + h > 1 + 1e-9 THEN 'box_outside_frame' WHEN row_id % 11 = 0 THEN 'unknown_state' WHEN row_id % 7 = 0 THEN 'unsupported_reason' END AS why
FROM boxes WHERE x + 0.5 + w > 1 + 1e-9 OR y + h > 1 + 1e-9 OR row_id % 11 = 0 OR row_id % 7 = 0""", ["boxes"])
def truth_box_violations(d):
    r = F.col("row_id")
    rows = d.boxes.select(
        "row_id",
        F.struct((F.col("x") + 0.5).alias("x"), "y", "w", "h").alias("box"),
        F.when(r % 11 == 0, "shut").otherwise("open").alias("left_eye"),
        F.lit("closed").alias("right_eye"),
        F.when(r % 7 == 0, "blur").alias("reason"),
    )
    return evaluate.truth_box_violations(rows, key=["row_id"])


def two_runs(d):
    """Two runs over the same orders; the later one rescored part of them."""
    k = F.col("k")
    before = d.shots.select("photo_id", k, (k % 101).cast("double").alias("score"), F.when(k % 3 == 0, "recommend").otherwise("review").alias("verdict"), "n_faces", F.when(k % 4 != 0, "open").alias("state"))
    after = before.select(
        "photo_id", "k",
        (F.col("score") + F.when(k % 10 == 0, 0.25).otherwise(0.0)).alias("score"),
        F.when(k % 20 == 0, "review").otherwise(F.col("verdict")).alias("verdict"),
        (F.col("n_faces") + F.when(k % 9 == 0, 1).when(k % 9 == 1, -1).otherwise(0)).alias("n_faces"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 14 == 0, "closed").otherwise(F.col("state")).alias("state"),
    )
    return before, after


RUNS = """r AS (SELECT photo_id, k, CASE WHEN k % 3 = 0 THEN 'recommend' ELSE 'review' END AS bv, CASE WHEN k % 20 = 0 THEN 'review' WHEN k % 3 = 0 THEN 'recommend' ELSE 'review' END AS av,
  CASE WHEN k % 4 <> 0 THEN 'open' END AS bs, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 14 = 0 THEN 'closed' WHEN k % 4 <> 0 THEN 'open' END AS as_ FROM shots)"""


@query("run_transitions", "D4 N9 C13", f"WITH {RUNS} SELECT bv AS before, av AS after, count(*) AS n FROM r GROUP BY 1, 2", ["shots"])
def run_transitions(d):
    before, after = two_runs(d)
    return audits.compare_runs(before, after, key=["photo_id"], frozen=["k"], numeric="score", categorical="verdict")["transitions"]


@query("run_delta_summary", "D5 N9", """
SELECT min(CASE WHEN k % 10 = 0 THEN 0.25e0 ELSE 0e0 END) AS min, median(CASE WHEN k % 10 = 0 THEN 0.25e0 ELSE 0e0 END) AS median, max(CASE WHEN k % 10 = 0 THEN 0.25e0 ELSE 0e0 END) AS max, count(*) FILTER (k % 10 = 0) AS changed FROM shots""", ["shots"])
def run_delta_summary(d):
    before, after = two_runs(d)
    return audits.compare_runs(before, after, key=["photo_id"], frozen=["k"], numeric="score", categorical="verdict")["delta"]


@query("mask_violations", "N10", f"WITH {RUNS} SELECT photo_id, CASE WHEN bs IS NULL THEN 'restored' ELSE 'changed' END AS why FROM r WHERE as_ IS NOT NULL AND (bs IS NULL OR bs <> as_)", ["shots"])
def mask_violations(d):
    before, after = two_runs(d)
    return audits.mask_violations(audits.paired_runs(before, after, key=["photo_id"], columns=["state"]), key=["photo_id"])


@query("detector_changes", "N11", "SELECT count(*) FILTER (k % 9 > 1) AS same, count(*) FILTER (k % 9 = 0) AS more, count(*) FILTER (k % 9 = 1) AS fewer FROM shots", ["shots"])
def detector_changes(d):
    before, after = two_runs(d)
    return audits.count_changes(audits.paired_runs(before, after, key=["photo_id"], columns=["n_faces"]), "n_faces")


@query("device_audit", "N12", """
SELECT false AS counts_equal, 0.25e0 AS max_score_error, count(*) FILTER (k % 60 = 0) AS verdict_changes, false AS passed FROM shots""", ["shots"])
def device_audit(d):
    before, after = two_runs(d)
    pairs = audits.paired_runs(before, after, key=["photo_id"], columns=["score", "verdict", "n_faces"])
    return audits.device_audit(pairs, count="n_faces")


@query("device_verdicts", "N12", """
WITH p AS (SELECT vec_id % 4 AS device, list_dot_product(embedding::DOUBLE[], list_transform(embedding, lambda x: CAST(x * CASE WHEN vec_id % 4 = 1 THEN 0.99e0 ELSE 1e0 END AS FLOAT))::DOUBLE[]) AS c,
   CASE WHEN vec_id % 4 = 2 THEN 0.625e0 ELSE 0.25e0 END AS e, vec_id % 60 = 3 AS changed FROM embeddings)
SELECT device, true AS counts_equal, max(e) AS max_score_error, count(*) FILTER (changed) AS verdict_changes, round(min(c), 5) AS min_cosine,
   max(e) < 0.5 AND count(*) FILTER (changed) = 0 AND min(c) > 0.9999 AS passed FROM p GROUP BY 1""")
def device_verdicts(d):
    """Four devices against one: one agrees, the others differ in vectors, scores and verdicts."""
    device = F.col("vec_id") % 4
    factor = F.when(device == 1, 0.99).otherwise(1.0)
    pairs = d.embeddings.select(
        device.alias("device"), (F.col("vec_id") % 101).cast("double").alias("before_score"), F.lit("keep").alias("before_verdict"), F.lit(2).alias("before_faces"),
        F.col("embedding").alias("before_vector"), (F.col("vec_id") % 101 + F.when(device == 2, 0.625).otherwise(0.25)).alias("after_score"),
        F.when(F.col("vec_id") % 60 == 3, "review").otherwise("keep").alias("after_verdict"), F.lit(2).alias("after_faces"),
        F.transform("embedding", lambda x: (x * factor).cast("float")).alias("after_vector"),
    )
    return audits.device_audit(pairs, vector="vector", by=["device"]).withColumn("min_cosine", F.round("min_cosine", 5))


@query("vector_audit", "N12 H3", """
SELECT round(min(list_dot_product(embedding::DOUBLE[], list_transform(embedding, lambda x: CAST(x * 0.5 AS FLOAT))::DOUBLE[])), 6) AS min_cosine, count(*) AS n FROM embeddings""")
def vector_audit(d):
    half = F.transform("embedding", lambda x: (x * 0.5).cast("float"))
    return d.embeddings.agg(F.round(F.min(vectors.dot("embedding", half)), 6).alias("min_cosine"), F.count("*").alias("n"))


@query("pipeline_check", "N13", """
SELECT bool_and(o_orderstatus IS NOT NULL) AND count(*) = max(n) AS passed FROM orders, (SELECT count(*) AS n FROM orders)""")
def pipeline_check(d):
    n = d.orders.count()
    # One report row per priority; every step saw all rows of the run.
    seen = [F.lit(n).alias(c) for c in ("scanned", "analyzed", "reused")]
    runs = d.orders.groupBy("o_orderpriority").agg(F.count("*").alias("seq")).select(
        F.lit("completed").alias("state"), F.lit(0).alias("errors"), *seen, "seq"
    )
    return audits.pipeline_passed(runs, expected=n)


@query("repeat_audit", "D11", """
WITH x AS (SELECT text, count(*) AS copies, min(source) AS lo, max(source) AS hi FROM documents GROUP BY 1) SELECT md5(text) AS source, copies, lo = hi AS consistent FROM x""")
def repeat_audit(d):
    rows = d.documents.select(F.col("doc_id").alias("path"), F.col("source").alias("payload"))
    expected = d.documents.select(F.col("doc_id").alias("path"), F.md5("text").alias("source"))
    return audits.repeat_audit(rows, expected)[0]


@query("run_digest", "D12", """
WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR) || chr(1) || text) AS d FROM documents)
SELECT count(*) AS rows, """ + ", ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest{i}" for i in range(4)
) + " FROM h")
def run_digest(d):
    return audits.run_digest(d.documents.withColumn("doc_id", F.col("doc_id").cast("string")), columns=["doc_id", "text"])


@query("value_counts", "D8", """
SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def value_counts(d):
    return audits.value_counts(d.documents, ["lang", "source"])


@query("value_histogram", "D13", """
SELECT CAST(least(15, greatest(0, floor((l_extendedprice - 0) / (100000e0 / 16)))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def value_histogram(d):
    return audits.histogram(d.lineitem, "l_extendedprice", low=0.0, high=100_000.0, bins=16)


@query("phase_report", "D14", """
WITH r AS (SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'first_scan' WHEN 'click' THEN 'first_analysis' WHEN 'purchase' THEN 'incremental_scan' ELSE 'cached_analysis' END AS phase, value FROM events)
SELECT run_id, round(sum(value) FILTER (phase IN ('first_scan', 'first_analysis')), 6) AS first_seconds, round(sum(value) FILTER (phase IN ('incremental_scan', 'cached_analysis')), 6) AS incremental_seconds,
 round(1000 / sum(value) FILTER (phase = 'first_analysis'), 6) AS per_second FROM r GROUP BY 1""")
def phase_report(d):
    t = F.col("event_type")
    runs = d.events.select(
        F.col("user_id").alias("run_id"),
        F.when(t == "view", "first_scan").when(t == "click", "first_analysis").when(t == "purchase", "incremental_scan").otherwise("cached_analysis").alias("phase"),
        F.col("value").alias("seconds"),
        F.lit(1000).alias("count"),
    )
    out = audits.phase_report(runs)
    return out.select("run_id", *[F.round(c, 6).alias(c) for c in ("first_seconds", "incremental_seconds", "per_second")])


@query("dataset_gate", "D10", """
WITH g AS (SELECT user_id, event_type, list(DISTINCT event_id % 50 ORDER BY event_id % 50) AS m FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(DISTINCT m) FROM g WHERE event_type = 'view') AS unique_burst_groups, (SELECT count(DISTINCT m) FROM g WHERE event_type = 'click') AS unique_duplicate_groups,
 (SELECT count(*) FROM documents) >= 300 AND (SELECT count(DISTINCT m) FROM g WHERE event_type = 'view') >= 60 AS satisfied""")
def dataset_gate(d):
    kind = F.when(F.col("event_type") == "view", "burst").when(F.col("event_type") == "click", "duplicate")
    members = d.events.select("user_id", kind.alias("kind"), (F.col("event_id") % 50).alias("photo_id")).filter("kind IS NOT NULL").distinct()
    keys = evaluate.group_keys(members, group=["user_id", "kind"])
    return evaluate.dataset_gate(d.documents, keys)


@query("weighted_means", "D15", """
SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) FILTER (l_discount > 0) / sum(l_quantity) FILTER (l_discount > 0), 4) AS mean FROM lineitem GROUP BY 1""")
def weighted_means(d):
    return corpus.weighted_mean(
        d.lineitem.withColumn("observed", F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))), by=["l_returnflag"], value="observed", weight="l_quantity"
    ).withColumn("mean", F.round("mean", 4))


@query("corpus_statistics", "D17", """
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(avg(a.v), 5) AS mean_i, round(covar_samp(a.v, b.v), 6) AS covariance FROM e a JOIN e b USING (vec_id) WHERE a.i <= b.i GROUP BY 1, 2""")
def corpus_statistics(d):
    out = corpus.covariance(d.embeddings, vector="embedding", size=64)
    return out.select("i", "j", F.round("mean_i", 5).alias("mean_i"), F.round("covariance", 6).alias("covariance"))


@query("feature_distances", "D17", """
WITH f AS (SELECT vec_id, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM (SELECT vec_id, embedding, unnest(range(32)) AS i FROM embeddings)),
c AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, covar_samp(x, y) AS vxy, var_samp(y) AS vy FROM f),
r AS (SELECT vec_id, avg(x) - any_value(mx) AS dx, avg(y) - any_value(my) AS dy, (var_samp(x) + any_value(vx)) / 2 AS a, (covar_samp(x, y) + any_value(vxy)) / 2 AS b, (var_samp(y) + any_value(vy)) / 2 AS e FROM f, c GROUP BY 1)
SELECT vec_id, round(sqrt(greatest(0, (e * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * e - b * b))), 4) AS distance FROM r""")
def feature_distances(d):
    """Each vector as 32 blocks of two features, against the mean and covariance of all blocks."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(*[F.get("embedding", i * 2 + j).cast("double") for j in range(2)]))
    rows = d.embeddings.select("vec_id", pairs.alias("blocks"))
    mean, cov = corpus.fit(rows.select(F.explode("blocks").alias("block")), vector="block", size=2)
    return corpus.distances(rows, mean, cov, id="vec_id", blocks="blocks").withColumn("distance", F.round("distance", 4))


@query("phase_targets", "D14", """
WITH r AS (SELECT user_id AS run_id, sum(value) FILTER (event_type IN ('view', 'click')) AS first_seconds, sum(value) FILTER (event_type NOT IN ('view', 'click')) AS incremental_seconds,
   max(event_id % 1000) AS peak_mib, count(*) FILTER (event_id % 3 = 0) AS samples FROM events GROUP BY 1),
t AS (SELECT run_id, coalesce(first_seconds <= 400, false) AS first_time, coalesce(incremental_seconds <= 350, false) AS cache_time, coalesce(peak_mib <= 990, false) AS memory, samples > 0 AS sampling FROM r)
SELECT *, first_time AND cache_time AND memory AND sampling AS all_targets_passed FROM t""")
def phase_targets(d):
    t = F.col("event_type")
    phase = F.when(t == "view", "first_scan").when(t == "click", "first_analysis").when(t == "purchase", "incremental_scan").otherwise("cached_analysis")
    runs = d.events.select(F.col("user_id").alias("run_id"), phase.alias("phase"), F.col("value").alias("seconds"), F.lit(1000).alias("count"))
    memory = d.events.groupBy(F.col("user_id").alias("run_id")).agg(F.max(F.col("event_id") % 1000).alias("peak_mib"), F.count_if(F.col("event_id") % 3 == 0).alias("samples"))
    report = audits.phase_report(runs).join(memory, "run_id")
    budgets = {"first_time": ("first_seconds", 400), "cache_time": ("incremental_seconds", 350), "memory": ("peak_mib", 990)}
    return audits.targets_passed(report, budgets, sampled="samples").select("run_id", *budgets, "sampling", "all_targets_passed")


@query("capture_times", "H17", """
SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN 1767268800 + n_chars WHEN 1 THEN 1767268800 + n_chars WHEN 2 THEN 1767268800 + n_chars WHEN 3 THEN 1767268800 + n_chars - 7200 END AS seconds FROM documents""")
def capture_times(d):
    n = F.col("n_chars")
    at = F.timestamp_seconds(F.lit(1_767_268_800) + n)
    text = (
        F.when(n % 5 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(n % 5 == 1, F.date_format(at, "yyyy:MM:dd HH:mm:ss"))
        .when(n % 5 == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(n % 5 == 3, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return d.documents.select("doc_id", identity.capture_seconds(text).alias("seconds"))


@query("content_ids", "H18 H19 H20 H21 H26", """
SELECT doc_id, 'scene-' || sha256('scene-v1:' || source || ':[' || doc_id || ', ' || n_chars || ']') AS scene, sha256('[' || least(doc_id, n_chars) || ',' || greatest(doc_id, n_chars) || ']') AS members,
  sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS content, sha256(source || ':' || lang || ':' || n_chars) AS space, true AS valid FROM documents""")
def content_ids(d):
    ids = F.array("doc_id", "n_chars")
    space = identity.space_key("source", "lang", "n_chars")
    return d.documents.select(
        "doc_id",
        identity.scene_id("source", ids).alias("scene"),
        identity.members_key(ids).alias("members"),
        identity.content_key("doc_id", "lang").alias("content"),
        space.alias("space"),
        identity.is_sha256(space).alias("valid"),
    )


@query("vector_distances", "H3 H4 H5", """
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
z AS (SELECT *, list_transform(list_zip(x, y), lambda q: q[1] - q[2]) AS dif FROM p)
SELECT vec_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 5) AS cosine, round(list_sum(list_transform(dif, lambda v: abs(v))) / 64, 4) AS mean_abs,
 round(list_max(list_transform(dif, lambda v: abs(v))), 4) AS max_abs, round(list_sum(list_transform(dif, lambda v: v * v)) / 64, 5) AS mean_sq, round(sqrt(list_dot_product(x, x)), 4) AS norm FROM z""")
def vector_distances(d):
    b = d.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return d.embeddings.join(b, "vec_id").select(
        "vec_id",
        F.round(vectors.cosine("embedding", "other"), 5).alias("cosine"),
        F.round(vectors.mean_abs_difference("embedding", "other").cast("double"), 4).alias("mean_abs"),
        F.round(vectors.max_abs_difference("embedding", "other").cast("double"), 4).alias("max_abs"),
        F.round(vectors.mean_squared_difference("embedding", "other"), 5).alias("mean_sq"),
        F.round(vectors.norm("embedding"), 4).alias("norm"),
    )


@query("aspect_gates", "H6", """
SELECT row_id, abs(w / h - 1) < 0.05 AS close, abs(w / h / 1 - 1) <= 0.005 AS relative, w / h BETWEEN 2e0 / 3 AND 1.5 AS within FROM boxes""", ["boxes"])
def aspect_gates(d):
    a, one = F.col("w") / F.col("h"), F.lit(1.0)
    return d.boxes.select(
        "row_id",
        geometry.aspect_close(a, one).alias("close"),
        geometry.aspect_relative(a, one).alias("relative"),
        geometry.aspect_ratio_within(a, one).alias("within"),
    )


