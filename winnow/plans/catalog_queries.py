"""Queries over sources, snapshots, the catalog and the decision log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.identity import media_format, safe_relative, variant_key
from ..operators import audits, catalog, latest, log, ranking, regroup, sampling, snapshots, stored
from ..session import ContractViolation, shared_folder
from ..settings import Settings
from ..sources import annotations, decisions, files, manifests, payloads, sidecars
from .registry import query
from .views import VERSION

KEY = ["project_id", "path"]
FINGERPRINT = ["mtime", "size_bytes"]

STATE = """
  dec AS (SELECT photo_id, arg_max(action, seq) AS decision FROM decision_log WHERE undone_at IS NULL GROUP BY photo_id),
  mrk AS (SELECT photo_id, arg_max(rating, seq) AS rating, arg_max(color_label, seq) AS color_label
          FROM mark_log WHERE undone_at IS NULL GROUP BY photo_id),
  narrow AS (SELECT doc_id AS photo_id,
      (n_chars % 11 NOT IN (0, 1, 3, 6, 8)) AS fresh,
      CASE WHEN n_chars % 11 IN (5, 6) THEN -1.0 ELSE CAST(n_chars % 101 AS DOUBLE) END AS raw_score,
      CASE WHEN n_chars % 11 IN (6, 7) THEN NULL WHEN n_chars % 3 = 0 THEN 'recommend' WHEN n_chars % 3 = 1 THEN 'review' ELSE 'reject_suggest' END AS raw_verdict
      FROM documents),
  state AS (SELECT e.*, coalesce(dec.decision, 'pending') AS decision, coalesce(mrk.rating, 0) AS rating,
      coalesce(mrk.color_label, 'none') AS color_label, CASE WHEN fresh THEN raw_score ELSE -1.0 END AS score,
      CASE WHEN fresh THEN raw_verdict END AS verdict, raw_verdict, CASE WHEN fresh THEN 'current' ELSE 'stale' END AS status
      FROM entities e LEFT JOIN dec USING (photo_id) LEFT JOIN mrk USING (photo_id) JOIN narrow USING (photo_id))
"""
STATE_VIEWS = ["entities", "decision_log", "mark_log"]


def entity_state(d):
    return latest.with_state(d.entities, latest.decision_state(d.decision_log), latest.mark_state(d.mark_log))


def narrow_analyses(d):
    return payloads.project_payload(d.payloads)


_DIGESTS: dict[str, str] = {}
_STORES: dict[tuple, stored.StoredCatalog] = {}


def settings_digest(spark) -> str:
    """Digest of the default settings as the stored-settings expression writes it; found once in an application."""
    from ..settings import scoring_settings_key

    app = spark.sparkContext.applicationId
    if app not in _DIGESTS:
        _DIGESTS[app] = spark.range(1).select(scoring_settings_key(F.lit("{}")).alias("k")).first()["k"]
    return _DIGESTS[app]


def states(decisions, marks):
    return latest.decision_state(decisions).join(latest.mark_state(marks), "photo_id", "full_outer")


def new_store(d, name: str) -> stored.StoredCatalog:
    return stored.StoredCatalog(d.spark, f"{shared_folder(d.spark)}/winnow-{name}-{uuid.uuid4().hex}")


def stored_catalog(d) -> stored.StoredCatalog:
    """The stored catalog over a folder's tables: written by the first page of an application, refreshed by changed keys when a table was replaced."""
    paths, conf = d.spark._jvm.org.apache.hadoop.fs.Path, d.spark._jsc.hadoopConfiguration()
    places = [paths(f"{d.folder}/{t}.parquet") for t in ("documents", "events")]
    written = tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in places)
    key = (d.spark.sparkContext.applicationId, d.folder)
    store, seen = _STORES.get(key, (None, None))
    if store is None or not paths(store.place).getFileSystem(conf).exists(paths(store.place)):
        store = new_store(d, "catalog")
        store.save({"entities": d.entities, "analyses": stored.hashed_analyses(d.payloads, payloads.project_payload), "states": states(d.decision_log, d.mark_log)})
    elif seen != written:
        store.refresh_analyses(d.payloads, payloads.project_payload)
        store.refresh({"entities": d.entities, "states": states(d.decision_log, d.mark_log)})
    _STORES[key] = (store, written)
    return store


def candidate_view(d):
    return stored_catalog(d).rows(version=VERSION, settings_key=settings_digest(d.spark))


def classified(d):
    return snapshots.diff_snapshot(
        d.snapshot_before, d.snapshot_after, key=KEY, fingerprint=FINGERPRINT, keep_flag="quarantined"
    )


DIFF = """
  diff AS (SELECT coalesce(b.project_id, a.project_id) AS project_id, coalesce(b.path, a.path) AS path,
      CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'unseen'
           WHEN b.mtime = a.mtime AND b.size_bytes = a.size_bytes AND NOT b.quarantined THEN 'unchanged' ELSE 'changed' END AS status
      FROM snapshot_before b FULL JOIN snapshot_after a ON b.project_id = a.project_id AND b.path = a.path)
"""


@query("listed_files", "A1")
def listed_files(d):
    """Files of the folder of the given tables; SQL has no listing, so a test compares it with a walk."""
    return files.classify_files(files.list_files(d.spark, d.folder)).select("path", "size_bytes", "filename", "safe")


@query("media_formats", "A2", """
SELECT CASE WHEN ext IN ('jpg','jpeg') THEN 'jpeg' WHEN ext = 'png' THEN 'png' WHEN ext = 'webp' THEN 'webp'
            WHEN ext IN ('heic','heif') THEN 'heic'
            WHEN ext IN ('dng','cr2','cr3','nef','nrw','arw','srw','orf','rw2','pef','raf','rwl','raw') THEN 'raw' ELSE 'skipped' END AS format,
       count(*) AS files
FROM (SELECT lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM (SELECT path FROM entities UNION ALL SELECT url FROM pages))
GROUP BY 1""", ["entities"])
def media_formats(d):
    paths = d.entities.select("path").unionByName(d.pages.select(F.col("url").alias("path")))
    return paths.groupBy(F.coalesce(media_format("path"), F.lit("skipped")).alias("format")).agg(
        F.count("*").alias("files")
    )


@query("snapshot_diff", "A3 C3", f"WITH {DIFF} SELECT * FROM diff", ["snapshot_before", "snapshot_after"])
def snapshot_diff(d):
    return classified(d).select(*KEY, "status")


@query("missing_rows", "A4", """
SELECT b.project_id, b.path FROM snapshot_before b
WHERE NOT b.quarantined AND NOT b.missing
  AND NOT EXISTS (SELECT 1 FROM snapshot_after a WHERE a.project_id = b.project_id AND a.path = b.path)
  AND b.project_id NOT IN (SELECT project_id FROM scan_failures)""", ["snapshot_before", "snapshot_after", "scan_failures"])
def missing_rows(d):
    return snapshots.mark_missing(d.snapshot_before, d.snapshot_after, d.scan_failures, key=KEY).select(*KEY)


@query("next_snapshot", "A3 A4", """
SELECT project_id, path, size_bytes, missing FROM (
  SELECT a.project_id, a.path, a.size_bytes, NULL::BOOLEAN AS missing FROM snapshot_after a
  UNION ALL
  SELECT b.project_id, b.path, b.size_bytes, b.missing OR (NOT b.quarantined AND b.project_id NOT IN (SELECT project_id FROM scan_failures))
  FROM snapshot_before b WHERE NOT EXISTS (SELECT 1 FROM snapshot_after a WHERE a.project_id = b.project_id AND a.path = b.path))""",
  ["snapshot_before", "snapshot_after", "scan_failures"])
def next_snapshot(d):
    gone = snapshots.mark_missing(d.snapshot_before, d.snapshot_after, d.scan_failures, key=KEY)
    return snapshots.next_snapshot(d.snapshot_before, d.snapshot_after, gone, key=KEY).select(
        *KEY, "size_bytes", "missing"
    )


@query("rescan_scope", "A5 B9", """
SELECT e.project_id, e.path FROM entities e WHERE EXISTS (
  SELECT 1 FROM (SELECT project_id, regexp_replace(path, '/[^/]*$', '') AS root FROM scan_failures) s
  WHERE s.project_id = e.project_id AND (e.path = s.root OR starts_with(e.path, s.root || '/')))""", ["entities", "scan_failures"])
def rescan_scope(d):
    roots = d.scan_failures.select("project_id", F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return snapshots.in_scope(d.entities, roots).select(*KEY)


@query("scan_report", "A6 O5", f"""
WITH {DIFF}, c AS (SELECT project_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed,
   count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'unseen') AS unseen, 0::BIGINT AS skipped FROM diff GROUP BY 1),
f AS (SELECT project_id, count(*) AS failed FROM scan_failures GROUP BY 1)
SELECT coalesce(c.project_id, f.project_id) AS project_id, coalesce(added, 0) AS added, coalesce(changed, 0) AS changed,
  coalesce(unchanged, 0) AS unchanged, coalesce(unseen, 0) AS unseen, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed
FROM c FULL JOIN f ON c.project_id = f.project_id""", ["snapshot_before", "snapshot_after", "scan_failures"])
def scan_report(d):
    return snapshots.scan_report(classified(d), d.scan_failures)


@query("surviving_analyses", "A7", f"""
WITH {DIFF} SELECT p.photo_id FROM payloads p JOIN entities e USING (photo_id)
WHERE NOT EXISTS (SELECT 1 FROM diff x WHERE x.status = 'changed' AND x.project_id = e.project_id AND x.path = e.path)
  AND NOT EXISTS (SELECT 1 FROM scan_failures f WHERE f.project_id = e.project_id AND f.path = e.path)""",
  ["entities", "payloads", "snapshot_before", "snapshot_after", "scan_failures"])
def surviving_analyses(d):
    """Changed sources and sources that could not be read drop their analysis."""
    children = d.payloads.select("photo_id").join(d.entities.select("photo_id", *KEY), "photo_id")
    changed = classified(d).filter("status = 'changed'").select(*KEY)
    return snapshots.invalidate(children, changed.unionByName(d.scan_failures.select(*KEY)), key=KEY).select("photo_id")


@query("variant_keys", "A8 H27", """
SELECT photo_id, substr(path, 1, length(path) - length(regexp_extract(path, '\\.[^./]*$', 0))) AS variant FROM entities""", ["entities"])
def variant_keys(d):
    return d.entities.select("photo_id", variant_key("path").alias("variant"))


@query("payload_projection", "A10 B4 P", """
SELECT doc_id AS photo_id, CASE WHEN n_chars % 11 = 6 THEN NULL WHEN n_chars % 11 = 0 THEN 'features-v6' ELSE 'features-v7' END AS version,
  n_chars % 11 NOT IN (3, 6, 8) AS settings_valid, n_chars % 11 = 1 AS source_invalid,
  CASE WHEN n_chars % 11 IN (5, 6) THEN -1.0 ELSE CAST(n_chars % 101 AS DOUBLE) END AS score,
  CASE WHEN n_chars % 11 IN (6, 7) THEN NULL WHEN n_chars % 3 = 0 THEN 'recommend' WHEN n_chars % 3 = 1 THEN 'review' ELSE 'reject_suggest' END AS verdict
FROM documents""")
def payload_projection(d):
    return narrow_analyses(d).select(
        "photo_id",
        "version",
        F.col("settings_key").isNotNull().alias("settings_valid"),
        "source_invalid",
        "score",
        "verdict",
    )


@query("analysis_upsert", "A11", """
SELECT group_id, max(photo_id) AS photo_id, round(arg_max(sharpness_lap, photo_id), 6) AS sharpness_lap, arg_max(decision, photo_id) AS decision
FROM shots GROUP BY group_id""", ["shots"])
def analysis_upsert(d):
    rows = d.shots.select("group_id", "photo_id", "sharpness_lap", "decision")
    held = rows.filter("decision = 'pending'")
    fresh = rows.filter("decision <> 'pending'")
    return snapshots.upsert(held, fresh, key="group_id", seq="photo_id").withColumn(
        "sharpness_lap", F.round("sharpness_lap", 6)
    )


@query("saved_analyses", "A11 J9", """
SELECT photo_id, max(k) AS seq, round(arg_max(sharpness_lap, k), 6) AS sharpness_lap, arg_max(decision, k) AS decision
FROM (SELECT photo_id, k, sharpness_lap, 'first' AS decision FROM shots WHERE photo_id % 3 <> 0
      UNION ALL SELECT photo_id, k + 1, sharpness_lap + 1, 'second' FROM shots WHERE photo_id % 2 = 0) AS saved GROUP BY photo_id""", ["shots"])
def saved_analyses(d):
    """Four saves: one goes through, one has an id that no entity has, one has a task that fails, one goes through."""
    table = stored.VersionedTable(d.spark, f"{shared_folder(d.spark)}/winnow-saved-{uuid.uuid4().hex}")
    shots = d.shots.select("photo_id", F.col("k").alias("seq"), "sharpness_lap")
    first = shots.where("photo_id % 3 <> 0").withColumn("decision", F.lit("first"))
    second = shots.where("photo_id % 2 = 0").select("photo_id", (F.col("seq") + 1).alias("seq"), (F.col("sharpness_lap") + 1).alias("sharpness_lap"), F.lit("second").alias("decision"))
    kept = stored.save_analyses(table, first, shots)
    unknown = second.withColumn("photo_id", F.when(F.col("photo_id") % 1000 == 0, -1).otherwise(F.col("photo_id")))
    failing = second.withColumn("decision", F.when(F.col("photo_id") % 1000 == 0, F.raise_error(F.lit("broken row"))).otherwise(F.col("decision")))
    for batch, error in ((unknown, ContractViolation), (failing, Exception)):
        try:
            stored.save_analyses(table, batch, shots)
        except error:
            if table.commits.latest() != kept:
                raise
        else:
            raise AssertionError("a batch that had to be refused was saved")
    stored.save_analyses(table, second, shots)
    return table.read().withColumn("sharpness_lap", F.round("sharpness_lap", 6)).select("photo_id", "seq", "sharpness_lap", "decision")


@query("face_rows", "A11", """
SELECT photo_id, i AS item_index, round(confidence, 6) AS confidence, round(bx, 3) AS x, smile IS NULL AS no_smile FROM faces""", ["faces"])
def face_rows(d):
    return snapshots.explode_items(d.measured).select(
        "photo_id",
        F.col("item_index").cast("long").alias("item_index"),
        F.round("confidence", 6).alias("confidence"),
        F.round("bbox.x", 3).alias("x"),
        F.col("smile_score").isNull().alias("no_smile"),
    )


@query("decision_export", "A12", f"WITH {STATE} SELECT path, decision AS action FROM state", STATE_VIEWS)
def decision_export(d):
    return decisions.decision_rows(entity_state(d))


def decision_file(d):
    """A decision file with the faults an import must refuse."""
    rows = d.entities.join(latest.decision_state(d.decision_log), "photo_id")
    base = rows.select(
        F.when(F.col("size_bytes") % 19 == 0, F.concat(F.lit("../"), "path"))
        .when(F.col("size_bytes") % 23 == 0, F.concat("path", F.lit("x")))
        .otherwise(F.col("path"))
        .alias("path"),
        F.when(F.col("size_bytes") % 31 == 0, F.lit("maybe")).otherwise(F.col("decision")).alias("action"),
        F.col("size_bytes").alias("n"),
    )
    return base.unionByName(base.filter("n % 29 = 0")).select("path", "action")


@query("decision_import_check", "A13", f"""
WITH {STATE}, base AS (SELECT CASE WHEN size_bytes % 19 = 0 THEN '../' || path WHEN size_bytes % 23 = 0 THEN path || 'x' ELSE path END AS path,
   CASE WHEN size_bytes % 31 = 0 THEN 'maybe' ELSE decision END AS action, size_bytes AS n FROM entities JOIN dec USING (photo_id)),
f AS (SELECT path, action FROM base UNION ALL SELECT path, action FROM base WHERE n % 29 = 0),
bad AS (SELECT path, CASE WHEN starts_with(path, '../') THEN 'unsafe_path' WHEN path NOT IN (SELECT path FROM entities) THEN 'unknown_path'
   WHEN action = 'maybe' THEN 'unknown_action' END AS reason FROM f
   UNION ALL SELECT path, 'duplicate_path' FROM f GROUP BY path HAVING count(*) > 1)
SELECT path, reason FROM bad WHERE reason IS NOT NULL""", STATE_VIEWS)
def decision_import_check(d):
    return decisions.check_decisions(decision_file(d), d.entities)[1]


@query("decision_csv", "A12 A13", f"""
WITH {STATE} SELECT path, decision AS action, 'accepted' AS outcome FROM state WHERE path IN (SELECT path FROM entities GROUP BY path HAVING count(*) = 1)
UNION ALL SELECT path, NULL, 'duplicate_path' FROM entities GROUP BY path HAVING count(*) > 1""", STATE_VIEWS)
def decision_csv(d):
    """Export to a CSV file, and its import: what comes back are the requests, and paths that two rows share are refused."""
    place = f"{shared_folder(d.spark)}/winnow-decisions-{uuid.uuid4().hex}"
    state = entity_state(d)
    decisions.write_decisions(state, place)
    requests, bad = decisions.check_decisions(decisions.read_decision_file(d.spark, place), d.entities)
    named = requests.join(d.entities.select("project_id", "photo_id", "path"), ["project_id", "photo_id"])
    good = named.join(bad.select("path"), "path", "left_anti").select("path", "action", F.lit("accepted").alias("outcome"))
    return good.unionByName(bad.select("path", F.lit(None).cast("string").alias("action"), F.col("reason").alias("outcome")))


@query("export_scope", "A14", f"""
WITH {STATE} SELECT project_id, photo_id, path FROM state WHERE decision = 'keep' AND NOT missing AND NOT quarantined""", STATE_VIEWS)
def export_scope(d):
    return decisions.scoped(entity_state(d), "keep").select("project_id", "photo_id", "path")


@query("sidecar_plan", "A15", f"""
WITH {STATE}, k AS (SELECT *, regexp_replace(path, '\\.[^./]*$', '') || '.xmp' AS destination FROM state),
g AS (SELECT project_id, destination, count(*) AS n, count(*) FILTER (format = 'raw') AS raws, count(*) FILTER (format = 'jpeg') AS jpegs,
  count(DISTINCT (decision, rating, color_label, capture_variant_id)) AS kinds, min(path) AS path, arg_min(format, path) AS first_format FROM k GROUP BY 1, 2)
SELECT project_id, destination, path, n = 1 OR (kinds = 1 AND ((first_format = 'raw' AND raws = 1 AND jpegs = n - 1) OR (first_format = 'jpeg' AND jpegs = 1 AND raws = n - 1))) AS accepted
FROM g""", STATE_VIEWS)
def sidecar_plan(d):
    plan, bad = sidecars.sidecar_plan(entity_state(d))
    stems = entity_state(d).withColumn("destination", F.concat(variant_key("path"), F.lit(".xmp")))
    first = stems.groupBy("project_id", "destination").agg(F.min("path").alias("path"))
    refused = bad.join(first, ["project_id", "destination"]).select("project_id", "destination", "path", F.lit(False).alias("accepted"))
    return plan.select("project_id", "destination", "path", F.lit(True).alias("accepted")).unionByName(refused)


@query("sidecar_text", "A16 H25", f"""
WITH {STATE} SELECT project_id, path AS destination,
 '<?xpacket begin=''' || chr(65279) || ''' id=''W5M0MpCehiHzreSzNTczkc9d''?>' || chr(10) || '<x:xmpmeta xmlns:x=''adobe:ns:meta/''><rdf:RDF xmlns:rdf=''{sidecars.RDF}''>'
 || '<rdf:Description xmlns:rdf=''{sidecars.RDF}'' rdf:about='''' xmlns:xmp=''{sidecars.XMP}'' xmlns:cur=''{sidecars.DECISION_NS}'' xmp:Rating=''' || rating
 || ''' xmp:Label=''' || CASE WHEN color_label = 'none' THEN '' ELSE upper(color_label[1]) || color_label[2:] END || ''' cur:Decision=''' || decision || '''/>'
 || '</rdf:RDF></x:xmpmeta>' || chr(10) || '<?xpacket end=''w''?>' || chr(10) AS body
FROM state""", STATE_VIEWS)
def sidecar_text(d):
    return sidecars.render_sidecars(entity_state(d).withColumn("destination", F.col("path")))


@query("subset_copy", "A18", f"""
WITH {STATE} SELECT count(*) FILTER (b.path IS NULL) AS written, count(*) FILTER (b.path IS NOT NULL) AS skipped
FROM state s LEFT JOIN snapshot_before b ON s.project_id = b.project_id AND s.path = b.path WHERE decision = 'keep' AND NOT s.missing AND NOT s.quarantined""",
  [*STATE_VIEWS, "snapshot_before"])
def subset_copy(d):
    return decisions.subset_copy(decisions.scoped(entity_state(d), "keep"), d.snapshot_before)[1]


@query("content_manifest", "A19", "SELECT doc_id AS path, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM documents")
def content_manifest(d):
    return manifests.manifest(d.documents.withColumnRenamed("doc_id", "path"), content="text")


@query("manifest_check", "A20 A23", """
SELECT doc_id AS path, CASE WHEN n_chars % 17 = 0 THEN 'missing' WHEN n_chars % 13 = 0 THEN 'decision_changed' WHEN n_chars % 11 = 0 THEN 'size_changed'
  WHEN n_chars % 7 = 0 AND reverse(text) <> text THEN 'content_changed' WHEN n_chars % 5 = 0 THEN 'target_exists' ELSE 'ok' END AS status FROM documents""")
def manifest_check(d):
    docs = d.documents.withColumnRenamed("doc_id", "path").withColumn("decision", F.lit("reject"))
    stored = manifests.manifest(docs, content="text", extra=["decision"])
    now = docs.filter("n_chars % 17 <> 0").withColumn(
        "decision", F.when(F.col("n_chars") % 13 == 0, "keep").otherwise(F.col("decision"))
    ).withColumn(
        "text",
        F.when(F.col("n_chars") % 11 == 0, F.concat("text", F.lit("!")))
        .when(F.col("n_chars") % 7 == 0, F.reverse("text"))
        .otherwise(F.col("text")),
    )
    current = manifests.manifest(now, content="text", extra=["decision"])
    targets = docs.filter("n_chars % 5 = 0").select("path")
    return manifests.check_manifest(stored, current, decision="decision", targets=targets)


@query("storage_usage", "A21", """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def storage_usage(d):
    files = d.pages.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("size_bytes")
    )
    return manifests.storage_usage(files, by=["host"])


@query("annotation_template", "A22 H24", """
SELECT s.photo_id, false AS annotation_complete, count(i) AS suggestions, round(coalesce(sum(bx / 4000 + bys / 3000 + bw / 4000 + bh / 3000), 0), 6) AS box_total
FROM shots s LEFT JOIN faces f ON f.photo_id = s.photo_id GROUP BY 1""", ["shots", "faces"])
def annotation_template(d):
    rows = d.measured.withColumns({"path": F.col("photo_id").cast("string"), "mtime": F.lit(0), "size_bytes": F.lit(0)})
    t = annotations.annotation_template(rows, suggestions=True)
    total = F.aggregate("suggested_boxes", F.lit(0.0), lambda s, b: s + b.x + b.y + b.w + b.h)
    return t.select(
        "photo_id", "annotation_complete", F.size("suggested_boxes").cast("long").alias("suggestions"), F.round(total, 6).alias("box_total")
    )


@query("first_per_format", "A24", """
SELECT format, photo_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY photo_id) AS n FROM entities WHERE size_bytes <= 40000 AND NOT missing) WHERE n = 1""", ["entities"])
def first_per_format(d):
    ok = d.entities.filter((F.col("size_bytes") <= 40_000) & ~F.col("missing"))
    return sampling.per_key_top(ok, key=["format"], order=[F.col("photo_id")], n=1).select("format", "photo_id", "size_bytes")


@query("two_cameras_per_format", "A25", """
SELECT format, camera, photo_id FROM (
 SELECT *, row_number() OVER (PARTITION BY format ORDER BY photo_id) AS m FROM (
  SELECT format, split_part(path, '/', 2) AS camera, photo_id, row_number() OVER (PARTITION BY format, split_part(path, '/', 2) ORDER BY photo_id) AS n FROM entities)
 WHERE n = 1) WHERE m <= 2""", ["entities"])
def two_cameras_per_format(d):
    rows = d.entities.select("format", F.split_part("path", F.lit("/"), F.lit(2)).alias("camera"), "photo_id")
    return sampling.per_key_top(rows, key=["format"], order=[F.col("photo_id")], n=2, distinct="camera")


@query("systematic_groups", "A26", """
WITH names AS (SELECT capture_variant_id AS g, row_number() OVER (ORDER BY capture_variant_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT capture_variant_id FROM entities)),
picks AS (SELECT DISTINCT j * n // 60 AS i FROM (SELECT unnest(range(60)) AS j), (SELECT max(n) AS n FROM names))
SELECT capture_variant_id, photo_id FROM entities WHERE capture_variant_id IN (SELECT g FROM names JOIN picks USING (i))""", ["entities"])
def systematic_groups(d):
    return sampling.systematic_groups(d.entities, group="capture_variant_id", n=60).select("capture_variant_id", "photo_id")


@query("seeded_sample", "A27", "SELECT photo_id, path FROM entities ORDER BY md5('42:' || path), path LIMIT 100", ["entities"])
def seeded_sample(d):
    return sampling.hash_sample(d.entities, key=["path"], seed=42, n=100).select("photo_id", "path")


@query("portrait_eligibility", "A28", """
SELECT page_id FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'CC0' WHEN 2 THEN 'Public domain' WHEN 3 THEN 'CC BY-NC 2.0' WHEN 4 THEN 'CC BY-ND 3.0' ELSE 'GFDL' END AS license,
  strlen(html) * 1000 AS size, strlen(html) % 5000 AS width, strlen(url) * 40 AS height FROM pages)
WHERE license IN ('CC BY-SA 4.0', 'CC0', 'Public domain') AND size <= 6 * 1024 * 1024 AND width * height <= 20000000 AND greatest(width, height) >= 640""")
def portrait_eligibility(d):
    n = F.col("page_id") % 6
    names = ["CC BY-SA 4.0", "CC0", "Public domain", "CC BY-NC 2.0", "CC BY-ND 3.0", "GFDL"]
    lic = F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    rows = d.pages.select(
        "page_id",
        F.concat("page_id", F.lit(".JPG")).alias("title"),
        lic.alias("license"),
        (F.octet_length("html") * 1000).alias("size"),
        (F.octet_length("html") % 5000).alias("width"),
        (F.octet_length("url") * 40).alias("height"),
    )
    return sampling.eligible_portraits(rows).select("page_id")


PAGE_COLUMNS = ["photo_id", "path", "decision", "rating", "color_label", "score", "verdict", "status"]
PAGE = "photo_id, path, decision, rating, color_label, score, verdict, status"


@query("catalog_page_score", "B1 B3 F1 F2 C1 C2", f"""
WITH {STATE} SELECT {PAGE} FROM state WHERE NOT missing AND NOT quarantined ORDER BY score DESC, photo_id LIMIT 100 OFFSET 200""", STATE_VIEWS)
def catalog_page_score(d):
    f = catalog.PageFilter(sort="score", offset=200, limit=100)
    return catalog.catalog_page(candidate_view(d), f).select(*PAGE_COLUMNS)


@query("catalog_page_filtered", "B1 F1 F2", f"""
WITH {STATE} SELECT {PAGE} FROM state WHERE NOT missing AND NOT quarantined AND decision = 'keep' AND verdict = 'recommend'
ORDER BY coalesce(taken_at, '') DESC, mtime DESC, photo_id DESC LIMIT 20""", STATE_VIEWS)
def catalog_page_filtered(d):
    f = catalog.PageFilter(decision="keep", verdict="recommend", sort="date", descending=True, limit=20)
    return catalog.catalog_page(candidate_view(d), f).select(*PAGE_COLUMNS)


@query("catalog_order_all", "F1", f"WITH {STATE} SELECT {PAGE} FROM state WHERE rating = 3", STATE_VIEWS)
def catalog_order_all(d):
    f = catalog.PageFilter(rating=3, include_missing=True, sort="size", descending=True)
    return catalog.catalog_page(candidate_view(d), f).select(*PAGE_COLUMNS)


@query("catalog_deep_page", "F2", f"""
WITH {STATE} SELECT {PAGE} FROM state ORDER BY path, photo_id LIMIT 200000 OFFSET 150""", STATE_VIEWS)
def catalog_deep_page(d):
    f = catalog.PageFilter(include_missing=True, sort="name", offset=150, limit=200_000)
    return catalog.catalog_page(candidate_view(d), f).select(*PAGE_COLUMNS)


@query("catalog_page_payload", "F3", f"""
WITH {STATE}, page AS (SELECT {PAGE} FROM state WHERE NOT missing AND NOT quarantined ORDER BY score DESC, photo_id LIMIT 50)
SELECT photo_id, score, text FROM page JOIN documents ON doc_id = photo_id""", STATE_VIEWS)
def catalog_page_payload(d):
    f = catalog.PageFilter(sort="score", limit=50)
    page = catalog.catalog_page(candidate_view(d), f).select("photo_id", "score", "path")
    wide = d.documents.select(F.col("doc_id").alias("photo_id"), "text")
    return catalog.attach_payload(page, wide, f).select("photo_id", "score", "text")


@query("catalog_page_members", "B5 C8 G3", f"""
WITH {STATE} SELECT {PAGE} FROM state WHERE NOT missing AND NOT quarantined AND photo_id IN (SELECT doc_id FROM labels WHERE quality = 1)
ORDER BY path, photo_id LIMIT 80""", STATE_VIEWS)
def catalog_page_members(d):
    members = d.labels.filter("quality = 1").select(F.col("doc_id").alias("photo_id")).distinct()
    f = catalog.PageFilter(limit=80)
    return catalog.catalog_page(candidate_view(d), f, scene_members=members).select(*PAGE_COLUMNS)


@query("catalog_refreshed", "B1 B2 B3 C1", f"WITH {STATE} SELECT {PAGE}, missing, quarantined, size_bytes FROM state", STATE_VIEWS)
def catalog_refreshed(d):
    """A stored catalog of older tables, brought to the present ones by changed keys: new, changed and lost rows of each part."""
    store, size = new_store(d, "refreshed"), F.col("size_bytes")
    older = d.entities.where(size % 11 != 0).withColumn("size_bytes", F.when(size % 10 == 0, size + 1).otherwise(size))
    lost = d.entities.where(size % 13 == 1).withColumn("photo_id", -1 - F.col("photo_id"))
    held = d.payloads.where("photo_id % 9 <> 0").withColumn("data", F.when(F.col("photo_id") % 7 == 0, "{}").otherwise(F.col("data")))
    store.save({
        "entities": older.unionByName(lost),
        "analyses": stored.hashed_analyses(held, payloads.project_payload),
        "states": states(d.decision_log.where("seq % 4 <> 0"), d.mark_log.where("seq % 3 <> 0")),
    })
    store.refresh_analyses(d.payloads, payloads.project_payload)
    store.refresh({"entities": d.entities, "states": states(d.decision_log, d.mark_log)})
    return store.rows(version=VERSION, settings_key=settings_digest(d.spark)).select(*PAGE_COLUMNS, "missing", "quarantined", "size_bytes")


@query("freshness_counts", "B2 B8", f"WITH {STATE} SELECT status, verdict, count(*) AS n FROM state GROUP BY 1, 2", STATE_VIEWS)
def freshness_counts(d):
    return candidate_view(d).groupBy("status", "verdict").agg(F.count("*").alias("n"))


@query("readable_payloads", "B8", "SELECT doc_id AS photo_id FROM documents WHERE n_chars % 11 <> 6")
def readable_payloads(d):
    return payloads.readable(d.payloads).select("photo_id")


@query("scope_violations", "B6", """
SELECT DISTINCT source AS project_id, doc_id AS photo_id FROM labels l JOIN documents d USING (doc_id)
WHERE doc_id NOT IN (SELECT photo_id FROM entities WHERE NOT missing AND NOT quarantined)""", ["entities"])
def scope_violations(d):
    asked = d.labels.join(d.documents, "doc_id").select(F.col("source").alias("project_id"), F.col("doc_id").alias("photo_id"))
    return catalog.unavailable(asked, d.entities)


@query("path_safety", "B9", """
SELECT path, NOT (starts_with(path, '/') OR contains('/' || path || '/', '/../')) AS safe FROM (
  SELECT CASE WHEN size_bytes % 7 = 0 THEN '/' || path WHEN size_bytes % 7 = 1 THEN replace(path, '/', '/../') WHEN size_bytes % 7 = 2 THEN replace(path, '/', '..') ELSE path END AS path FROM entities)""", ["entities"])
def path_safety(d):
    n = F.col("size_bytes") % 7
    path = (
        F.when(n == 0, F.concat(F.lit("/"), "path"))
        .when(n == 1, F.replace("path", F.lit("/"), F.lit("/../")))
        .when(n == 2, F.replace("path", F.lit("/"), F.lit("..")))
        .otherwise(F.col("path"))
    )
    return d.entities.select(path.alias("path")).withColumn("safe", safe_relative("path"))


@query("project_readiness", "D1", """
SELECT project_id, count(*) AS active, count(*) FILTER (n_chars % 11 IN (0, 6)) AS pending_analysis
FROM entities JOIN documents ON doc_id = photo_id WHERE NOT missing AND NOT quarantined GROUP BY 1""", ["entities"])
def project_readiness(d):
    return catalog.readiness(d.entities, narrow_analyses(d), engine_version=VERSION)


@query("decision_counts", "D9", f"WITH {STATE} SELECT project_id, decision, count(*) AS n FROM state GROUP BY 1, 2", STATE_VIEWS)
def decision_counts(d):
    return entity_state(d).groupBy("project_id", "decision").agg(F.count("*").alias("n"))


@query("latest_state", "E1 C2", f"WITH {STATE} SELECT photo_id, decision, rating, color_label FROM state", STATE_VIEWS)
def latest_state(d):
    return entity_state(d).select("photo_id", "decision", "rating", "color_label")


@query("open_sessions", "E2", "SELECT project_id, arg_max(session_id, seq) AS session_id FROM sessions WHERE undone_at IS NULL GROUP BY 1", ["sessions"])
def open_sessions(d):
    return latest.open_session(d.sessions)


@query("recent_sessions", "E8", "SELECT project_id, session_id, seq FROM sessions ORDER BY seq DESC, session_id DESC LIMIT 50", ["sessions"])
def recent_sessions(d):
    return latest.recent_first(d.sessions, order="seq", tie="session_id", n=50).select("project_id", "session_id", "seq")


LOCKS = "locks AS (SELECT photo_id FROM state WHERE size_bytes % 6 = 0 AND decision IN ('pending', 'keep'))"


def locks(d):
    return entity_state(d).filter("size_bytes % 6 = 0 AND decision IN ('pending', 'keep')").select("photo_id")


def decision_requests(d):
    n = F.col("size_bytes") % 4
    action = F.when(n == 0, "keep").when(n == 1, "reject").when(n == 2, "flag").otherwise("pending")
    return d.entities.select("project_id", "photo_id", action.alias("action"))


REQUESTS = """req AS (SELECT project_id, photo_id, CASE size_bytes % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 2 THEN 'flag' ELSE 'pending' END AS action FROM entities)"""


@query("apply_decisions", "K1", f"""
WITH {STATE}, {LOCKS}, {REQUESTS} SELECT r.project_id, r.photo_id, r.action, s.decision AS previous_action, 'human' AS source
FROM req r JOIN state s USING (photo_id) WHERE r.action <> s.decision AND NOT (r.action <> 'keep' AND photo_id IN (SELECT photo_id FROM locks))""", STATE_VIEWS)
def apply_decisions(d):
    return log.apply_decisions(decision_requests(d), entity_state(d).select("project_id", "photo_id", "decision"), locks(d), source="human")[0]


@query("locked_refusals", "K3", f"""
WITH {STATE}, {LOCKS}, {REQUESTS} SELECT r.project_id, r.photo_id, r.action, 'locked' AS reason
FROM req r JOIN state s USING (photo_id) WHERE r.action <> s.decision AND r.action <> 'keep' AND photo_id IN (SELECT photo_id FROM locks)""", STATE_VIEWS)
def locked_refusals(d):
    return log.apply_decisions(decision_requests(d), entity_state(d).select("project_id", "photo_id", "decision"), locks(d), source="batch_adopt")[1]


def variant_requests(d):
    return decision_requests(d).join(d.labels.select(F.col("doc_id").alias("photo_id")), "photo_id", "left_semi")


VARIANTS = f"""{REQUESTS}, named AS (SELECT * FROM req WHERE photo_id IN (SELECT doc_id FROM labels)),
  reached AS (SELECT DISTINCT e.project_id, e.photo_id, n.action FROM named n JOIN entities a ON a.photo_id = n.photo_id
     JOIN entities e ON e.project_id = a.project_id AND e.capture_variant_id = a.capture_variant_id AND e.photo_id <> a.photo_id),
  judged AS (SELECT r.*, (s.decision <> 'pending' AND s.decision <> r.action) OR (r.photo_id NOT IN (SELECT photo_id FROM named) AND r.action <> 'keep'
     AND r.action <> s.decision AND r.photo_id IN (SELECT photo_id FROM locks)) AS conflict FROM reached r JOIN state s USING (photo_id))"""


@query("variant_changes", "K2 C15", f"""
WITH {STATE}, {LOCKS}, {VARIANTS} SELECT project_id, photo_id, action FROM named UNION SELECT project_id, photo_id, action FROM judged WHERE NOT conflict""", STATE_VIEWS)
def variant_changes(d):
    return log.expand_variants(variant_requests(d), d.entities, entity_state(d), locks(d))[0]


@query("variant_conflicts", "K2", f"""
WITH {STATE}, {LOCKS}, {VARIANTS} SELECT DISTINCT project_id, photo_id, action FROM judged WHERE conflict""", STATE_VIEWS)
def variant_conflicts(d):
    return log.expand_variants(variant_requests(d), d.entities, entity_state(d), locks(d))[1]


MARKS = """asked AS (SELECT project_id, photo_id, CASE WHEN size_bytes % 3 = 0 THEN 'keep' WHEN size_bytes % 3 = 1 THEN 'flag' END AS d,
   CASE WHEN size_bytes % 5 < 3 THEN CAST(size_bytes % 7 AS INT) END AS r, CASE WHEN size_bytes % 4 = 0 THEN 'blue' END AS c FROM entities),
 full_ AS (SELECT s.project_id, photo_id, coalesce(d, decision) AS nd, coalesce(r, rating) AS nr, coalesce(c, color_label) AS nc, decision, rating, color_label,
   photo_id IN (SELECT photo_id FROM locks) AND coalesce(d, decision) NOT IN (decision, 'keep') AS guarded FROM asked JOIN state s USING (photo_id))"""


def mark_requests(d):
    n = F.col("size_bytes")
    return d.entities.select(
        "project_id",
        "photo_id",
        F.when(n % 3 == 0, "keep").when(n % 3 == 1, "flag").alias("decision"),
        F.when(n % 5 < 3, (n % 7).cast("int")).alias("rating"),
        F.when(n % 4 == 0, "blue").alias("color_label"),
    )


@query("apply_marks", "K4", f"""
WITH {STATE}, {LOCKS}, {MARKS}
SELECT photo_id, 'decision' AS kind, nd AS value FROM full_ WHERE nd <> decision AND NOT guarded
UNION ALL SELECT photo_id, 'mark', nr || ':' || nc FROM full_ WHERE nr <> rating OR nc <> color_label
UNION ALL SELECT photo_id, 'violation', CASE WHEN guarded THEN 'locked' ELSE 'invalid_rating' END FROM full_ WHERE guarded OR nr NOT BETWEEN 0 AND 5""", STATE_VIEWS)
def apply_marks(d):
    decided, marked, bad = log.apply_marks(
        mark_requests(d), entity_state(d).select("project_id", "photo_id", "decision", "rating", "color_label"), locks(d)
    )
    return (
        decided.select("photo_id", F.lit("decision").alias("kind"), F.col("action").alias("value"))
        .unionByName(
            marked.select(
                "photo_id", F.lit("mark").alias("kind"), F.concat_ws(":", F.col("rating").cast("string"), "color_label").alias("value")
            )
        )
        .unionByName(bad.select("photo_id", F.lit("violation").alias("kind"), F.col("reason").alias("value")))
    )


@query("undo_report", "K5 D18 G1", """
WITH target AS (SELECT project_id, arg_max(session_id, seq) AS session_id FROM sessions WHERE undone_at IS NULL GROUP BY 1),
touched AS (SELECT session_id, photo_id FROM decision_log UNION SELECT session_id, photo_id FROM mark_log)
SELECT t.project_id, t.session_id, count(photo_id) AS changed FROM target t LEFT JOIN touched USING (session_id) GROUP BY 1, 2""", ["sessions", "decision_log", "mark_log"])
def undo_report(d):
    return log.undo_latest(d.sessions, d.decision_log, d.mark_log)[1]


ADOPT = """cand AS (SELECT project_id, photo_id, decision, raw_verdict AS verdict, status, size_bytes % 8 = 0 AS closed_eye, photo_id IN (SELECT photo_id FROM locks) AS locked,
   CASE WHEN size_bytes % 9 = 0 THEN false WHEN size_bytes % 9 = 1 THEN true END AS allowed FROM state WHERE NOT missing AND NOT quarantined AND decision = 'pending'),
 acted AS (SELECT *, CASE WHEN locked THEN 'keep' WHEN closed_eye THEN NULL WHEN verdict = 'recommend' AND allowed IS DISTINCT FROM false THEN 'keep' WHEN verdict = 'reject_suggest' THEN 'reject' END AS action FROM cand)"""


def adoption(d):
    # Adoption reads the stored verdict: acting on a stale one is a violation, not a skip.
    stored = narrow_analyses(d).select("photo_id", "verdict")
    rows = (
        catalog.available(candidate_view(d))
        .drop("verdict")
        .join(stored, "photo_id", "left")
        .withColumn("closed_eye", F.col("size_bytes") % 8 == 0)
    )
    rules = d.entities.select(
        "photo_id", F.when(F.col("size_bytes") % 9 == 0, False).when(F.col("size_bytes") % 9 == 1, True).alias("allowed")
    )
    return log.adopt(rows, locks(d), rules)


@query("bulk_adoption", "K6", f"WITH {STATE}, {LOCKS}, {ADOPT} SELECT project_id, photo_id, action FROM acted WHERE action IS NOT NULL", STATE_VIEWS)
def bulk_adoption(d):
    return adoption(d)[0]


@query("adoption_violations", "K6", f"""
WITH {STATE}, {LOCKS}, {ADOPT} SELECT project_id, photo_id, 'stale_analysis' AS reason FROM acted WHERE action IS NOT NULL AND NOT locked AND status <> 'current'""", STATE_VIEWS)
def adoption_violations(d):
    return adoption(d)[1]


@query("replay_guard", "K8", """
WITH r AS (SELECT user_id || ':' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS request_id, event_type AS arguments, event_id FROM events),
j AS (SELECT request_id, min(arguments) AS lo, max(arguments) AS hi FROM r WHERE event_id % 2 = 0 GROUP BY 1),
a AS (SELECT request_id, min(arguments) AS arguments, max(arguments) AS top FROM r WHERE event_id % 2 = 1 GROUP BY 1)
SELECT request_id, CASE WHEN arguments <> top OR lo <> arguments OR hi <> arguments THEN 'mismatch' ELSE 'fresh' END AS outcome
FROM a LEFT JOIN j USING (request_id) WHERE lo IS NULL OR arguments <> top OR lo <> arguments OR hi <> arguments""")
def replay_guard(d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = d.events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), k.cast("string")).alias("request_id"), F.col("event_type").alias("arguments"), "event_id"
    )
    fresh, clash = log.replay_guard(rows.filter("event_id % 2 = 1"), rows.filter("event_id % 2 = 0"))
    return fresh.select("request_id", F.lit("fresh").alias("outcome")).unionByName(clash.select("request_id", F.lit("mismatch").alias("outcome")))


@query("first_wins", "G6", "SELECT doc_id AS photo_id, min(e.event_id) AS pos FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents) GROUP BY 1")
def first_wins(d):
    asked = d.decision_log.select("photo_id", F.col("seq").alias("pos")).unionByName(d.mark_log.select("photo_id", F.col("seq").alias("pos")))
    return log.first_wins(asked)


@query("key_set_differences", "G4 C13", """
SELECT project_id, path, 'before_only' AS side FROM (SELECT project_id, path FROM snapshot_before EXCEPT SELECT project_id, path FROM snapshot_after)
UNION ALL SELECT project_id, path, 'after_only' FROM (SELECT project_id, path FROM snapshot_after EXCEPT SELECT project_id, path FROM snapshot_before)""", ["snapshot_before", "snapshot_after"])
def key_set_differences(d):
    return audits.key_differences(d.snapshot_before, d.snapshot_after, key=KEY)


@query("dirty_projects", "J10", """
SELECT DISTINCT coalesce(b.project_id, a.project_id) AS project_id FROM snapshot_before b FULL JOIN snapshot_after a ON b.project_id = a.project_id AND b.path = a.path
WHERE b.path IS NULL OR a.path IS NULL OR b.size_bytes <> a.size_bytes OR b.mtime <> a.mtime""", ["snapshot_before", "snapshot_after"])
def dirty_projects(d):
    columns = ["path", "mtime", "size_bytes"]
    before = snapshots.group_inputs_digest(d.snapshot_before, columns=columns)
    return snapshots.dirty_projects(before, snapshots.group_inputs_digest(d.snapshot_after, columns=columns))


@query("regrouped", "J8 J9 J10", """
SELECT project_id, concat('variant-', capture_variant_id) AS group_id, photo_id, project_id IN (SELECT project_id FROM entities WHERE photo_id % 20 < 3) AS rebuilt
FROM entities WHERE NOT missing AND NOT quarantined""", ["entities"])
def regrouped(d):
    """Groups of older inputs, then a refresh: only projects with a change are built again."""
    live = d.entities.filter(~F.col("missing") & ~F.col("quarantined")).select("project_id", "photo_id", "capture_variant_id")

    def build(rows):
        return rows.select("project_id", F.concat(F.lit("variant-"), "capture_variant_id").alias("group_id"), "photo_id")

    store = regroup.StoredGroups(d.spark, f"{shared_folder(d.spark)}/winnow-groups-{uuid.uuid4().hex}", build(live).schema)
    changed = d.entities.where("photo_id % 20 < 3").select("project_id").distinct()
    older = live.join(changed, "project_id", "left_anti").unionByName(live.join(changed, "project_id").withColumn("capture_variant_id", F.lit("old")))
    columns = ["photo_id", "capture_variant_id"]
    store.refresh(older.where("project_id <> 'none'"), build, columns=columns)
    again = store.refresh(live, build, columns=columns)
    return store.read().join(again.withColumn("rebuilt", F.lit(True)), "project_id", "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(False)))


@query("user_sessions", "E3", """
WITH p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600 THEN 1 ELSE 0 END AS brk FROM p)
SELECT event_id, user_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM b""")
def user_sessions(d):
    rows = d.events.select("event_id", "user_id", F.unix_timestamp("ts").alias("t"))
    return ranking.gap_sessions(rows, entity="user_id", time="t", gap=21_600).select("event_id", "user_id", "session_no")


@query("settings_keys", "H20 I6", "SELECT doc_id AS photo_id, n_chars % 11 NOT IN (3, 6, 8) AS valid FROM documents")
def settings_keys(d):
    """Stored settings text against the active settings' canonical key."""
    from ..settings import scoring_settings_key

    assert Settings().canonical() == Settings.parse({}).canonical()
    text = F.get_json_object("data", "$.settings")
    key = F.when(F.try_parse_json("data").isNotNull(), scoring_settings_key(text))
    return d.payloads.select("photo_id", key.eqNullSafe(F.lit(settings_digest(d.spark))).alias("valid"))
