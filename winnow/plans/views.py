"""Stand-in views over the given tables.

The tables hold no images, so entities, logs, hashes and measurements are derived
from whole tables here. Each view is one SQL text that both engines accept; the
few functions that differ are written as markers and filled in per dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

MARKERS = {
    "EPOCH_S": ("unix_timestamp({0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "HASH60": (
        "CAST(conv(substr({0}, 1, 15), 16, 10) AS BIGINT)",
        "CAST(('0x' || substr({0}, 1, 15)) AS BIGINT)",
    ),
}

VERSION = "features-v7"

VIEWS = {
    # Documents as catalog entries. Pairs of documents of one source are capture variants.
    "entities": """
        SELECT source AS project_id, doc_id AS photo_id,
               concat(source, '/', lang, '/', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING),
                      CASE CAST(floor(doc_id / 20) AS BIGINT) % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.dng'
                           WHEN 2 THEN '.png' WHEN 3 THEN '.heic' ELSE '.webp' END) AS path,
               CASE CAST(floor(doc_id / 20) AS BIGINT) % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'raw'
                    WHEN 2 THEN 'png' WHEN 3 THEN 'heic' ELSE 'webp' END AS format,
               n_chars AS size_bytes, doc_id % 7 AS mtime,
               CASE WHEN n_chars % 5 <> 0 THEN
                    concat('2026-01-0', CAST(n_chars % 3 + 1 AS STRING), ' 12:00:00') END AS taken_at,
               n_chars % 13 = 0 AS missing, n_chars % 17 = 0 AS quarantined,
               concat(source, '/v', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING)) AS capture_variant_id
        FROM {documents}""",
    # The catalog before and after a scan: some rows are new, some gone, some resized.
    "snapshot_before": """
        SELECT project_id, photo_id, path, mtime, size_bytes, missing, quarantined
        FROM {entities} WHERE size_bytes % 11 <> 0""",
    "snapshot_after": """
        SELECT project_id, photo_id, path, mtime,
               size_bytes + CASE WHEN size_bytes % 10 = 0 THEN 1 ELSE 0 END AS size_bytes
        FROM {entities} WHERE size_bytes % 9 <> 0""",
    "scan_failures": """
        SELECT project_id, path FROM {entities} WHERE size_bytes % 223 = 0""",
    "decision_log": """
        SELECT e.event_id AS seq, d.source AS project_id, d.doc_id AS photo_id,
               concat(d.source, ':', CAST(CAST(e.ts AS DATE) AS STRING)) AS session_id,
               CASE e.event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject'
                    WHEN 'click' THEN 'flag' ELSE 'pending' END AS action,
               CASE WHEN CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 10 = 0 THEN e.ts END AS undone_at
        FROM {events} e JOIN {documents} d ON d.doc_id = e.event_id % N_DOCUMENTS
        WHERE e.event_type <> 'signup'""",
    "mark_log": """
        SELECT e.event_id AS seq, d.source AS project_id, d.doc_id AS photo_id,
               concat(d.source, ':', CAST(CAST(e.ts AS DATE) AS STRING)) AS session_id,
               CAST(CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 6 AS INT) AS rating,
               CASE CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'red'
                    WHEN 2 THEN 'yellow' WHEN 3 THEN 'green' WHEN 4 THEN 'blue' ELSE 'purple' END AS color_label,
               CASE WHEN e.value > 15 THEN e.ts END AS undone_at
        FROM {events} e JOIN {documents} d ON d.doc_id = e.event_id % N_DOCUMENTS
        WHERE e.event_type = 'signup'""",
    "sessions": """
        SELECT project_id, session_id, min(seq) AS seq,
               CASE WHEN min(seq) % 3 = 0 THEN 'undone' END AS undone_at
        FROM (SELECT project_id, session_id, seq FROM {decision_log}
              UNION ALL SELECT project_id, session_id, seq FROM {mark_log}) AS u
        GROUP BY project_id, session_id""",
    # Stored results with the defects a catalog must survive.
    "payloads": """
        SELECT doc_id AS photo_id,
               CASE WHEN n_chars % 11 = 6 THEN '{{"version": broken'
                    ELSE concat('{{"version":"', CASE WHEN n_chars % 11 = 0 THEN 'features-v6' ELSE 'features-v7' END,
                         '","settings":', CASE n_chars % 11 WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"max_faces":99}}'
                              WHEN 8 THEN '{{"bogus":1}}' ELSE '{{"eyes_weight":25.0,"max_faces":10}}' END,
                         CASE n_chars % 11 WHEN 1 THEN ',"source_invalid":true' WHEN 4 THEN ',"source_invalid":1'
                              ELSE '' END,
                         ',"composite_score":', CASE WHEN n_chars % 11 = 5 THEN '"12"' ELSE CAST(n_chars % 101 AS STRING) END,
                         ',"verdict":', CASE WHEN n_chars % 11 = 7 THEN '3' WHEN n_chars % 3 = 0 THEN '"recommend"'
                              WHEN n_chars % 3 = 1 THEN '"review"' ELSE '"reject_suggest"' END, '}}') END AS data
        FROM {documents}""",
    # Vectors with a space, a fingerprint and a capture time.
    "vectors": """
        SELECT v.vec_id AS photo_id, v.label AS project_id, v.embedding AS vector,
               EPOCH_S(e.ts) AS taken_s, 1.5e0 AS aspect, v.vec_id % 7 AS score
        FROM {embeddings} v LEFT JOIN {events} e ON e.event_id = v.vec_id""",
    # Orders as measured shots; every number is derived from the order's price in cents.
    "shots": """
        SELECT o_orderkey AS photo_id, o_custkey AS group_id, o_orderpriority AS project_id, k,
               CASE WHEN k % 7 = 0 THEN CAST(k % 9 AS DOUBLE) ELSE (k % 997) / 3e0 END AS sharpness_lap,
               (k % 1009) / 1009e0 AS sharpness_fft,
               CASE WHEN k % 5 <> 0 THEN k % 12 + 0.5e0 END AS niqe,
               CAST(k % 256 AS DOUBLE) AS exposure_mean,
               CASE WHEN k % 13 = 0 THEN 0.7e0 ELSE (k % 83) / 4e2 END AS shadow_clip,
               (k % 71) / 35e1 AS highlight_clip,
               k % 4 AS n_faces,
               CASE WHEN k % 6 = 0 THEN 'raw_embedded' ELSE 'jpeg' END AS preview_source,
               k % 29 = 0 AS omitted,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'keep' ELSE 'reject' END AS decision
        FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus,
                     CAST(floor(o_totalprice * 100) AS BIGINT) AS k FROM {orders}) AS o""",
    # Every row is kept: rows of an order are numbered, so that equal ones are told apart too.
    "boxes": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity,
                   l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_id, l_orderkey AS image,
               (l_partkey % 20) / 4e1 AS x, (l_suppkey % 20) / 4e1 AS y,
               0.1e0 + l_discount * 2 AS w, 0.1e0 + l_tax * 2 AS h,
               l_extendedprice AS confidence, l_returnflag = 'N' AS is_truth
        FROM {lineitem}""",
}

DEPENDS = {
    "snapshot_before": ["entities"],
    "snapshot_after": ["entities"],
    "scan_failures": ["entities"],
    "sessions": ["decision_log", "mark_log"],
}

# Written for each engine: bit and list arithmetic has no common spelling.
DUCK_ONLY = {
    "doc_features": """
        SELECT doc_id AS photo_id, source AS project_id,
               CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS phash,
               structure
        FROM (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN pow(2::DOUBLE, b)::HUGEINT ELSE 0 END) AS u,
                     list(CAST(ones / n AS FLOAT) ORDER BY b) AS structure
              FROM (SELECT doc_id, b, sum(CAST((h >> b) & 1 AS BIGINT)) AS ones, count(*) AS n
                    FROM (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h
                          FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents)) AS hashed,
                         (SELECT unnest(range(64))::INT AS b) AS bits
                    GROUP BY doc_id, b) AS counted
              GROUP BY doc_id) AS packed JOIN documents USING (doc_id)""",
    "signs": """
        SELECT *, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS phash
        FROM (SELECT vectors.*, list_sum(list_transform(range(64),
                  lambda i: CASE WHEN vector[i + 1] > 0 THEN pow(2::DOUBLE, i)::HUGEINT ELSE 0::HUGEINT END)) AS u FROM vectors) AS s""",
    "timeline": """
        SELECT e.user_id AS project_id, e.event_id AS photo_id, CAST(floor(epoch(e.ts)) AS BIGINT) AS taken_s,
               s.phash, s.vector AS structure
        FROM events e JOIN signs s ON s.photo_id = e.event_id % (SELECT count(*) FROM embeddings)""",
    "faces": """
        SELECT photo_id, group_id, k, i,
               CASE WHEN u % 17 <> 0 THEN CASE WHEN u % 19 < 12 THEN CASE WHEN v % 5 = 0 THEN 'uncertain' WHEN v % 23 = 0 THEN 'closed' ELSE 'open' END ELSE 'uncertain' END END AS left_state,
               CASE WHEN v % 13 <> 0 THEN CASE WHEN u % 7 = 0 THEN 'uncertain' ELSE 'open' END END AS right_state,
               CASE WHEN u % 3 <> 0 THEN (v % 50) / 5e1 END AS smile,
               CASE WHEN v % 11 <> 0 THEN u * 2.5e0 END AS q_lap, (u % 9) / 1e2 AS q_shadow, (v % 8) / 1e2 AS q_high,
               CAST(20 + u * 2 AS DOUBLE) AS q_w, CAST(20 + v * 2 AS DOUBLE) AS q_h,
               CAST(u * 30 AS DOUBLE) AS bx, CAST(v * 20 AS DOUBLE) AS bys, CAST(100 + u AS DOUBLE) AS bw, CAST(120 + v AS DOUBLE) AS bh,
               0.5e0 + (u % 10) / 5e1 AS confidence
        FROM (SELECT photo_id, group_id, k, i, (k * (7 + 2 * i) + 13 * i) % 101 AS u, (k * (11 + 3 * i) + 5) % 89 AS v
              FROM (SELECT photo_id, group_id, k, unnest(range(n_faces)) AS i FROM shots))""",
}
DUCK_DEPENDS = {"signs": ["vectors"], "timeline": ["signs"], "faces": ["shots"]}

# Face arithmetic on the Spark side: the same integers, nested instead of exploded.
FACES = """
    CASE WHEN n_faces = 0 THEN CAST(array() AS FACE_TYPE) ELSE CAST(transform(
      transform(sequence(0L, n_faces - 1), i -> named_struct('i', i, 'u', (k * (7 + 2 * i) + 13 * i) % 101, 'v', (k * (11 + 3 * i) + 5) % 89)),
      f -> named_struct(
        'index', CAST(f.i AS INT),
        'bbox', named_struct('x', CAST(f.u * 30 AS DOUBLE), 'y', CAST(f.v * 20 AS DOUBLE), 'w', CAST(100 + f.u AS DOUBLE), 'h', CAST(120 + f.v AS DOUBLE)),
        'confidence', 0.5e0 + (f.u % 10) / 5e1,
        'left_eye', CASE WHEN f.u % 17 <> 0 THEN named_struct(
            'state', CASE WHEN v_open(f.v) THEN 'open' WHEN f.v % 5 = 0 THEN 'uncertain' ELSE 'closed' END,
            'blink_score', CASE WHEN f.u % 19 < 12 THEN 0.2e0 END, 'ear', 0.3e0) END,
        'right_eye', CASE WHEN f.v % 13 <> 0 THEN named_struct(
            'state', CASE WHEN f.u % 7 = 0 THEN 'uncertain' ELSE 'open' END, 'blink_score', 0.2e0, 'ear', 0.3e0) END,
        'smile_score', CASE WHEN f.u % 3 <> 0 THEN (f.v % 50) / 5e1 END,
        'quality', CASE WHEN f.v % 11 <> 0 THEN named_struct(
            'sharpness_lap', f.u * 2.5e0, 'shadow_clip', (f.u % 9) / 1e2, 'highlight_clip', (f.v % 8) / 1e2,
            'crop_width', CAST(20 + f.u * 2 AS DOUBLE), 'crop_height', CAST(20 + f.v * 2 AS DOUBLE)) END)) AS FACE_TYPE) END
""".replace("v_open(f.v)", "f.v % 5 <> 0 AND f.v % 23 <> 0")


def _dialect(text: str, which: int) -> str:
    for name, forms in MARKERS.items():
        text = re.sub(rf"{name}\(([^()]+)\)", lambda m, f=forms[which]: f.format(m.group(1)), text)
    return text


def duck_with(names, body: str) -> str:
    """``body`` preceded by the CTEs of the named views and what they depend on."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in DEPENDS.get(name, []) + DUCK_DEPENDS.get(name, []):
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body
    plain = {n: n for n in [*TABLES, *VIEWS]}
    count = "(SELECT count(*) FROM documents)"
    parts = [
        f"{n} AS ({DUCK_ONLY[n] if n in DUCK_ONLY else _dialect(VIEWS[n], 1).format(**plain).replace('N_DOCUMENTS', count)})" for n in order
    ]
    if body.lstrip().upper().startswith("RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body.lstrip()[len("RECURSIVE ") :]
    head = "WITH "
    if re.match(r"^\s*WITH\s", body, flags=re.I):
        body = re.sub(r"^\s*WITH\s+", "", body, flags=re.I)
        return head + ", ".join(parts) + ", " + body
    return head + ", ".join(parts) + " " + body


class Data:
    """Tables and views of one folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # Naive times are read as UTC on both sides.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            text = _dialect(VIEWS[name], 0)
            if "N_DOCUMENTS" in text:
                text = text.replace("N_DOCUMENTS", str(self.documents.count()))
            used = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if "{" + n + "}" in text}
            return self.spark.sql(text, **used)
        return getattr(self, f"_{name}")()

    def _doc_features(self) -> DataFrame:
        """Token-hash bit shares per document and their majority hash.

        Two 31-bit counters share a long, so 32 sums cover 64 bits; a document's
        tokens never leave their task before the partial sums.
        """
        tokens = spread(self.documents.select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", F.explode(F.split("text", " ", -1)).alias("t"))
        h = F.conv(F.substring(F.md5("t"), 1, 16), 16, -10).cast("long")
        hashed = tokens.select("doc_id", "source", h.alias("h"))
        sums = [
            F.sum(
                F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))
                + F.shiftleft(F.shiftrightunsigned("h", b + 32).bitwiseAND(F.lit(1)).cast("long"), 31)
            ).alias(f"s{b}")
            for b in range(32)
        ]
        counted = hashed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), *sums)
        mask = F.lit((1 << 31) - 1)
        ones = [F.col(f"s{b}").bitwiseAND(mask) for b in range(32)] + [F.shiftrightunsigned(f"s{b}", 31) for b in range(32)]
        bits = [
            F.when(ones[b] * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            for b in range(64)
        ]
        packed = bits[0]
        for b in bits[1:]:
            packed = packed.bitwiseOR(b)
        return counted.select(
            F.col("doc_id").alias("photo_id"),
            F.col("source").alias("project_id"),
            packed.alias("phash"),
            F.array(*[(o / F.col("n")).cast("float") for o in ones]).alias("structure"),
        )

    def _signs(self) -> DataFrame:
        from ..functions.hashing import sign_bits

        return self.vectors.withColumn("phash", sign_bits("vector"))

    def _timeline(self) -> DataFrame:
        n = self.embeddings.count()
        looks = self.signs.select(F.col("photo_id").alias("slot"), "phash", F.col("vector").alias("structure"))
        rows = self.events.select(
            F.col("user_id").alias("project_id"),
            F.col("event_id").alias("photo_id"),
            F.unix_timestamp("ts").alias("taken_s"),
            (F.col("event_id") % n).alias("slot"),
        )
        return rows.join(looks, "slot").drop("slot")

    def _measured(self) -> DataFrame:
        """Shots with nested faces, ready for scoring; a pure projection of orders."""
        from ..operators.scoring import FACE_TYPE

        return spread(self.shots, "photo_id", rows=25_000).withColumns(
            {
                "faces": F.expr(FACES.replace("FACE_TYPE", FACE_TYPE)),
                "exposure": F.struct(
                    F.col("exposure_mean").alias("mean"), "shadow_clip", "highlight_clip"
                ),
                "width": F.lit(4000),
                "height": F.lit(3000),
                "warnings": F.when(F.col("omitted"), F.array(F.lit("omitted faces"))).otherwise(
                    F.array().cast("array<string>")
                ),
            }
        )
