"""Registered queries of the training-data operators over the given tables, with DuckDB texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    edit_counts,
    jaccard_join,
    license_scan,
    line_dedup,
    merkle_manifest,
    mixing,
    prefix_trie,
    pseudonyms,
    quality_rules,
    secret_scan,
    toxicity,
    wrapper_induction,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
i AS (SELECT r, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2]) AS n FROM i),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[!-@\[-`{-~]+', '', 'g')) AS n_marks
  FROM w LEFT JOIN c USING (r)),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 32 * (10 * n_capitals > 3 * word_chars)::INT + 64 * (10 * n_marks > 4 * word_chars)::INT)::INT AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, 2 AS policy, fail_bits = 0 AS kept FROM b
"""


@query("op1_quality_rules", RULES_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.ledger(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, folder, "documents")).select("doc_id", "text", *(f"n_{kind}" for kind in pseudonyms.FORMATS))


@query("op4_main_text")
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper_induction.extract(table(spark, folder, "pages"))


@query("op5_edit_counts")
def op5_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    no_tree = [F.lit(None).cast(kind).alias(name) for name, kind in (("starts", "array<long>"), ("counts", "array<long>"), ("levels", "array<array<long>>"))]
    return edit_counts.recount(docs.select("*", *no_tree))


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_gone_lines", "text")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS visible,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln(u) / (CASE WHEN seen > 0 THEN greatest(0.05, (seen - length(regexp_replace(visible, '[^!-@\[-`{-~]+', '', 'g'))) / seen::DOUBLE) ELSE 1.0 END) AS sort_key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, 1 + (row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 AS weight FROM s),
f AS (SELECT *, row_number() OVER o AS turn, coalesce(sum(cap) OVER p, 0) AS full_caps, coalesce(sum(weight) OVER p, 0) AS used,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM w WINDOW o AS (ORDER BY cap / weight::DOUBLE, source IS NULL, source::BLOB),
    p AS (ORDER BY cap / weight::DOUBLE, source IS NULL, source::BLOB ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_caps)::DOUBLE / (all_weights - used)::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT min_by(level, turn) FROM l WHERE level * weight <= cap), 0.0) * weight) AS target FROM l),
x AS (SELECT k.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY sort_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - prefix)))::BIGINT AS taken
FROM x
"""


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [ws] ELSE [ws[i : i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reached.d, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reached GROUP BY 1) c USING (doc_id)
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), width=3, num=90, den=100)


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


TRIE_SQL = rf"""
WITH {merkle_manifest.CRC_SQL.strip()},
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, {merkle_manifest.crc_of("c::VARCHAR")} % 9 AS h FROM ids, crc),
x AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
y AS (SELECT *, substr(sha256(strlen(role)::VARCHAR || ':' || role || text), 1, 32) AS g FROM x),
t AS (SELECT c, g, strlen(text) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, g) - 1 AS p FROM y),
u AS (
  SELECT hs.c, 0 AS own, p, g, b FROM hs JOIN t ON t.c = hs.c - hs.c % 5 AND p < h
  UNION ALL SELECT hs.c, 1 AS own, p, g, b FROM hs JOIN t ON t.c = hs.c AND p >= h),
q AS (SELECT c, b, row_number() OVER w AS d, string_agg(g, '') OVER w AS path FROM u WINDOW w AS (PARTITION BY c ORDER BY own, p)),
m AS (SELECT c, 0 AS d, '' AS path, 0 AS b FROM hs UNION ALL SELECT c, d, path, b FROM q),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM m),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY path, d),
k AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT substr(path, 1, 32 * a) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n up ON f.d > 0 AND up.path = substr(f.path, 1, 32 * (f.d - 1))
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op12_license_scan", license_scan.sql())
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query("op13_merkle_manifest", merkle_manifest.sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.audit(table(spark, folder, "documents"))
