"""Score arithmetic, NaN rules, settings, catalog grid and refusals."""

import itertools

import pytest
from pyspark.sql import functions as F

from winnow.functions.hashing import hex_to_long
from winnow.functions.measures import lap_score
from winnow.functions.numeric import at_least, finite
from winnow.operators import catalog, evaluate, log, retrieval, scoring
from winnow.session import ContractViolation
from winnow.settings import Settings, scoring_settings_key
from winnow.sources import sidecars

FEATURES = (
    "photo_id long, sharpness_lap double, sharpness_fft double, niqe double, exposure struct<mean:double,shadow_clip:double,highlight_clip:double>, "
    f"faces {scoring.FACE_TYPE}, width int, height int, preview_source string, warnings array<string>"
)


def shot(lap=1000.0, fft=0.25, niqe=4.0, mean=128.0, shadow=0.0, high=0.0, faces=(), source="jpeg", id=1):
    return (id, lap, fft, niqe, (mean, shadow, high), list(faces), 100, 100, source, [])


def scores(spark, rows, **settings):
    df = spark.createDataFrame(rows, FEATURES)
    return scoring.rescore(df, Settings(**settings)).orderBy("photo_id").collect()


ONLY_SHARP = dict(eyes_weight=0.0, face_weight=0.0, exposure_weight=0.0, smile_weight=0.0, sharpness_weight=100.0)


def test_sharpness_literals(spark):
    got = scores(spark, [shot(), shot(fft=1.0, id=2), shot(niqe=None, id=3)], **ONLY_SHARP)
    assert [round(r["score"], 9) for r in got] == [85.0, 95.0, 87.5]
    off = scores(spark, [shot()], enable_niqe=False, **ONLY_SHARP)
    assert round(off[0]["score"], 9) == 87.5


def test_tone_changes_neither_score_nor_verdict(spark):
    got = scores(spark, [shot(mean=m, id=i) for i, m in enumerate((40.0, 128.0, 215.0))])
    assert len({r["score"] for r in got}) == 1 and {r["verdict"] for r in got} == {"recommend"}


def test_raw_preview_is_never_rejected_and_nan_is_reviewed(spark):
    bad = dict(lap=1.0, fft=0.0, niqe=12.0, mean=10.0, shadow=0.9, high=0.9)
    got = scores(spark, [shot(**bad), shot(**bad, source="raw_embedded", id=2), shot(lap=float("nan"), id=3)])
    assert [r["verdict"] for r in got] == ["reject_suggest", "review", "review"]
    assert "invalid_measurements" in {e["code"] for e in got[2]["evidence"]}


def test_missing_is_never_zero_and_nan_never_passes(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (9.0,)], "v double")
    got = df.select(lap_score("v").alias("s"), at_least("v", 8.0).alias("ok"), finite("v").alias("f")).collect()
    assert got[0]["s"] is None
    assert [r["ok"] for r in got] == [False, False, True, True]
    assert [r["f"] for r in got] == [False, False, False, True]


def test_hash_text_guard(spark):
    df = spark.createDataFrame([("bad!",), ("ff",), ("ffffffffffffffff",), ("",), ("0" * 20 + "a",)], "h string")
    assert [r[0] for r in df.select(hex_to_long("h")).collect()] == [None, 255, -1, None, 10]


def test_settings_key_matches_defaults(spark):
    texts = ["{}", '{"max_faces":10}', '{"max_faces":99}', '{"bogus":1}', '{"eyes_weight":"x"}', "nope", '{"niqe_weight":0.3}']
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scoring_settings_key(F.col("t"))).collect()]
    assert keys[0] == keys[1] is not None
    assert keys[2:6] == [None] * 4 and keys[6] not in (None, keys[0])
    with pytest.raises(ValueError):
        Settings.parse({"bogus": 1})


def grid(spark):
    names = ["é", "A", "a", "人像"]
    rows = []
    for i in range(36):
        rows.append((
            i, f"{names[i % 4]}-{36 - i:03d}.jpg", "raw" if i % 3 == 0 else "jpeg", i % 4, i % 3,
            None if i % 5 == 0 else f"2026-01-{i % 3 + 1} 12:00:00", i % 13 == 0, i % 17 == 0,
            "keep" if i % 3 == 0 else "pending", i % 6, "purple" if i % 2 == 0 else "none",
            -1.0 if i % 7 == 0 else float(i % 4 * 20), None if i % 7 == 0 else ("recommend" if i % 2 else "review"),
        ))
    schema = "photo_id long, path string, format string, mtime long, size_bytes long, taken_at string, missing boolean, quarantined boolean, decision string, rating int, color_label string, score double, verdict string"
    return rows, spark.createDataFrame(rows, schema).repartition(1).cache()


def test_catalog_grid(spark):
    rows, df = grid(spark)
    keys = {
        "name": lambda r: (r[1].encode(), r[0]), "score": lambda r: (-r[11], r[0]), "suggestion": lambda r: (-r[11], r[0]),
        "size": lambda r: (r[4], r[0]), "date": lambda r: (r[5] or "", r[3], r[0]),
    }
    filters = [{}, {"decision": "keep"}, {"rating": 2}, {"include_missing": True}]
    pages = [(0, None), (0, 5), (3, 7), (100, 5), (0, 0)]
    for (sort, down), flt, (offset, limit) in itertools.product(itertools.product(keys, (False, True)), filters, pages[:3]):
        f = catalog.PageFilter(sort=sort, descending=down, offset=offset, limit=limit, **flt)
        want = [r for r in rows if f.include_missing or not (r[6] or r[7])]
        want = [r for r in want if f.decision in (None, r[8]) and f.rating in (None, r[9])]
        want = sorted(want, key=keys[sort], reverse=down)[offset:]
        want = want if limit is None else want[:limit]
        got = [r["photo_id"] for r in catalog.catalog_page(df, f).collect()]
        assert got == [r[0] for r in want], (sort, down, flt, offset, limit)
    assert catalog.catalog_page(df, catalog.PageFilter(limit=0)).count() == 0
    with pytest.raises(ValueError):
        catalog.PageFilter.parse({"colour": "red"})


def test_people_cannot_move_locked_rows(spark):
    state = spark.createDataFrame([("p", 1, "keep"), ("p", 2, "pending")], "project_id string, photo_id long, decision string")
    locks = spark.createDataFrame([(1,)], "photo_id long")
    asked = spark.createDataFrame([("p", 1, "reject"), ("p", 2, "keep")], "project_id string, photo_id long, action string")
    rows, bad = log.apply_decisions(asked, state, locks, source="human")
    with pytest.raises(ContractViolation):
        log.commit(rows, bad, session_id="s", source="human")
    rows, bad = log.apply_decisions(asked, state, locks, source="batch_adopt")
    assert [r["photo_id"] for r in log.commit(rows, bad, session_id="s", source="batch_adopt").collect()] == [2]


def test_matching_prefers_cardinality_then_total():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2)
        w = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), 0.0)
        best = (0, 0.0)
        for cols in itertools.product(range(-1, m), repeat=n):
            used = [c for c in cols if c >= 0]
            if len(set(used)) == len(used) and all(w[i, c] > 0 for i, c in enumerate(cols) if c >= 0):
                best = max(best, (len(used), sum(w[i, c] for i, c in enumerate(cols) if c >= 0)))
        got = evaluate.best_assignment(w)
        assert len(got) == best[0] and abs(sum(w[i, j] for i, j in got) - best[1]) < 1e-9
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_search_refuses_bad_queries_and_splits_query_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(20)], "photo_id long, vector array<float>")
    for q in ([float("nan"), 1.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            retrieval.search(rows, q, k=3)
    asked = rows.withColumnRenamed("photo_id", "query_id")
    one = retrieval.top_k(rows, asked, k=4, dimensions=3)
    many = retrieval.top_k(rows, asked, k=4, dimensions=3, block_bytes=100)
    key = lambda df: sorted((r["query_id"], r["rank"], r["photo_id"]) for r in df.collect())
    assert key(one) == key(many) and len(key(one)) == 80


def test_many_queries_stay_where_they_are_and_equal_vectors_are_ranked_by_id(spark, monkeypatch):
    """Blocks of vectors pass the driver, queries do not; copies of a vector and a missing one among them."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 3)).astype(np.float32)
    v[::3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None)], "photo_id long, vector array<float>")
    sent, inner = [], retrieval._matrix
    monkeypatch.setattr(retrieval, "_matrix", lambda block, name: sent.append((name, len(block))) or inner(block, name))
    got = retrieval.top_k(rows, rows.withColumnRenamed("photo_id", "query_id"), k=40, dimensions=3, exclude_self=True, block_bytes=1000).collect()
    assert {name for name, _ in sent} == {"id"} and sum(n for _, n in sent) == 90 and len(sent) > 2
    ids = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        ids.setdefault(r["query_id"], []).append(r["photo_id"])
    assert set(ids) == set(range(90)) and ids[0][:29] == list(range(3, 90, 3))
    for q in range(90):
        sims = (v.astype(np.float64) * v[q].astype(np.float64)).sum(1)
        want = [i for i in np.lexsort((np.arange(90), -np.round(sims, 9))) if i != q][:40]
        assert sorted(np.round(sims[ids[q]], 6)) == sorted(np.round(sims[want], 6)) and len(set(ids[q])) == 40


def test_sidecar_merge_keeps_other_bytes():
    ns = f"xmlns:rdf='{sidecars.RDF}'"
    text = (
        f"<x:xmpmeta xmlns:x='adobe:ns:meta/'><!-- note --><rdf:RDF {ns} xmlns:xmp='{sidecars.XMP}' xmlns:dc='urn:dc'>"
        "<rdf:Description rdf:about='' xmp:Rating='2' dc:title='kept'><xmp:Label>Red</xmp:Label></rdf:Description></rdf:RDF></x:xmpmeta>"
    )
    out = sidecars.merge_text(text, path="/a/b.jpg", rating=5, label="Blue", decision="keep")
    assert "<!-- note -->" in out and "dc:title='kept'" in out
    assert "Rating='2'" not in out and ">Red<" not in out and "Rating='5'" in out
    again = sidecars.merge_text(out, path="/a/b.jpg", rating=1, label="", decision="reject")
    assert again.count("Decision=") == 1 and "Rating='5'" not in again
    with pytest.raises(ValueError):
        sidecars.merge_text("<a/>", path="/a/b.jpg", rating=1, label="", decision="keep")


def test_audit_scores_a_row_once(spark):
    """The audit's filter does not repeat the expression that scores a row; a changed total is found."""
    df = spark.createDataFrame([shot(), shot(lap=20.0, id=2)], FEATURES)
    rows = scoring.rescore(df, Settings()).withColumn("score", F.col("score") + F.when(F.col("photo_id") == 2, 0.001).otherwise(0.0))
    found = scoring.audit_scores(rows).select("photo_id")
    once = scoring.rescore(df, Settings()).select("photo_id", "components", "score", "weight_total")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("_left_eye")
    assert plan(found) == plan(once) > 0
    assert [r["photo_id"] for r in found.collect()] == [2]
