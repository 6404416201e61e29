"""Stored catalog, commits and all-or-nothing saves."""

import pytest
from pyspark.sql import functions as F

from winnow.operators import catalog, stored
from winnow.plans import catalog_queries
from winnow.plans.views import Data
from winnow.session import ContractViolation
from winnow.sources.commits import Commits

FOLDER = "/root/testdata/sf0.001"


def parts(spark, n=50):
    ids = spark.range(n).withColumnRenamed("id", "photo_id")
    flags = {"missing": F.lit(False), "quarantined": F.lit(False)}
    entities = ids.withColumns({"path": F.concat(F.lit("p"), "photo_id"), "size_bytes": F.col("photo_id") * 3, **flags})
    analyses = ids.select("photo_id", F.lit("v").alias("version"), F.lit("s").alias("settings_key"), F.lit(False).alias("source_invalid"), F.col("photo_id").cast("double").alias("score"), F.lit("review").alias("verdict"))
    states = ids.where("photo_id % 2 = 0").select("photo_id", F.lit("keep").alias("decision"), F.lit(3).alias("rating"), F.lit("red").alias("color_label"))
    return {"entities": entities, "analyses": analyses.withColumn("payload_hash", F.lit(1).cast("long")), "states": states}


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_join_buckets_without_an_exchange(spark, tmp_path):
    store = stored.StoredCatalog(spark, f"file://{tmp_path}/catalog", buckets=4)
    store.save(parts(spark))
    page = catalog.PageFilter(sort="score", limit=5)
    for _ in range(2):
        df = catalog.catalog_page(store.rows(version="v", settings_key="s"), page)
        plan = plan_of(df)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "json" not in plan.lower()
        assert [r["photo_id"] for r in df.collect()] == [49, 48, 47, 46, 45]
        # A second generation: aggregated inside the buckets.
        store.save({"states": parts(spark)["states"].where("photo_id = 48")})


def test_refresh_writes_changed_keys_only(spark, tmp_path):
    store = stored.StoredCatalog(spark, f"file://{tmp_path}/catalog", buckets=4)
    now = parts(spark)
    store.save({**now, "entities": now["entities"].where("photo_id <> 7").unionByName(now["entities"].where("photo_id = 1").withColumn("photo_id", F.lit(99).cast("long")))})
    assert store.refresh({"analyses": now["analyses"], "states": now["states"]}) is None
    number = store.refresh({"entities": now["entities"].withColumn("size_bytes", F.when(F.col("photo_id") == 3, 0).otherwise(F.col("size_bytes")))})
    appended = spark.table(f"{store.name}_entities").where(F.col("generation") == number)
    assert sorted((r["photo_id"], r["gone"]) for r in appended.collect()) == [(3, False), (7, False), (99, True)]
    assert store.latest("entities").count() == 50
    again = store.compact()
    assert again.commits.committed() == [0] and again.latest("entities").count() == 50


def test_rows_of_a_failed_change_stay_invisible(spark, tmp_path):
    store = stored.StoredCatalog(spark, f"file://{tmp_path}/catalog", buckets=4)
    now = parts(spark)
    store.save(now)
    broken = now["analyses"].withColumn("score", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        store.save({"entities": now["entities"].where("photo_id = 1").withColumn("path", F.lit("new")), "analyses": broken})
    assert store.latest("entities").where("path = 'new'").count() == 0
    # Another session names the tables by their place.
    schemas = {p: now[p].schema for p in stored.PARTS}
    for part in stored.PARTS:
        spark.sql(f"DROP TABLE {store.name}_{part}")
    assert stored.StoredCatalog(spark, store.place, buckets=4).open(schemas).latest("states").count() == 25


def test_refused_and_failed_saves_leave_the_table(spark, tmp_path):
    table = stored.VersionedTable(spark, str(tmp_path / "analyses"))
    entities = spark.range(10).withColumnRenamed("id", "photo_id")
    rows = entities.selectExpr("photo_id", "1 as seq", "'a' as data")
    assert stored.save_analyses(table, rows, entities) == 0
    before = table.read()
    with pytest.raises(ContractViolation):
        stored.save_analyses(table, rows.unionByName(spark.range(99, 100).selectExpr("id as photo_id", "2 as seq", "'b' as data")), entities)
    with pytest.raises(Exception, match="late"):
        table.save(rows, lambda staged: (_ for _ in ()).throw(ValueError("late")))
    assert table.commits.latest() == 0 and not (tmp_path / "analyses" / "v1").exists()
    stored.save_analyses(table, rows.where("photo_id < 3").selectExpr("photo_id", "2 as seq", "'b' as data"), entities)
    assert before.where("data = 'b'").count() == 0
    assert table.read().where("data = 'b'").count() == 3


def test_two_writers_never_share_a_number(spark, tmp_path):
    one, two = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    a, b = one.claim(), two.claim()
    assert a != b
    two.commit(b)
    assert one.latest() == b
    with pytest.raises(ValueError):
        two.commit(b)
    one.commit(a)
    assert one.committed() == [0, 1]


def test_a_page_reads_no_payload(spark):
    rows = catalog_queries.candidate_view(Data(spark, FOLDER))
    plan = plan_of(catalog.catalog_page(rows, catalog.PageFilter(sort="score", limit=5)))
    assert "json" not in plan.lower() and "Exchange" not in plan


def test_batch_search_asks_for_every_row(spark, tmp_path):
    import numpy as np

    from winnow.plans import load

    rng = np.random.default_rng(3)
    v = rng.normal(size=(250, 64)).astype(np.float32)
    rows = [(i, 0, v[i].tolist()) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = load().QUERIES["search_batch"](spark, str(tmp_path)).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 1, 99, 100, 200, 249):
        sims = unit @ unit[q]
        sims[q] = -2
        assert [r["photo_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-sims)[:10].tolist()
    assert {r["query_id"] for r in got} == set(range(250))
