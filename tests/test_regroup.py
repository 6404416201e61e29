"""Incremental regroup, live scenes and decision files."""

import os

import pytest
from pyspark.sql import functions as F

from winnow.operators import regroup, scenes
from winnow.sources import decisions
from winnow.streaming import live, live_scenes


def build(rows):
    return rows.where("variant <> 'none'").select("project_id", F.col("variant").alias("group_id"), "photo_id")


def times(place):
    return {(folder.rsplit("=", 1)[-1], f): os.stat(os.path.join(folder, f)).st_mtime_ns for folder, _, files in os.walk(place) for f in files if f.startswith("part")}


def test_a_second_run_rewrites_dirty_projects_only(spark, tmp_path):
    columns, place = ["photo_id", "variant"], str(tmp_path)
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y"), ("c", 4, "z"), (None, 5, "n")]
    df = spark.createDataFrame(rows, "project_id string, photo_id long, variant string")
    store = regroup.StoredGroups(spark, place, build(df).schema)
    assert store.refresh(df, build, columns=columns).count() == 4
    before = times(f"{place}/groups")
    assert store.refresh(df, build, columns=columns).isEmpty() and times(f"{place}/groups") == before
    # b changes, c loses its groups, a and the null project stay, d is new.
    now = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "w"), ("c", 4, "none"), (None, 5, "n"), ("d", 6, "v")], df.schema)
    assert {r[0] for r in store.refresh(now, build, columns=columns).collect()} == {"b", "c", "d"}
    after = times(f"{place}/groups")
    assert {k for k in before if after.get(k) == before[k]} == {k for k in before if k[0] not in ("b", "c")}
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, build(now).collect()), key=str)
    # A project that is gone, and a build that fails: what is stored stays.
    with pytest.raises(Exception, match="broken"):
        store.refresh(now.where("project_id <> 'a'"), lambda r: build(r).withColumn("group_id", F.raise_error(F.lit("broken"))).unionByName(build(now).where("1 = 0")), columns=["photo_id"])
    assert store.read().count() == 5
    store.refresh(now.where("project_id <> 'a'"), build, columns=columns)
    assert store.read().where("project_id = 'a'").count() == 0


def test_live_scenes_wait_for_the_watermark(spark, tmp_path):
    place, limits = str(tmp_path), scenes.SceneLimits(structure_size=2)
    rows = [("p", i, 1000 + 40 * i, (1 << 62) - 1 if i % 5 else -1, [0.1, 0.2] if i % 7 else None) for i in range(60)] + [("q", 100, 1500, 3, [0.5, 0.5]), ("q", 101, None, 3, [0.5, 0.5])]
    schema = "project_id string, photo_id long, taken_s long, phash long, structure array<float>"
    df = spark.createDataFrame(rows, schema)
    want = {(r["project_id"], r["photo_id"], r["anchor_id"]) for r in scenes.scene_members(df, limits=limits).where("kind = 'scene_candidate'").collect()}
    end = [("end", -1, 100_000, 0, None)]
    # Rows come in the wrong order within an arrival, and up to 600 seconds late across arrivals.
    late = sorted(rows, key=lambda r: (r[2] or 0) - r[1] * 97 % 600)
    for batch in (late[:20][::-1], late[20:45], late[45:], end):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{place}/in")
        with live.keyed_state(spark):
            stream = live.file_stream(spark, f"{place}/in", schema=schema)
            run = live.publish(live_scenes.live_scenes(stream, limits=limits, delay=600), live.batch_table(f"{place}/out"), checkpoint=f"{place}/mark")
        run.awaitTermination()
    got = [(r["project"], r["id"], r["anchor_id"]) for r in spark.read.parquet(f"{place}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_decision_files_keep_quotes_and_refuse_a_taken_place(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c.jpg', "keep"), ("d\\e.jpg", "reject"), ("f\ng.jpg", "flag")], "path string, decision string")
    place = str(tmp_path / "out")
    decisions.write_decisions(rows, place)
    assert {tuple(r) for r in decisions.read_decision_file(spark, place, multi_line=True).collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        decisions.write_decisions(rows, place)
    (tmp_path / "bad.csv").write_text("file,action\na,keep\n")
    with pytest.raises(ValueError, match="lacks columns"):
        decisions.read_decision_file(spark, str(tmp_path / "bad.csv"))


def test_structures_of_waiting_rows_are_packed():
    import numpy as np
    import pyarrow as pa

    s = pa.array([[9.0], [], [1.0, 2.5], [], [3.0]], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), s], names=["id", "s"]).slice(1)
    (packed,) = live_scenes._packed([batch])
    assert packed.column("id").to_pylist() == [1, 2, 3, 4]
    assert [np.frombuffer(b, np.float32).tolist() for b in packed.column("s").to_pylist()] == [[], [1.0, 2.5], [], [3.0]]
