"""Stale-writer guard, dead letters and progress rows."""

import time

import pytest

from winnow.session import ContractViolation
from winnow.streaming import live


def test_stale_writer_is_refused(spark):
    wrote = []
    write = live.guarded(lambda df, i: wrote.append(i), lambda: "new", "old")
    with pytest.raises(ContractViolation):
        write(spark.range(1), 0)
    live.guarded(lambda df, i: wrote.append(i), lambda: "old", "old")(spark.range(1), 3)
    assert wrote == [3]


def test_only_failed_rows_are_retried(spark):
    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    good, dead = live.split_failures(df)
    assert [r["id"] for r in good.collect()] == [1]
    assert [r["id"] for r in live.retry_rows(df, dead, key=["id"]).collect()] == [2]


def test_progress_and_replayed_batch(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(10).write.parquet(source)
    listener = live.RunProgress()
    spark.streams.addListener(listener)
    try:
        stream = live.observed(live.file_stream(spark, source, schema="id long"), "counts")
        live.publish(stream, live.batch_table(out), checkpoint=mark).awaitTermination()
        for _ in range(50):
            if any(r[2] == "finished" for r in listener.rows):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    live.batch_table(out)(spark.range(10), 0)
    assert spark.read.parquet(out).select("id").distinct().count() == 10
    assert listener.table(spark).filter("phase = 'progress'").agg({"rows": "sum"}).first()[0] == 10


def requests(spark, rows, place):
    """One arrival through the first-seen state; returns the run and everything it has said so far."""
    spark.createDataFrame(rows, "request_id string, arguments string, seq long").write.mode("append").parquet(place + "/in")
    stream = live.file_stream(spark, place + "/in", schema="request_id string, arguments string, seq long", files_per_batch=None)
    with live.keyed_state(spark):
        run = live.publish(live.first_seen(stream), live.batch_table(place + "/out"), checkpoint=place + "/checkpoint")
    run.awaitTermination()
    return run, sorted((r["request_id"], r["arguments"] or "", r["outcome"], r["n"], r["batch"]) for r in spark.read.parquet(place + "/out").collect())


def test_a_request_is_accepted_once_for_ever(spark, tmp_path):
    place = str(tmp_path)
    run, said = requests(spark, [("a", "x", 2), ("a", "y", 1), ("b", None, 1), (None, "z", 1)] + [("hot", "x", i) for i in range(3, 400)], place)
    assert said == [("", "z", "accepted", 1, 0), ("a", "x", "mismatch", 1, 0), ("a", "y", "accepted", 1, 0), ("b", "", "accepted", 1, 0), ("hot", "x", "accepted", 1, 0), ("hot", "x", "replayed", 396, 0)]
    assert live.state_rows(run) == 4
    # A run that starts from the checkpoint knows what earlier runs accepted, and an id that comes with other arguments is an error.
    run, said = requests(spark, [("a", "y", 9), ("a", "x", 10), ("b", None, 11), ("c", "x", 12)], place)
    assert [x for x in said if x[4] == 1] == [("a", "x", "mismatch", 1, 1), ("a", "y", "replayed", 1, 1), ("b", "", "replayed", 1, 1), ("c", "x", "accepted", 1, 1)]
    assert live.state_rows(run) == 5


def test_a_bucket_of_ids_is_one_call_of_the_processor(spark, tmp_path):
    place, schema = str(tmp_path), "request_id string, arguments string, seq long"
    said = []
    for rows in ([("a", "x", 2), ("a", None, 1), ("b", "x", 3)], [("a", None, 4), ("b", "y", 5), ("c", "z", 6)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(place + "/in")
        stream = live.file_stream(spark, place + "/in", schema=schema, files_per_batch=None)
        with live.keyed_state(spark):
            run = live.publish(live.first_seen(stream, buckets=1), live.batch_table(place + "/out"), checkpoint=place + "/checkpoint")
        run.awaitTermination()
        found = spark.read.parquet(place + "/out").collect()
        said.append(sorted((r["request_id"], r["arguments"] or "", r["outcome"], r["n"]) for r in found if r["batch"] == len(said)))
    assert said[0] == [("a", "", "accepted", 1), ("a", "x", "mismatch", 1), ("b", "x", "accepted", 1)]
    assert said[1] == [("a", "", "replayed", 1), ("b", "y", "mismatch", 1), ("c", "z", "accepted", 1)]
    # The keys of this state are buckets.
    assert live.state_rows(run) == 1


def test_dead_letters_are_retried_once(spark, tmp_path):
    place = str(tmp_path)
    source = spark.createDataFrame([(1, None), (2, "bad"), (None, "bad"), (3, None), (4, "bad")], "id long, error string")
    source.write.parquet(place + "/in")
    sinks = live.two_sinks(live.batch_table(place + "/out"), live.batch_table(place + "/dead"))
    live.publish(live.file_stream(spark, place + "/in", schema=source.schema), sinks, checkpoint=place + "/a").awaitTermination()
    tried = []

    def retry():
        letters = live.file_stream(spark, place + "/dead/*", schema="id long")
        live.retry_stream(letters, source, lambda rows: rows.where("id is null or id < 4"), lambda df, i: tried.append(sorted(r["id"] or 0 for r in df.collect())), key=["id"], checkpoint=place + "/b").awaitTermination()

    retry()
    retry()
    assert sorted(r["id"] for r in spark.read.parquet(place + "/out").collect()) == [1, 3]
    assert sum(tried, []) == [0, 2]


def test_progress_of_a_long_run_is_whole(spark, tmp_path):
    place = str(tmp_path)
    spark.range(0, 104, 1, 104).write.parquet(place + "/in")
    stream = live.file_stream(spark, place + "/in", schema="id long", files_per_batch=1)
    write = live.recorded(lambda df, i: df.write.format("noop").mode("overwrite").save(), place + "/progress", run="long", failed=stream["id"] % 10 == 0)
    run = live.publish(stream, write, checkpoint=place + "/mark")
    run.awaitTermination()
    totals = live.run_totals(spark.read.parquet(place + "/progress")).collect()
    files = len(list((tmp_path / "in").glob("*.parquet")))
    assert files > 100 >= len(run.recentProgress)
    assert [tuple(r) for r in totals] == [("long", files, 104, 11, "finished")]


def test_a_failed_batch_is_recorded_and_then_done(spark, tmp_path):
    place, broken = str(tmp_path), [True]

    def write(batch, batch_id):
        if broken[0]:
            raise ValueError("disk full")
        batch.write.format("noop").mode("overwrite").save()

    spark.range(3).write.parquet(place + "/in")
    for phase in ("failed", "finished"):
        run = live.publish(live.file_stream(spark, place + "/in", schema="id long"), live.recorded(write, place + "/progress", run="r"), checkpoint=place + "/mark")
        try:
            run.awaitTermination()
        except Exception:
            assert phase == "failed"
        assert live.run_totals(spark.read.parquet(place + "/progress")).first()["phase"] == phase
        broken[0] = False
