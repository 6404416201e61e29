"""Streaming forms driven to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import audits, snapshots
from ..session import shared_folder
from ..streaming import live
from .registry import query


def _place(d, name: str) -> str:
    return f"{shared_folder(d.spark)}/winnow-stream-{name}-{uuid.uuid4().hex}"


PARTS = 4


def arrive(table, key: str, place: str, part: int) -> None:
    """One arrival of a table, with as many files as it has tasks: rows whose key (0 if it has none) has this remainder."""
    rows = table.filter(F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(PARTS)) == part)
    rows.write.parquet(f"{place}/in/arrival-{part}-{uuid.uuid4().hex}")


def arrived(d, table, place: str):
    """All arrivals as a stream; a run takes what is new in micro-batches bounded by their bytes."""
    return live.file_stream(d.spark, f"{place}/in/*", schema=table.schema, files_per_batch=None)


def as_log(events):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    t = F.col("event_type")
    return events.select(
        F.col("user_id").alias("photo_id"),
        F.col("event_id").alias("seq"),
        F.when(t == "purchase", "keep").when(t == "error", "reject").when(t == "click", "flag").otherwise("pending").alias("action"),
        F.when(k % 10 == 0, F.col("ts")).alias("undone_at"),
    )


@query("streamed_decisions", "O4 E1", """
SELECT user_id AS photo_id, max(event_id) AS seq, arg_max(CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'flag' ELSE 'pending' END, event_id) AS decision
FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 <> 0 GROUP BY 1""")
def streamed_decisions(d):
    """Every trigger appends the keys it changed; the newest row per key is the state."""
    place = _place(d, "state")
    for part in range(PARTS):
        arrive(d.events, "event_id", place, part)
        state = live.live_decisions(as_log(arrived(d, d.events, place)))
        run = (
            state.writeStream.outputMode("update")
            .foreachBatch(live.batch_table(f"{place}/out"))
            .option("checkpointLocation", f"{place}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    out = d.spark.read.parquet(f"{place}/out").drop("batch")
    return snapshots.upsert(out, out.limit(0), key="photo_id", seq="seq").select("photo_id", "seq", "decision")


def ingested(rows):
    """What a document becomes; one that can't be read gets its error."""
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars", F.when(F.col("n_chars") % 10 == 0, "unreadable").alias("error"))


@query("streamed_ingest", "O1 O2 O5", """
SELECT doc_id, sha256(text) AS sha256, n_chars FROM documents WHERE n_chars % 10 <> 0 OR n_chars IS NULL""")
def streamed_ingest(d):
    """The first arrival is committed alone, then the others in batches; rows marked bad go to dead letters."""
    place = _place(d, "ingest")
    for part in range(PARTS):
        arrive(d.documents, "doc_id", place, part)
        sinks = live.two_sinks(live.batch_table(place + "/out"), live.batch_table(place + "/dead"))
        live.publish(ingested(arrived(d, d.documents, place)), sinks, checkpoint=place + "/checkpoint").awaitTermination()
    return d.spark.read.parquet(place + "/out").drop("batch")


@query("streamed_retry", "O5", "SELECT doc_id, sha256(text) AS sha256, n_chars, CASE WHEN n_chars % 10 = 0 THEN 'retried' ELSE 'first' END AS run FROM documents")
def streamed_retry(d):
    """Ingest with rows that fail, repair of what failed, and a stream over the dead letters: together they are a clean run."""
    place = _place(d, "retry")
    for part in range(PARTS):
        arrive(d.documents, "doc_id", place, part)
        sinks = live.two_sinks(live.batch_table(place + "/out"), live.batch_table(place + "/dead"))
        live.publish(ingested(arrived(d, d.documents, place)), sinks, checkpoint=place + "/checkpoint").awaitTermination()
        # Letters of this arrival only: the checkpoint remembers which were taken.
        letters = live.file_stream(d.spark, place + "/dead/*", schema="doc_id long", files_per_batch=None)
        failing = d.documents.where("n_chars % 10 = 0")
        run = live.retry_stream(
            letters, failing, lambda rows: rows.select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars"), live.batch_table(place + "/again"), key=["doc_id"], checkpoint=place + "/retries"
        )
        run.awaitTermination()
    columns = ["doc_id", "sha256", "n_chars"]
    first = d.spark.read.parquet(place + "/out").select(*columns, F.lit("first").alias("run"))
    return first.unionByName(d.spark.read.parquet(place + "/again").select(*columns, F.lit("retried").alias("run")))


@query("pipeline_runs", "N13", """
SELECT 'readable' AS input, count(*) AS scanned, count(*) AS analyzed, count(*) AS reused, 0 AS errors, true AS passed FROM documents WHERE n_chars % 10 <> 0
UNION ALL SELECT 'everything', count(*), count(*) FILTER (n_chars % 10 <> 0), count(*) FILTER (n_chars % 10 <> 0), count(*) FILTER (n_chars % 10 = 0), false FROM documents""")
def pipeline_runs(d):
    """Scan, analysis and repeat of two inputs, counted from what the runs left: one passes, one has rows that fail."""
    reports = []
    for name, rows in (("readable", d.documents.where("n_chars % 10 <> 0")), ("everything", d.documents)):
        place = _place(d, "pipeline")
        for part in range(PARTS):
            arrive(rows, "doc_id", place, part)
            sinks = live.two_sinks(live.batch_table(place + "/out"), live.batch_table(place + "/dead"))
            write = live.recorded(sinks, place + "/progress", run=name, failed=F.col("error").isNotNull())
            live.publish(ingested(arrived(d, d.documents, place)), write, checkpoint=place + "/checkpoint").awaitTermination()
        totals = live.run_totals(d.spark.read.parquet(place + "/progress"))
        done = d.spark.read.parquet(place + "/out")
        # A repeat analyses only what has no stored result with the same digest.
        again = ingested(rows).join(done.select("doc_id", F.col("sha256").alias("held")).distinct(), "doc_id")
        counts = totals.join(done.agg(F.count("*").alias("analyzed"))).join(again.agg(F.count_if(F.col("sha256") == F.col("held")).alias("reused")))
        runs = counts.select(F.when(F.col("phase") == "finished", "completed").otherwise("failed").alias("state"), "errors", F.col("rows").alias("scanned"), "analyzed", "reused", F.lit(0).alias("seq"))
        passed = audits.pipeline_passed(runs, expected=rows.count())
        reports.append(runs.join(passed).select(F.lit(name).alias("input"), "scanned", "analyzed", "reused", "errors", "passed"))
    return reports[0].unionByName(reports[1])


def requested(d, request, place: str, parts):
    """Arrivals of requests through the keyed first-seen state, each a run of its own that starts from the checkpoint of the last."""
    for part in parts:
        arrive(d.events, "event_id", place, part)
        with live.keyed_state(d.spark):
            run = live.publish(live.first_seen(request(arrived(d, d.events, place))), live.batch_table(place + "/out"), checkpoint=place + "/checkpoint")
        run.awaitTermination()
    return d.spark.read.parquet(place + "/out").drop("batch")


@query("streamed_requests", "K8 O5", """
SELECT DISTINCT user_id || ':' || event_type AS request_id FROM events""")
def streamed_requests(d):
    """Every arrival comes, and the first one once more after all others: a request is accepted once."""

    def request(events):
        return events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_id"), F.lit("").alias("arguments"), F.col("event_id").alias("seq"))

    found = requested(d, request, _place(d, "requests"), [*range(PARTS), 0])
    return found.where("outcome = 'accepted'").select("request_id")


@query("streamed_replays", "K8", f"""
WITH r AS (SELECT user_id || ':' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS request_id, event_type AS arguments, event_id, coalesce(event_id, 0) % {PARTS} AS part FROM events),
f AS (SELECT request_id, arg_min(arguments, (part, event_id, arguments)) AS first FROM r GROUP BY 1),
c AS (SELECT request_id, arguments, first, count(*) + count(*) FILTER (part = 0) AS n FROM r JOIN f USING (request_id) GROUP BY ALL)
SELECT request_id, arguments, 'accepted' AS outcome, 1 AS n FROM c WHERE arguments = first
UNION ALL SELECT request_id, arguments, CASE WHEN arguments = first THEN 'replayed' ELSE 'mismatch' END, n - (arguments = first)::INT FROM c WHERE n > (arguments = first)::INT""")
def streamed_replays(d):
    """Requests with arguments: what an id was first accepted with decides whether a later one is a replay or an error."""

    def request(events):
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
        return events.select(F.concat_ws(":", F.col("user_id").cast("string"), k.cast("string")).alias("request_id"), F.col("event_type").alias("arguments"), F.col("event_id").alias("seq"))

    found = requested(d, request, _place(d, "replays"), [*range(PARTS), 0])
    return found.groupBy("request_id", "arguments", "outcome").agg(F.sum("n").alias("n"))


@query("streamed_guard", "O3 O2", f"""
SELECT event_id, value FROM events WHERE coalesce(event_id, 0) % {PARTS} < 2""")
def streamed_guard(d):
    """The settings change while the second arrival is written: what was computed with the old ones is refused from then on."""
    place = _place(d, "guard")
    settings, store = ["first"], live.batch_table(place + "/out")
    for part in range(PARTS):
        arrive(d.events, "event_id", place, part)

        def write(batch, batch_id, part=part):
            store(batch, batch_id)
            if part == 1:
                settings[0] = "second"

        run = live.publish(arrived(d, d.events, place).select("event_id", "value"), live.guarded(write, lambda: settings[0], "first"), checkpoint=place + "/checkpoint")
        try:
            run.awaitTermination()
        except StreamingQueryException:
            if part == 2:
                return d.spark.read.parquet(place + "/out").drop("batch")
            raise
    raise AssertionError("the stale writer was not refused")


@query("streamed_progress", "O7", f"""
SELECT 'arrival ' || coalesce(event_id, 0) % {PARTS} AS run, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, 'finished' AS phase FROM events GROUP BY 1""")
def streamed_progress(d):
    """Each arrival is a run; its batches leave their counts in a table that outlives the run."""
    place = _place(d, "progress")
    for part in range(PARTS):
        arrive(d.events, "event_id", place, part)
        write = live.recorded(live.batch_table(place + "/out"), place + "/progress", run=f"arrival {part}", failed=F.col("event_type") == "error")
        live.publish(arrived(d, d.events, place).select("event_id", "event_type"), write, checkpoint=place + "/checkpoint").awaitTermination()
    return live.run_totals(d.spark.read.parquet(place + "/progress")).select("run", "rows", "errors", "phase")
