"""Structured Streaming forms: micro-batch ingest and publish, live state, replay, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.latest import ACTIONS, decode, encode
from ..session import ContractViolation


def file_stream(spark: SparkSession, folder: str, *, schema, pattern: str = "*.parquet", files_per_batch: int | None = 32, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """New files of a folder in micro-batches bounded by their number, or by their bytes where no number is given."""
    most = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(schema).option(*most).option("pathGlobFilter", pattern).parquet(folder)


def publish(stream: DataFrame, write: Callable[[DataFrame, int], None], *, checkpoint: str, trigger: dict | None = None):
    """Hand every micro-batch to ``write``; the batch id lets it skip a replayed batch."""
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_table(destination: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Writer that owns one folder per batch id, so a batch replayed after a lost driver overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{destination}/batch={batch_id}")

    return write


def guarded(write: Callable[[DataFrame, int], None], current_settings: Callable[[], str], started_with: str) -> Callable[[DataFrame, int], None]:
    """Refuse a batch when the settings changed after the run started."""

    def checked(batch: DataFrame, batch_id: int) -> None:
        if current_settings() != started_with:
            raise ContractViolation("settings changed while results were computed", [batch_id])
        write(batch, batch_id)

    return checked


def split_failures(rows: DataFrame, *, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): a failing row never stops the others."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def two_sinks(good: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], *, error: str = "error") -> Callable[[DataFrame, int], None]:
    """Writer of both halves of a micro-batch. The batch is computed once; a replayed batch overwrites both of its folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            done, failed = split_failures(held, error=error)
            dead(failed, batch_id)
            good(done, batch_id)
        finally:
            held.unpersist()

    return write


def retry_rows(rows: DataFrame, dead: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Only the rows that failed before; a null key is a key as well."""
    ids = dead.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(ids, same, "left_semi")


def retry_stream(dead: DataFrame, source: DataFrame, work: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], *, key: Sequence[str], checkpoint: str):
    """A stream over dead letters: rows of ``source`` that failed are worked on once more. Each letter is taken once, so a later
    run retries what failed since; what fails again goes where ``write`` puts it."""
    return publish(dead, lambda letters, batch_id: write(work(retry_rows(source, letters, key=key)), batch_id), checkpoint=checkpoint)


def live_decisions(log: DataFrame, *, key: str = "photo_id", seq: str = "seq") -> DataFrame:
    """Continuously updated latest decision per key.

    State is one sequence number and one small code per key; use output mode
    ``update`` with a checkpoint. Void rows are ignored as in the batch form.
    """
    return (
        log.filter(F.col("undone_at").isNull())
        .groupBy(key)
        .agg(F.max_by(encode(F.col("action"), ACTIONS), F.col(seq)).alias("code"), F.max(seq).alias(seq))
        .select(key, seq, decode(F.col("code"), ACTIONS).alias("decision"))
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "request_id string, arguments string, outcome string, n long"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB files under their checkpoint; a query keeps the settings it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class FirstSeen(StatefulProcessor):
    """Of a bucket of request ids, the arguments each was first accepted with: equal requests are replays, others mismatches.

    A bucket reads and extends its state once in a micro-batch; with a key for each id every id would ask the state store several times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getListState("first", "request_id string, arguments string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked: dict[str, dict[str | None, list[int]]] = {}
        for row in rows:
            held = asked.setdefault(row["request_id"], {}).setdefault(row["arguments"], [0, row["seq"]])
            held[0] += row["n"]
            held[1] = min(held[1], row["seq"])
        firsts = {id: arguments for id, arguments in self.first.get() if id in asked}
        # Of one micro-batch the request with the lowest sequence number is the first.
        new = {id: min(counts, key=lambda a: (counts[a][1], a is None, a or "")) for id, counts in asked.items() if id not in firsts}
        if new:
            self.first.appendList(list(new.items()))
        for id, counts in asked.items():
            first = new[id] if id in new else firsts[id]
            if id in new:
                yield Row(request_id=id, arguments=first, outcome="accepted", n=1)
                counts[first][0] -= 1
            for arguments, (n, _) in counts.items():
                if n:
                    yield Row(request_id=id, arguments=arguments, outcome="replayed" if arguments == first else "mismatch", n=n)

    def close(self) -> None:
        pass


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal requests of an Arrow batch as one row, so that a hot id is a few rows of each task before it is shuffled."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["request_id", "arguments"]).aggregate([("seq", "min"), ("seq", "count")])
        yield from table.select(["request_id", "arguments", "seq_min", "seq_count"]).rename_columns(["request_id", "arguments", "seq", "n"]).to_batches()


def first_seen(requests: DataFrame, *, buckets: int = 4096) -> DataFrame:
    """``request_id, arguments, outcome, n`` for a stream of ``request_id, arguments, seq``: accepted once for ever, later a replay or, with
    other arguments, a mismatch. State is one row for each id, held by ``buckets``: a task has the ids of one bucket in memory at a time. A
    checkpoint keeps the number it was started with. Start the query inside :func:`keyed_state`."""
    rows = requests.select(F.coalesce("request_id", F.lit("")).alias("request_id"), "arguments", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    few = rows.mapInArrow(_collapsed, "request_id string, arguments string, seq long, n long")
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int")
    return few.withColumn("bucket", bucket).groupBy("bucket").transformWithState(statefulProcessor=FirstSeen(), outputStructType=OUTCOMES, outputMode="Append", timeMode="None")


def state_rows(query) -> int:
    """Keys held by the stateful operators of a run, as its last trigger reported them (for :func:`first_seen` the buckets in use, not the ids)."""
    last = query.lastProgress
    return sum(op["numRowsTotal"] for op in last["stateOperators"]) if last else 0


PROGRESS = "run string, rows long, errors long, phase string, error string"


def recorded(write: Callable[[DataFrame, int], None], place: str, *, run: str, failed: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Writer that leaves a row of progress for each micro-batch in ``place``: rows and errors counted while the batch is written.

    The row has a folder of its own for each batch id, so a replayed batch counts once, and a run of any length is whole."""

    def record(batch: DataFrame, batch_id: int, rows: int, errors: int, phase: str, error: str | None) -> None:
        row = batch.sparkSession.createDataFrame([(run, rows, errors, phase, error)], PROGRESS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{place}/batch={batch_id}")

    def counted(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        errors = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
        try:
            write(batch.observe(seen, F.count(F.lit(1)).alias("rows"), errors.alias("errors")), batch_id)
        except Exception as error:
            record(batch, batch_id, 0, 0, "failed", str(error)[:500])
            raise
        record(batch, batch_id, seen.get["rows"], seen.get["errors"], "progress", None)

    return counted


def run_totals(progress: DataFrame) -> DataFrame:
    """``run, batches, rows, errors, phase`` of every run; a failed batch that was done later no longer counts as failed."""
    return progress.groupBy("run").agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("errors").alias("errors"),
        F.when(F.count_if(F.col("phase") == "failed") > 0, "failed").otherwise("finished").alias("phase"),
    )


def observed(rows: DataFrame, name: str, *, error: str | None = None) -> DataFrame:
    """Attach row and error counts to a query without another pass."""
    failed = F.count_if(F.col(error).isNotNull()) if error else F.lit(0)
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), failed.alias("errors"))


class RunProgress(StreamingQueryListener):
    """Collects per-batch progress; :meth:`table` gives it as rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.runId), -1, "started", 0, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.runId), p.batchId, "progress", p.numInputRows, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        phase = "failed" if event.exception else "finished"
        self.rows.append((str(event.runId), -1, phase, 0, event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run string, batch long, phase string, rows long, error string")
