"""Stored forms of the catalog: bucketed narrow tables kept up to date by changed keys, and tables saved whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import require_empty
from ..sources.commits import Commits
from .catalog import candidates, freshness

KEY = "photo_id"
PARTS = ("entities", "analyses", "states")


class StoredCatalog:
    """Entities, narrow analysis columns and latest states in three tables with the same buckets.

    Rows of one key are in the same bucket of each table, so a page joins the three without an exchange and reads no payload. A
    change appends the new rows of the changed keys under a number of its own; the newest row of a key wins, found by
    an aggregation inside the buckets. All three tables of a change become visible with one commit.
    """

    def __init__(self, spark: SparkSession, place: str, *, buckets: int | None = None):
        self.spark, self.place = spark, place.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.commits = Commits(spark, self.place)
        self.name = "winnow_" + uuid.uuid5(uuid.NAMESPACE_URL, self.place).hex

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _write(self, part: str, rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("generation", F.lit(number))
        # Hash partitions are the buckets, so each task writes one file.
        writer = rows.repartition(self.buckets, KEY).write.mode("append").bucketBy(self.buckets, KEY).sortBy(KEY)
        writer.option("path", f"{self.place}/{part}").saveAsTable(self._table(part))

    def save(self, parts: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> int:
        """Append rows of the named tables, and keys that are gone, as one change."""
        number = self.commits.claim()
        for part, rows in parts.items():
            rows = rows.withColumn("gone", F.lit(False))
            lost = (gone or {}).get(part)
            if lost is not None:
                rows = rows.unionByName(lost.select(KEY, F.lit(True).alias("gone")), allowMissingColumns=True)
            self._write(part, rows, number)
        self.commits.commit(number)
        return number

    def open(self, schemas: dict[str, StructType]) -> "StoredCatalog":
        """Name the tables of ``place`` in a session that did not write them."""
        for part, schema in schemas.items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(part)} ({columns}, gone boolean, generation int) USING parquet "
                f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.place}/{part}'"
            )
        return self

    def latest(self, part: str) -> DataFrame:
        """Newest committed row of each key that is not gone; no shuffle."""
        numbers = self.commits.committed()
        rows = self.spark.table(self._table(part)).where(F.col("generation").isin(numbers))
        columns = [c for c in rows.columns if c not in ("gone", "generation")]
        if len(numbers) > 1:
            rest = [c for c in columns if c != KEY]
            newest = rows.groupBy(KEY).agg(F.max_by(F.struct(*rest, "gone"), "generation").alias("row"))
            rows = newest.select(KEY, "row.*")
        return rows.where(~F.col("gone")).select(*columns)

    def refresh(self, now: dict[str, DataFrame]) -> int | None:
        """Bring the tables to ``now`` by the rows that differ; None if nothing does."""
        changed, gone = {}, {}
        for part, rows in now.items():
            changed[part], gone[part] = differences(self.latest(part), rows)
        if all(x.isEmpty() for x in [*changed.values(), *gone.values()]):
            return None
        return self.save(changed, gone)

    def refresh_analyses(self, raw: DataFrame, narrow: Callable[[DataFrame], DataFrame], *, text: str = "data") -> int | None:
        """Project the payloads whose text has changed, and no others."""
        held = self.latest("analyses").select(KEY, F.col("payload_hash").alias("held"))
        hashed = raw.withColumn("payload_hash", F.xxhash64(text))
        both = hashed.join(held, KEY, "full_outer")
        new = both.where(F.col("payload_hash").isNotNull() & ~F.col("payload_hash").eqNullSafe(F.col("held"))).drop("held")
        lost = both.where(F.col("payload_hash").isNull()).select(KEY)
        if new.isEmpty() and lost.isEmpty():
            return None
        return self.save({"analyses": hashed_analyses(new, narrow, text=text)}, {"analyses": lost})

    def compact(self) -> "StoredCatalog":
        """The newest rows alone, in a new place."""
        fresh = StoredCatalog(self.spark, f"{self.place}-{uuid.uuid4().hex[:8]}", buckets=self.buckets)
        fresh.save({part: self.latest(part) for part in PARTS})
        return fresh

    def rows(self, *, version: str, settings_key: str | Column) -> DataFrame:
        """The candidate view that pages are cut from; merge joins of equal buckets."""
        masked = freshness(self.latest("analyses").drop("payload_hash"), version=version, settings_key=settings_key)
        states = self.latest("states")
        known = self.latest("entities").join(states.hint("merge"), KEY, "left")
        known = known.withColumns({"decision": F.coalesce("decision", F.lit("pending")), "rating": F.coalesce("rating", F.lit(0)), "color_label": F.coalesce("color_label", F.lit("none"))})
        return candidates(known, masked.hint("merge"))


def hashed_analyses(raw: DataFrame, narrow: Callable[[DataFrame], DataFrame], *, text: str = "data") -> DataFrame:
    """Narrow analysis columns with a hash of the payload they come from."""
    columns = [c for c in raw.columns if c not in (KEY, text, "payload_hash")]
    hashes = raw.drop(*columns).select(KEY, F.xxhash64(text).alias("payload_hash"))
    return narrow(raw.select(KEY, text)).join(hashes, KEY)


def differences(held: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``now`` that ``held`` lacks or has otherwise, keys that only ``held`` has); keys are unique on both sides."""
    columns = [c for c in now.columns if c != KEY]

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(KEY, F.struct(*columns).alias(name))

    both = packed(held, "held").join(packed(now, "now"), KEY, "full_outer")
    new = both.where(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("held"))).select(KEY, "now.*")
    return new, both.where(F.col("now").isNull()).select(KEY)


class VersionedTable:
    """A table whose versions become current one at a time: staged under a claimed number, checked, then committed.

    Readers of a version keep it while later ones are written; a refused or failed save leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self.commits = Commits(spark, self.place)

    def _folder(self, number: int) -> str:
        return f"{self.place}/v{number}"

    def read(self, number: int | None = None) -> DataFrame:
        number = self.commits.latest() if number is None else number
        if number is None or number not in self.commits.committed():
            raise ValueError(f"no committed version {number} at {self.place}")
        return self.spark.read.parquet(self._folder(number))

    def save(self, rows: DataFrame, *checks: Callable[[DataFrame], None], partition: str | None = None) -> int:
        """Stage ``rows``, run the checks on what was staged, commit; any error removes the staged rows and is raised."""
        number = self.commits.claim()
        try:
            writer = rows.write.partitionBy(partition) if partition else rows.write
            writer.parquet(self._folder(number))
            staged = self.spark.read.schema(rows.schema).parquet(self._folder(number))
            for check in checks:
                check(staged)
            self.commits.commit(number)
        except BaseException:
            self.commits.remove(number, self._folder(number))
            raise
        return number


def save_analyses(table: VersionedTable, rows: DataFrame, entities: DataFrame, *, key: str = KEY, seq: str = "seq") -> int:
    """All-or-nothing upsert of analyses: an id that no entity has refuses the whole batch, and a task that fails changes nothing.

    The newest row of a key by ``seq`` wins over stored ones; the ids are checked before anything is staged."""
    from .snapshots import upsert

    require_empty(rows.select(key).join(entities.select(key), key, "left_anti"), "unknown ids in batch")
    base = table.read() if table.commits.latest() is not None else rows.limit(0)
    return table.save(upsert(base, rows, key=key, seq=seq))
