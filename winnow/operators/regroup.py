"""Incremental regroup: stored groups by project, rewritten where a project's inputs have changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .snapshots import group_inputs_digest
from .stored import VersionedTable


class StoredGroups:
    """Groups in one folder for each project, and the digest of the inputs that each was built from.

    A run builds the groups of dirty projects only and replaces their folders by a dynamic partition overwrite. The digests are
    committed after the groups, so a run that fails between the two is done again by the next one. A project that has no
    group, or is gone, keeps a row without members, which readers do not see.
    """

    def __init__(self, spark: SparkSession, place: str, schema: StructType, *, project: str = "project_id", id: str = "photo_id"):
        self.spark, self.place, self.schema, self.project, self.id = spark, place.rstrip("/"), schema, project, id
        self.digests = VersionedTable(spark, f"{self.place}/digests")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.place}/groups").where(F.col(self.id).isNotNull()).select(*self.schema.names)

    def dirty(self, now: DataFrame) -> DataFrame:
        """Projects whose digest differs from the stored one, on either side; a null project is a project."""
        project = F.col(self.project)
        if self.digests.commits.latest() is None:
            return now.select(project)
        held = self.digests.read().select(project.alias("__held"), F.col("digest").alias("__old"))
        both = now.join(held, project.eqNullSafe(F.col("__held")), "full_outer")
        return both.where(~F.col("digest").eqNullSafe(F.col("__old"))).select(F.coalesce(project, "__held").alias(self.project))

    def refresh(self, inputs: DataFrame, build: Callable[[DataFrame], DataFrame], *, columns: Sequence[str]) -> DataFrame:
        """Rebuild what changed in ``columns``; returns the projects that were rebuilt."""
        now = cut(group_inputs_digest(inputs, project=self.project, columns=columns))
        dirty = cut(self.dirty(now))
        if dirty.isEmpty():
            return dirty
        names = dirty.select(F.col(self.project).alias("__dirty"))
        todo = inputs.join(names, F.col(self.project).eqNullSafe(F.col("__dirty")), "left_semi")
        empty = dirty.select(self.project, *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.project])
        rows = build(todo).select(*self.schema.names).unionByName(empty.select(*self.schema.names))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(self.project).parquet(f"{self.place}/groups")
        self.digests.save(now)
        return dirty
