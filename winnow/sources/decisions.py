"""Decision files: export, validated import and scoped subset copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import safe_relative
from ..operators.catalog import available
from ..operators.latest import ACTIONS


def decision_rows(entities: DataFrame) -> DataFrame:
    """path and action of every row, missing ones included, in path order."""
    return entities.select("path", F.col("decision").alias("action")).orderBy("path")


def write_decisions(entities: DataFrame, destination: str) -> None:
    """CSV with a header; an existing destination is an error. Quotes are doubled, as spreadsheets write and read them."""
    decision_rows(entities).write.csv(destination, header=True, mode="error", escape='"')


def read_decision_file(spark: SparkSession, source: str, *, multi_line: bool = False) -> DataFrame:
    """Columns are found by header name; a file without them is refused. ``multi_line`` reads paths with line ends, a file in one task."""
    frame = spark.read.csv(source, header=True, inferSchema=False, escape='"', multiLine=multi_line)
    missing = {"path", "action"} - set(frame.columns)
    if missing:
        raise ValueError(f"decision file lacks columns: {sorted(missing)}")
    return frame.select(F.col("path").cast("string"), F.col("action").cast("string"))


def check_decisions(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, violations): unsafe or unknown path, unknown action, repeated path."""
    known = entities.select("project_id", "photo_id", "path")
    joined = rows.join(known, "path", "left")
    repeated = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    reason = (
        F.when(~F.coalesce(safe_relative("path"), F.lit(False)), "unsafe_path")
        .when(F.col("photo_id").isNull(), "unknown_path")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown_action")
    )
    bad = joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "reason")
    bad = bad.unionByName(repeated.select("path", F.lit("duplicate_path").alias("reason")))
    return joined.select("project_id", "photo_id", "action"), bad


def scoped(entities: DataFrame, scope: str) -> DataFrame:
    """Available rows to export: ``keep``, ``reject`` or ``all``."""
    if scope not in ("keep", "reject", "all"):
        raise ValueError("scope must be keep, reject or all")
    rows = available(entities)
    return rows if scope == "all" else rows.filter(F.col("decision") == scope)


def subset_copy(chosen: DataFrame, existing: DataFrame, *, key=("project_id", "path")) -> tuple[DataFrame, DataFrame]:
    """(rows to write, report): rows already at the destination are skipped."""
    there = existing.select(*key, F.lit(True).alias("__there")).distinct()
    marked = chosen.join(there, list(key), "left")
    report = marked.agg(
        F.count_if(F.col("__there").isNull()).alias("written"),
        F.count_if(F.col("__there").isNotNull()).alias("skipped"),
    )
    return marked.filter(F.col("__there").isNull()).drop("__there"), report


def write_subset(rows: DataFrame, destination: str, *, by: str = "project_id") -> None:
    rows.write.partitionBy(by).mode("append").parquet(destination)
