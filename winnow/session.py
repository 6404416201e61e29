"""Session defaults, lineage cuts and size-checked broadcasts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the operators rely on to a session builder."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A test-sized session; clusters bring their own and only need :func:`configure`."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("winnow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent and the master itself is local (tests, one machine), a folder is made once per
    application and set as its checkpoint folder; no executor can be lost without the driver there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="winnow-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Remove the tables that :func:`cut` writes inside the block, once the block's own result has been written."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used between rounds of the iterative operators. Lost executors cost a
    re-read of the files, never a replay of earlier rounds, and the planner
    sees true sizes. Inside :func:`scratch` the table goes with the block.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/winnow-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Use idle cores for CPU-heavy column work on an input with too few splits.

    A no-op on inputs that already have a split per core, which is every large
    table; a small file with one row group is hashed over the cores once. With ``rows`` a
    task gets about that many however large the table is: narrow rows fill few splits, and
    a task would grow with the table.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        slots = max(slots, -(-df.count() // rows))
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the counted rows at the width of a row in memory stay within ``limit``.

    No more rows are counted than that. Beyond it the join is left to adaptive execution.
    """
    most = limit // max(1, df._jdf.schema().defaultSize())
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class ContractViolation(ValueError):
    """An all-or-nothing operation was refused; ``examples`` shows a few offending rows."""

    def __init__(self, message: str, examples: list):
        super().__init__(f"{message}: {examples}")
        self.examples = examples


def require_empty(violations: DataFrame, message: str) -> None:
    """Refuse the whole operation when any violating row exists."""
    examples = [row.asDict() for row in violations.limit(5).collect()]
    if examples:
        raise ContractViolation(message, examples)
