"""Global positions and time sessions that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Zero-based position in a total order, without a one-task window.

    One range shuffle sorts the rows; the written table fixes each row's
    (partition, offset) pair, and only one count per partition is summed up.
    ``order`` should end in a unique column so ties cannot pile up in one range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per range partition: the only table ordered in a single task.
    starts = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__n").over(
                Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("__start"),
    )
    return (
        local.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__start", "__at")
    )


def gap_sessions(df: DataFrame, *, entity: str, time: str, gap: int, chunk: int = 86_400, name: str = "session_no") -> DataFrame:
    """Number sessions per entity; a pause longer than ``gap`` starts a new one.

    Rows sharing (entity, time) can never be separated, so the break positions
    are found on distinct pairs: a hot second collapses in the map-side
    aggregate. Each entity's time line is then cut into ``chunk``-second pieces
    whose window holds at most ``chunk`` rows; only one summary row per piece
    crosses pieces.
    """
    if chunk <= 0 or gap < 0:
        raise ValueError("chunk must be positive and gap non-negative")
    points = (
        df.filter(F.col(time).isNotNull())
        .groupBy(entity, time)
        .agg(F.count("*").alias("__n"))
        .withColumn("__piece", F.floor(F.col(time) / chunk))
    )
    inner = Window.partitionBy(entity, "__piece").orderBy(time)
    stepped = points.withColumn(
        "__break", (F.col(time) - F.lag(time).over(inner) > gap).cast("long")
    ).withColumn("__local", F.sum(F.coalesce("__break", F.lit(0))).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = stepped.groupBy(entity, "__piece").agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"), F.max("__local").alias("__breaks")
    )
    outer = Window.partitionBy(entity).orderBy("__piece")
    opens = (
        (F.col("__first") - F.lag("__last").over(outer) > gap).cast("long")
    )
    base = pieces.withColumn("__opens", F.coalesce(opens, F.lit(0))).select(
        entity,
        "__piece",
        (
            F.sum("__opens").over(outer.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(
                F.sum("__breaks").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            )
        ).alias("__base"),
    )
    numbered = stepped.join(base, [entity, "__piece"]).select(
        entity, time, (F.col("__base") + F.col("__local")).alias(name)
    )
    return df.join(numbered, [entity, time], "left")


def first_n(df: DataFrame, *, key: Sequence[str], order: Sequence[Column], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows per key; Spark prunes each map task to n rows per key before the shuffle."""
    rank = name or "__rank"
    out = df.withColumn(
        rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    ).filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def rank_within(df: DataFrame, *, group: Sequence[str], order: Sequence[Column], name: str = "rank", at_most: int | None = None) -> DataFrame:
    """One-based rank inside each group, whatever the group sizes.

    With a small ``at_most`` every map task keeps only that many rows per group.
    Otherwise one range-partitioned order over (group, order) ranks all groups
    at once, and a group's ranks are positions minus its first position.
    """
    if at_most is not None and at_most <= 1000:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= at_most)
    placed = global_position(df, [*[F.col(g) for g in group], *order], name="__pos")
    starts = placed.groupBy(*group).agg(F.min("__pos").alias("__start"))
    out = placed.join(starts, list(group)).withColumn(name, (F.col("__pos") - F.col("__start") + 1).cast("int"))
    if at_most is not None:
        out = out.filter(F.col(name) <= at_most)
    return out.drop("__pos", "__start")


def nearest_rank(df: DataFrame, *, value: str, quantiles: Sequence[float], method: str = "ceil") -> DataFrame:
    """Exact nearest-rank percentiles of one column over the whole table.

    ``ceil``: element ceil(q n) - 1; ``floor``: element int(q (n - 1)).
    Equal values are counted, not listed, so positions come from running
    totals over distinct values.
    """
    spark = df.sparkSession
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ends = running_total(counts, order=[F.col(value)], amount="__n", name="__end")
    total = counts.agg(F.sum("__n").alias("__total"))
    wanted = spark.createDataFrame([(float(q),) for q in quantiles], "quantile double")
    q, n = F.col("quantile"), F.col("__total")
    index = F.ceil(q * n) - 1 if method == "ceil" else F.floor(q * (n - 1))
    targets = wanted.join(F.broadcast(total)).select("quantile", F.greatest(index, F.lit(0)).alias("__i"))
    hits = ends.join(
        F.broadcast(targets),
        (F.col("__i") < F.col("__end")) & (F.col("__i") >= F.col("__end") - F.col("__n")),
    )
    return hits.select("quantile", F.col(value).alias("value"))


def running_total(df: DataFrame, *, order: Sequence[Column], amount: str, name: str) -> DataFrame:
    """Inclusive running sum in a global order, range-partitioned like :func:`global_position`."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = cut(
        df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    )
    sums = part.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    starts = sums.select(
        "__part",
        F.coalesce(
            F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__start"),
    )
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        part.withColumn("__run", F.sum(amount).over(inner))
        .join(broadcast_if_small(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__run"))
        .drop("__part", "__start", "__run")
    )


def exact_percentiles(df: DataFrame, *, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, one column per quantile): exact percentiles with linear interpolation.

    Values are counted, put in one range-partitioned order per (group, value) and
    addressed by position, so neither a hot group nor a column of all-distinct
    values is ever held by one task.
    """
    keys = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ends = running_total(counts, order=[*[F.col(k) for k in keys], F.col(value)], amount="__n", name="__end")
    ends = ends.withColumn("__first", F.col("__end") - F.col("__n"))
    spans = ends.groupBy(*keys).agg(F.min("__first").alias("__base"), F.sum("__n").alias("__total"))
    # Without keys there is exactly one span row.
    rows = ends.join(spans, keys) if keys else ends.join(F.broadcast(spans))
    picks, last = [], F.col("__total") - 1
    for q in quantiles:
        low = F.floor(last * F.lit(float(q))) + F.col("__base")
        high = F.ceil(last * F.lit(float(q))) + F.col("__base")
        for name, at in (("lo", low), ("hi", high)):
            inside = (F.col("__first") <= at) & (at < F.col("__end"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}{_label(q)}"))
    found = rows.groupBy(*keys).agg(F.max("__total").alias("n"), *picks)
    out = []
    for q in quantiles:
        place = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"__lo{_label(q)}"), F.col(f"__hi{_label(q)}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(_label(q)))
    return found.select(*keys, "n", *out)


def _label(q: float) -> str:
    return f"p{round(q * 100)}"
