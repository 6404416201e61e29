"""Run-to-run comparison, determinism, device and pipeline audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..session import require_empty
from .ranking import exact_percentiles


def key_differences(before: DataFrame, after: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Keys present in only one run."""
    keys = list(key)
    lost = before.select(*keys).join(after.select(*keys), keys, "left_anti").withColumn("side", F.lit("before_only"))
    new = after.select(*keys).join(before.select(*keys), keys, "left_anti").withColumn("side", F.lit("after_only"))
    return lost.unionByName(new)


def paired_runs(before: DataFrame, after: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer pairing with ``before_``/``after_`` columns and a ``side`` marker."""
    b = before.select(*key, *[F.col(c).alias(f"before_{c}") for c in columns], F.lit(True).alias("__b"))
    a = after.select(*key, *[F.col(c).alias(f"after_{c}") for c in columns], F.lit(True).alias("__a"))
    side = F.when(F.col("__b").isNull(), "after_only").when(F.col("__a").isNull(), "before_only").otherwise("both")
    return b.join(a, list(key), "full").withColumn("side", side).drop("__a", "__b")


def transitions(pairs: DataFrame, column: str) -> DataFrame:
    """State-transition counts between two runs."""
    return pairs.groupBy(F.col(f"before_{column}").alias("before"), F.col(f"after_{column}").alias("after")).agg(
        F.count("*").alias("n")
    )


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, median and max, the median by position rather than from a collected column."""
    spread = exact_percentiles(df, value=value, quantiles=[0.0, 0.5, 1.0], by=by)
    return spread.select(*by, F.col("p0").alias("min"), F.col("p50").alias("median"), F.col("p100").alias("max"))


def frozen_differences(pairs: DataFrame, *, key: Sequence[str], frozen: Sequence[str]) -> DataFrame:
    """One row per frozen column that differs."""
    tests = [
        F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in frozen
    ]
    changed = F.filter(F.array(*tests), lambda c: c.isNotNull())
    return pairs.select(*key, F.explode(changed).alias("column"))


def compare_runs(before: DataFrame, after: DataFrame, *, key: Sequence[str], frozen: Sequence[str], numeric: str, categorical: str, tolerance: float = 1e-9) -> dict[str, DataFrame]:
    """Scoring audit: key sets and frozen columns must agree; deltas and transitions are reported."""
    pairs = paired_runs(before, after, key=key, columns=[*frozen, numeric, categorical])
    require_empty(pairs.filter("side <> 'both'").select(*key, "side"), "run key sets differ")
    require_empty(frozen_differences(pairs, key=key, frozen=frozen), "a frozen column changed")
    deltas = pairs.withColumn("delta", F.col(f"after_{numeric}") - F.col(f"before_{numeric}"))
    return {
        "transitions": transitions(pairs, categorical),
        "delta": summary(deltas, "delta").join(
            F.broadcast(deltas.agg(F.count_if(F.abs("delta") > tolerance).alias("changed")))  # one row each
        ),
    }


def mask_violations(pairs: DataFrame, *, key: Sequence[str], state: str = "state") -> DataFrame:
    """An optional gate may hide a value; changing or restoring one is a violation."""
    b, a = F.col(f"before_{state}"), F.col(f"after_{state}")
    why = F.when(b.isNull() & a.isNotNull(), "restored").when(a.isNotNull() & (a != b), "changed")
    return pairs.withColumn("why", why).filter("why IS NOT NULL").select(*key, "why")


def count_changes(pairs: DataFrame, column: str) -> DataFrame:
    """One row: rows with more, fewer and the same count after a detector change."""
    diff = F.col(f"after_{column}") - F.col(f"before_{column}")
    return pairs.agg(
        F.count_if(diff == 0).alias("same"), F.count_if(diff > 0).alias("more"), F.count_if(diff < 0).alias("fewer")
    )


def device_audit(pairs: DataFrame, *, score: str = "score", verdict: str = "verdict", count: str = "faces", vector: str | None = None, by: Sequence[str] = (), max_error: float = 0.5, min_cosine: float = 0.9999) -> DataFrame:
    """Agreement of two devices on counts, scores, verdicts and, with ``vector``, unit vectors: one row for each ``by``.

    Without a pair of vectors the vector gate fails, as nothing was compared."""
    error = F.max(F.abs(F.col(f"after_{score}") - F.col(f"before_{score}")))
    aggs = [
        F.coalesce(F.bool_and(F.col(f"after_{count}") == F.col(f"before_{count}")), F.lit(False)).alias("counts_equal"),
        error.alias("max_score_error"),
        F.count_if(F.col(f"after_{verdict}") != F.col(f"before_{verdict}")).alias("verdict_changes"),
    ]
    if vector:
        aggs.append(F.min(dot(f"before_{vector}", f"after_{vector}")).alias("min_cosine"))
    out = pairs.groupBy(*by).agg(*aggs)
    ok = F.col("counts_equal") & (F.col("max_score_error") < max_error) & (F.col("verdict_changes") == 0)
    if vector:
        ok = ok & (F.col("min_cosine") > min_cosine)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def repeat_audit(rows: DataFrame, expected: DataFrame, *, path: str = "path", source: str = "source", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(per source digest facts, violations): every copy of a source must have one payload digest."""
    digested = rows.select(path, F.sha2(F.col(payload), 256).alias("digest"))
    joined = digested.join(expected.select(path, source), path, "full")
    per = joined.filter(F.col(source).isNotNull() & F.col("digest").isNotNull()).groupBy(source).agg(
        F.count("*").alias("copies"), F.min("digest").alias("lo"), F.max("digest").alias("hi")
    )
    facts = per.select(source, "copies", (F.col("lo") == F.col("hi")).alias("consistent"))
    stray = joined.filter(F.col(source).isNull() | F.col("digest").isNull()).select(
        F.col(path).cast("string").alias("subject"),
        F.when(F.col("digest").isNull(), "missing").otherwise("unexpected").alias("why"),
    )
    differing = facts.filter(~F.col("consistent")).select(
        F.col(source).cast("string").alias("subject"), F.lit("differs").alias("why")
    )
    repeated = rows.groupBy(path).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col(path).cast("string").alias("subject"), F.lit("repeated").alias("why")
    )
    return facts, stray.unionByName(differing).unionByName(repeated)


def run_digest(rows: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    """One row naming a whole run: sums of 60-bit slices of the row digests, in any order."""
    d = F.sha2(F.concat_ws("\u0001", *columns), 256)
    return rows.select(d.alias("d")).agg(
        F.count("*").alias("rows"),
        *[
            F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"digest{i}")
            for i in range(4)
        ],
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n) of several categorical columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    )


def histogram(df: DataFrame, value: str, *, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts; values outside fall into the first or last bin."""
    i = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), i)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def phase_report(runs: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Per run: seconds by phase, throughput and budget checks.

    ``runs``: run, phase, seconds, count.
    """
    def seconds(*names: str):
        return F.sum(F.when(F.col("phase").isin(*names), F.col("seconds")))

    return (
        runs.groupBy(run)
        .agg(
            seconds("first_scan", "first_analysis").alias("first_seconds"),
            seconds("incremental_scan", "cached_analysis").alias("incremental_seconds"),
            seconds("first_analysis").alias("__analysis"),
            F.max(F.when(F.col("phase") == "first_analysis", F.col("count"))).alias("__count"),
        )
        .withColumn("per_second", F.try_divide("__count", "__analysis"))
        .drop("__analysis", "__count")
    )


def targets_passed(report: DataFrame, budgets: dict[str, tuple[str, float]], *, sampled: str | None = None) -> DataFrame:
    """``report`` with one boolean for each target, ``name: (column, budget)``, and ``all_targets_passed``.

    A target whose column is missing in a row was not measured, so it does not pass; ``sampled`` counts measurements that must not be none.
    """
    checks = {name: F.coalesce(F.col(column) <= F.lit(float(budget)), F.lit(False)) for name, (column, budget) in budgets.items()}
    if sampled:
        checks["sampling"] = F.coalesce(F.col(sampled) > 0, F.lit(False))
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return report.withColumns(checks).withColumn("all_targets_passed", every)


def pipeline_passed(runs: DataFrame, *, expected: int) -> DataFrame:
    """One row: did scan, analysis and the repeat reach every row without errors?

    ``runs``: step, state, errors, scanned, analyzed, reused, seq.
    """
    return runs.agg(
        (
            F.coalesce(F.bool_and((F.col("state") == "completed") & (F.col("errors") == 0)), F.lit(False))
            & (F.coalesce(F.max("scanned"), F.lit(0)) == expected)
            & (F.coalesce(F.max("analyzed"), F.lit(0)) == expected)
            & (F.coalesce(F.max_by("reused", "seq"), F.lit(0)) == expected)
        ).alias("passed")
    )
