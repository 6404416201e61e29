"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws ``-ln(u) / quality``: ordered by that key, a prefix is a weighted sample without replacement. A source whose
target is more than its size is taken whole as often as it fits (complete epochs); the rest of the target is the prefix of
its documents in key order that holds just as many words. The last document of the prefix is taken in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.session import cut

#: Key ranges a source is cut into for its prefix sums; each range is summed on its own.
RANGES = 4096


def quality_weight(text="text"):
    """Share of letters among the visible characters, from 0.05 to 1; 1 for a text without any."""
    seen = F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""))
    letters = seen - F.length(F.regexp_replace(text, "[^!-@\\[-`{-~]+", ""))
    return F.when(seen > 0, F.greatest(F.lit(0.05), letters / seen)).otherwise(F.lit(1.0))


def uniform(seed: int, doc_id="doc_id"):
    """A number in (0, 1) for each document and seed: 52 bits of an MD5 digest. No id counts as the text ``null``."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight: with sources ordered by how soon
    they are full, the first level that does not fill the next source holds. The table has a row per source only, so its order is
    taken in one task.
    """
    code_points = F.encode("source", "utf-8")
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), code_points))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_fill = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), code_points)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weights", F.sum("weight").over(every))
    full, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (F.col("total") - full) / (F.col("all_weights") - used))
    rows = rows.withColumn("turn", F.row_number().over(by_fill))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("turn"))
    rows = rows.withColumn("level", F.min_by("level", holds).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, quality, sort_key, taken`` for every row of ``docs (doc_id, text, source, ...)``.

    Sizes are words; a null text has 0. Reruns agree because keys come from doc_id and seed; ties go to the smaller doc_id and
    rows that repeat one are told apart by size only (equal rows share their words in either order). A source without words has
    target 0 and takes nothing. An empty table gives an empty result. Prefix sums run inside key ranges of a source, with
    the sums of the ranges before added, so no source is sorted in one task.
    """
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    quality = F.coalesce(quality_weight(), F.lit(1.0))
    rows = docs.select("doc_id", "source", size.alias("size"), quality.alias("quality"), uniform(seed).alias("u"))
    rows = rows.withColumn("sort_key", -F.log("u") / F.col("quality"))
    rows = cut(rows.withColumn("range", F.floor((F.lit(1.0) - F.exp(-F.col("sort_key"))) * RANGES).cast("int")).drop("u"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    known = cut(sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(sums["source"].alias("s"), F.col("range").alias("r"), "start", "source_size", "target"))
    joined = rows.join(known, rows["source"].eqNullSafe(known["s"]) & (rows["range"] == known["r"]))
    inside = W.partitionBy("source", "range").orderBy("sort_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("prefix", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "quality", "sort_key", (epochs * F.col("size") + part).cast("long").alias("taken"))
