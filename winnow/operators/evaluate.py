"""Evaluation against human labels: box matching, abstention-aware accuracy, preferences, gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.numeric import ratio
from ..session import broadcast_if_small, cut, require_empty
from .ranking import exact_percentiles

TIE_EPSILON = 1e-9
#: Boxes of both sides up to which an image is paired without a grid.
CROWDED = 256
# Reasons a person may give for an ungradable label.
UNGRADABLE_REASONS = ("occlusion", "small_face", "pose", "lighting", "blur", "other")


def box_edges(predicted: DataFrame, truth: DataFrame, *, image: str, box: str = "box", p: str = "pred_id", t: str = "truth_id", threshold: float = 0.5) -> DataFrame:
    """(image, pred, truth, overlap) of pairs that reach the threshold.

    An image of at most ``CROWDED`` boxes is paired as it is. The boxes of a larger
    one meet through a grid sized to each box: a pair overlapping by at least
    the threshold has sides within a factor of each other, so its size levels
    are equal or adjacent and its centres lie in neighbouring cells. An image
    with very many boxes is therefore spread over cells, not paired in full.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")

    def keyed(df: DataFrame, name: str, alias: str) -> DataFrame:
        placed = F.col(f"{box}.x").isNotNull() & F.col(f"{box}.y").isNotNull()
        return df.filter(placed & (F.col(f"{box}.w") > 0) & (F.col(f"{box}.h") > 0)).select(
            image, F.col(name), F.col(box).alias(alias)
        )

    def overlapping(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("overlap", iou("pb", "tb")).filter(F.col("overlap") >= threshold).select(image, p, t, "overlap")

    a, b = keyed(predicted, p, "pb"), keyed(truth, t, "tb")
    sizes = a.select(image).union(b.select(image)).groupBy(image).agg(F.count("*").alias("n"))
    crowded = cut(sizes.filter(F.col(image).isNotNull() & (F.col("n") > CROWDED)).select(image))
    if crowded.isEmpty():
        return overlapping(a.join(b, image))
    named = broadcast_if_small(crowded)
    few = a.join(named, image, "left_anti").join(b, image)
    many = _grid_pairs(a.join(named, image, "left_semi"), b.join(named, image, "left_semi"), image, threshold)
    return overlapping(few).unionByName(overlapping(many))


def _grid_pairs(a: DataFrame, b: DataFrame, image: str, threshold: float) -> DataFrame:
    """Boxes ``pb`` and ``tb`` of one image that may overlap by ``threshold``, each pair once."""
    levels = int(np.ceil(-np.log2(threshold))) if threshold < 1 else 0
    # Centres of matching boxes are within this many truth sides of each other.
    far = max(1, int(np.ceil((1 / threshold - 1) / 2)))

    def level(v: Column) -> Column:
        return F.floor(F.log2(F.greatest(v, F.lit(1e-300)))).cast("long")

    def side(lev: str) -> Column:
        return F.pow(F.lit(2.0), F.col(lev) + 1) * far

    def home(centre: Column, lev: str) -> Column:
        return F.floor(centre / (4 * side(lev))).cast("long")

    def around(centre: Column, lev: str) -> Column:
        return F.array_distinct(F.array(home(centre - side(lev), lev), home(centre + side(lev), lev)))

    b = b.withColumn("lw", level(F.col("tb.w"))).withColumn("lh", level(F.col("tb.h")))
    b = b.withColumn("cx", home(F.col("tb.x") + F.col("tb.w") / 2, "lw")).withColumn(
        "cy", home(F.col("tb.y") + F.col("tb.h") / 2, "lh")
    )
    steps = [F.lit(i) for i in range(-levels, levels + 1)]
    a = a.withColumn("lw", F.explode(F.array(*[level(F.col("pb.w")) + s for s in steps]))).withColumn(
        "lh", F.explode(F.array(*[level(F.col("pb.h")) + s for s in steps]))
    )
    a = a.withColumn("cx", F.explode(around(F.col("pb.x") + F.col("pb.w") / 2, "lw"))).withColumn(
        "cy", F.explode(around(F.col("pb.y") + F.col("pb.h") / 2, "lh"))
    )
    return a.join(b, [image, "lw", "lh", "cx", "cy"])


def match_boxes(predicted: DataFrame, truth: DataFrame, *, image: str, box: str = "box", p: str = "pred_id", t: str = "truth_id", threshold: float = 0.5) -> DataFrame:
    """Maximum-cardinality, then maximum-overlap matching per image.

    Pairs whose both boxes touch nothing else are settled as columns. Only the
    remaining connected clusters, whose size is a handful of boxes around one
    object, go to a per-cluster assignment.
    """
    edges = cut(box_edges(predicted, truth, image=image, box=box, p=p, t=t, threshold=threshold))
    pd_ = edges.groupBy(image, p).agg(F.count("*").alias("np"))
    td = edges.groupBy(image, t).agg(F.count("*").alias("nt"))
    tagged = edges.join(pd_, [image, p]).join(td, [image, t])
    sole = tagged.filter((F.col("np") == 1) & (F.col("nt") == 1)).select(image, p, t, "overlap")
    rest = tagged.filter((F.col("np") > 1) | (F.col("nt") > 1)).select(image, p, t, "overlap")
    rest = cut(rest)
    if rest.isEmpty():
        return sole
    # A given number of tasks: the clusters are few bytes but much work, and would be put into one task.
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    clusters = _clusters(rest, image, p, t).repartition(tasks, image, "cluster")
    listed = clusters.groupBy(image, "cluster").agg(F.collect_list(F.struct(p, t, "overlap")).alias("pairs"))
    solved = listed.select(image, "pairs").mapInArrow(_assign(image, p, t), edges.select(image, p, t, "overlap").schema)
    return sole.unionByName(solved)


def _clusters(edges: DataFrame, image: str, p: str, t: str) -> DataFrame:
    """Connected components of the overlap graph, labelled by their smallest prediction."""
    labels = cut(edges.select(image, p).distinct().withColumn("cluster", F.col(p)))
    while True:
        via_truth = (
            edges.join(labels, [image, p]).groupBy(image, t).agg(F.min("cluster").alias("cluster"))
        )
        moved = cut(
            edges.join(via_truth, [image, t])
            .groupBy(image, p)
            .agg(F.min("cluster").alias("cluster"))
        )
        changed = moved.join(
            labels.select(image, p, F.col("cluster").alias("old")), [image, p]
        ).filter(F.col("cluster") != F.col("old"))
        done = changed.isEmpty()
        labels = moved
        if done:
            return edges.join(labels, [image, p])


def _assign(image: str, p: str, t: str):
    def solve(batches):
        for batch in batches:
            images, rows = batch.column(image), []
            for n, pairs in enumerate(batch.column("pairs").to_pylist()):
                ps, ts = sorted({pair[p] for pair in pairs}), sorted({pair[t] for pair in pairs})
                pi, ti = {v: i for i, v in enumerate(ps)}, {v: i for i, v in enumerate(ts)}
                weight = np.zeros((len(ps), len(ts)))
                for pair in pairs:
                    weight[pi[pair[p]], ti[pair[t]]] = pair["overlap"]
                rows += [(n, ps[i], ts[j], weight[i, j]) for i, j in best_assignment(weight)]
            at, left, right, overlap = zip(*rows) if rows else ((), (), (), ())
            kind = batch.schema.field("pairs").type.value_type
            yield pa.RecordBatch.from_arrays(
                [images.take(pa.array(at, pa.int64())), pa.array(left, kind.field(p).type), pa.array(right, kind.field(t).type), pa.array(overlap, pa.float64())],
                names=[image, p, t, "overlap"],
            )

    return solve


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positive weight: as many as possible, then the largest total.

    Repeatedly extends the matching along the best augmenting path, found by
    Bellman-Ford relaxation over the small cluster.
    """
    n, m = weight.shape
    weight = weight.tolist()
    row, col = [-1] * n, [-1] * m
    while True:
        gain = [-np.inf] * m
        back = [-1] * m
        for j in range(m):
            for i in range(n):
                if row[i] < 0 and weight[i][j] > gain[j] and weight[i][j] > 0:
                    gain[j], back[j] = weight[i][j], i
        for _ in range(n + m):
            moved = False
            for j in range(m):
                i = col[j]
                if i < 0 or gain[j] == -np.inf:
                    continue
                base = gain[j] - weight[i][j]
                for k in range(m):
                    if k != j and weight[i][k] > 0 and base + weight[i][k] > gain[k] + 1e-12:
                        gain[k], back[k], moved = base + weight[i][k], i, True
            if not moved:
                break
        ends = [j for j in range(m) if col[j] < 0 and gain[j] > -np.inf]
        if not ends:
            return [(i, row[i]) for i in range(n) if row[i] >= 0]
        j = max(ends, key=lambda e: (gain[e], -e))
        while j >= 0:
            i = back[j]
            previous = row[i]
            row[i], col[j] = j, i
            j = previous


def detection_counts(predicted: DataFrame, truth: DataFrame, matches: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """tp / fp / fn with precision and recall, NULL when undefined."""
    keys = list(by)
    p = predicted.groupBy(*keys).agg(F.count("*").alias("np"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("nt"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("tp"))
    joined = p.join(t, keys, "full").join(m, keys, "full").na.fill(0, ["np", "nt", "tp"]) if keys else (
        p.join(F.broadcast(t)).join(F.broadcast(m))  # one row each
    )
    return joined.select(
        *keys,
        "tp",
        (F.col("np") - F.col("tp")).alias("fp"),
        (F.col("nt") - F.col("tp")).alias("fn"),
        ratio("tp", "np").alias("precision"),
        ratio("tp", "nt").alias("recall"),
    )


def abstention_report(pairs: DataFrame, *, truth: str = "truth", prediction: str = "prediction", classes: Sequence[str] = ("open", "closed"), by: Sequence[str] = ()) -> DataFrame:
    """Coverage and accuracy where a prediction may abstain; ungradable truth is excluded."""
    gradable = pairs.filter(F.col(truth).isin(*classes))
    answered = F.coalesce(F.col(prediction).isin(*classes), F.lit(False))
    right = answered & (F.col(truth) == F.col(prediction))
    out = gradable.groupBy(*by).agg(
        F.count("*").alias("gradable"),
        F.count_if(answered).alias("answered"),
        F.count_if(right).alias("correct"),
        F.count_if(answered & ~right).alias("incorrect"),
        F.count_if(~answered).alias("abstained"),
    )
    return (
        out.withColumn("coverage", ratio("answered", "gradable"))
        .withColumn("accuracy_when_answered", ratio("correct", "answered"))
        .withColumn("end_to_end_rate", ratio("correct", "gradable"))
    )


def confusion(pairs: DataFrame, *, truth: str = "truth", prediction: str = "prediction", classes: Sequence[str] = ("open", "closed")) -> DataFrame:
    answered = F.when(F.col(prediction).isin(*classes), F.col(prediction)).otherwise("abstain")
    return (
        pairs.filter(F.col(truth).isin(*classes))
        .groupBy(F.col(truth).alias("truth"), answered.alias("prediction"))
        .agg(F.count("*").alias("n"))
    )


def ungradable_report(pairs: DataFrame, *, reason: str = "reason", matched: str = "matched", prediction: str = "prediction", classes: Sequence[str] = ("open", "closed")) -> DataFrame:
    """How often a state is shown where people could not grade; per reason plus a total row."""
    det = F.coalesce(F.col(prediction).isin(*classes), F.lit(False))
    unc = F.coalesce(F.col(prediction) == "uncertain", F.lit(False))
    hit = F.col(matched)
    aggs = [
        F.count("*").alias("total"),
        F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("missing"),
        F.count_if(hit & det).alias("determinate"),
        F.count_if(hit & unc).alias("uncertain"),
        F.count_if(hit & ~det & ~unc).alias("hidden"),
    ]
    per = pairs.groupBy(F.coalesce(reason, F.lit("unspecified")).alias("reason")).agg(*aggs)
    sums = ["total", "matched", "missing", "determinate", "uncertain", "hidden"]
    whole = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).select(F.lit("(all)").alias("reason"), *sums)
    return (
        per.unionByName(whole)
        .withColumn("determinate_rate", ratio("determinate", "matched"))
        .withColumn("display_rate", ratio(F.col("determinate") + F.col("uncertain"), "matched"))
    )


def group_success(ranked: DataFrame, acceptable: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Per group: is the first-ranked member acceptable?"""
    top = ranked.filter(F.col("rank") == 1).select(*group, id)
    ok = acceptable.select(*group, id, F.lit(True).alias("hit")).distinct()
    return top.join(ok, [*group, id], "left").select(
        *group, F.col(id).alias("top_id"), F.coalesce("hit", F.lit(False)).alias("success")
    )


def ablation_scores(terms: Column, names: Sequence[str]) -> Column:
    """array<struct<variant, score>>: full score and each leave-one-term-out mean, NULL when nothing remains."""

    def mean(kept: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.weight)
        return F.when(total > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.score * x.weight) / total)

    live = F.filter(terms, lambda x: x.score.isNotNull() & (x.weight > 0))

    def without(name: str) -> Column:
        kept = F.filter(live, lambda x: x["name"] != name)
        return F.struct(F.lit(f"without_{name}").alias("variant"), mean(kept).alias("score"))

    full = F.struct(F.lit("full").alias("variant"), mean(live).alias("score"))
    return F.array(full, *[without(n) for n in names])


def preference_report(pairs: DataFrame, *, epsilon: float = TIE_EPSILON) -> DataFrame:
    """Agreement with human pair preferences per (dimension, variant).

    ``pairs``: dimension, preference (a/b/tie/ungradable), variants_a, variants_b as
    built by :func:`ablation_scores`. Each pair carries a handful of variants.
    """
    zipped = F.zip_with(
        "variants_a",
        "variants_b",
        lambda a, b: F.struct(
            a.variant.alias("variant"),
            F.when(F.abs(a.score - b.score) <= epsilon, "tie")
            .when(a.score > b.score, "a")
            .when(a.score < b.score, "b")
            .alias("said"),
        ),
    )
    full = F.get(F.filter("judged", lambda v: v.variant == "full"), F.lit(0)).said
    rows = (
        pairs.filter(F.col("preference") != "ungradable")
        .withColumn("judged", zipped)
        .withColumn("full_said", full)
        .select("dimension", "preference", "full_said", F.explode("judged").alias("v"))
        .select("dimension", "preference", "full_said", "v.variant", "v.said")
    )
    hit = F.coalesce(F.col("said") == F.col("preference"), F.lit(False))
    full_hit = F.coalesce(F.col("full_said") == F.col("preference"), F.lit(False))
    both = F.col("said").isNotNull() & F.col("full_said").isNotNull()
    out = rows.groupBy("dimension", "variant").agg(
        F.count("*").alias("gradable"),
        F.count("said").alias("answered"),
        F.count_if(hit).alias("correct"),
        F.count_if(both).alias("paired"),
        F.count_if(both & hit).alias("variant_correct"),
        F.count_if(both & full_hit).alias("full_correct"),
    )
    return (
        out.withColumn("coverage", ratio("answered", "gradable"))
        .withColumn("agreement", ratio("correct", "answered"))
        .withColumn("end_to_end", ratio("correct", "gradable"))
        .withColumn("paired_delta", ratio(F.col("variant_correct") - F.col("full_correct"), "paired"))
    )


def percentiles(df: DataFrame, *, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return exact_percentiles(df, value=value, quantiles=quantiles, by=by)


def group_keys(groups: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Kind, size and an order-independent member digest per group: equal sets share a key.

    The digest adds up hashes of the ids, so large groups are never listed.
    """
    h = F.sha2(F.col(id).cast("string"), 256)
    parts = [
        F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(3)
    ]
    return groups.groupBy(*group).agg(
        F.count("*").alias("size"), F.concat_ws("-", *parts).alias("members_digest")
    )


def dataset_gate(n_rows: DataFrame, keys: DataFrame, *, kind: str = "kind", minimum_rows: int = 300, minimum_bursts: int = 60) -> DataFrame:
    """One row: unique member sets by kind and whether the design minimum is met."""
    unique = keys.select(kind, "size", "members_digest").distinct()
    counts = unique.agg(
        F.count_if(F.col(kind) == "burst").alias("unique_burst_groups"),
        F.count_if(F.col(kind) == "duplicate").alias("unique_duplicate_groups"),
    )
    total = n_rows.agg(F.count("*").alias("rows"))
    return total.join(F.broadcast(counts)).withColumn(  # one row each
        "satisfied",
        (F.col("rows") >= minimum_rows) & (F.col("unique_burst_groups") >= minimum_bursts),
    )


def label_violations(predictions: DataFrame, labels: DataFrame, *, key: str, fingerprint: Sequence[str]) -> DataFrame:
    """Missing, extra, incomplete or stale labels; evaluation requires none."""
    p = predictions.select(key, *[F.col(c).alias(f"p_{c}") for c in fingerprint], F.lit(True).alias("in_p"))
    lab = labels.select(key, *fingerprint, "complete", F.lit(True).alias("in_l"))
    same = F.lit(True)
    for c in fingerprint:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    reason = (
        F.when(F.col("in_l").isNull(), "label_missing")
        .when(F.col("in_p").isNull(), "label_extra")
        .when(~F.coalesce("complete", F.lit(False)), "incomplete")
        .when(~same, "fingerprint_differs")
    )
    return p.join(lab, key, "full").withColumn("reason", reason).filter("reason IS NOT NULL").select(key, "reason")


def truth_box_violations(truth: DataFrame, *, key: Sequence[str], box: str = "box", left: str = "left_eye", right: str = "right_eye", reason: str = "reason") -> DataFrame:
    """Labelled boxes outside the unit frame, unknown states or unsupported reasons."""
    b = F.col(box)
    inside = (b.x >= 0) & (b.y >= 0) & (b.w > 0) & (b.h > 0) & (b.x + b.w <= 1 + 1e-9) & (b.y + b.h <= 1 + 1e-9)
    states = F.col(left).isin("open", "closed", "ungradable") & F.col(right).isin("open", "closed", "ungradable")
    excuse = F.col(reason).isNull() | (
        F.col(reason).isin(*UNGRADABLE_REASONS) & ((F.col(left) == "ungradable") | (F.col(right) == "ungradable"))
    )
    why = (
        F.when(~F.coalesce(inside, F.lit(False)), "box_outside_frame")
        .when(~F.coalesce(states, F.lit(False)), "unknown_state")
        .when(~F.coalesce(excuse, F.lit(False)), "unsupported_reason")
    )
    return truth.withColumn("why", why).filter("why IS NOT NULL").select(*key, "why")


def require_valid_labels(predictions: DataFrame, labels: DataFrame, *, key: str, fingerprint: Sequence[str]) -> None:
    require_empty(label_violations(predictions, labels, key=key, fingerprint=fingerprint), "labels are not usable")
