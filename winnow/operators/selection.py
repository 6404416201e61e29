"""Group assessment, member comparison, quota plans, intents and constraints.

Per-group facts (reference, counts) are aggregates joined back to the members,
so a group that holds a third of all rows is reduced on the map side and never
gathered. Only the quota cut uses a ranking, pruned per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..session import cut, require_empty
from .ranking import rank_within

CLOSE_GAP = 5.0
COMPONENT_MARGIN = 10.0


def best_reference(members: DataFrame, *, group: Sequence[str], id: str = "photo_id", score: str = "score", ok: str = "usable") -> DataFrame:
    """Best usable row per group, ties to the lowest id.

    Two fixed-width aggregates instead of one over structs keep hash aggregation.
    """
    live = members.select(*group, id, score, ok).filter(F.col(ok))
    top = live.groupBy(*group).agg(F.max(score).alias("reference_score"))
    return (
        live.join(top, list(group))
        .filter(F.col(score) == F.col("reference_score"))
        .groupBy(*group, "reference_score")
        .agg(F.min(id).alias("reference_id"))
    )


def assess_groups(members: DataFrame, *, group: Sequence[str], id: str = "photo_id", close: float = CLOSE_GAP) -> tuple[DataFrame, DataFrame]:
    """(per member reasons, per group summary).

    ``members``: group, id, score, verdict, usable, valid, face_count, face_score,
    sharpness_score; an unanalysed member has NULLs and stays visible.
    """
    # The scored columns are read three times below; they are computed once.
    members = cut(members.select(*group, id, "score", "verdict", "usable", "valid", "face_count", "face_score", "sharpness_score"))
    ref = best_reference(members.withColumn("usable", F.coalesce("usable", F.lit(False))), group=group, id=id)
    facts = members.select(
        *group,
        F.col(id).alias("reference_id"),
        F.col("face_count").alias("ref_faces"),
        F.col("face_score").alias("ref_face"),
        F.col("sharpness_score").alias("ref_sharp"),
    )
    ref = ref.join(facts, [*group, "reference_id"])
    rows = members.join(ref, list(group), "left")
    valid = F.coalesce("valid", F.lit(False))
    ok = F.coalesce("usable", F.lit(False))
    gap = F.greatest(F.col("reference_score") - F.col("score"), F.lit(0.0))
    is_ref = F.col(id) == F.col("reference_id")
    has_ref = F.col("reference_id").isNotNull()
    lower = lambda mine, best: (F.col(mine) + COMPONENT_MARGIN < F.col(best))
    higher = lambda mine, best: (F.col(best) + COMPONENT_MARGIN < F.col(mine))
    tests = [
        ("review_observations", ~ok | (F.col("verdict") == "review")),
        ("technical_reference", has_ref & is_ref),
        ("close_quality", has_ref & ~is_ref & (gap <= close) & ok),
        ("face_detail_lower", lower("face_score", "ref_face")),
        ("face_detail_higher", higher("face_score", "ref_face")),
        ("preview_detail_lower", lower("sharpness_score", "ref_sharp")),
        ("preview_detail_higher", higher("sharpness_score", "ref_sharp")),
        ("different_face_count", has_ref & (F.col("face_count") != F.col("ref_faces"))),
    ]
    reasons = F.filter(
        F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for code, t in tests]),
        lambda r: r.isNotNull(),
    )
    out = (
        rows.withColumn("score_gap", F.when(valid & has_ref, gap))
        .withColumn("reasons", F.when(valid, reasons).otherwise(F.array(F.lit("analysis_unavailable"))))
        .withColumn("candidate", has_ref & ok & (F.col("reference_score") - F.col("score") <= close))
    )
    doubt = ~ok | ~F.coalesce(F.col("verdict") == "recommend", F.lit(False)) | F.array_contains("reasons", "different_face_count")
    summary = out.groupBy(*group).agg(
        F.max("reference_id").alias("reference_id"),
        F.count_if(F.coalesce("candidate", F.lit(False))).alias("candidates"),
        F.coalesce(F.bool_or(doubt), F.lit(False)).alias("needs_review"),
    )
    return (
        out.select(*group, id, "score_gap", "reasons", F.coalesce("candidate", F.lit(False)).alias("candidate")),
        summary,
    )


def face_points(rows: DataFrame, *, keys: Sequence[str], faces: str = "faces", minimum: float = 0.55) -> DataFrame:
    """One row per placed face: normalised centre and area fraction."""
    f = F.col("f")
    return (
        rows.filter((F.col("width") > 0) & (F.col("height") > 0))
        .select(*keys, "width", "height", F.explode(faces).alias("f"))
        .filter(
            (f.confidence >= minimum)
            & finite(f.bbox.x) & finite(f.bbox.y) & finite(f.bbox.w) & finite(f.bbox.h)
            & (f.bbox.w > 0) & (f.bbox.h > 0)
        )
        .select(
            *keys,
            f.index.alias("face"),
            ((f.bbox.x + f.bbox.w / 2) / F.col("width")).alias("x"),
            ((f.bbox.y + f.bbox.h / 2) / F.col("height")).alias("y"),
            (f.bbox.w * f.bbox.h / F.col("width") / F.col("height")).alias("area"),
        )
    )


def mutual_nearest(reference: DataFrame, other: DataFrame, *, pair: Sequence[str], low: float = 0.5, high: float = 2.0, reach: float = 0.15, margin: float = 0.05) -> DataFrame:
    """(pair, face_a, face_b) of faces that are each other's clear nearest match.

    Both inputs: pair, face, x, y, area. Comparable areas, distance within
    ``reach`` and at least ``margin`` ahead of the runner-up, in both directions.
    Reach bounds which cells can meet, so faces are joined through a grid of
    cells rather than all against all.
    """
    def cell(v: Column) -> Column:
        return F.floor(v / (2 * (reach + margin))).cast("long")

    def cells(v: Column) -> Column:
        r = reach + margin
        return F.array_distinct(F.array(cell(v - r), cell(v + r)))

    a = reference.select(*pair, F.col("face").alias("face_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("area").alias("aa"))
    b = other.select(*pair, F.col("face").alias("face_b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("area").alias("ba"))
    a = a.withColumn("cx", F.explode(cells(F.col("ax")))).withColumn("cy", F.explode(cells(F.col("ay"))))
    b = b.withColumn("cx", cell(F.col("bx"))).withColumn("cy", cell(F.col("by")))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = (
        a.join(b, [*pair, "cx", "cy"])
        .withColumn("d", d)
        # Anything farther than reach + margin can neither match nor spoil a margin.
        .filter((F.col("d") < reach + margin) & (F.col("aa") / F.col("ba")).between(low, high))
        .select(*pair, "face_a", "face_b", "d")
    )

    def clear(side: str, partner: str) -> DataFrame:
        # Smallest and second smallest distance per face with fixed-size state.
        first = near.groupBy(*pair, side).agg(F.min(F.struct("d", partner)).alias("one"))
        rest = (
            near.join(first, [*pair, side])
            .filter(F.col(partner) != F.col("one")[partner])
            .groupBy(*pair, side)
            .agg(F.min("d").alias("second"))
        )
        return (
            first.join(rest, [*pair, side], "left")
            .filter(
                (F.col("one.d") <= reach)
                & (F.col("second").isNull() | (F.col("second") - F.col("one.d") >= margin))
            )
            .select(*pair, side, F.col(f"one.{partner}").alias(partner))
        )

    return clear("face_a", "face_b").join(clear("face_b", "face_a"), [*pair, "face_a", "face_b"])


def compare_members(members: DataFrame, *, request: str = "request_id", id: str = "photo_id", chosen: DataFrame | None = None) -> DataFrame:
    """Score and exposure deltas and face counts against each request's reference.

    The reference is the chosen row, else the best usable one, else the first
    analysed member. Requests hold 2..32 rows.
    """
    members = cut(members.select(request, id, "pos", "score", "usable", "exposure_mean", "face_count"))
    best = best_reference(members.withColumn("usable", F.coalesce("usable", F.lit(False))), group=[request], id=id)
    first = (
        members.filter(F.col("score").isNotNull())
        .groupBy(request)
        .agg(F.min_by(id, "pos").alias("first_id"))
    )
    refs = members.select(request).distinct().join(best, request, "left").join(first, request, "left")
    if chosen is not None:
        refs = refs.join(chosen.select(request, F.col(id).alias("chosen_id")), request, "left")
        refs = refs.withColumn("ref", F.coalesce("chosen_id", "reference_id", "first_id"))
    else:
        refs = refs.withColumn("ref", F.coalesce("reference_id", "first_id"))
    base = members.select(request, F.col(id).alias("ref"), F.col("score").alias("rs"), F.col("exposure_mean").alias("re"))
    refs = refs.select(request, "ref").join(base, [request, "ref"], "left")
    ds, de = F.col("score") - F.col("rs"), F.col("exposure_mean") - F.col("re")
    return members.join(refs, request).select(
        request,
        id,
        F.col("ref").alias("reference_id"),
        F.when(finite(ds), ds).alias("score_delta"),
        F.when(finite(de), de).alias("exposure_delta"),
        "face_count",
    )


def face_states(members: DataFrame, intents: DataFrame, choices: DataFrame, matches: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Main-face state per member: reference, manual, absent, geometry_candidate, uncertain or stale.

    ``intents``: group, main_id, main_face, main_key. ``choices``: group, id, face,
    choice_key (face NULL = absent). ``matches``: group, id, main_face, face.
    A choice is valid only while its analysis key is the member's current one and
    the face still exists.
    """
    keys = members.select(*group, id, "analysis_key", "face_indices")
    main = intents.select(*group, "main_id", "main_face", "main_key")
    anchor = (
        main.join(
            keys.select(*group, F.col(id).alias("main_id"), F.col("analysis_key").alias("ak"), F.col("face_indices").alias("ai")),
            [*group, "main_id"],
            "left",
        )
        .withColumn(
            "anchor_ok",
            F.coalesce(
                (F.col("ak") == F.col("main_key")) & F.array_contains("ai", F.col("main_face")),
                F.lit(False),
            ),
        )
        .select(*group, "main_id", "main_face", "anchor_ok")
    )
    rows = (
        keys.join(anchor, list(group), "left")
        .join(choices.select(*group, id, F.col("face").alias("choice"), "choice_key"), [*group, id], "left")
        .join(matches.select(*group, id, "main_face", F.col("face").alias("matched")), [*group, id, "main_face"], "left")
    )
    has_anchor = F.col("main_id").isNotNull()
    chosen = F.col("choice_key").isNotNull()
    choice_ok = F.coalesce(
        (F.col("analysis_key") == F.col("choice_key"))
        & (F.col("choice").isNull() | F.array_contains("face_indices", F.col("choice"))),
        F.lit(False),
    )
    is_main = has_anchor & (F.col("main_id") == F.col(id))
    state = (
        F.when(has_anchor & ~F.col("anchor_ok"), "stale")
        .when(is_main, "reference")
        .when(chosen & ~choice_ok, "stale")
        .when(chosen & F.col("choice").isNull(), "absent")
        .when(chosen, "manual")
        .when(has_anchor & F.col("matched").isNotNull(), "geometry_candidate")
        .otherwise("uncertain")
    )
    face = (
        F.when(F.col("state") == "reference", F.col("main_face"))
        .when(F.col("state") == "manual", F.col("choice"))
        .when(F.col("state") == "geometry_candidate", F.col("matched"))
    )
    return rows.withColumn("state", state).select(*group, id, face.alias("face_index"), "state")


def plan_selection(members: DataFrame, intents: DataFrame, locks: DataFrame, *, group: Sequence[str], id: str = "photo_id", default_target: int = 1, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(member plan, group summary): keeps and locks first, then the best pending rows up to the target.

    ``members``: group, id, decision, usable, score, main_score (NULL when the main
    face is unknown). ``intents``: group, target_keep, has_main.
    """
    members = cut(members.select(*group, id, "decision", "usable", "score", "main_score"))
    flag = locks.select(id).distinct().withColumn("__lock", F.lit(True))
    rows = (
        members.join(flag, id, "left")
        .join(intents.select(*group, "target_keep", "has_main"), list(group), "left")
        .withColumn("target", F.coalesce("target_keep", F.lit(default_target)))
        .withColumn("has_main", F.coalesce("has_main", F.lit(False)))
        .withColumn("fixed", (F.col("decision") == "keep") | F.coalesce("__lock", F.lit(False)))
    )
    quality = F.when(F.col("has_main"), F.col("main_score")).otherwise(F.lit(0.0))
    rows = rows.withColumn("quality", quality).withColumn(
        "eligible",
        ~F.col("fixed")
        & (F.col("decision") == "pending")
        & F.coalesce("usable", F.lit(False))
        & finite("quality")
        & finite("score"),
    )
    counts = rows.groupBy(*group).agg(
        F.count_if("fixed").alias("fixed_n"), F.max("target").alias("target")
    ).withColumn("slots", F.greatest(F.col("target") - F.col("fixed_n"), F.lit(0)))
    open_rows = rows.filter("eligible").select(*group, id, "quality", "score").join(
        counts.filter("slots > 0").select(*group, "slots"), list(group)
    )
    order = [F.col("quality").desc(), F.col("score").desc(), F.col(id).asc()]
    widest = counts.agg(F.max("slots").alias("m")).first()["m"] or 0
    picked = (
        rank_within(open_rows, group=group, order=order, name="place", at_most=max(widest, 1))
        .filter(F.col("place") <= F.col("slots"))
        .select(*group, id, F.lit(True).alias("picked"))
    )
    plan = (
        rows.join(picked, [*group, id], "left")
        .withColumn("recommended", F.col("fixed") | F.coalesce("picked", F.lit(False)))
        .withColumn("pending_keep", F.col("recommended") & (F.col("decision") == "pending"))
        .select(*group, id, "decision", "fixed", "recommended", "pending_keep", "target", "has_main")
    )
    total = plan.groupBy(*group).agg(
        F.count_if("recommended").alias("recommended_n"),
        F.count_if("pending_keep").alias("pending_n"),
        F.max("target").alias("target"),
        F.bool_or("has_main").alias("has_main"),
    )
    remaining = F.greatest(F.col("target") - F.col("recommended_n"), F.lit(0))
    over = F.greatest(F.col("recommended_n") - F.col("target"), F.lit(0))
    doubt = F.lit(False)
    if states is not None:
        weak = states.groupBy(*group).agg(
            F.bool_or(~F.col("state").isin("reference", "manual")).alias("weak")
        )
        total = total.join(weak, list(group), "left")
        doubt = F.col("has_main") & F.coalesce("weak", F.lit(False))
    summary = total.select(
        *group,
        "recommended_n",
        "pending_n",
        remaining.alias("remaining_slots"),
        over.alias("over_target"),
        ((remaining > 0) | (over > 0) | doubt).alias("needs_review"),
    )
    return plan.select(*group, id, "recommended", "pending_keep"), summary


def keep_constraints(plan: DataFrame, configured: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Whether a row may be kept: recommended by every configured group it belongs to."""
    return (
        plan.join(configured.select(*group).distinct(), list(group), "left_semi")
        .groupBy(id)
        .agg(F.bool_and("recommended").alias("allowed"))
    )


def intent_violations(intents: DataFrame, members: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Rows that make a group intent invalid: target range, foreign locks or baselines, undecided locks."""
    sizes = members.groupBy(*group).agg(F.count("*").alias("n"))
    target = (
        intents.join(sizes, list(group), "left")
        .filter(
            F.col("target_keep").isNotNull()
            & ~F.col("target_keep").between(F.lit(1), F.coalesce("n", F.lit(0)))
        )
        .select(*group, F.lit(None).cast("long").alias(id), F.lit("target_out_of_range").alias("reason"))
    )
    listed = intents.select(*group, F.explode("locked_ids").alias(id), F.lit("lock").alias("what")).unionByName(
        intents.select(*group, F.explode("baseline_ids").alias(id), F.lit("baseline").alias("what"))
    )
    judged = listed.join(members.select(*group, id, "decision"), [*group, id], "left")
    foreign = judged.filter(F.col("decision").isNull()).select(
        *group, id, F.concat(F.col("what"), F.lit("_not_in_group")).alias("reason")
    )
    decided = judged.filter((F.col("what") == "lock") & F.col("decision").isin("reject", "flag")).select(
        *group, id, F.lit("lock_on_decided_row").alias("reason")
    )
    return target.unionByName(foreign).unionByName(decided)


def lock_changes(intents: DataFrame, *, group: Sequence[str], id: str = "photo_id") -> DataFrame:
    """Only the differences to the returned baseline: rows to lock and to unlock."""
    add = intents.select(*group, F.explode(F.array_except("locked_ids", "baseline_ids")).alias(id), F.lit("lock").alias("change"))
    drop = intents.select(*group, F.explode(F.array_except("baseline_ids", "locked_ids")).alias(id), F.lit("unlock").alias("change"))
    return add.unionByName(drop)


def accept_plan(plan: DataFrame, entities: DataFrame, live: DataFrame, *, id: str = "photo_id") -> DataFrame:
    """Keep requests of a plan after rechecking every source fingerprint; refuses whole on a change."""
    keeps = plan.filter("pending_keep").select(id).distinct()
    stored = entities.select(id, "mtime", "size_bytes")
    now = live.select(id, F.col("mtime").alias("m"), F.col("size_bytes").alias("s"))
    checked = keeps.join(stored, id).join(now, id, "left")
    moved = checked.filter(
        ~(F.col("mtime").eqNullSafe(F.col("m")) & F.col("size_bytes").eqNullSafe(F.col("s")))
    )
    require_empty(moved.select(id), "rows changed since analysis")
    return entities.join(keeps, id, "left_semi").select("project_id", id, F.lit("keep").alias("action"))
