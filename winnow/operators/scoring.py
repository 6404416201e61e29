"""Evidence-weighted scores: component breakdown, verdicts, reasons, settings changes and audits.

Input columns (missing evidence is NULL, never zero): sharpness_lap, sharpness_fft,
niqe, exposure struct<mean, shadow_clip, highlight_clip>, faces array<struct<index,
bbox struct<x,y,w,h>, confidence, left_eye struct<state, blink_score, ear>, right_eye,
smile_score, quality struct<sharpness_lap, shadow_clip, highlight_clip, crop_width,
crop_height>>>, width, height, preview_source, warnings array<string>.
All of it is one narrow stage of column expressions.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import placement_score
from ..functions.measures import exposure_score, fft_score, lap_score, niqe_score, region_quality
from ..functions.numeric import above, at_least, at_most, below, finite, let, measurements_valid
from ..settings import DETECTION_KEYS, SEMANTIC_KEYS, Settings

COMPONENTS = ("eyes", "sharpness", "face", "exposure", "smile")
TERM = "struct<name:string,score:double,weight:double>"

FACE_TYPE = (
    "array<struct<index:int,bbox:struct<x:double,y:double,w:double,h:double>,confidence:double,"
    "left_eye:struct<state:string,blink_score:double,ear:double>,"
    "right_eye:struct<state:string,blink_score:double,ear:double>,smile_score:double,"
    "quality:struct<sharpness_lap:double,shadow_clip:double,highlight_clip:double,"
    "crop_width:double,crop_height:double>>>"
)


INPUTS = ("sharpness_lap", "sharpness_fft", "niqe", "exposure", "faces", "width", "height", "preview_source", "warnings")
OUTPUTS = ("faces", "composition", "components", "weight_total", "score", "verdict", "evidence", "closed_eye", "valid", "usable")


def row(**bound: Column) -> SimpleNamespace:
    """Columns of one result by name; ``bound`` replaces some with already computed values."""
    return SimpleNamespace(**{c: F.col(c) for c in INPUTS} | bound)


def term(name: str | Column, score: Column, weight: Column | float) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return F.struct(label.alias("name"), score.cast("double").alias("score"), w.cast("double").alias("weight"))


def weighted_mean(terms: Column) -> Column:
    """Mean of the observed terms with the weights renormalised; NULL without observations."""
    seen = F.filter(terms, lambda t: t.score.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda s, t: s + t.weight)
    return F.when(
        total > 0, F.aggregate(seen, F.lit(0.0), lambda s, t: s + t.score * (t.weight / total))
    )


def observed(terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: t.score.isNotNull()))


def sharpness_terms(r, settings: Settings) -> Column:
    lap, fft, niqe = r.sharpness_lap, r.sharpness_fft, r.niqe
    has_niqe = finite(niqe) & F.lit(settings.enable_niqe)
    w = F.when(has_niqe, F.lit(float(settings.niqe_weight))).otherwise(F.lit(0.0))
    return F.array(
        term("laplacian", F.when(finite(lap), lap_score(lap)), 0.75 * (1.0 - w)),
        term("fft", F.when(finite(fft), fft_score(fft)), 0.25 * (1.0 - w)),
        term("niqe", F.when(has_niqe, niqe_score(niqe)), w),
    )


def _eye_score(eye: Column) -> Column:
    state = eye.state
    return F.when(eye.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(state == "open", 100.0).when(state == "uncertain", 50.0).when(state == "closed", 0.0)
    )


def _face_label(face: Column, tail: str) -> Column:
    return F.concat(F.lit("face_"), face.index.cast("string"), F.lit(tail))


def eye_terms(r) -> Column:
    pairs = F.transform(
        r.faces,
        lambda f: F.array(
            term(_face_label(f, "_left_eye"), _eye_score(f.left_eye), 1.0),
            term(_face_label(f, "_right_eye"), _eye_score(f.right_eye), 1.0),
        ),
    )
    return F.flatten(pairs)


def face_terms(r) -> Column:
    def score(f: Column) -> Column:
        q = f.quality
        usable = (
            finite(q.sharpness_lap)
            & finite(q.shadow_clip)
            & finite(q.highlight_clip)
            & (q.crop_width >= 3)
            & (q.crop_height >= 3)
        )
        return F.when(
            usable,
            region_quality(q.sharpness_lap, q.shadow_clip, q.highlight_clip, q.crop_width, q.crop_height),
        )

    return F.transform(r.faces, lambda f: term(_face_label(f, "_quality"), score(f), 1.0))


def smile_terms(r) -> Column:
    return F.transform(r.faces, lambda f: term(_face_label(f, "_smile"), f.smile_score * 100.0, 1.0))


def exposure_terms(r) -> Column:
    e = r.exposure
    ok = finite(e.mean) & finite(e.shadow_clip) & finite(e.highlight_clip)
    placed = r.composition.isNotNull()
    return F.array(
        term(
            "exposure",
            F.when(ok, exposure_score(e.shadow_clip, e.highlight_clip)),
            F.when(placed, 0.75).otherwise(1.0),
        ),
        term("composition", r.composition.score, F.when(placed, 0.25).otherwise(0.0)),
    )


def sanitize_eyes(faces: str | Column = "faces") -> Column:
    """Eye states without a finite blink measurement become uncertain."""

    def fix(eye: Column) -> Column:
        return F.when(
            eye.isNotNull(),
            eye.withField(
                "state", F.when(finite(eye.blink_score), eye.state).otherwise(F.lit("uncertain"))
            ),
        )

    return F.transform(
        faces,
        lambda f: f.withField("left_eye", fix(f.left_eye)).withField("right_eye", fix(f.right_eye)),
    )


def composition(r, minimum_confidence: float = 0.55) -> Column:
    """struct<x, y, score>: area-and-confidence centroid of placed boxes and its placement score."""

    def point(f: Column) -> Column:
        b = f.bbox
        return F.struct(
            ((b.x + b.w / 2) / r.width).alias("x"),
            ((b.y + b.h / 2) / r.height).alias("y"),
            (b.w * b.h * f.confidence).alias("weight"),
        )

    usable = F.filter(
        r.faces,
        lambda f: finite(f.bbox.x)
        & finite(f.bbox.y)
        & above(f.bbox.w, 0)
        & above(f.bbox.h, 0)
        & finite(f.bbox.w)
        & finite(f.bbox.h)
        & finite(f.confidence)
        & at_least(f.confidence, minimum_confidence),
    )
    points = F.filter(
        F.transform(usable, point), lambda p: p.x.between(0.0, 1.0) & p.y.between(0.0, 1.0)
    )
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("weight"))
    total = F.aggregate(
        points,
        zero,
        lambda a, p: F.struct(
            (a.x + p.x * p.weight).alias("x"),
            (a.y + p.y * p.weight).alias("y"),
            (a.weight + p.weight).alias("weight"),
        ),
    )

    def placed(t: Column) -> Column:
        middle = F.struct((t.x / t.weight).alias("x"), (t.y / t.weight).alias("y"))
        point = let(middle, lambda m: F.struct(m.x.alias("x"), m.y.alias("y"), placement_score(m.x, m.y).alias("score")))
        return F.when((r.width > 0) & (r.height > 0) & (t.weight > 0), point)

    return let(total, placed)


def _components(r, settings: Settings) -> Column:
    """array of component structs before weights are renormalised."""
    n = F.size(r.faces)
    build = {
        "eyes": (eye_terms(r), n * 2),
        "sharpness": (sharpness_terms(r, settings), F.lit(3)),
        "face": (face_terms(r), n),
        "exposure": (exposure_terms(r), F.lit(2)),
        "smile": (smile_terms(r), n),
    }

    def component(name: str, terms: Column, total: Column) -> Column:
        weight = F.lit(float(getattr(settings, f"{name}_weight")))
        return let(
            terms,
            lambda t: F.struct(
                F.lit(name).alias("id"),
                weighted_mean(t).alias("score"),
                weight.alias("configured_weight"),
                observed(t).alias("observed_count"),
                total.alias("total_count"),
                t.alias("terms"),
            ),
        )

    return F.array(*[component(name, *parts) for name, parts in build.items()])


def _weigh(parts: Column, total: Column) -> Column:
    def weigh(p: Column) -> Column:
        weight = F.when(p.score.isNotNull() & (total > 0), p.configured_weight / total).otherwise(0.0)
        return let(
            weight,
            lambda w: p.withField("effective_weight", w).withField(
                "contribution", F.coalesce(p.score, F.lit(0.0)) * w
            ),
        )

    return F.transform(parts, weigh)


def _configured(parts: Column) -> Column:
    live = F.filter(parts, lambda p: p.score.isNotNull())
    return F.aggregate(live, F.lit(0.0), lambda s, p: s + p.configured_weight)


def _scored(settings: Settings) -> Column:
    """Everything derived from one row as a single struct.

    Intermediate values are bound once. Written as a chain of columns, each
    later mention would be inlined when a filter on the verdict is pushed down,
    and the expression would grow exponentially.
    """

    def finish(faces, placed, parts, total, components) -> Column:
        score = F.aggregate(components, F.lit(0.0), lambda s, p: s + p.contribution)

        def judge(value: Column) -> Column:
            r = row(faces=faces, composition=placed, score=value)
            checks = F.struct(
                closed_eye(r).alias("closed"), valid_measurements(r).alias("valid"), omitted_faces(r).alias("omitted"), raw_preview(r).alias("raw")
            )
            return let(checks, lambda c: decide(r, value, c))

        def decide(r, value, c) -> Column:
            r.closed, r.valid, r.omitted, r.raw = c.closed, c.valid, c.omitted, c.raw
            both = F.struct(verdict(r, settings).alias("verdict"), evidence(r).alias("evidence"))
            return let(
                both,
                lambda b: F.struct(
                    faces.alias("faces"),
                    placed.alias("composition"),
                    components.alias("components"),
                    total.alias("weight_total"),
                    value.alias("score"),
                    b.verdict.alias("verdict"),
                    b.evidence.alias("evidence"),
                    c.closed.alias("closed_eye"),
                    c.valid.alias("valid"),
                    usable(r, b.verdict, b.evidence).alias("usable"),
                ),
            )

        return let(score, judge)

    def with_parts(faces, placed):
        return let(
            _components(row(faces=faces, composition=placed), settings),
            lambda parts: let(
                _configured(parts),
                lambda total: let(
                    _weigh(parts, total), lambda components: finish(faces, placed, parts, total, components)
                ),
            ),
        )

    return let(
        sanitize_eyes(),
        lambda faces: let(composition(row(faces=faces)), lambda placed: with_parts(faces, placed)),
    )


def _eyes(faces: Column) -> Column:
    return F.flatten(F.transform(faces, lambda f: F.array(f.left_eye, f.right_eye)))


def closed_eye(r) -> Column:
    return F.coalesce(F.exists(_eyes(r.faces), lambda e: e.state == "closed"), F.lit(False))


def omitted_faces(r) -> Column:
    return F.coalesce(F.exists(r.warnings, lambda w: w.contains("omitted faces")), F.lit(False))


def raw_preview(r) -> Column:
    return F.coalesce(r.preview_source.startswith("raw_"), F.lit(False))


def valid_measurements(r) -> Column:
    e = r.exposure
    return measurements_valid(
        [r.sharpness_lap, r.sharpness_fft, e.mean, e.shadow_clip, e.highlight_clip, r.score], [e.shadow_clip, e.highlight_clip]
    )


def can_recommend(r, threshold: float) -> Column:
    eyes_open = F.forall(_eyes(r.faces), lambda e: F.coalesce(e.state == "open", F.lit(False)))
    return (
        ((F.size(r.faces) == 0) | eyes_open)
        & ~r.omitted
        & r.valid
        & at_least(r.sharpness_lap, 8.0)
        & at_least(r.score, float(threshold))
        & at_most(r.exposure.shadow_clip, 0.1)
        & at_most(r.exposure.highlight_clip, 0.1)
    )


def verdict(r, settings: Settings) -> Column:
    e = r.exposure
    severe = below(r.sharpness_lap, 8.0) & (
        below(e.mean, 35) | above(e.mean, 225) | above(e.shadow_clip, 0.65) | above(e.highlight_clip, 0.65)
    )
    return (
        F.when(r.closed, "review")
        .when(severe & below(r.score, float(settings.reject_threshold)) & ~r.raw, "reject_suggest")
        .when(can_recommend(r, settings.recommend_threshold), "recommend")
        .otherwise("review")
    )


def evidence(r) -> Column:
    """array<struct<code, kind>> of the reasons behind a result; absence of evidence is a limitation."""
    e = r.exposure
    unsure = F.exists(_eyes(r.faces), lambda eye: eye.isNull() | (eye.state == "uncertain"))
    small = F.exists(
        r.faces, lambda f: f.quality.isNull() | (F.least(f.quality.crop_width, f.quality.crop_height) < 32)
    )
    rules = [
        ("preview_measurement", "context", F.lit(True)),
        ("no_face_detected", "context", F.size(r.faces) == 0),
        ("closed_eye_review", "observation", r.closed),
        ("eye_evidence_limited", "limitation", unsure),
        ("face_detail_limited", "limitation", small),
        ("tonal_style_review", "context", below(e.mean, 60) | above(e.mean, 200)),
        ("preview_shadow_clip", "observation", above(e.shadow_clip, 0.1)),
        ("preview_highlight_clip", "observation", above(e.highlight_clip, 0.1)),
        ("raw_recovery_unknown", "limitation", r.raw),
        ("low_preview_detail", "observation", below(r.sharpness_lap, 8.0)),
        ("invalid_measurements", "limitation", ~r.valid),
        ("omitted_faces", "limitation", r.omitted),
    ]
    return F.filter(
        F.array(
            *[
                F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind")))
                for code, kind, test in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )


def usable(r, decided: Column, reasons: Column) -> Column:
    """May this row stand as a comparison reference?"""
    blocking = F.exists(
        reasons,
        lambda x: ((x.kind == "limitation") & (x.code != "raw_recovery_unknown")) | (x.code == "closed_eye_review"),
    )
    return r.valid & at_least(r.sharpness_lap, 8.0) & (decided != "reject_suggest") & ~blocking


def rescore(df: DataFrame, settings: Settings) -> DataFrame:
    """Components, score, verdict and evidence of stored features under ``settings``."""
    keep = [c for c in df.columns if c not in (*OUTPUTS, "settings_key")]
    return (
        df.withColumn("__scored", _scored(settings))
        .select(*keep, *[F.col(f"__scored.{c}").alias(c) for c in OUTPUTS])
        .withColumn("settings_key", F.lit(settings.canonical()))
    )


def change_class(old: Settings, new: Settings) -> str:
    changed = set(old.changed_keys(new))
    if not changed:
        return "none"
    if changed & set(DETECTION_KEYS):
        return "invalidate"
    return "restamp" if changed <= set(SEMANTIC_KEYS) else "rescore"


def apply_settings(rows: DataFrame, old: Settings, new: Settings) -> tuple[DataFrame, DataFrame]:
    """(surviving rows, dropped ids) after a settings change.

    Detection changes drop everything; semantic-only changes keep results and
    restamp; otherwise current rows are rescored and stale ones dropped.
    """
    kind = change_class(old, new)
    if kind == "none":
        return rows, rows.select("photo_id").limit(0)
    if kind == "invalidate":
        return rows.limit(0), rows.select("photo_id")
    current = rows.filter(F.col("settings_key").eqNullSafe(F.lit(old.canonical())))
    stale = rows.filter(~F.col("settings_key").eqNullSafe(F.lit(old.canonical()))).select("photo_id")
    if kind == "restamp":
        return current.withColumn("settings_key", F.lit(new.canonical())), stale
    return rescore(current, new), stale


def settings_impact(rows: DataFrame, old: Settings, new: Settings) -> DataFrame:
    """Verdict counts under both settings, one row per (before, after); nothing is written."""
    old_, new_ = _scored(old).verdict, _scored(new).verdict
    both = rows.select(old_.alias("before"), new_.alias("after"))
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def audit_scores(scored: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Rows whose stored contributions, weights or totals do not re-derive; empty when sound."""

    def off(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(a - b) > tolerance, F.lit(True))

    def wrong(parts: Column, stored: Column, score: Column, total: Column) -> Column:
        def part(c: Column) -> Column:
            weight = F.when(c.score.isNotNull() & (total > 0), c.configured_weight / total).otherwise(0.0)
            value = F.coalesce(c.score, F.lit(0.0))
            return (
                off(c.effective_weight, weight)
                | off(c.contribution, value * weight)
                | ~c.observed_count.between(0, c.total_count)
                | (c.score.isNotNull() & (~finite(c.score) | ~c.score.between(0.0, 100.0 + tolerance)))
                | off(value, F.coalesce(weighted_mean(c.terms), F.lit(0.0)))
            )

        summed = F.aggregate(parts, F.lit(0.0), lambda s, c: s + c.contribution)
        return (F.size(parts) != len(COMPONENTS)) | off(total, stored) | off(summed, score) | F.exists(parts, part)

    facts = F.struct(F.col("components").alias("c"), F.col("weight_total").alias("w"), F.col("score").alias("s"))
    # The facts leave as the one element of an exploded array: a filter on them is not pushed into the expression that
    # scores a row, which would then be evaluated again for each mention.
    held = scored.withColumn("__facts", F.explode(F.array(facts)))
    found = held.filter(let("__facts", lambda f: let(_configured(f.c), lambda t: wrong(f.c, f.w, f.s, t))))
    return found.drop("__facts")
