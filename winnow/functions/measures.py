"""Measurement-to-score mappings and measurement classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c
from .numeric import above, below, clamp


def _known(value: Column, *inputs) -> Column:
    """NULL when any input is missing: greatest and least would skip it and invent a score."""
    seen = F.lit(True)
    for i in inputs:
        seen = seen & _c(i).isNotNull()
    return F.when(seen, value)


def lap_score(lap) -> Column:
    """100 ln(1 + lap) / ln(1001), clamped to 0..100."""
    value = clamp(100.0 * F.log1p(F.greatest(_c(lap), F.lit(0.0))) / math.log1p(1000.0), 0.0, 100.0)
    return _known(value, lap)


def exposure_score(shadow_clip, highlight_clip, allowance: float = 0.02) -> Column:
    over = F.greatest(_c(shadow_clip) - allowance, F.lit(0.0)) + F.greatest(
        _c(highlight_clip) - allowance, F.lit(0.0)
    )
    return _known(clamp(100.0 - over * 100.0, 0.0, 100.0), shadow_clip, highlight_clip)


def fft_score(energy_ratio) -> Column:
    return _known(100.0 * F.sqrt(clamp(energy_ratio, 0.0, 1.0)), energy_ratio)


def niqe_score(niqe) -> Column:
    return _known(clamp(100.0 - F.greatest(_c(niqe) - 2.0, F.lit(0.0)) * 12.5, 0.0, 100.0), niqe)


def region_quality(lap, shadow_clip, highlight_clip, width, height) -> Column:
    """0.5 sharpness + 0.3 exposure + 0.2 resolution of a measured crop."""
    resolution = _known(clamp(F.least(_c(width), _c(height)) / 128.0, 0.0, 1.0) * 100.0, width, height)
    return lap_score(lap) * 0.5 + exposure_score(shadow_clip, highlight_clip) * 0.3 + resolution * 0.2


def exposure_class(mean, shadow_clip, highlight_clip) -> Column:
    return (
        F.when(below(mean, 70) | above(shadow_clip, 0.35), "underexposed")
        .when(above(mean, 188) | above(highlight_clip, 0.25), "overexposed")
        .otherwise("normal")
    )
