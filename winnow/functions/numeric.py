"""Finite-safe numeric helpers: comparisons with NaN are false and missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c


def let(value, body) -> Column:
    """``body`` applied to ``value`` evaluated once, instead of once per mention."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def finite(value) -> Column:
    # NaN and infinities minus themselves are NaN, which sorts above every number.
    v = _c(value).cast("double")
    return F.coalesce(v - v == 0.0, F.lit(False))


def at_least(value, bound) -> Column:
    """value >= bound, false for NULL and NaN (Spark alone would order NaN last)."""
    v = _c(value)
    return F.coalesce((v >= bound) & ~F.isnan(v), F.lit(False))


def above(value, bound) -> Column:
    v = _c(value)
    return F.coalesce((v > bound) & ~F.isnan(v), F.lit(False))


def below(value, bound) -> Column:
    v = _c(value)
    return F.coalesce((v < bound) & ~F.isnan(v), F.lit(False))


def at_most(value, bound) -> Column:
    v = _c(value)
    return F.coalesce((v <= bound) & ~F.isnan(v), F.lit(False))


def clamp(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(value)))


def ratio(numerator, denominator) -> Column:
    """Quotient in double, NULL when the denominator is zero."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def measurements_valid(finite_cols, unit_cols) -> Column:
    """Every measurement finite and every clip ratio within [0, 1]."""
    ok = F.lit(True)
    for name in finite_cols:
        ok = ok & finite(name)
    for name in unit_cols:
        ok = ok & at_least(name, 0.0) & at_most(name, 1.0)
    return ok
