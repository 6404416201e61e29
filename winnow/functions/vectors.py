"""Array arithmetic used by appearance gates and retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c
from .numeric import finite, let


def all_finite(vector) -> Column:
    return F.forall(_c(vector), finite)


def norm(vector) -> Column:
    """Euclidean norm accumulated in double."""
    return F.sqrt(
        F.aggregate(
            _c(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def dot(left, right) -> Column:
    """Dot product accumulated in double."""
    return F.aggregate(
        F.zip_with(_c(left), _c(right), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def normalize(vector, dimensions: int | None = None) -> Column:
    """Unit-length float vector, NULL when empty, non-finite, mis-sized or (near) zero."""
    def scaled(v: Column) -> Column:
        def by(length: Column) -> Column:
            ok = finite(length) & (length > 1e-12) & all_finite(v) & (F.size(v) > 0)
            if dimensions is not None:
                ok = ok & (F.size(v) == dimensions)
            return F.when(ok, F.transform(v, lambda x: (x.cast("double") / length).cast("float")))

        return let(norm(v), by)

    return let(vector, scaled)


def valid_unit(vector, dimensions: int, tolerance: float = 1e-3) -> Column:
    v = _c(vector)
    return (F.size(v) == dimensions) & all_finite(v) & (F.abs(norm(v) - 1.0) <= tolerance)


def cosine(left, right) -> Column:
    """Cosine clamped to [-1, 1]; NULL for mismatched sizes or invalid norms."""
    a, b = _c(left), _c(right)
    return let(
        norm(a) * norm(b),
        lambda product: F.when(
            (F.size(a) == F.size(b)) & finite(product) & (product > 0),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / product)),
        ),
    )


def mean_abs_difference(left, right, size: int = 64) -> Column:
    """Mean |x - y| kept in single precision."""
    total = F.aggregate(
        F.zip_with(_c(left), _c(right), lambda x, y: F.abs(x - y)),
        F.lit(0.0).cast("float"),
        lambda acc, x: acc + x,
    )
    return total / F.lit(float(size)).cast("float")


def max_abs_difference(left, right) -> Column:
    return F.array_max(F.zip_with(_c(left), _c(right), lambda x, y: F.abs(x - y)))


def mean_squared_difference(left, right, size: int = 64) -> Column:
    """Mean squared difference: float subtraction, double accumulation."""
    return (
        F.aggregate(
            F.zip_with(
                _c(left), _c(right), lambda x, y: (x - y).cast("double") * (x - y).cast("double")
            ),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
        / size
    )
