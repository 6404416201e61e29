"""64-bit similarity hashes: parsing, Hamming distance and exact pigeonhole bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hex_to_long(value) -> Column:
    """Signed 64-bit value of a hex string, NULL unless it is 1..16 significant hex digits."""
    text = _c(value)
    digits = F.regexp_replace(text, r"^\+?0*(?=[0-9a-fA-F])", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("long"))


def long_to_hex(value) -> Column:
    return F.lower(F.lpad(F.hex(_c(value)), 16, "0"))


def hamming(left, right) -> Column:
    """Number of differing bits between two longs."""
    return F.bit_count(_c(left).bitwiseXOR(_c(right)))


def hex_distance(left, right) -> Column:
    return hamming(hex_to_long(left), hex_to_long(right))


def band_layout(max_distance: int) -> list[tuple[int, int]]:
    """(shift, width) of max_distance + 1 disjoint bands covering 64 bits.

    Two hashes within ``max_distance`` bits agree on at least one band.
    """
    if not 0 <= max_distance < 64:
        raise ValueError("max_distance must be in 0..63")
    count = max_distance + 1
    base, extra = divmod(64, count)
    if extra == 1:
        widths = [base] * (count - 1) + [base + 1]
    else:
        widths = [base + 1] * extra + [base] * (count - extra)
    layout, shift = [], 0
    for width in widths:
        layout.append((shift, width))
        shift += width
    return layout


def band_value(hash_, shift: int, width: int) -> Column:
    if width == 64:
        return _c(hash_)
    return F.shiftrightunsigned(_c(hash_), shift).bitwiseAND(F.lit((1 << width) - 1))


def bands(hash_, max_distance: int) -> Column:
    """array<struct<band int, value long>> of the pigeonhole bands."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("band"), band_value(hash_, s, w).alias("value"))
            for i, (s, w) in enumerate(band_layout(max_distance))
        ]
    )


def band_keys(hash_, max_distance: int) -> Column:
    """The bands as array<long>, band number in the high bits (widths are at most 32 for distance >= 1)."""
    if max_distance == 0:
        return F.array(_c(hash_))
    return F.array(
        *[
            F.lit(i << 33).bitwiseOR(band_value(hash_, s, w))
            for i, (s, w) in enumerate(band_layout(max_distance))
        ]
    )


def sign_bits(vector, size: int = 64) -> Column:
    """Pack the signs of the first ``size`` elements into a long, element i at bit i."""
    value = F.lit(0).cast("long")
    for i in range(size):
        bit = 1 << i if i < 63 else -(1 << 63)
        value = value.bitwiseOR(
            F.when(F.get(_c(vector), F.lit(i)) > 0, F.lit(bit).cast("long")).otherwise(
                F.lit(0).cast("long")
            )
        )
    return value
