"""String hashes as JVM-side folds, equal to the polynomial hash over UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STRING_HASH_BASE = 31
BITMAP_HASH_BASE = 61
BITMAP_BITS = 1 << 29


def _polynomial_hash(text: Column, base: int, mask: int) -> Column:
    """``sum(unit_i * base^(n-1-i)) & mask``; the mask inside the fold rules out overflow.

    Characters outside the basic plane count as their two surrogate units.
    """

    def step(acc: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        above = point - 0x10000
        high = F.lit(0xD800) + F.shiftright(above, 10)
        low = F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        return F.when(
            point < 0x10000, (acc * base + point).bitwiseAND(F.lit(mask))
        ).otherwise(
            ((acc * base + high).bitwiseAND(F.lit(mask)) * base + low).bitwiseAND(
                F.lit(mask)
            )
        )

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), step)


def _to_signed_int(unsigned: Column) -> Column:
    return (
        F.when(unsigned >= 1 << 31, unsigned - (1 << 32))
        .otherwise(unsigned)
        .cast("int")
    )


def string_hash(text: Column, addend: int = 0) -> Column:
    """32-bit string hash (base 31) plus ``addend``, wrapping as 32-bit ints do."""
    mask = (1 << 32) - 1
    hashed = _polynomial_hash(text, STRING_HASH_BASE, mask)
    return _to_signed_int((hashed + addend).bitwiseAND(F.lit(mask)))


def bitmap_offset(text: Column, bits: int = BITMAP_BITS) -> Column:
    """Bit position of a value in a bitmap of ``bits`` (a power of two) positions."""
    if bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    return _polynomial_hash(text, BITMAP_HASH_BASE, bits - 1)
