"""Repeatable pseudo-random order and draws.

A draw depends only on the row's identifier and the seed, so it is the same under
any partitioning and after any task retry.  ``mix`` is plain integer arithmetic
that any SQL engine can repeat; ``xx`` takes identifiers of any type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296  # 2**32, the range of every hash below


def mix(identifier: Column | str, seed: int = 0) -> Column:
    """Unsigned 32-bit multiplicative hash of an integer identifier."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    folded = F.pmod(c.cast("bigint"), F.lit(2147483648))
    return F.pmod(folded * F.lit(2654435761) + F.lit(seed), F.lit(SPAN))


def xx(*identifiers: Column | str, seed: int = 0) -> Column:
    """Unsigned 32-bit hash of identifiers of any type."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identifiers), 32)


def unit(hashed: Column) -> Column:
    """A hash as a number in (0, 1)."""
    return (hashed + F.lit(0.5)) / F.lit(float(SPAN))


def uniform(hashed: Column, low: float, high: float) -> Column:
    return F.lit(low) + unit(hashed) * F.lit(high - low)


def normal(first: Column, second: Column) -> Column:
    """Standard normal draw from two independent hashes (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(unit(first)))
    return radius * F.cos(F.lit(6.283185307179586) * unit(second))
