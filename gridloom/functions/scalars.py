"""Row-local expressions over cells: projections, predicates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values at or beyond this are nodata sentinels.
SENTINEL = 1e30


def is_finite(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    v = v.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_zero(v: Column) -> Column:
    """P1, S6."""
    return F.when(is_finite(v), v.cast("double")).otherwise(F.lit(0.0))


def is_valid(v: Column) -> Column:
    """Finite and below the sentinel."""
    return is_finite(v) & (F.abs(v.cast("double")) < F.lit(SENTINEL))


def valid_or_zero(v: Column) -> Column:
    """S7."""
    return F.when(is_valid(v), v.cast("double")).otherwise(F.lit(0.0))


def nodata_to_null(v: Column) -> Column:
    """Normalises NaN, infinities and sentinels to null at ingest."""
    return F.when(is_valid(v), v)


def inside_or_zero(v: Column, inside: Column) -> Column:
    """P3."""
    return F.when(inside, v).otherwise(F.lit(0.0))


def in_support(v: Column) -> Column:
    """Positive and finite."""
    return is_finite(v) & (v > 0)


def clip_unit(v: Column) -> Column:
    """P10."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def in_annulus(d: Column, lo: float, hi: float) -> Column:
    """Lo < d <= hi."""
    return (d > F.lit(lo)) & (d <= F.lit(hi))


def eligible(inside: Column, known: Column, distance: Column, ring: float) -> Column:
    """Inside, not known, and farther than the ring from what is known."""
    return inside & ~known & (distance > F.lit(ring))


def half_even(v: Column) -> Column:
    """Rounds halves to even, as an integer."""
    return F.rint(v).cast("int")


def blend(values: dict[str, float], columns: list[str]) -> Column:
    """Weighted sum over the bands that are present, divided by their weights."""
    have = {b: w for b, w in values.items() if b in columns}
    if not have:
        raise KeyError(f"none of the bands {sorted(values)} is present")
    return sum((F.lit(float(w)) * F.col(b) for b, w in have.items()), F.lit(0.0)) / F.lit(float(sum(abs(w) for w in have.values())))


def share(n: Column, of: Column) -> Column:
    """N / max(of, 1)."""
    return n.cast("double") / F.greatest(of, F.lit(1)).cast("double")
