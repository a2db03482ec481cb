"""Offset tables and scalar formulas of the distance-weighted metric. Distances are in cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reach of the metric's triangular kernel, and the weights of false positives and misses.
RADIUS, ALPHA, BETA, EPS = 3.0, 0.2, 0.8, 1e-12

Offsets = list[tuple[int, int, float]]


def kernel(d: Column | float):
    """M1: max(1 - d / RADIUS, 0)."""
    if isinstance(d, (int, float)):
        return max(1.0 - d / RADIUS, 0.0)
    return F.greatest(F.lit(1.0) - d / F.lit(RADIUS), F.lit(0.0))


def cone(radius: float = RADIUS) -> Offsets:
    """Offsets with positive weight of the triangular kernel."""
    r = math.ceil(radius)
    every = [(dy, dx, 1.0 - math.sqrt(dy * dy + dx * dx) / radius) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return [o for o in every if o[2] > 0]


def disk(radius: float, closed: bool = False) -> Offsets:
    """Euclidean disk, open (d < radius) or closed."""
    r = math.ceil(radius)
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if (d := dy * dy + dx * dx) < radius * radius or (closed and d == radius * radius)]


def diamond(r: int) -> Offsets:
    """City-block ball: r dilations by a cross."""
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]


def square(r: int, centre: bool = True) -> Offsets:
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if centre or (dy, dx) != (0, 0)]


def offsets_frame(spark: SparkSession, offsets: Offsets) -> DataFrame:
    """An offset table (dy, dx, k): a few dozen rows, always broadcast."""
    return spark.createDataFrame(offsets, "dy int, dx int, k double")


def offsets_column(offsets: Offsets) -> Column:
    """The offsets as an array literal to explode: no join at all."""
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(c)).alias("k")) for a, b, c in offsets])


def kernel_mass(radius: float = RADIUS) -> float:
    """The kernel's sum over all offsets."""
    return math.fsum(k for _, _, k in cone(radius))


def marginal_bar(s: Column, u: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """M10, as the reference states it: alpha s u / (1 - alpha s + beta s)."""
    return F.lit(alpha) * s * u / (F.lit(1.0) - F.lit(alpha) * s + F.lit(beta) * s)


def marginal_bar_exact(s: Column, u: Column, alpha: float = ALPHA) -> Column:
    """The break-even credit of the metric as implemented: alpha s u / (1 - (1 - alpha) ... ) reduces to alpha s u / (1 - alpha s)."""
    return F.lit(alpha) * s * u / (F.lit(1.0) - F.lit(alpha) * s)


def required_coverage(s: Column, rho: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """M11, as the reference states it: s (alpha rho + beta) / (1 - alpha s + beta s)."""
    return s * (F.lit(alpha) * rho + F.lit(beta)) / (F.lit(1.0) - F.lit(alpha) * s + F.lit(beta) * s)


def implied_credit(s: Column, n: Column, m: Column) -> Column:
    """The credit T that a score s implies at n dots and m truth cells, with every miss charged."""
    return s * (F.lit(ALPHA) * n + F.lit(BETA) * m) / (F.lit(1.0) - F.lit(ALPHA) * s)


def score_identity(t: Column, n: Column, k: Column) -> Column:
    """T / (0.2 n + 0.8 K): the approximation that takes every dot's best credit as its own."""
    return t / (F.lit(ALPHA) * n + F.lit(BETA) * k)


def tversky(tp: Column, fp: Column, fn: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return tp / (tp + F.lit(alpha) * fp + F.lit(beta) * fn + F.lit(EPS))
