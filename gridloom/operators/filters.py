"""Filters, derivatives and normalisations of bands.

Wide filters run on tiles with halos in numpy, small ones as stencil aggregates. Border rules apply at the grid's edge only, anew
for each filter of a chain. Cells that are not stored count as 0 in tile filters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions.quantiles import column_quantiles
from gridloom.functions.scalars import is_finite, is_valid, valid_or_zero
from gridloom.operators.stencil import Edge, neighbourhood, tile_halo_apply
from gridloom.session import cut
from gridloom.sources.grid import Grid, ranked


def taps(sigma: float, order: int = 0) -> np.ndarray:
    """Gaussian taps (or a derivative's) out to int(4 sigma + 0.5), the weights of order 0 summing to 1."""
    r = int(4 * sigma + 0.5)
    t = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    if order == 1:
        return g * -t / sigma**2
    if order == 2:
        return g * (t**2 / sigma**4 - 1 / sigma**2)
    return g


def along(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with the mirrored taps along an axis, the same size; the array brings its own margin."""
    return np.apply_along_axis(lambda v: np.convolve(v, k, mode="same"), axis, a)


def blur(a: np.ndarray, sigma: float, orders: tuple[int, int] = (0, 0)) -> np.ndarray:
    return along(along(a, taps(sigma, orders[0]), 0), taps(sigma, orders[1]), 1)


def radius(*sigmas: float) -> int:
    """The halo of blurs that follow one another."""
    return sum(int(4 * s + 0.5) for s in sigmas)


def sobel_pair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised [-1, 0, 1] x [1, 2, 1] derivatives along y and x."""
    d, s = np.array([1.0, 0.0, -1.0]), np.array([1.0, 2.0, 1.0])
    return along(along(a, d, 0), s, 1), along(along(a, s, 0), d, 1)


def gradient_pair(a: np.ndarray, edge: Edge) -> tuple[np.ndarray, np.ndarray]:
    """Central differences, one-sided at the grid's edge, 0 along an axis of one cell; filled beyond the edge."""
    b = edge.inside(a)
    return tuple(edge.fill(np.gradient(b, axis=k) if b.shape[k] > 1 else np.zeros_like(b)) for k in (0, 1))


def tile_filter(cells: DataFrame, v: str, fn: Callable[[np.ndarray, Edge], np.ndarray], grid: Grid, halo: int, border: str, out: str = "v") -> DataFrame:
    return tile_halo_apply(cells, [v], lambda a, edge: {out: fn(a[v], edge)}, [out], grid, halo, max(256, halo), border)


def gaussian(cells: DataFrame, v: str, sigma: float, grid: Grid, border: str = "reflect", out: str = "v") -> DataFrame:
    """F1."""
    return tile_filter(cells, v, lambda a, edge: blur(a, sigma), grid, radius(sigma), border, out)


def gaussian_axis(cells: DataFrame, v: str, sigma: float, grid: Grid, axis: str = "x") -> DataFrame:
    """F1 along one axis in SQL, for narrow kernels: weighted sums of what each cell scatters, reflected at the grid's edge."""
    k = taps(sigma)
    r = len(k) // 2
    n = grid.w if axis == "x" else grid.h
    each = F.array(*[F.struct(F.lit(i - r).alias("o"), F.lit(float(w)).alias("k")) for i, w in enumerate(k)])
    spread = cells.select("y", "x", v, F.explode(each).alias("s"))
    # a target t reads t + o, reflected: the sources of t are those whose images fall there
    images = F.array(F.col(axis), -F.col(axis) - 1, F.lit(2 * n - 1) - F.col(axis))
    spread = spread.withColumn("i", F.explode(images)).withColumn("t", F.col("i") - F.col("s.o")).where(F.col("t").between(0, n - 1))
    other = "y" if axis == "x" else "x"
    got = spread.groupBy(other, F.col("t").alias(axis)).agg(F.sum(F.col(v) * F.col("s.k")).alias("blur"))
    return cells.select("y", "x").join(got, ["y", "x"]).select("y", "x", "blur")


def sobel(cells: DataFrame, v: str, grid: Grid, border: str = "reflect") -> DataFrame:
    """gy and gx on tiles."""
    def run(a, edge):
        gy, gx = sobel_pair(a[v])
        return {"gy": gy, "gx": gx}

    return tile_halo_apply(cells, [v], run, ["gy", "gx"], grid, 1, border=border)


def gradient(cells: DataFrame, v: str, grid: Grid) -> DataFrame:
    """gy and gx, central differences that are one-sided at the grid's edge only; cells that are not stored count as 0."""
    def run(a, edge):
        gy, gx = gradient_pair(a[v], edge)
        return {"gy": gy, "gx": gx}

    return tile_halo_apply(cells, [v], run, ["gy", "gx"], grid, 1, border="nearest")


def smooth(cells: DataFrame, v: str, grid: Grid) -> DataFrame:
    """the sum of v * k over the metric's kernel, zero outside: a scatter with partial sums."""
    return neighbourhood(cells.select("y", "x", v), K.cone(), F.sum(F.col(v) * F.col("k")), "tau", grid)


def scale_columns(cells: DataFrame, columns: dict[str, str], where: Column | None = None, strided: int = 0) -> DataFrame:
    """Each column (name -> name of the result) clipped to its 1st and 99th percentile and scaled to [0, 1]; constant bands give 0.

    strided = 8 (F5): percentiles of the finite values on every eighth row and column, of range above 1e-7; values that are not finite
    give 0. Else (F6, or F7 with where): percentiles of all valid values; sentinels give 0, too. Without any value to take percentiles
    of, the range is [0, 1] in F5, and all is 0 otherwise. The rows are materialised once, as they are needed three times.
    """
    cells = cut(cells)
    good = is_finite if strided else is_valid
    use = F.lit(True) if where is None else where
    if strided:
        use = use & (F.col("y") % strided == 0) & (F.col("x") % strided == 0)
    ends = column_quantiles(cells.where(use), {f"c{k}": F.when(good(F.col(c)), F.col(c).cast("double")) for k, c in enumerate(columns)}, [0.01, 0.99])
    out = cells.crossJoin(F.broadcast(ends))  # a single row
    scaled = []
    for k, (c, name) in enumerate(columns.items()):
        lo, hi = (F.coalesce(f"c{k}_q0", F.lit(0.0)), F.coalesce(f"c{k}_q1", F.lit(1.0))) if strided else (F.col(f"c{k}_q0"), F.col(f"c{k}_q1"))
        wide = hi > lo + F.lit(1e-7 if strided else 0.0)
        scaled.append(F.when(wide & good(F.col(c)), F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias(name))
    keep = [c for c in cells.columns if c not in columns.values()]
    return out.select(*keep, *scaled)


def percentile_scale(cells: DataFrame, v: str, where: Column | None = None, strided: int = 0, out: str = "z") -> DataFrame:
    """F5 (strided = 8), F6, F7 (where) of one column."""
    return scale_columns(cells, {v: out}, where, strided)


def fixed_draw() -> Column:
    """A draw from a cell's place, the same in every run."""
    return (F.col("y").cast("long") * 7919 + F.col("x").cast("long") * 104729) % 1000003


def rank_columns(cells: DataFrame, bands: dict[str, str], inside: Column | None = None, tie: Column | None = None) -> DataFrame:
    """y, x and the rank of each band (name -> name of the result) among inside cells with a value, scaled to [0, 1], else null.

    Ties go by `tie`, then by (y, x). All bands are ranked in one distributed sort, by band, and shifted by the bands' first ranks.
    """
    use = cells if inside is None else cells.where(inside)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("b"), F.col(c).cast("double").alias("v")) for k, c in enumerate(bands)]))
    long = use.select("y", "x", (F.lit(0) if tie is None else tie).alias("t"), each.alias("s")).select("y", "x", "t", "s.b", "s.v").where("v is not null")
    order = ranked(long, *[F.col(c).asc() for c in ("b", "v", "t", "y", "x")])
    first = order.groupBy(F.col("b").alias("of")).agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    placed = order.join(F.broadcast(first), F.col("b") == F.col("of"))  # a row for each band
    share = (F.col("rank") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    return placed.groupBy("y", "x").agg(*[F.max(F.when(F.col("b") == k, share)).alias(name) for k, name in enumerate(bands.values())])


def pct_rank(cells: DataFrame, v: str, inside: Column | None = None, out: str = "pr") -> DataFrame:
    """the ordinal rank of each inside cell, ties by (y, x), scaled to [0, 1]; null outside. No single-partition window."""
    return cells.join(rank_columns(cells, {v: out}, inside), ["y", "x"], "left")


def rank_transform(cells: DataFrame, v: str, inside: Column | None = None, out: str = "z") -> DataFrame:
    """F8: as F9, with ties in the order of a fixed draw (instead of a random one), and 0 outside."""
    ranks = rank_columns(cells, {v: "_z"}, inside, fixed_draw())
    return cells.join(ranks, ["y", "x"], "left").withColumn(out, F.coalesce("_z", F.lit(0.0))).drop("_z")


def detrend(cells: DataFrame, v: str, sigma: float, grid: Grid) -> DataFrame:
    """v minus its wide blur."""
    return tile_filter(cells, v, lambda a, edge: a - blur(a, sigma), grid, radius(sigma), "nearest")


def _tensor(gy: np.ndarray, gx: np.ndarray, sigma: float, edge: Edge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """jxx, jyy, jxy: blurred products of the derivatives; and the difference of the tensor's eigenvalues."""
    jxx, jyy, jxy = (blur(edge.again(a), sigma) for a in (gx * gx, gy * gy, gx * gy))
    return jxx, jyy, jxy, np.sqrt(np.maximum((jxx - jyy) ** 2 + 4 * jxy**2, 0))


def orientation(mask: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """theta of the structure tensor of a mask, at the mask's cells. Cells outside the mask are 0, so only its tiles are dense.

    The tensor is rounded to 12 places, so that a symmetric neighbourhood has one direction and not that of its rounding errors.
    """
    ones = mask.select("y", "x").withColumn("v", F.lit(1.0))

    def run(a, edge):
        jxx, jyy, jxy, _ = (np.round(j, 12) + 0.0 for j in _tensor(*sobel_pair(a["v"]), sigma, edge))
        return {"theta": 0.5 * np.arctan2(2 * jxy, jxx - jyy + 0.0)}

    return tile_halo_apply(ones, ["v"], run, ["theta"], grid, radius(sigma) + 1)


def coherence(cells: DataFrame, v: str, grid: Grid, sigmas: tuple[float, ...] = (1.5, 3.0, 6.0)) -> DataFrame:
    """the largest (l1 - l2) / (l1 + l2) of the structure tensor over scales."""
    def run(a: np.ndarray, edge: Edge) -> np.ndarray:
        out = np.zeros_like(a)
        for s in sigmas:
            jxx, jyy, _, diff = _tensor(*gradient_pair(blur(a, s * 0.5), edge), s, edge)
            out = np.maximum(out, diff / np.maximum(jxx + jyy, 1e-9))
        return out

    return tile_filter(cells, v, run, grid, max(radius(s * 0.5, s) + 1 for s in sigmas), "nearest")


def _energies(cells: DataFrame, pairs: dict[str, tuple[str, float]], grid: Grid) -> DataFrame:
    """y, x and the tensor's eigenvalue difference of several columns (result -> column, scale) on one set of tiles."""
    columns = sorted({c for c, _ in pairs.values()})

    def run(a, edge):
        slopes = {c: sobel_pair(a[c]) for c in columns}
        return {name: _tensor(*slopes[c], sigma, edge)[3] for name, (c, sigma) in pairs.items()}

    halo = max(radius(sigma) for _, sigma in pairs.values()) + 1
    return tile_halo_apply(cells, columns, run, list(pairs), grid, halo)


def anisotropies(cells: DataFrame, pairs: dict[str, tuple[str, float]], grid: Grid) -> DataFrame:
    """F12 of several columns and scales (result -> column, scale) at once: values that are not valid count as 0, results are F6-scaled."""
    columns = sorted({c for c, _ in pairs.values()})
    clean = cells.select("y", "x", *[valid_or_zero(F.col(c)).alias(c) for c in columns])
    return scale_columns(_energies(clean, pairs, grid), {n: n for n in pairs}).select("y", "x", *pairs)


def anisotropy(cells: DataFrame, v: str, grid: Grid, sigma: float = 2.0) -> DataFrame:
    """the eigenvalue difference at one scale, F6-scaled."""
    return anisotropies(cells, {"v": (v, sigma)}, grid)


def lineaments(cells: DataFrame, bands: list[str], grid: Grid, sigma: float = 2.0) -> DataFrame:
    """F13 of several bands at once: y, x and the F5-scaled lineament energy of each F5-scaled band, under the band's name."""
    scaled = scale_columns(cells.select("y", "x", *bands), {b: b for b in bands}, strided=8)
    raw = _energies(scaled, {b: (b, sigma) for b in bands}, grid)
    return scale_columns(raw, {b: b for b in bands}, strided=8).select("y", "x", *bands)


def lineament(cells: DataFrame, v: str, grid: Grid, sigma: float = 2.0) -> DataFrame:
    """F13 of one band."""
    return lineaments(cells, [v], grid, sigma).select("y", "x", F.col(v).alias("v"))


def ridge(cells: DataFrame, v: str, grid: Grid, sigmas: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0)) -> DataFrame:
    """the largest scale-normalised absolute Hessian eigenvalue over scales."""
    def run(a: np.ndarray, edge: Edge) -> np.ndarray:
        out = np.zeros_like(a)
        for s in sigmas:
            yy, xy, xx = blur(a, s, (2, 0)), blur(a, s, (1, 1)), blur(a, s, (0, 2))
            half, diff = 0.5 * (xx + yy), 0.5 * np.sqrt((xx - yy) ** 2 + 4 * xy**2)
            out = np.maximum(out, s * s * (np.abs(half) + diff))
        return out

    return tile_filter(cells, v, run, grid, max(radius(s) for s in sigmas), "nearest")


def step_edges(cells: DataFrame, pairs: dict[str, tuple[str, float]], grid: Grid) -> DataFrame:
    """F15 of several columns and scales (result -> column, scale) at once."""
    columns = sorted({c for c, _ in pairs.values()})
    clean = cells.select("y", "x", *[valid_or_zero(F.col(c)).alias(c) for c in columns])

    def run(a, edge):
        return {name: np.hypot(*sobel_pair(edge.again(blur(a[c], sigma)))) for name, (c, sigma) in pairs.items()}

    raw = tile_halo_apply(clean, columns, run, list(pairs), grid, max(radius(s) for _, s in pairs.values()) + 1)
    return scale_columns(raw, {n: n for n in pairs}).select("y", "x", *pairs)


def step_edge(cells: DataFrame, v: str, grid: Grid, sigma: float = 2.0) -> DataFrame:
    """the F6-scaled gradient magnitude of the blurred surface."""
    return step_edges(cells, {"v": (v, sigma)}, grid)
