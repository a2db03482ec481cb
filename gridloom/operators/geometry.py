"""Geometry on cells: distances, morphology, traces, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions.scalars import half_even
from gridloom.operators.filters import orientation
from gridloom.operators.stencil import anti, fixpoint, neighbourhood, range_join, scatter
from gridloom.session import cut, ship_package
from gridloom.sources.grid import Grid


def distance(cells: DataFrame, mask: DataFrame, grid: Grid, band: int = 64) -> DataFrame:
    """G1: the exact Euclidean distance of each cell to the mask (null where the mask is empty).

    First the nearest mask row above and below in each column, which takes one row of summary per column and band of rows; then,
    per row, the lower envelope of the parabolas (x - x')**2 + dy(x')**2, in numpy. A group is 16 grid rows.
    """
    columns = mask.select("y", "x").distinct()
    # for each column and band of rows: the mask's rows, plus the last one above and the first one below the band
    banded = columns.withColumn("b", F.floor(F.col("y") / band).cast("int"))
    edge = banded.groupBy("x", "b").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    slots = edge.select("x").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((grid.h - 1) // band))))
    w = Window.partitionBy("x").orderBy("b")
    slots = slots.join(edge, ["x", "b"], "left").select(
        "x", "b", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("above"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("below")
    )
    rows = banded.groupBy("x", "b").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    filled = slots.join(rows, ["x", "b"], "left")
    near = filled.select("x", "above", "below", "ys", F.explode(F.sequence(F.col("b") * band, F.least(F.col("b") * band + band - 1, F.lit(grid.h - 1)))).alias("y"))
    gap = lambda c: F.abs(F.col("y") - c)
    best = F.least(gap(F.col("above")), gap(F.col("below")), F.array_min(F.transform("ys", lambda v: F.abs(F.col("y") - v))))
    vertical = near.select("y", "x", best.cast("int").alias("g"))

    def envelope(at: np.ndarray, g2: np.ndarray, xs: np.ndarray) -> np.ndarray:
        """min over at of (x - at)**2 + g2 at each x of xs: the lower envelope of parabolas; at is ascending."""
        hull: list[int] = []
        cuts: list[float] = []
        for k in range(len(at)):
            while hull:
                j = hull[-1]
                s = ((at[k] ** 2 + g2[k]) - (at[j] ** 2 + g2[j])) / (2 * (at[k] - at[j]))
                if len(hull) > 1 and s <= cuts[-1]:
                    hull.pop()
                    cuts.pop()
                    continue
                cuts.append(s)
                break
            hull.append(k)
        owner = np.array(hull)[np.searchsorted(np.array(cuts), xs, side="left")]
        return np.sqrt((xs - at[owner]) ** 2 + g2[owner])

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        y, x, want = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["want"].to_numpy(bool)
        g2 = pdf["g"].to_numpy(float) ** 2
        out = np.full(len(pdf), np.nan)
        edges = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mask = want[lo:hi]
            if mask.any() and not mask.all():
                out[lo:hi][mask] = envelope(x[lo:hi][~mask].astype(float), g2[lo:hi][~mask], x[lo:hi][mask])
        return pd.DataFrame({"y": y[want], "x": x[want], "dist": out[want]})

    ship_package(cells.sparkSession)
    wanted = cells.select("y", "x").withColumn("g", F.lit(None).cast("int")).withColumn("want", F.lit(True))
    both = vertical.withColumn("want", F.lit(False)).unionByName(wanted)
    got = both.groupBy(F.floor(F.col("y") / 16)).applyInPandas(rows_of, "y int, x int, dist double")
    return got.withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))


def distance_within(cells: DataFrame, mask: DataFrame, limit: float) -> DataFrame:
    """G1 up to a limit, as a stencil join: null beyond it."""
    near = neighbourhood(mask.select("y", "x"), [(a, b, float(np.hypot(a, b))) for a, b, _ in K.disk(limit, closed=True)], F.min("k"), "dist")
    return cells.select("y", "x").join(near, ["y", "x"], "left")


def dilate(mask: DataFrame, r: int, grid: Grid | None = None) -> DataFrame:
    """R dilations by a cross: the city-block ball."""
    return scatter(mask.select("y", "x"), K.diamond(max(r, 0)), grid).select(F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()


def neighbour_count(mask: DataFrame) -> DataFrame:
    """Each mask cell and its number of mask neighbours among eight."""
    near = neighbourhood(mask.select("y", "x"), K.square(1, centre=False), F.count("*"), "n")
    return mask.select("y", "x").join(near, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).alias("n"))


def tips(mask: DataFrame) -> DataFrame:
    """Mask cells with exactly one neighbour."""
    return neighbour_count(mask).where("n = 1").select("y", "x")


#: The eight neighbours, clockwise from above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
#: Sides of the tiles in which a mask is thinned, and rounds of two passes before tiles exchange their edges.
THIN_TILE, THIN_ROUNDS = 256, 8


def skeleton(mask: DataFrame) -> DataFrame:
    """Thinning to one cell's width, by the two-pass rule on 3 x 3 neighbourhoods, to a fixpoint.

    A cell goes if it has 2 to 6 neighbours, its circle of neighbours has one run, and the pass's two corner conditions hold.
    A pass sees one cell far, so tiles with a halo of as many cells as passes thin themselves exactly, in numpy; they exchange what is
    left until a last round takes nothing anywhere. A group is one tile, and there is no join. Cells without a place stay.
    """
    halo = 2 * THIN_ROUNDS
    kind = {c: mask.schema[c].dataType.simpleString() for c in ("y", "x")}
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / THIN_TILE), F.floor((F.col(c) + halo) / THIN_TILE)))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        core = (y // THIN_TILE == group[0]) & (x // THIN_TILE == group[1])
        if not core.any():
            return pdf[["y", "x"]].iloc[:0].assign(gone=False)
        iy, ix = y - y.min() + 1, x - x.min() + 1
        a = np.zeros((iy.max() + 2, ix.max() + 2), bool)
        a[iy, ix] = True
        for _ in range(THIN_ROUNDS):
            before = a
            a = _thinned(_thinned(a, True), False)
            if (a == before).all():
                break
        stays, went = a[iy, ix], before[iy, ix] & ~a[iy, ix]  # went: in the last round
        out = core & (stays | went)
        return pd.DataFrame({"y": y[out], "x": x[out], "gone": went[out]})

    ship_package(mask.sparkSession)
    cells = cut(mask.select("y", "x").distinct())
    placed = F.col("y").isNotNull() & F.col("x").isNotNull()
    cells, nowhere = cells.where(placed), cells.where(~placed)
    while True:
        tiles = cells.withColumn("_ty", reach("y")).withColumn("_tx", reach("x")).groupBy("_ty", "_tx")
        done = cut(tiles.applyInPandas(run, f"y {kind['y']}, x {kind['x']}, gone boolean"))
        cells = done.where("not gone").select("y", "x")
        if done.where("gone").isEmpty():
            return cells.unionByName(nowhere)


def _thinned(a: np.ndarray, first: bool) -> np.ndarray:
    """One pass over a mask with an empty border."""
    inner = a[1:-1, 1:-1]
    p = [a[1 + dy : a.shape[0] - 1 + dy, 1 + dx : a.shape[1] - 1 + dx] for dy, dx in RING]
    count = sum((q.view(np.int8) for q in p), np.zeros(inner.shape, np.int8))
    runs = sum(((p[(k + 1) % 8] & ~p[k]).view(np.int8) for k in range(8)), np.zeros(inner.shape, np.int8))
    n, e, s, w = p[0], p[2], p[4], p[6]
    corner = ~(e & s & (n | w)) if first else ~(n & w & (e | s))
    out = a.copy()
    out[1:-1, 1:-1] = inner & ~((count >= 2) & (count <= 6) & (runs == 1) & corner)
    return out


def strike(mask: DataFrame, grid: Grid, sigma: float = 5.0, kind: str = "reference") -> DataFrame:
    """Cos and sin of the local direction at every mask cell, from the structure tensor of the mask.

    kind 'reference' keeps the gradient's angle as the step (dy = cos, dx = sin), which mirrors oblique traces; 'tangent' turns it
    into the direction along the trace.
    """
    sine = F.sin("theta") if kind == "reference" else -F.sin("theta")
    return orientation(mask, grid, sigma).select("y", "x", F.cos("theta").alias("cos"), sine.alias("sin"))


def walk(starts: DataFrame, grid: Grid, length: int = 12, step: int = 1) -> DataFrame:
    """Cells on rays from starts (y, x, cos, sin), rounded half to even; a ray ends where it leaves the grid.

    Rays are convex, so a ray that has left the grid does not come back, and a filter serves as the stop.
    """
    t = F.explode(F.sequence(F.lit(step), F.lit(length), F.lit(step))).alias("t")
    rays = starts.where("cos <> 0 or sin <> 0").select("y", "x", "cos", "sin", t)
    out = rays.select(half_even(F.col("y") + F.col("cos") * F.col("t")).alias("y"), half_even(F.col("x") + F.col("sin") * F.col("t")).alias("x"))
    return out.where(F.col("y").between(0, grid.h - 1) & F.col("x").between(0, grid.w - 1)).distinct()


def segments(ends: DataFrame, grid: Grid) -> DataFrame:
    """Cells on straight segments a_y, a_x to b_y, b_x: ceil(length) + 1 steps, rounded half to even."""
    n = F.ceil(F.sqrt((F.col("b_y") - F.col("a_y")) ** 2 + (F.col("b_x") - F.col("a_x")) ** 2)).cast("int")
    t = ends.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("i") / F.col("n"))
    cells = t.select(half_even(F.col("a_y") + (F.col("b_y") - F.col("a_y")) * F.col("t")).alias("y"), half_even(F.col("a_x") + (F.col("b_x") - F.col("a_x")) * F.col("t")).alias("x"))
    return cells.where(F.col("y").between(0, grid.h - 1) & F.col("x").between(0, grid.w - 1)).distinct()


def bridges(ends: DataFrame, grid: Grid, max_gap: float = 14, angle: float = 35.0, both_ways: bool = False) -> DataFrame:
    """Segments between ends (y, x, cos, sin) within max_gap that point at each other.

    The end that comes first in (y, x) must point at the other within the angle, and the other back at it. both_ways takes
    directions without sign, so that collinear traces are bridged whatever their sign.
    """
    pairs = range_join(ends, ends, max_gap).where("a_y < b_y or (a_y = b_y and a_x < b_x)")
    uy, ux = (F.col("b_y") - F.col("a_y")) / F.col("dist"), (F.col("b_x") - F.col("a_x")) / F.col("dist")
    d1, d2 = F.col("a_cos") * uy + F.col("a_sin") * ux, -(F.col("b_cos") * uy + F.col("b_sin") * ux)
    if both_ways:
        d1, d2 = F.abs(d1), F.abs(d2)
    least = float(np.cos(np.deg2rad(angle)))
    return segments(pairs.where((d1 >= least) & (d2 >= least)), grid)


def components(mask: DataFrame, eight: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Y, x, label; a label is the smallest (y, x) of the component, as a struct packed into a long.

    Rounds of neighbour minimum and pointer jumping, each a reliable checkpoint; neighbours are found by offsets, not pairs.
    """
    offsets = K.square(1) if eight else K.diamond(1)
    pack = (F.col("y").cast("long") * F.lit(1 << 32)) + F.col("x").cast("long")
    start = mask.select(*by, "y", "x").distinct().withColumn("label", pack).withColumn("old", F.lit(-1).cast("long"))

    def step(s: DataFrame) -> DataFrame:
        least = scatter(s, offsets).groupBy(*by, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.min("label").alias("near"))
        met = s.join(least, [*by, "y", "x"]).select(*by, "y", "x", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        root = met.select(*by, pack.alias("low"), F.col("low").alias("far"))  # where that label's own cell points
        return met.join(root, [*by, "low"], "left").select(*by, "y", "x", "old", F.least("low", F.coalesce("far", "low")).alias("label"))

    return fixpoint(start, step, lambda s: s.where("label <> old")).select(*by, "y", "x", "label")


def large_components(mask: DataFrame, least: int, eight: bool = False) -> DataFrame:
    """Cells in components of at least so many cells."""
    labelled = components(mask, eight)
    big = labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.join(big, "label", "left_semi").select("y", "x")


def parallel_strands(trace: DataFrame, known: DataFrame, grid: Grid, offsets: tuple[int, ...] = (4, 6, 8), least: int = 25) -> DataFrame:
    """The trace (y, x, cos, sin) moved along its normal to both sides, outside what is known, without small specks."""
    moved = trace.withColumn("o", F.explode(F.array(*[F.lit(s * o) for o in offsets for s in (1, -1)])))
    cells = moved.select(half_even(F.col("y") - F.col("o") * F.col("sin")).alias("y"), half_even(F.col("x") + F.col("o") * F.col("cos")).alias("x"))
    cells = anti(cells.where(F.col("y").between(0, grid.h - 1) & F.col("x").between(0, grid.w - 1)).distinct(), known)
    return large_components(cells, least, eight=False) if least > 0 else cells


def ball(points: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """Points within the radius of any seed."""
    return range_join(points.select("y", "x"), seeds.select("y", "x"), radius).select(F.col("a_y").alias("y"), F.col("a_x").alias("x")).distinct()


def bbox(mask: DataFrame, grid: Grid, pad: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """The padded bounding box, clipped to the grid."""
    lo = lambda c: F.greatest(F.min(c) - pad, F.lit(0))
    return mask.groupBy(*by).agg(lo("y").alias("y0"), F.least(F.max("y") + pad, F.lit(grid.h - 1)).alias("y1"), lo("x").alias("x0"), F.least(F.max("x") + pad, F.lit(grid.w - 1)).alias("x1"))


def max_filter(cells: DataFrame, v: str, r: int) -> DataFrame:
    """The largest value in the (2 r + 1)-square around each stored cell, by scatter with partial maxima; absent cells are -inf."""
    near = neighbourhood(cells.select("y", "x", v), K.square(r), F.max(v), "top")
    return cells.join(near, ["y", "x"])


def annulus(cells: DataFrame, mask: DataFrame, lo: float, hi: float) -> DataFrame:
    """Cells at lo < distance <= hi from the mask."""
    return distance_within(cells, mask, hi).where(F.col("dist") > lo).select("y", "x")
