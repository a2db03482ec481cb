"""Neighbourhood joins on cells, tiles with halos, and fixpoint loops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.kernels import Offsets, offsets_column
from gridloom.session import cut
from gridloom.sources.grid import Grid

KEY = ("y", "x")


def semi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a that are in b."""
    return a.join(b.select(*KEY), list(KEY), "left_semi")


def anti(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a that are not in b."""
    return a.join(b.select(*KEY), list(KEY), "left_anti")


def scatter(df: DataFrame, offsets: Offsets, grid: Grid | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Each cell once for each offset: its own columns, the cell it reaches (ty, tx) and the weight k.

    The offsets are an array literal, so this is a generator without any join; an equi-join on (ty, tx) makes it a stencil join.
    """
    out = df.withColumn("_o", F.explode(offsets_column(offsets))).select("*", (F.col("y") + F.col("_o.dy")).alias("ty"), (F.col("x") + F.col("_o.dx")).alias("tx"), F.col("_o.k").alias("k")).drop("_o")
    return out.where(F.col("ty").between(0, grid.h - 1) & F.col("tx").between(0, grid.w - 1)) if grid else out


def stencil_join(left: DataFrame, right: DataFrame, offsets: Offsets, how: str = "left", by: tuple[str, ...] = ()) -> DataFrame:
    """Every left cell with every right cell at one of the offsets; right's other columns are prefixed r_.

    left is exploded (choose the smaller side) and joined on the shifted cell: an equi-join, never a theta join.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    s = scatter(left, offsets)
    on = (s["ty"] == r["r_y"]) & (s["tx"] == r["r_x"])
    for c in by:
        on = on & (s[c] == r[f"r_{c}"])
    return s.join(r, on, how)


def neighbourhood(df: DataFrame, offsets: Offsets, agg: Column, name: str, grid: Grid | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Scatter and aggregate: for each reached cell, agg over what reaches it (columns of df, and k). Partial sums shrink the shuffle."""
    return scatter(df, offsets, grid).groupBy(*by, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(agg.alias(name))


def range_join(a: DataFrame, b: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at Euclidean distance radius or less. a's columns are prefixed a_, b's b_, the distance is dist.

    Cells fall into buckets of the radius; b is repeated into the nine buckets around its own, and an equi-join on the bucket is
    refined by the exact distance.
    """
    size = max(1, int(np.ceil(radius)))
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("_by", F.floor(F.col("a_y") / size)).withColumn("_bx", F.floor(F.col("a_x") / size))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_n", F.explode(near))
    right = right.select(*[f"b_{c}" for c in b.columns], (F.floor(F.col("b_y") / size) + F.col("_n.i")).alias("_by"), (F.floor(F.col("b_x") / size) + F.col("_n.j")).alias("_bx"))
    on = [left["_by"] == right["_by"], left["_bx"] == right["_bx"]] + [left[f"a_{c}"] == right[f"b_{c}"] for c in by]
    square = (F.col("a_y") - F.col("b_y")) * (F.col("a_y") - F.col("b_y")) + (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x"))
    return left.join(right, on).where(square <= radius * radius).withColumn("dist", F.sqrt(square.cast("double"))).drop("_by", "_bx")


def nearest(a: DataFrame, b: DataFrame, radius: float, k: int = 1, apart: bool = False) -> DataFrame:
    """Y, x, nth, dist, ny, nx: the k nearest cells of b for each cell of a, ties by (y, x); apart leaves out the cell itself.

    Cells that have fewer than k within the radius are searched again with twice the radius, up to the diagonal of both tables: there
    every cell of b is found, so a cell comes back with fewer than k rows only if b has no more. Only the k best pairs of a cell are
    kept, in the task that finds them as well as in the last one. Cells of a without any partner have no row.
    """
    a, b = cut(a.select(*KEY).distinct()), cut(b.select(*KEY).distinct())
    box = a.union(b).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if box[0] is None:
        return a.select(*KEY, F.lit(1).alias("nth"), F.lit(0.0).alias("dist"), F.col("y").alias("ny"), F.col("x").alias("nx")).limit(0)
    diagonal = float(np.hypot(box[1] - box[0], box[3] - box[2])) + 1.0
    order = Window.partitionBy("a_y", "a_x").orderBy("dist", "b_y", "b_x")
    out, rest = [], a
    while True:
        radius = min(float(radius), diagonal)
        pairs = range_join(rest, b, radius)
        if apart:
            pairs = pairs.where("a_y <> b_y or a_x <> b_x")
        near = cut(pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k))
        done = near.groupBy(F.col("a_y").alias("y"), F.col("a_x").alias("x")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*KEY)
        if radius >= diagonal:
            out.append(near)
            break
        out.append(near.join(done.select(F.col("y").alias("a_y"), F.col("x").alias("a_x")), ["a_y", "a_x"], "left_semi"))
        rest = cut(anti(rest, done))
        if rest.isEmpty():
            break
        radius *= 2
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(F.col("a_y").alias("y"), F.col("a_x").alias("x"), "nth", "dist", F.col("b_y").alias("ny"), F.col("b_x").alias("nx"))


class Edge:
    """The grid's edge as a tile sees it: how much of the arrays lies beyond it, and the rule that fills it."""

    def __init__(self, pad: tuple[tuple[int, int], tuple[int, int]], mode: str):
        self.pad, self.mode = pad, mode

    def inside(self, a: np.ndarray) -> np.ndarray:
        """Without what lies beyond the grid's edge."""
        (top, bottom), (left, right) = self.pad
        return a[top : a.shape[0] - bottom, left : a.shape[1] - right]

    def fill(self, a: np.ndarray) -> np.ndarray:
        """An array without the part beyond the edge, with it."""
        return np.pad(a, self.pad, mode=self.mode)

    def again(self, a: np.ndarray) -> np.ndarray:
        """The part beyond the edge filled anew: each filter of a chain sees the edge of its own input."""
        return self.fill(self.inside(a)) if any(n for side in self.pad for n in side) else a


def tile_halo_apply(
    cells: DataFrame, columns: list[str], fn: Callable[[dict[str, np.ndarray], Edge], dict[str, np.ndarray]], outputs: list[str], grid: Grid, halo: int, tile: int = 256, border: str = "reflect", fill: float = 0.0,
) -> DataFrame:
    """Dense windows with halos: fn gets each column as an array of the tile and its halo, and returns arrays of the same shape.

    Cells are repeated into each tile whose halo holds them (a few copies), and a tile is one bounded group. At the grid's edge the
    halo is filled by the border rule (reflect, nearest or constant), never at a tile's. Only cells that are stored come back.
    """
    near = F.expr(f"sequence(cast(floor(greatest(0, y - {halo}) / {tile}) as int), cast(floor(least({grid.h - 1}, y + {halo}) / {tile}) as int))")
    near_x = F.expr(f"sequence(cast(floor(greatest(0, x - {halo}) / {tile}) as int), cast(floor(least({grid.w - 1}, x + {halo}) / {tile}) as int))")
    spread = cells.select("y", "x", *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_ty", F.explode(near)).withColumn("_tx", F.explode(near_x))
    mode = {"reflect": "symmetric", "nearest": "edge", "constant": "constant"}[border]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])
        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        y1, x1 = min(grid.h, (ty + 1) * tile + halo), min(grid.w, (tx + 1) * tile + halo)
        pad = ((halo if y0 == 0 else 0, halo if y1 == grid.h else 0), (halo if x0 == 0 else 0, halo if x1 == grid.w else 0))
        edge = Edge(pad, mode)
        iy, ix = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        arrays = {}
        for c in columns:
            a = np.full((y1 - y0, x1 - x0), fill)
            a[iy, ix] = np.where(np.isnan(v := pdf[c].to_numpy(float)), fill, v)
            arrays[c] = edge.fill(a)
        found = fn(arrays, edge)
        core = (pdf["y"] // tile == ty) & (pdf["x"] // tile == tx)
        cy, cx = iy[core] + pad[0][0], ix[core] + pad[1][0]
        return pd.DataFrame({"y": pdf["y"][core], "x": pdf["x"][core], **{o: found[o][cy, cx].astype(float) for o in outputs}})

    from gridloom.session import ship_package

    ship_package(cells.sparkSession)
    return spread.groupBy("_ty", "_tx").applyInPandas(run, "y int, x int, " + ", ".join(f"{o} double" for o in outputs))


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], DataFrame], rounds: int = 200) -> DataFrame:
    """Repeat step until `changed` (of the new state) has no rows; every round is a reliable checkpoint, so plans stay small."""
    state = cut(state)
    for _ in range(rounds):
        state = cut(step(state))
        if changed(state).isEmpty():
            return state
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def sweep(df: DataFrame, **params: list) -> DataFrame:
    """Df once for each combination of parameters (their number is fixed by the call), as columns."""
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
