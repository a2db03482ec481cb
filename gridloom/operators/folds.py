"""Blocks, folds and hold-outs (H1-H7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.kernels import disk
from gridloom.operators.geometry import ball, bbox, dilate
from gridloom.operators.select import matched_sample
from gridloom.operators.stencil import anti, scatter, semi
from gridloom.sources.grid import Grid


def block_column(n: int, grid: Grid) -> Column:
    """H1: block number of an n x n partition with edges floor(i * size / n), row-major."""
    def part(c: str, size: int) -> Column:
        edges = [size * i // n for i in range(1, n)]
        return sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges), F.lit(0))

    return (part("y", grid.h) * n + part("x", grid.w)).cast("int")


def sized_block(k: int, grid: Grid) -> Column:
    """H2: blocks of ceil(size / k)."""
    sy, sx = -(-grid.h // k), -(-grid.w // k)
    return (F.floor(F.col("y") / sy) * k + F.floor(F.col("x") / sx)).cast("int")


def fixed_block(size: int = 100, stride: int = 40) -> Column:
    """H3: (y div size) * stride + x div size."""
    return (F.floor(F.col("y") / size) * stride + F.floor(F.col("x") / size)).cast("int")


def fold_cells(known: DataFrame, n: int, grid: Grid, least: int = 50) -> DataFrame:
    """H1, H4: known cells with their fold; folds with fewer cells are not admitted."""
    cells = known.select("y", "x").withColumn("fold", block_column(n, grid))
    big = cells.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("fold")
    return cells.join(big, "fold", "left_semi").select("fold", "y", "x")


def fold_free(known: DataFrame, folds: DataFrame, n: int, grid: Grid, buffer: int = 0) -> DataFrame:
    """H5: for each fold, the known cells of all other blocks, dilated by the buffer if there is one."""
    cells = known.select("y", "x").withColumn("block", block_column(n, grid))
    names = folds.select("fold").distinct()
    free = cells.crossJoin(F.broadcast(names)).where("block <> fold").select("fold", "y", "x")  # at most n * n folds
    if not buffer:
        return free
    near = scatter(free, [(a, b, 1.0) for a, b, _ in disk(buffer + 1) if abs(a) + abs(b) <= buffer], grid)
    return near.select("fold", F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()


def cut_runs(known: DataFrame, thin: DataFrame, grid: Grid, n_seeds: int = 400, run_radius: float = 6, halfwidth: int = 2, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """H6: contiguous runs as truth: cells of the thinned mask near seeds, dilated, within what is known; the rest is visible.

    Seeds are the first n_seeds cells of the thinned mask by key (a hash of the cell unless given).
    """
    seeds = matched_sample(thin.select("y", "x"), n_seeds, F.xxhash64("y", "x", F.lit(0)) if key is None else key)
    truth = semi(known.select("y", "x"), dilate(ball(thin, seeds, run_radius), halfwidth, grid))
    return truth, anti(known.select("y", "x"), truth)


def windows(folds: DataFrame, grid: Grid, n: int, pad: int = 6) -> DataFrame:
    """H7: each fold's padded window, its area, and its share of a budget of n dots (half-even, at least 1)."""
    box = bbox(folds, grid, pad, ("fold",)).withColumn("area", (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))
    return box.withColumn("budget", F.greatest(F.lit(1), F.rint(F.lit(float(n)) * F.col("area") / F.lit(float(grid.h * grid.w)))).cast("int"))
