"""Selection and packing of ranked cells (E1-E13). Ties always go to the smaller (y, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions.quantiles import quantiles
from gridloom.operators.geometry import max_filter
from gridloom.operators.stencil import anti, scatter, semi
from gridloom.session import cut
from gridloom.sources.grid import ranked

BEST = lambda v: (F.col(v).desc(), F.col("y").asc(), F.col("x").asc())


def tile_argmax(cells: DataFrame, v: str, bar: float, spacing: int, free: DataFrame | None = None, use_free: bool = True) -> DataFrame:
    """Free cells with v > 0, and of the others the best above the bar of each spacing x spacing tile."""
    others = (anti(cells, free) if free is not None else cells).where(F.col(v) > F.lit(bar))
    if spacing > 1:
        tile = Window.partitionBy(F.floor(F.col("y") / spacing), F.floor(F.col("x") / spacing)).orderBy(*BEST(v))
        others = others.withColumn("_n", F.row_number().over(tile)).where("_n = 1")
    out = others.select("y", "x")
    if use_free and free is not None:
        out = out.union(semi(cells.where(F.col(v) > 0), free).select("y", "x"))
    return out.withColumn("p", F.lit(1.0))


def greedy_nms(cells: DataFrame, v: str, spacing: float = 3.0, n: int | None = None, pool: int | None = None) -> DataFrame:
    """Rank, y, x, v: cells in descending v, each blocking all later ones closer than spacing.

    Rounds instead of a sequential loop: a candidate that has the best place in its whole disk is accepted, whatever comes before it;
    then the accepted cells' disks are cleared. Only the best cell of each square that no two taken cells share is tried. The result and its order equal the loop's, and the first n of the order are what a
    loop that stops at n would give. The pool keeps the best candidates only, as the parameter says.
    """
    order = ranked(cells.select("y", "x", v), *BEST(v), name="place")
    open_ = cut(order.where(F.col("place") <= pool) if pool else order)
    near = K.disk(spacing)
    side = max(1, math.ceil(spacing / 2**0.5 - 1e-9))  # no two cells of such a square are both taken: only its best can be
    rounds: list[DataFrame] = []
    while True:
        best = open_.groupBy(F.floor(F.col("y") / side), F.floor(F.col("x") / side)).agg(F.min(F.struct("place", "y", "x", v)).alias("s")).select("s.y", "s.x", f"s.{v}", "s.place")
        rival = scatter(best, near).select("y", "x", F.col("place").alias("mine"), "ty", "tx")
        beaten = rival.join(open_.select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("place").alias("other")), ["ty", "tx"]).where("other < mine").select("y", "x")
        won = cut(best.join(beaten, ["y", "x"], "left_anti"))
        rounds.append(won)
        gone = scatter(won, near).select(F.col("ty").alias("y"), F.col("tx").alias("x"))
        open_ = cut(anti(open_, gone))
        if open_.isEmpty():
            break
    taken = rounds[0]
    for won in rounds[1:]:
        taken = taken.unionByName(won)
    out = ranked(taken, F.col("place").asc(), name="rank").select("rank", "y", "x", v)
    return out.where(F.col("rank") <= n) if n else out


def local_max(cells: DataFrame, v: str, r: int = 1) -> DataFrame:
    """E3 (r = 3), E4 (r = 1): cells that no neighbour in the square exceeds; plateaus stay whole."""
    return max_filter(cells, v, r).where(F.col(v) >= F.col("top")).drop("top")


def ranked_peaks(cells: DataFrame, v: str, r: int = 3) -> DataFrame:
    """Local maxima with their rank."""
    return ranked(local_max(cells, v, r).select("y", "x", v), *BEST(v))


def prefix(order: DataFrame, n: int) -> DataFrame:
    """E5."""
    return order.where(F.col("rank") <= n)


def top(cells: DataFrame, v: str, n: int) -> DataFrame:
    """The n best cells."""
    return cells.orderBy(*BEST(v)).limit(n)


def round_robin(cells: DataFrame, v: str, block: str, name: str = "rank") -> DataFrame:
    """The best of every block first, then the second best, and so on."""
    nth = F.row_number().over(Window.partitionBy(block).orderBy(*BEST(v)))
    return ranked(cells.withColumn("nth", nth), F.col("nth").asc(), *BEST(v), name=name)


def quotas(cumulative: list[float], n: int) -> list[int]:
    """Whole quotas of each distance bin: half-even rounding, the remainder to the (first) largest bin."""
    cuts = [0.0, *cumulative, 1.0]
    mass = [b - a for a, b in zip(cuts, cuts[1:])]
    out = [round(m / sum(mass) * n) for m in mass]
    out[max(range(len(out)), key=lambda k: (out[k], -k))] += n - sum(out)
    return out


def stratified_select(peaks: DataFrame, v: str, d: str, block: str, edges: list[float], cumulative: list[float], n: int) -> DataFrame:
    """Peaks whose distance profile follows the reference: in each bin (edge, next edge] round-robin over blocks up to its quota, then
    round-robin over the rest up to n."""
    quota = quotas(cumulative, n)
    bin_ = sum((F.when(F.col(d) > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    peaks = peaks.withColumn("bin", bin_)
    nth = F.row_number().over(Window.partitionBy("bin", block).orderBy(*BEST(v)))
    limit = F.array(*[F.lit(max(0, q)) for q in quota])
    most = max(quota)  # as a literal it lets every task keep only its best rows of a block before the shuffle
    in_block = peaks.withColumn("nth", nth).where((F.col("nth") <= most) & (F.col("nth") <= limit[F.col("bin")]))
    order = ranked(in_block, F.col("bin").asc(), F.col("nth").asc(), *BEST(v), name="at")  # bins stand one after another
    start = order.groupBy(F.col("bin").alias("of")).agg(F.min("at").alias("first"))  # a row for each bin
    first = cut(order.join(F.broadcast(start), F.col("bin") == F.col("of")).where(F.col("at") - F.col("first") < limit[F.col("bin")]).select(*peaks.columns))
    missing = n - first.count()
    if missing <= 0:
        return first
    rest = anti(peaks, first)
    return first.union(round_robin(rest, v, block).where(F.col("rank") <= missing).select(*peaks.columns))


def pool_draw(cells: DataFrame, v: str, q: float, n: int, key: Column) -> DataFrame:
    """N cells by a fixed key out of the best share q; all cells are the pool if that is too small."""
    floor = quantiles(cells, v, [1.0 - q]).select(F.col("q0").alias("_f"))
    pool = cells.crossJoin(F.broadcast(floor)).where(F.col(v) >= F.col("_f")).drop("_f")  # a single row
    if pool.count() < n:
        pool = cells
    return pool.withColumn("_k", key).orderBy("_k", "y", "x").limit(n).drop("_k")


def matched_sample(cells: DataFrame, n: int, key: Column) -> DataFrame:
    """N cells by a fixed key."""
    return cells.withColumn("_k", key).orderBy("_k", "y", "x").limit(n).drop("_k")


def compose(*parts: DataFrame) -> DataFrame:
    """Y, x and the largest p over emissions."""
    out = parts[0].select("y", "x", "p")
    for part in parts[1:]:
        out = out.union(part.select("y", "x", "p"))
    return out.groupBy("y", "x").agg(F.max("p").alias("p"))


def expected_credit(dots: DataFrame, field: DataFrame, v: str = "v") -> DataFrame:
    """The field's sum over the dots."""
    return semi(field, dots).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("credit"))


def carpet(free: DataFrame) -> DataFrame:
    """A dot on every free cell, which is never charged."""
    return free.select("y", "x").withColumn("p", F.lit(1.0))
