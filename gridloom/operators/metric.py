"""The distance-weighted Tversky index on sparse tables.

pred: y, x, p. truth and free: y, x. With `by`, tables carry grouping columns and a row per group comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions.scalars import clip_unit
from gridloom.operators.stencil import anti, neighbourhood, stencil_join
from gridloom.sources.grid import Grid


def credit(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """M6: for each truth cell, the largest p * k among the dots in reach (0 if none)."""
    dots = pred.select(*by, "y", "x", clip_unit(F.col("p")).alias("p"))
    met = stencil_join(truth.select(*by, "y", "x"), dots, K.cone(), "left", by)
    return met.groupBy(*by, "y", "x").agg(F.coalesce(F.max(F.col("r_p") * F.col("k")), F.lit(0.0)).alias("credit"))


def reach(truth: DataFrame, by: tuple[str, ...] = (), grid: Grid | None = None) -> DataFrame:
    """M3: for each cell near truth, the largest k."""
    return neighbourhood(truth.select(*by, "y", "x"), K.cone(), F.max("k"), "reach", grid, by)


def dilate_weighted(pred: DataFrame, grid: Grid | None = None) -> DataFrame:
    """M3: the neighbourhood maximum of p * k."""
    return neighbourhood(pred, K.cone(), F.max(F.col("p") * F.col("k")), "reach", grid)


def _own(table: DataFrame | None, by: tuple[str, ...]) -> list[str]:
    return [c for c in by if table is not None and c in table.columns]


def score(pred: DataFrame, truth: DataFrame, free: DataFrame | None = None, by: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """M5, M8, M9: n_truth, tp, fp, fn, dti, one row, or one for each group of `by`.

    Each table may carry some of the grouping columns: dots without a fold are scored against every fold, truth without a bar serves
    all bars. No table is repeated for the groups it does not tell apart. Truth is scattered once over the kernel's cells (`reach`), and
    the dots meet it on their own cells: what is charged is the mass of all dots, less that of dots on the free mask, less p * reach of
    the others. groups: grouping columns of groups that truth may lack.

    M14: without truth, dti and fn are 0 and the whole mass is charged, also on the free mask.
    """
    dots = pred.select(*_own(pred, by), "y", "x", clip_unit(F.col("p")).alias("p")).where("p > 0")
    pby, tby = _own(pred, by), _own(truth, by)
    fby = _own(free, by)
    best = stencil_join(truth.select(*tby, "y", "x"), dots, K.cone(), "inner", tuple(c for c in tby if c in pby))
    each = [c if c in tby else f"r_{c}" for c in by if c in tby or c in pby]
    tp = best.groupBy(*each, "y", "x").agg(F.max(F.col("r_p") * F.col("k")).alias("c")).groupBy(*each).agg(F.sum("c").alias("tp"))
    tp = tp.select(*[F.col(e).alias(c) for c, e in zip([c for c in by if c in tby or c in pby], each, strict=True)], "tp")
    mass = dots.groupBy(*pby).agg(F.sum("p").alias("mass"))
    near = reach(truth.select(*tby, "y", "x"), tuple(tby))
    hit = dots.join(near, ["y", "x", *[c for c in pby if c in tby]])
    if free is not None:
        mask = free.select(*fby, "y", "x").distinct().withColumn("_free", F.lit(1))
        spared = dots.join(mask, ["y", "x", *[c for c in pby if c in fby]])
        spared = spared.groupBy(*[c for c in by if c in pby or c in fby]).agg(F.sum("p").alias("spared"))
        hit = hit.join(mask, ["y", "x", *[c for c in fby if c in hit.columns]], "left").where("_free is null")
    met = hit.groupBy(*[c for c in by if c in pby or c in tby]).agg(F.sum(F.col("p") * F.col("reach")).alias("met"))
    n = truth.groupBy(*tby).agg(F.count("*").alias("n_truth"))
    # the groups: a few rows each
    every = groups.select(*[c for c in by if c in groups.columns]).distinct() if groups is not None else n.select(*tby)
    for part, own in ((mass, pby), (n, tby)):
        if missing := [c for c in own if c not in every.columns]:
            every = every.crossJoin(part.select(*missing).distinct())
    out = every
    for part in (n, mass, tp, met, *([spared] if free is not None else [])):
        keys = [c for c in by if c in part.columns]
        out = out.join(part, keys, "left") if keys else out.crossJoin(part)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = out.select(*by, F.coalesce("n_truth", F.lit(0)).alias("n_truth"), value("mass").alias("mass"), value("tp").alias("tp"), value("met").alias("met"), (value("spared") if free is not None else F.lit(0.0)).alias("spared"))
    some = F.col("n_truth") > 0
    out = out.withColumn("fp", F.when(some, F.greatest(F.col("mass") - F.col("spared") - F.col("met"), F.lit(0.0))).otherwise(F.col("mass"))).withColumn("fn", F.col("n_truth") - F.col("tp"))
    dti = F.when(some, K.tversky(F.col("tp"), F.col("fp"), F.col("fn"))).otherwise(F.lit(0.0))
    return out.select(*by, "n_truth", "tp", "fp", "fn", dti.alias("dti"))


def score_literal(pred: DataFrame, truth: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """M2, M4: the same figures by definition, through a bucketed range join of all pairs within reach."""
    from gridloom.operators.stencil import range_join

    dots = pred.select("y", "x", clip_unit(F.col("p")).alias("p")).where("p > 0")
    pairs = range_join(truth.select("y", "x"), dots, K.RADIUS).withColumn("k", K.kernel(F.col("dist")))
    best = pairs.groupBy("a_y", "a_x").agg(F.max(F.col("b_p") * F.col("k")).alias("c"))
    near = pairs.groupBy(F.col("b_y").alias("y"), F.col("b_x").alias("x")).agg(F.max("k").alias("reach"))
    charged = (anti(dots, free) if free is not None else dots).join(near, ["y", "x"], "left")
    tp, n = best.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("tp")), truth.agg(F.count("*").alias("n_truth"))
    fp = charged.agg(F.coalesce(F.sum(F.col("p") * (F.lit(1.0) - F.coalesce("reach", F.lit(0.0)))), F.lit(0.0)).alias("fp"))
    row = n.crossJoin(tp).crossJoin(fp).withColumn("fn", F.col("n_truth") - F.col("tp"))
    return row.withColumn("dti", K.tversky(F.col("tp"), F.col("fp"), F.col("fn")))


def credit_and_charge(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """M7: T and F of dots against a surrogate truth."""
    return score(pred, truth, None, by).select(*by, F.col("tp").alias("t"), F.col("fp").alias("f"))


def verdict(scored: DataFrame) -> DataFrame:
    """The score as one struct, with the share of truth that got credit."""
    return scored.select(F.struct("dti", "tp", "fp", "fn", "n_truth", (F.col("tp") / F.greatest(F.col("n_truth"), F.lit(1))).alias("coverage")).alias("verdict"))


def mean_over_folds(scored: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """The mean score over folds, and each fold's score in fold order."""
    per: Column = F.transform(F.array_sort(F.collect_list(F.struct(fold, "dti"))), lambda s: s["dti"])
    return scored.groupBy(*by).agg(F.avg("dti").alias("mean_dti"), F.count("*").alias("n_folds"), per.alias("per_fold"))
