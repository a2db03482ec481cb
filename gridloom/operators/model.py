"""Small regressions and searches over result tables.

Design matrices have a row per artifact and few columns; what scales is how they are gathered. The Gram matrix is one Spark
aggregate; only p x p numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import ship_package
from gridloom.sources.grid import ranked


@dataclass(frozen=True)
class Ridge:
    """Weights of standardised features, their means and population deviations, and the mean of y."""

    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    centre: float


def _solve(gram: np.ndarray, moment: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(gram + lam * np.eye(len(moment)), moment)


def ridge(rows: DataFrame, features: list[str], y: str, lam: float) -> Ridge:
    """L1: one aggregate of sums and products, then a p x p solve. The penalty is not scaled by the number of rows."""
    p = len(features)
    cols = [F.col(f).cast("double") for f in features]
    t = F.col(y).cast("double")
    r = rows.agg(
        F.count("*"), F.sum(t), *[F.sum(c) for c in cols], *[F.sum(c * t) for c in cols], *[F.sum(cols[i] * cols[j]) for i in range(p) for j in range(i, p)]
    ).first()
    n, sy = r[0], r[1]
    s, sxy = np.array(r[2 : 2 + p]), np.array(r[2 + p : 2 + 2 * p])
    sxx = np.zeros((p, p))
    sxx[np.triu_indices(p)] = r[2 + 2 * p :]
    sxx = sxx + np.triu(sxx, 1).T
    mean = s / n
    cov = sxx / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-12
    gram = n * cov / np.outer(deviation, deviation)
    return Ridge(_solve(gram, (sxy - mean * sy) / deviation, lam), mean, deviation, sy / n)


def predict(model: Ridge, features: list[str]) -> Column:
    """L2."""
    return F.lit(float(model.centre)) + sum(((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(d)) * F.lit(float(w)) for f, w, m, d in zip(features, model.weights, model.mean, model.deviation, strict=True)), F.lit(0.0))


@dataclass(frozen=True)
class Moments:
    """Of rows of numbers: how many they are, a centre near their means, the sums of their differences from it and of their products."""

    n: int
    centre: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def add(self, rows: np.ndarray) -> Moments:
        d = rows - self.centre
        return Moments(self.n + len(d), self.centre, self.sums + d.sum(0), self.products + d.T @ d)


#: A row with more than this share of a column's squared deviations is not taken from the sums, which would cancel, but left out of them.
HEAVY = 0.9


def _moments(rows: DataFrame, cols: list[str]) -> tuple[Moments, list[tuple[float, ...]]]:
    """Moments of the rows and, for each column, the row that differs most from the mean: two aggregates, (p + 1)**2 numbers."""
    v = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]  # a null leaves no fit, as a NaN does
    p = len(cols)
    r = rows.agg(F.count("*"), *[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)) for c in v]).first()  # a constant is its own mean, without rounding
    centre = np.array(r[1:], float)
    d = [c - F.lit(float(m)) for c, m in zip(v, centre, strict=True)]
    up = np.triu_indices(p)
    q = rows.agg(*[F.sum(c) for c in d], *[F.sum(d[i] * d[j]) for i, j in zip(*up, strict=True)], *[F.max_by(F.struct(*v), F.abs(c)) for c in d]).first()
    products = np.zeros((p, p))
    products[up] = np.array(q[p:-p], float)
    return Moments(r[0], centre, np.array(q[:p], float), products + np.triu(products, 1).T), [tuple(x) if x else () for x in q[-p:]]


def _heavy(rows: DataFrame, cols: list[str]) -> tuple[Moments, np.ndarray, list[Moments]]:
    """Moments of all rows, the rows that make up most of a column's squared deviations (one a column at most), and the moments without each of them."""
    whole, most = _moments(rows, cols)
    spread = np.diag(whole.products) - whole.sums**2 / max(whole.n, 1)
    at = {}
    for j, row in enumerate(most):
        gap = row[j] - whole.centre[j] - whole.sums[j] / whole.n if row else 0.0
        if 0 < HEAVY * spread[j] < gap * gap * whole.n / max(whole.n - 1, 1):
            at[j] = row
    if not at:
        return whole, np.zeros((0, len(cols))), []
    heavy = np.array(sorted(set(at.values())), float)
    # such a value is its column's only one, so that it tells the row
    is_heavy = [F.coalesce(F.col(cols[j]).cast("double") == F.lit(row[j]), F.lit(False)) for j, row in at.items()]
    rest, _ = _moments(rows.where(~F.array_contains(F.array(*is_heavy), True)), cols)
    if not rest.n:
        rest = Moments(0, whole.centre, np.zeros(len(cols)), np.zeros((len(cols), len(cols))))
    return rest.add(heavy), heavy, [rest.add(np.delete(heavy, k, 0)) for k in range(len(heavy))]


def _fits_without(m: Moments, rows: np.ndarray, at: list[int], lam: float, taken: bool) -> np.ndarray:
    """Predictions of the rows' last column from those at the places `at`, each by the fit to all rows but itself; taken: the moments are without it already."""
    d = rows - m.centre
    n, s, c = (m.n, np.broadcast_to(m.sums, d.shape), np.broadcast_to(m.products, (len(d), *m.products.shape))) if taken else (m.n - 1, m.sums - d, m.products - d[:, :, None] * d[:, None, :])
    c = c - s[:, :, None] * (s[:, None, :] / n)
    mean, centre = m.centre[at] + s[:, at] / n, m.centre[-1] + s[:, -1] / n
    gram = c[:, at][:, :, at]
    dev = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0) / n) + 1e-12
    w = np.linalg.solve(gram / (dev[:, :, None] * dev[:, None, :]) + lam * np.eye(len(at)), (c[:, at, -1] / dev)[:, :, None])[:, :, 0]
    return centre + ((rows[:, at] - mean) / dev * w).sum(1)


def leave_one_out(rows: DataFrame, key: str, features: list[str], y: str, lams: list[float], subsets: dict[str, list[str]] | None = None) -> DataFrame:
    """L3, L4: lam, subset, key, y, pred: each row predicted by the fit to all others, for each penalty and feature subset.

    The sums and products of all rows are gathered once; a row's fit has them less its own, so that the work is in proportion to the
    rows. What it cancels is bounded: see HEAVY.
    """
    subsets = subsets or {"all": features}
    whole, heavy, without = _heavy(rows, [*features, y])
    step = max(1, 1_000_000 // (len(features) + 1) ** 2)

    def predicted(v: np.ndarray, at: list[int], lam: float) -> np.ndarray:
        out = np.concatenate([_fits_without(whole, v[k : k + step], at, lam, False) for k in range(0, len(v), step)])
        for row, m in zip(heavy, without, strict=True):
            if (same := (v == row).all(1)).any():
                out[same] = _fits_without(m, v[same], at, lam, True)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = pdf[[*features, y]].to_numpy(float)
            for name, used in subsets.items():
                for lam in lams:
                    with np.errstate(all="ignore"):
                        pred = predicted(v, [features.index(f) for f in used], float(lam))
                    yield pd.DataFrame({"lam": float(lam), "subset": name, key: pdf[key], "y": v[:, -1], "pred": pred})

    ship_package(rows.sparkSession)
    schema = f"lam double, subset string, {key} {rows.schema[key].dataType.simpleString()}, y double, pred double"
    return rows.select(key, *features, y).mapInPandas(run, schema)


def loo_summary(loo: DataFrame, key: str | None = None) -> DataFrame:
    """L3: R squared and RMSE of each penalty and subset; with the key also Spearman of prediction and truth, ties in the key's order.

    Ranks are global row numbers with penalties and subsets one after another: they differ from ranks by a number that a correlation
    does not see.
    """
    e, n = F.col("y") - F.col("pred"), F.count("*")
    aggs = [n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.sum(e * e) / (F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n)).alias("r2")]
    if key:
        for c, at in (("pred", "_p"), ("y", "_t")):
            loo = ranked(loo, *[F.col(k).asc() for k in ("lam", "subset", c, key)], name=at)
        aggs.append(F.corr("_p", "_t").alias("spearman"))
    return loo.groupBy("lam", "subset").agg(*aggs)


def coefficients(spark: SparkSession, model: Ridge, features: list[str]) -> DataFrame:
    """L4: feature, nth, weight (per unit of the feature), the largest first."""
    rows = sorted(((f, float(w / d)) for f, w, d in zip(features, model.weights, model.deviation, strict=True)), key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame([(f, k, w) for k, (f, w) in enumerate(rows, 1)], "feature string, nth int, weight double")


def hull_clip(model: Ridge, features: list[str], rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Predictions with standardised features clipped to the range that the fit has seen; the worst clip and the number clipped."""
    low_high = rows.agg(*[e for f in features for e in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))])
    at = candidates.crossJoin(F.broadcast(low_high))  # a single row
    z, clip = {}, {}
    for f, m, d in zip(features, model.mean, model.deviation, strict=True):
        std = lambda c, m=m, d=d: (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(d))
        z[f], clip[f] = std(f), F.least(F.greatest(std(f), std(f"lo_{f}")), std(f"hi_{f}"))
    pred = F.lit(float(model.centre)) + sum((clip[f] * F.lit(float(w)) for f, w in zip(features, model.weights, strict=True)), F.lit(0.0))
    gaps = [F.abs(z[f] - clip[f]) for f in features]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return at.select(*candidates.columns, pred.alias("pred"), worst.alias("worst_clip"), sum((F.when(g > 1e-9, 1).otherwise(0) for g in gaps), F.lit(0)).alias("n_clipped"))


def grid_fit(rows: DataFrame, loss: Callable[[Column], Column], lo: int, hi: int, step: int) -> DataFrame:
    """The parameter of an integer grid with the least root mean squared loss; ties go to the smaller."""
    at = rows.withColumn("param", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    e = loss(F.col("param").cast("double"))
    scored = at.groupBy("param").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return scored.orderBy("rmse", "param").limit(1)


def golden_section(rows: DataFrame, loss: Callable[[float], Column], lo: float, hi: float, rounds: int = 40) -> tuple[float, float]:
    """A one-parameter fit by golden-section search; each step is one aggregate over the rows."""
    g = (5**0.5 - 1) / 2
    at = lambda v: rows.agg(F.sqrt(F.avg(loss(v) * loss(v)))).first()[0]
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = at(a), at(b)
    for _ in range(rounds):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = at(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = at(b)
    return ((a, fa) if fa <= fb else (b, fb))


def bounded_least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Projected, damped Gauss-Newton with a numeric Jacobian, for a few dozen rows and parameters."""
    p, damp = np.clip(start, lo, hi), 1e-3
    r = residual(p)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(residual(np.where(np.arange(len(p)) == k, p + h, p)) - r) / h[k] for k in range(len(p))], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(len(p)), -jac.T @ r)
        trial = np.clip(p + step, lo, hi)
        if (new := residual(trial)) @ new < r @ r:
            done = np.abs(trial - p).max() < 1e-10
            p, r, damp = trial, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def block_inversion(counts: np.ndarray, scores: np.ndarray, areas: np.ndarray, kernel_mass: float, most: float = 0.95) -> dict[str, np.ndarray | float]:
    """The share of cells of each block that scores imply, for artifacts (rows) with so many cells in each block (columns).

    An artifact earns its cells times the shares, is charged for the rest, and misses what the blocks' areas times the shares hold,
    over the kernel's mass. share, pred, rmse, corr, and the same figures with each artifact left out: loo, loo_mae, loo_corr.
    A fit has a few dozen artifacts and as many blocks.
    """
    def predict(c: np.ndarray, n: np.ndarray) -> np.ndarray:
        t, k = n @ c, areas @ c / kernel_mass
        return t / (0.2 * t + 0.2 * (n @ (1.0 - c)) + 0.8 * k + 1e-12)

    def solve(use: np.ndarray) -> np.ndarray:
        p = counts.shape[1]
        return bounded_least_squares(lambda c: predict(c, counts[use]) - scores[use], np.full(p, 0.02), np.zeros(p), np.full(p, most))

    every = np.arange(len(scores))
    share = solve(every)
    pred = predict(share, counts)
    loo = np.array([predict(solve(every[every != k]), counts[k : k + 1])[0] for k in every])
    corr = lambda x: float(np.corrcoef(x, scores)[0, 1]) if len(scores) > 2 and x.std() > 0 else float("nan")
    return {"share": share, "pred": pred, "rmse": float(np.sqrt(np.mean((pred - scores) ** 2))), "corr": corr(pred), "loo": loo, "loo_mae": float(np.abs(loo - scores).mean()), "loo_corr": corr(loo)}


def loglog_slope(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The slope of ln y on ln x."""
    a, b = F.ln(F.col(x).cast("double")), F.ln(F.col(y).cast("double"))
    return rows.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*by).agg(F.regr_slope(b, a).alias("slope"))


def mass_bounds(pairs: DataFrame, least: float, most: float, points: int) -> DataFrame:
    """The interval of m on a geometric grid that nested pairs and saturation allow.

    pairs: s0, n0, s1, n1 of nested emissions. Monotonicity: the implied credit of the larger is no less; saturation: m exceeds
    0.2 s n / (1 - s) for every score.
    """
    step = (most / least) ** (1.0 / (points - 1))
    grid = pairs.sparkSession.range(points).select((F.lit(least) * F.pow(F.lit(step), F.col("id"))).alias("m"))
    credit = lambda s, n: F.col(s) * (F.lit(0.2) * F.col(n) + F.lit(0.8) * F.col("m")) / (F.lit(1.0) - F.lit(0.2) * F.col(s))
    bad = pairs.join(F.broadcast(grid), credit("s1", "n1") < credit("s0", "n0"))  # a fixed number of points
    floor = pairs.agg(F.max(F.greatest(F.lit(0.2) * F.col("s0") * F.col("n0") / (F.lit(1.0) - F.col("s0")), F.lit(0.2) * F.col("s1") * F.col("n1") / (F.lit(1.0) - F.col("s1")))).alias("lower"))
    return bad.agg(F.min("m").alias("upper")).crossJoin(floor).select("lower", "upper")


def forward_selection(fields: dict[str, DataFrame], score: Callable[[DataFrame], float], most: int = 4) -> list[tuple[str, float]]:
    """Greedy: add the field whose average with the current one scores best, until nothing improves by 1e-9."""
    from gridloom.session import cut

    chosen: list[tuple[str, float]] = []
    current, best = None, -np.inf
    for _ in range(most):
        trials = []
        for name in sorted(set(fields) - {n for n, _ in chosen}):
            f = fields[name].select("y", "x", F.col("v").alias("f"))
            mixed = f.withColumnRenamed("f", "v") if current is None else current.join(f, ["y", "x"]).select("y", "x", ((F.col("v") + F.col("f")) / F.lit(2.0)).alias("v"))
            trials.append((score(mixed), name, mixed))
        if not trials:
            break
        value, name, mixed = max(trials, key=lambda t: (t[0], t[1]))
        if value <= best + 1e-9:
            break
        best, current = value, cut(mixed)
        chosen.append((name, value))
    return chosen


def choose(rows: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """The best row of a sweep."""
    return rows.orderBy(F.col(value).desc(), *ties).limit(1)


def pair_marginals(pairs: DataFrame, ms: list[float]) -> DataFrame:
    """Marginal credit and elasticity of nested pairs (s0, n0, s1, n1) at several m."""
    at = pairs.withColumn("m", F.explode(F.array(*[F.lit(float(m)) for m in ms])))
    t = lambda s, n: F.col(s) * (F.lit(0.2) * F.col(n) + F.lit(0.8) * F.col("m")) / (F.lit(1.0) - F.lit(0.2) * F.col(s))
    at = at.withColumn("t0", t("s0", "n0")).withColumn("t1", t("s1", "n1"))
    return at.withColumn("marginal", (F.col("t1") - F.col("t0")) / (F.col("n1") - F.col("n0"))).withColumn("elasticity", F.ln(F.col("t1") / F.col("t0")) / F.ln(F.col("n1").cast("double") / F.col("n0")))


def correlations(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """Each feature's correlation with y, strongest first."""
    wide = rows.agg(*[F.corr(F.col(f).cast("double"), F.col(y).cast("double")).alias(f) for f in features])
    long = wide.unpivot([], features, "feature", "r")
    return long.withColumn("nth", F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "feature")))
