"""Aggregates over cells, sets and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles
from gridloom.operators.geometry import components
from gridloom.sources.grid import Grid, ranked

#: Distances of the descriptor's cumulative profile.
DISTANCES = (1, 2, 3, 5, 10, 20, 40, 80)


def mask_stats(cells: DataFrame, v: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """A1."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def fraction_within(d: Column, limit: float) -> Column:
    """A2: the share of rows with d <= limit."""
    return F.avg(F.when(d <= F.lit(limit), F.lit(1.0)).otherwise(F.lit(0.0)))


def histogram(cells: DataFrame, v: str, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """A3: counts in [edge, next edge); values outside the edges are left out."""
    bin_ = sum((F.when(F.col(v) >= F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    rows = cells.where((F.col(v) >= F.lit(float(edges[0]))) & (F.col(v) < F.lit(float(edges[-1]))))
    return rows.groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentiles(cells: DataFrame, v: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """A4: exact, by linear interpolation; columns p<100 q>."""
    names = [f"p{round(100 * q)}" for q in qs]
    return quantiles(cells, v, qs, by).select(*by, *[F.col(f"q{k}").alias(n) for k, n in enumerate(names)])


def median_offset(cells: DataFrame, d: str, centre: float, by: tuple[str, ...] = ()) -> DataFrame:
    """A5: mad: median(|d - centre|)."""
    rows = cells.select(*by, F.abs(F.col(d) - F.lit(centre)).alias("_d"))
    return quantiles(rows, "_d", [0.5], by).select(*by, F.col("q0").alias("mad"))


def block_density(mask: DataFrame, grid: Grid, size: int = 32, by: tuple[str, ...] = ()) -> DataFrame:
    """By, bi, bj, density of each block with mask cells; edge blocks divide by their true size."""
    h = F.least(F.lit(size), F.lit(grid.h) - F.col("bi") * size)
    w = F.least(F.lit(size), F.lit(grid.w) - F.col("bj") * size)
    counted = mask.groupBy(*by, F.floor(F.col("y") / size).cast("int").alias("bi"), F.floor(F.col("x") / size).cast("int").alias("bj")).agg(F.count("*").alias("n"))
    return counted.select(*by, "bi", "bj", (F.col("n") / (h * w)).alias("density"))


def density_array(density: DataFrame, grid: Grid, size: int = 32, by: tuple[str, ...] = ()) -> DataFrame:
    """A6 as one row-major array of all blocks, rounded to 6 places; its length is fixed by the grid."""
    nb = -(-grid.w // size)
    total = nb * -(-grid.h // size)
    at = density.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bi") * nb + F.col("bj")).alias("k"), F.round("density", 6).alias("d")))).alias("m"))
    return at.select(*by, F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("block_density"))


def block_counts(mask: DataFrame, block: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """A7."""
    return mask.groupBy(*by, block.alias("block")).agg(F.count("*").alias("n"))


def occupancy(mask: DataFrame, inside: DataFrame, block: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The share of the footprint's blocks that hold a mask cell."""
    total = inside.agg(F.count_distinct(block).alias("_t"))
    held = mask.groupBy(*by).agg(F.count_distinct(block).alias("occupied"))
    return held.crossJoin(F.broadcast(total)).select(*by, "occupied", F.col("_t").alias("blocks"), (F.col("occupied") / F.col("_t")).alias("occupancy"))  # a single row


def centroid(mask: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A9."""
    return mask.groupBy(*by).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def component_stats(mask: DataFrame, eight: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """A10: number, mean and largest size of components, and the percentage of single cells among them."""
    sizes = components(mask, eight, by).groupBy(*by, "label").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("components"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), (F.lit(100.0) * F.avg(F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("pct_single"))


def best_by(rows: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """Each group's row with the largest value, ties in the order given."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pearson(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Null for constant input."""
    r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return rows.groupBy(*by).agg(F.when(~F.isnan(r), r).alias("pearson"))


def binary_pearson(n: Column, na: Column, nb: Column, both: Column) -> Column:
    """The correlation of two 0/1 layers on n cells from their counts; constant layers give 1 (both) or 0."""
    n, na, nb, both = (c.cast("double") for c in (n, na, nb, both))
    va, vb = na * (n - na), nb * (n - nb)
    return F.when((va > 0) & (vb > 0), (n * both - na * nb) / F.sqrt(va * vb)).otherwise(F.when((va <= 0) & (vb <= 0), F.lit(1.0)).otherwise(F.lit(0.0)))


def spearman(rows: DataFrame, a: str, b: str, ties: str = "ordinal", key: str = "id") -> DataFrame:
    """Ordinal ranks (ties by key) or average ranks, then Pearson; rows with a null or NaN are left out, fewer than 3 give null.

    Ranks are global row numbers of a distributed sort.
    """
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    if ties == "average":
        ranks = average_ranks(rows.select(key, F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], [key])
    else:
        first, second = (ranked(rows.select(key, F.col(c).alias("v")), F.col("v").asc(), F.col(key).asc(), name=f"r_{n}").select(key, f"r_{n}") for n, c in (("a", a), ("b", b)))
        ranks = first.join(second, key)
    return ranks.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("r_a", "r_b")).alias("spearman"))


def average_ranks(rows: DataFrame, cols: list[str], key: list[str]) -> DataFrame:
    """Columns r_<c>: average ranks of large tables: global row numbers, averaged over equal values."""
    for c in cols:
        order = ranked(rows.select(*key, c), F.col(c).asc(), *[F.col(k).asc() for k in key], name="_r")
        tied = order.groupBy(c).agg(F.avg("_r").alias(f"r_{c}"))
        rows = rows.join(order.join(tied, c).select(*key, f"r_{c}"), key)
    return rows


def fit_quality(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """N, RMSE, R squared, mean and largest absolute residual."""
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    n, sy, sy2 = F.count("*"), F.sum(F.col(y).cast("double")), F.sum(F.col(y).cast("double") * F.col(y).cast("double"))
    return rows.agg(n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.sum(e * e) / (sy2 - sy * sy / n)).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_residual"))


def percentile_lift(ranks: DataFrame, bands: list[str], sets: DataFrame) -> DataFrame:
    """For each set and band: mean rank, lift over all cells, and the percentages in the top tenth and hundredth.

    ranks: y, x and a rank in [0, 1] for each band; sets: name, y, x.
    """
    long = ranks.unpivot(["y", "x"], bands, "band", "pr").where("pr is not null")
    base = long.groupBy("band").agg(F.avg("pr").alias("base"))
    pct = lambda bar: F.lit(100.0) * F.avg(F.when(F.col("pr") >= bar, F.lit(1.0)).otherwise(F.lit(0.0)))
    got = long.join(sets.select("name", "y", "x"), ["y", "x"]).groupBy("name", "band").agg(F.avg("pr").alias("mean_rank"), pct(0.9).alias("pct_top10"), pct(0.99).alias("pct_top1"))
    return got.join(F.broadcast(base), "band").withColumn("lift", F.col("mean_rank") - F.col("base")).select("name", "band", "mean_rank", "lift", "pct_top10", "pct_top1")


def distance_profile(sets: DataFrame, distances: DataFrame) -> DataFrame:
    """For each set: count, p10, p50, p90 and the shares within 3 and 10 cells. distances: y, x, dist."""
    rows = sets.join(distances, ["y", "x"])
    shares = rows.groupBy("name").agg(F.count("*").alias("n"), fraction_within(F.col("dist"), 3).alias("within_3"), fraction_within(F.col("dist"), 10).alias("within_10"))
    return shares.join(percentiles(rows, "dist", [0.1, 0.5, 0.9], ("name",)), "name", "left").select("name", "n", "p10", "p50", "p90", "within_3", "within_10")


def marginals(curve: DataFrame, n: str, t: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Change of t per dot and log-log elasticity between adjacent budgets."""
    w = Window.partitionBy(*by).orderBy(n)
    n0, t0 = F.lag(n).over(w), F.lag(t).over(w)
    return curve.select(
        *by, n, t, ((F.col(t) - t0) / (F.col(n) - n0)).alias("marginal"),
        F.when((t0 > 0) & (F.col(t) > 0), F.ln(F.col(t) / t0) / F.ln(F.col(n).cast("double") / n0)).alias("elasticity"),
    )


def credit_curve(order: DataFrame, budgets: list[int], truth: DataFrame) -> DataFrame:
    """The credit of each prefix of a ranking, by truth's fold: n, fold, t. order: rank, y, x; truth: fold, y, x.

    One stencil join serves all budgets: a truth cell's credit at n is its best kernel weight among dots of rank n or less.
    """
    from gridloom.functions.kernels import cone
    from gridloom.operators.stencil import stencil_join

    met = stencil_join(truth.select("fold", "y", "x"), order.select("rank", "y", "x"), cone(), "inner")
    at = met.select("fold", "y", "x", "k", F.col("r_rank").alias("rank"), F.explode(F.array(*[F.lit(b) for b in budgets])).alias("n")).where("rank <= n")
    best = at.groupBy("n", "fold", "y", "x").agg(F.max("k").alias("credit"))
    return best.groupBy("n", "fold").agg(F.sum("credit").alias("t"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """The mean, least and number of positive folds for each budget."""
    return curve.groupBy("n").agg(F.avg("t").alias("mean_t"), F.min("t").alias("min_t"), F.count_if(F.col("t") > 0).alias("positive"))


def descriptor_vector(mask: DataFrame, distances: DataFrame, ranks: DataFrame, bands: list[str], inside: DataFrame, block: Column, least: int = 100) -> DataFrame:
    """One row: log count, distance shares, median offsets, mean ranks, mean component size, block occupancy; none below `least` cells."""
    rows = mask.select("y", "x").join(distances, ["y", "x"]).join(ranks.select("y", "x", *bands), ["y", "x"], "left")
    wide = rows.agg(
        F.count("*").alias("n"), F.log10(F.count("*").cast("double")).alias("log10_n"), *[fraction_within(F.col("dist"), d).alias(f"frac_le_{d}") for d in DISTANCES],
        *[F.avg(b).alias(f"pr_{b}") for b in bands],
    )
    for d in (5, 20):
        wide = wide.crossJoin(median_offset(rows, "dist", d).withColumnRenamed("mad", f"mad_d_{d}"))
    extra = component_stats(mask).select("mean_size").crossJoin(occupancy(mask, inside, block).select("occupancy"))
    return wide.crossJoin(extra).where(F.col("n") >= least)  # single rows


def is_binary(v: Column) -> Column:
    """All values are 0 or 1."""
    return F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(True))
