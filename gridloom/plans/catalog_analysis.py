"""Queries of filters, selection, folds, statistics, similarity and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.operators import fields, filters, folds, geometry, metric, model, select, similarity, stats, stencil
from gridloom.plans.catalog import ART, CONE, DIST, PX, SETS, Ctx, _block_sql, _on, add, query, r6
from gridloom.sources import grid as G

# ---------------------------------------------------------------- filters and fields

_TAPS = [float(t) for t in filters.taps(1.5)]
_TAPS_SQL = "tp(o, k) AS (VALUES " + ", ".join(f"({i - len(_TAPS) // 2}, {t!r}e0)" if "e" not in repr(t) else f"({i - len(_TAPS) // 2}, {t!r})" for i, t in enumerate(_TAPS)) + ")"
add(
    "gaussian_1d", lambda c: filters.gaussian_axis(c.px.select("y", "x", F.col("d").cast("double").alias("v")), "v", 1.5, c.grid).select("y", "x", *r6("blur")),
    f"""WITH {SETS}, {_TAPS_SQL}, s AS (SELECT y, i - o AS t, d * k AS c FROM px, gs, tp, (SELECT unnest([0, 1, 2]) AS f),
  LATERAL (SELECT CASE f WHEN 0 THEN x WHEN 1 THEN -x - 1 ELSE 2 * w - 1 - x END AS i))
SELECT px.y, px.x, round(sum(c), 6) AS blur FROM px JOIN s ON s.y = px.y AND s.t = px.x GROUP BY 1, 2""",
)
add(
    "smooth_tau", lambda c: filters.smooth(c.px.select("y", "x", (F.col("d") / 10.0).alias("v")), "v", c.grid).select("y", "x", *r6("tau")),
    f"""WITH {SETS}, {CONE} SELECT y + dy AS y, x + dx AS x, round(sum(d / 10.0e0 * k), 6) AS tau FROM px, k, gs WHERE y + dy BETWEEN 0 AND h - 1
  AND x + dx BETWEEN 0 AND w - 1 GROUP BY px.y + dy, px.x + dx""",
)
_SCALE6 = "CASE WHEN hi <= lo THEN 0.0e0 ELSE least(greatest((v - lo) / (hi - lo), 0.0e0), 1.0e0) END"
_SCALE = "CASE WHEN hi <= lo + 1.0e-7 THEN 0.0e0 ELSE least(greatest((v - lo) / (hi - lo), 0.0e0), 1.0e0) END"
_DIRTY = "CASE WHEN q % 7 = 0 OR q % 5 = 0 THEN NULL ELSE v END AS v"


def _dirtied(c: Ctx) -> DataFrame:
    """v with NaN and sentinels among its values."""
    return c.px.select("y", "x", "q", F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).when(F.col("q") % 5 == 0, F.lit(-3.4028e38)).otherwise(F.col("v")).alias("v"))


add(
    "norm_percentile", lambda c: filters.percentile_scale(_dirtied(c), "v").select("y", "x", *r6("z")),
    f"""WITH {PX}, n AS (SELECT y, x, {_DIRTY} FROM px), c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM n) SELECT y, x,
  round(CASE WHEN v IS NULL THEN 0.0e0 ELSE {_SCALE6} END, 6) AS z FROM n, c""",
)
add(
    "norm_strided", lambda c: filters.percentile_scale(c.px.select("y", "x", "v"), "v", strided=8).select("y", "x", *r6("z")),
    f"WITH {PX}, c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px WHERE y % 8 = 0 AND x % 8 = 0) SELECT y, x, round({_SCALE}, 6) AS z FROM px, c",
)
add(
    "norm_masked", lambda c: filters.percentile_scale(c.px.select("y", "x", "v", "q"), "v", F.col("q") > 10).select("y", "x", *r6("z")),
    f"WITH {PX}, c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px WHERE q > 10) SELECT y, x, round({_SCALE6}, 6) AS z FROM px, c",
)
add(
    "pct_rank", lambda c: filters.pct_rank(c.px.select("y", "x", "q"), "q", F.col("q") > 2).select("y", "x", *r6("pr")),
    f"""WITH {PX}, r AS (SELECT y, x, (row_number() OVER (ORDER BY q, y, x) - 1) / CAST(greatest(count(*) OVER () - 1, 1) AS DOUBLE) AS pr FROM px
  WHERE q > 2) SELECT px.y, px.x, round(pr, 6) AS pr FROM px LEFT JOIN r ON r.y = px.y AND r.x = px.x""",
)
add(
    "composite", lambda c: fields.composite(c.px.select("y", "x", F.col("d").cast("double").alias("d"), "v"), {"d": 2.0, "v": 1.0}).select("y", "x", *r6("v")),
    f"""WITH {PX}, c AS (SELECT quantile_cont(d, 0.01) AS dl, quantile_cont(d, 0.99) AS dh, quantile_cont(v, 0.01) AS vl, quantile_cont(v, 0.99) AS vh FROM px WHERE y % 8 = 0 AND x % 8 = 0),
a AS (SELECT y, x, (2.0e0 * least(greatest((d - dl) / (dh - dl), 0.0e0), 1.0e0) + least(greatest((v - vl) / (vh - vl), 0.0e0), 1.0e0)) AS v FROM px,
  c), s AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM a WHERE y % 8 = 0 AND x % 8 = 0)
SELECT y, x, round({_SCALE}, 6) AS v FROM a, s""",
)
add(
    "consensus", lambda c: fields.consensus(G.derived_supports(c.spark, c.sf_dir).select("y", "x", (F.col("a") / 10.0).alias("score"))).select("y", "x", *r6("v")),
    f"WITH {ART} SELECT y, x, round(sum((a / 10.0e0) * (a / 10.0e0)), 6) AS v FROM art GROUP BY 1, 2",
)
add(
    "near_shell", lambda c: fields.near_known(c.px, c.truth, c.grid).select("y", "x", *r6("v")),
    f"WITH {SETS}, {DIST} SELECT y, x, round(CASE WHEN dist > 0 THEN exp(-pow(dist / 6.0e0, 2)) ELSE 0.0e0 END, 6) AS v FROM dist",
)
add(
    "shell_reweight", lambda c: geometry.distance(c.px, c.truth, c.grid).join(c.px, ["y", "x"]).select("y", "x", F.round(fields.shell_reweight(F.col("d") / 10.0, F.col("dist"), 4.0, 2.0, 1.0, F.col("q") > 2), 6).alias("v")),
    f"WITH {SETS}, {DIST} SELECT y, x, round(CASE WHEN q > 2 THEN d / 10.0e0 * exp(-0.5e0 * pow((dist - 4.0e0) / 2.0e0, 2)) ELSE 0.0e0 END, 6) AS v FROM dist JOIN px USING (y, x)",
)
add(
    "distance_band", lambda c: geometry.distance(c.px, c.truth, c.grid).select("y", "x", F.round(fields.distance_band(F.col("dist")), 6).alias("v")),
    f"WITH {SETS}, {DIST} SELECT y, x, round(least(greatest(1.0e0 - abs(dist - 8.0e0) / 4.0e0, 0.0e0), 1.0e0), 6) AS v FROM dist",
)


# ---------------------------------------------------------------- selection

add(
    "tile_argmax", lambda c: select.tile_argmax(c.px.select("y", "x", "v"), "v", 60000.0, 3, c.free).select("y", "x", "p"),
    f"""WITH {SETS}, o AS (SELECT * FROM px p WHERE v > 60000.0e0 AND NOT EXISTS (SELECT 1 FROM free f WHERE f.y = p.y AND f.x = p.x))
SELECT y, x, 1.0e0 AS p FROM (SELECT y, x, row_number() OVER (PARTITION BY y // 3, x // 3 ORDER BY v DESC, y, x) AS n FROM o) WHERE n = 1 UNION ALL
  SELECT y, x, 1.0e0 FROM px JOIN free USING (y, x) WHERE v > 0""",
)
#: Rounds of a recursive query: a cell next to a taken one goes, a cell before all its open neighbours is taken.
_GREEDY = f"""WITH RECURSIVE {PX}, o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx < 9),
st(step, place, y, x, s) AS (
  SELECT 0, row_number() OVER (ORDER BY v DESC, y, x), y, x, 0 FROM px
  UNION ALL
  SELECT step + 1, place, y, x, CASE WHEN s = 1 OR least = place THEN 1 ELSE 0 END FROM (
    SELECT a.step, a.place, a.y, a.x, a.s, min(CASE WHEN b.s = 0 THEN b.place END) AS least, max(CASE WHEN b.s = 1 AND b.place <> a.place THEN 1 ELSE 0 END) AS beaten, any_value(u.n) AS n
    FROM st a CROSS JOIN o JOIN st b ON b.y = a.y + o.dy AND b.x = a.x + o.dx CROSS JOIN (SELECT count(*) FILTER (s = 0) AS n FROM st) u GROUP BY 1, 2, 3, 4, 5)
  WHERE n > 0 AND (s = 1 OR beaten = 0)),
g AS (SELECT row_number() OVER (ORDER BY place) AS rank, y, x FROM st WHERE step = (SELECT max(step) FROM st))
SELECT rank, y, x, v FROM g JOIN px USING (y, x)"""
add("greedy_nms", lambda c: select.greedy_nms(c.px, "v", 3.0), _GREEDY)
add("greedy_prefix", lambda c: select.prefix(select.greedy_nms(c.px, "v", 3.0), 500), _GREEDY + " WHERE rank <= 500")
add("topk_cap", lambda c: select.top(c.px.select("y", "x", "v"), "v", 1000), f"WITH {PX} SELECT y, x, v FROM px ORDER BY v DESC, y, x LIMIT 1000")
_BLOCKED = "b AS (SELECT y, x, v, CAST((y // 100) * 40 + x // 100 AS INT) AS block FROM px)"
add(
    "round_robin", lambda c: select.round_robin(c.px.select("y", "x", "v", folds.fixed_block().alias("block")), "v", "block"),
    f"""WITH {PX}, {_BLOCKED}, n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY v DESC, y, x) AS nth FROM b) SELECT y, x, v, block, nth,
  row_number() OVER (ORDER BY nth, v DESC, y, x) AS rank FROM n""",
)
_EDGES, _CUM = [1.0, 2.0, 3.0, 5.0], [0.1, 0.35, 0.6, 0.9]
_QUOTA = select.quotas(_CUM, 400)
add(
    "stratified_select", lambda c: select.stratified_select(select.local_max(c.px.select("y", "x", "v"), "v", 1).join(geometry.distance(c.px, c.truth, c.grid), ["y", "x"]).withColumn("block", folds.fixed_block(20, 20)), "v", "dist", "block", _EDGES, _CUM, 400).select("y", "x", "v", "block", "bin"),
    f"""WITH {SETS}, {DIST}, o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)), top AS (SELECT a.y, a.x, any_value(a.v) AS v,
  max(b.v) AS t FROM px a CROSS JOIN o JOIN px b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2),
pk AS (SELECT y, x, v, CAST((y // 20) * 20 + x // 20 AS INT) AS block,
  CAST((dist > 1)::INT + (dist > 2)::INT + (dist > 3)::INT + (dist > 5)::INT AS INT) AS bin FROM top JOIN dist USING (y, x) WHERE v >= t),
qt(bin, quota) AS (VALUES {", ".join(f"({k}, {q})" for k, q in enumerate(_QUOTA))}),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY nth, v DESC, y, x) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY bin, block ORDER BY v DESC, y, x) AS nth FROM pk)),
f AS (SELECT y, x, v, block, bin FROM r JOIN qt USING (bin) WHERE pos <= quota),
rest AS (SELECT *, row_number() OVER (ORDER BY nth, v DESC, y, x) AS pos FROM (SELECT pk.*, row_number() OVER (PARTITION BY block ORDER BY v DESC, y,
  x) AS nth FROM pk WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.y = pk.y AND f.x = pk.x)))
SELECT * FROM f UNION ALL SELECT y, x, v, block, bin FROM rest WHERE pos <= 400 - (SELECT count(*) FROM f)""",
)
_KEY = "(y * 7919 + x * 104729) % 1000003"
add(
    "pool_draw", lambda c: select.pool_draw(c.px.select("y", "x", "v"), "v", 0.25, 500, F.expr(_KEY)),
    f"WITH {PX}, f AS (SELECT quantile_cont(v, 0.75) AS f FROM px) SELECT y, x, v FROM px, f WHERE v >= f ORDER BY {_KEY}, y, x LIMIT 500",
)
add("matched_sample", lambda c: select.matched_sample(c.px.select("y", "x"), 500, F.expr(_KEY)), f"WITH {PX} SELECT y, x FROM px ORDER BY {_KEY}, y, x LIMIT 500")
add(
    "emission_compose", lambda c: select.compose(select.carpet(c.free), c.pred, select.top(c.px.select("y", "x", "v"), "v", 300).select("y", "x", F.lit(0.5).alias("p"))),
    f"""WITH {SETS}, t AS (SELECT y, x, 0.5e0 AS p FROM px ORDER BY v DESC, y, x LIMIT 300) SELECT y, x, max(p) AS p FROM (SELECT y, x, 1.0e0 AS p
  FROM free UNION ALL SELECT y, x, p FROM pred UNION ALL SELECT * FROM t) GROUP BY 1, 2""",
)
add("expected_credit", lambda c: select.expected_credit(c.truth, c.px.select("y", "x", "v")).select(*r6("credit")), f"WITH {PX} SELECT round(sum(v), 6) AS credit FROM px WHERE q <= 2")

# ---------------------------------------------------------------- folds

add("fold_cells", lambda c: folds.fold_cells(c.truth, 3, c.grid, 10), f"""WITH {SETS}, kb AS (SELECT y, x, {_block_sql(3)} AS fold FROM truth, gs)
  SELECT fold, y, x FROM kb WHERE fold IN (SELECT fold FROM kb GROUP BY 1 HAVING count(*) >= 10)""")
add(
    "fold_free", lambda c: folds.fold_free(c.truth, folds.fold_cells(c.truth, 2, c.grid, 10), 2, c.grid, 1),
    f"""WITH {SETS}, kb AS (SELECT y, x, {_block_sql(2)} AS fold FROM truth, gs), adm AS (SELECT fold FROM kb GROUP BY 1 HAVING count(*) >= 10),
  ff AS (SELECT adm.fold, y, x FROM kb, adm WHERE kb.fold <> adm.fold)
SELECT DISTINCT fold, y + dy AS y, x + dx AS x FROM ff, range(-1, 2) a(dy), range(-1, 2) b(dx), gs WHERE abs(dy) + abs(dx) <= 1 AND y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND w - 1""",
)
add("sized_blocks", lambda c: c.px.groupBy(folds.sized_block(4, c.grid).alias("block")).agg(F.count("*").alias("n")), f"""WITH {SETS}
  SELECT CAST((y // ((h + 3) // 4)) * 4 + x // ((w + 3) // 4) AS INT) AS block, count(*) AS n FROM px, gs GROUP BY 1""")
add("fixed_blocks", lambda c: c.px.groupBy(folds.fixed_block().alias("block")).agg(F.count("*").alias("n")), f"WITH {PX}, {_BLOCKED} SELECT block, count(*) AS n FROM b GROUP BY 1")
add(
    "fold_windows", lambda c: folds.windows(folds.fold_cells(c.truth, 3, c.grid, 10), c.grid, 1000),
    f"""WITH {SETS}, b AS (SELECT {_block_sql(3)} AS fold, greatest(min(y) - 6, 0) AS y0, least(max(y) + 6, any_value(h) - 1) AS y1,
  greatest(min(x) - 6, 0) AS x0, least(max(x) + 6, any_value(w) - 1) AS x1, count(*) AS n, any_value(h * w) AS total FROM truth, gs GROUP BY 1)
SELECT fold, y0, y1, x0, x1, (y1 - y0 + 1) * (x1 - x0 + 1) AS area, CAST(greatest(1,
  round_even(1000.0e0 * ((y1 - y0 + 1) * (x1 - x0 + 1)) / CAST(total AS DOUBLE), 0)) AS INT) AS budget FROM b WHERE n >= 10""",
)
# ---------------------------------------------------------------- statistics

add("mask_stats", lambda c: stats.mask_stats(c.px.where("d >= 5"), "v").select("n", *r6("sum", "mean", "min", "max")), f"""WITH {PX}
  SELECT CAST(count(*) AS BIGINT) AS n, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM px
  WHERE d >= 5""")
add(
    "distance_fractions", lambda c: geometry.distance(c.px, c.truth, c.grid).agg(*[F.round(stats.fraction_within(F.col("dist"), d), 6).alias(f"le_{d}") for d in (1, 3, 5, 10)]),
    f"WITH {SETS}, {DIST} SELECT " + ", ".join(f"round(avg(CASE WHEN dist <= {d} THEN 1.0e0 ELSE 0.0e0 END), 6) AS le_{d}" for d in (1, 3, 5, 10)) + " FROM dist",
)
add("distance_hist", lambda c: stats.histogram(geometry.distance(c.px, c.truth, c.grid), "dist", [0, 1, 2, 3, 5, 10]), f"""WITH {SETS},
  {DIST} SELECT CAST((dist >= 1)::INT + (dist >= 2)::INT + (dist >= 3)::INT + (dist >= 5)::INT AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM dist
  WHERE dist >= 0 AND dist < 10 GROUP BY 1""")
add(
    "distance_percentiles", lambda c: stats.percentiles(geometry.distance(c.px, c.truth, c.grid).join(c.px, ["y", "x"]), "dist", [0.1, 0.5, 0.9], ("d",)).select("d", *r6("p10", "p50", "p90")),
    f"""WITH {SETS}, {DIST} SELECT d, round(quantile_cont(dist, 0.1), 6) AS p10, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist,
  0.9), 6) AS p90 FROM dist JOIN px USING (y, x) GROUP BY 1""",
)
add("median_offset", lambda c: stats.median_offset(c.px, "v", 40000.0, ("d",)).select("d", *r6("mad")), f"WITH {PX} SELECT d, round(quantile_cont(abs(v - 40000.0e0), 0.5), 6) AS mad FROM px GROUP BY 1")
add(
    "block_density", lambda c: stats.block_density(c.pred, c.grid).select("bi", "bj", *r6("density")),
    f"""WITH {SETS} SELECT CAST(y // 32 AS INT) AS bi, CAST(x // 32 AS INT) AS bj, round(count(*) / CAST(any_value(least(32,
  h - (y // 32) * 32) * least(32, w - (x // 32) * 32)) AS DOUBLE), 6) AS density FROM pred, gs GROUP BY 1, 2""",
)
add("block_counts", lambda c: stats.block_counts(c.pred, folds.fixed_block(50)), f"""WITH {SETS}
  SELECT CAST((y // 50) * 40 + x // 50 AS INT) AS block, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY 1""")
add("block_occupancy", lambda c: stats.occupancy(c.truth, c.px, folds.fixed_block(10, 100)).select("occupied", "blocks", *r6("occupancy")), f"""WITH {SETS}
  SELECT *, round(occupied / CAST(blocks AS DOUBLE), 6) AS occupancy FROM (SELECT (SELECT count(DISTINCT (y // 10) * 100 + x // 10)
  FROM truth) AS occupied, (SELECT count(DISTINCT (y // 10) * 100 + x // 10) FROM px) AS blocks)""")
add("centroid", lambda c: stats.centroid(c.truth).select(*r6("cy", "cx")), f"WITH {SETS} SELECT round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM truth")
add(
    "pearson_pairs", lambda c: stats.pearson(c.px, "v", "q", ("d",)).select("d", *r6("pearson")),
    f"WITH {PX} SELECT d, round(corr(v, q), 6) AS pearson FROM px GROUP BY 1",
)


def _parts(c: Ctx) -> DataFrame:
    return c.spark.read.parquet(f"{c.sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))


add("spearman_ordinal", lambda c: stats.spearman(_parts(c), "a", "b").select("n", *r6("spearman")), """SELECT count(*) AS n, round(corr(ra, rb),
  6) AS spearman FROM (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS ra, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rb
  FROM customer)""")
add(
    "spearman_avg_ties", lambda c: stats.spearman(_parts(c), "a", "b", "average").select("n", *r6("spearman")),
    """SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman
  FROM (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0e0 AS ra,
  rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0e0 AS rb FROM customer)""",
)
add(
    "fit_quality", lambda c: stats.fit_quality(c.px.withColumn("guess", F.col("q") * 1500.0), "v", "guess").select("n", *r6("rmse", "r2", "mae", "max_residual")),
    f"""WITH {PX}, e AS (SELECT v, v - q * 1500.0e0 AS e FROM px) SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse,
  round(1.0e0 - sum(e * e) / (sum(v * v) - sum(v) * sum(v) / count(*)), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS max_residual
  FROM e""",
)


def _ranks(c: Ctx) -> DataFrame:
    return c.px.join(filters.rank_columns(c.px, {"v": "pv", "q": "pq"}), ["y", "x"], "left")


def _sets(c: Ctx) -> DataFrame:
    return c.pred.select(F.lit("pred").alias("name"), "y", "x").union(c.free.select(F.lit("free"), "y", "x"))


_RANKS_SQL = """pr AS (SELECT y, x, (row_number() OVER (ORDER BY v, y, x) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS pv,
  (row_number() OVER (ORDER BY q, y, x) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS pq FROM px)"""
add(
    "percentile_lift", lambda c: stats.percentile_lift(_ranks(c), ["pv", "pq"], _sets(c)).select("name", "band", *r6("mean_rank", "lift", "pct_top10", "pct_top1")),
    f"""WITH {SETS}, {_RANKS_SQL}, l AS (SELECT y, x, 'pv' AS band, pv AS r FROM pr UNION ALL SELECT y, x, 'pq', pq FROM pr),
  s AS (SELECT 'pred' AS name, y, x FROM pred UNION ALL SELECT 'free', y, x FROM free), b AS (SELECT band, avg(r) AS base FROM l GROUP BY 1)
SELECT name, band, round(avg(r), 6) AS mean_rank, round(avg(r) - any_value(base), 6) AS lift,
  round(100.0e0 * avg(CASE WHEN r >= 0.9e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pct_top10,
  round(100.0e0 * avg(CASE WHEN r >= 0.99e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pct_top1
FROM l JOIN s USING (y, x) JOIN b USING (band) GROUP BY 1, 2""",
)
add(
    "distance_profile", lambda c: stats.distance_profile(_sets(c), geometry.distance(c.px, c.truth, c.grid)).select("name", "n", *r6("p10", "p50", "p90", "within_3", "within_10")),
    f"""WITH {SETS}, {DIST}, s AS (SELECT 'pred' AS name, y, x FROM pred UNION ALL SELECT 'free', y, x FROM free) SELECT name, count(*) AS n,
  round(quantile_cont(dist, 0.1), 6) AS p10, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.9), 6) AS p90,
round(avg(CASE WHEN dist <= 3 THEN 1.0e0 ELSE 0.0e0 END), 6) AS within_3, round(avg(CASE WHEN dist <= 10 THEN 1.0e0 ELSE 0.0e0 END), 6) AS within_10 FROM s JOIN dist USING (y, x) GROUP BY 1""",
)
_BUDGETS = [100, 500, 1000, 5000]
_CURVE = f"""WITH {SETS}, {CONE}, r AS (SELECT y, x, row_number() OVER (ORDER BY v DESC, y, x) AS rank FROM px), t AS (SELECT y, x,
  {_block_sql(2)} AS fold FROM truth, gs), n AS (SELECT unnest([100, 500, 1000, 5000]) AS n),
b AS (SELECT n, fold, t.y, t.x, max(k) AS c FROM t CROSS JOIN k JOIN r ON r.y = t.y + dy AND r.x = t.x + dx JOIN n ON rank <= n GROUP BY 1, 2, 3, 4),
  cv AS (SELECT n, fold, sum(c) AS t FROM b GROUP BY 1, 2)"""


def _curve(c: Ctx) -> DataFrame:
    order = G.ranked(c.px.select("y", "x", "v"), *select.BEST("v"))
    return stats.credit_curve(order, _BUDGETS, c.truth.withColumn("fold", folds.block_column(2, c.grid)))


add("credit_curve", lambda c: _curve(c).select("n", "fold", *r6("t")), f"{_CURVE} SELECT n, fold, round(t, 6) AS t FROM cv")
add("credit_curve_summary", lambda c: stats.curve_summary(_curve(c)).select("n", "positive", *r6("mean_t", "min_t")), f"""{_CURVE}
  SELECT n, count(*) FILTER (t > 0) AS positive, round(avg(t), 6) AS mean_t, round(min(t), 6) AS min_t FROM cv GROUP BY 1""")
add(
    "elasticity", lambda c: stats.marginals(_curve(c), "n", "t", ("fold",)).select("fold", "n", *r6("t", "marginal", "elasticity")),
    f"""{_CURVE}, l AS (SELECT *, lag(n) OVER w AS n0, lag(t) OVER w AS t0 FROM cv WINDOW w AS (PARTITION BY fold ORDER BY n))
SELECT fold, n, round(t, 6) AS t, round((t - t0) / (n - n0), 6) AS marginal, round(CASE WHEN t0 > 0 AND t > 0 THEN ln(t / t0) / ln(CAST(n AS DOUBLE) / n0) END, 6) AS elasticity FROM l""",
)
add("loglog_slope", lambda c: model.loglog_slope(_curve(c), "n", "t", ("fold",)).select("fold", *r6("slope")), f"{_CURVE} SELECT fold, round(regr_slope(ln(t), ln(n)), 6) AS slope FROM cv WHERE t > 0 GROUP BY 1")
_FRACTIONS = ", ".join(f"round(avg(CASE WHEN dist <= {d} THEN 1.0e0 ELSE 0.0e0 END), 6) AS frac_le_{d}" for d in stats.DISTANCES)
_DESCRIBED = ["log10_n", *[f"frac_le_{d}" for d in stats.DISTANCES], "mad_d_5", "mad_d_20", "pr_pv", "pr_pq", "mean_size", "occupancy"]
add(
    "descriptor_vector",
    lambda c: stats.descriptor_vector(c.truth, geometry.distance(c.px, c.free, c.grid), _ranks(c), ["pv", "pq"], c.px, folds.fixed_block(10, 100)).select("n", *r6(*_DESCRIBED)),
    f"""WITH RECURSIVE {SETS}, {_RANKS_SQL},
dist AS (SELECT px.y, px.x, min(sqrt((px.y - t.y) * (px.y - t.y) + (px.x - t.x) * (px.x - t.x))) AS dist FROM px, free t GROUP BY 1, 2),
reach(y, x, ry, rx) AS (SELECT y, x, y, x FROM truth UNION SELECT r.y, r.x, n.y, n.x FROM reach r JOIN truth n ON n.y BETWEEN r.ry - 1 AND r.ry + 1 AND n.x BETWEEN r.rx - 1 AND r.rx + 1),
lab AS (SELECT y, x, min(CAST(ry AS BIGINT) * 4294967296 + rx) AS label FROM reach GROUP BY 1, 2), s AS (SELECT count(*) AS n FROM lab GROUP BY label)
SELECT count(*) AS n, round(log10(count(*)), 6) AS log10_n, {_FRACTIONS},
  round(quantile_cont(abs(dist - 5), 0.5), 6) AS mad_d_5, round(quantile_cont(abs(dist - 20), 0.5), 6) AS mad_d_20, round(avg(pv), 6) AS pr_pv, round(avg(pq), 6) AS pr_pq,
  (SELECT round(avg(n), 6) FROM s) AS mean_size,
  round((SELECT count(DISTINCT (y // 10) * 100 + x // 10) FROM truth) / CAST((SELECT count(DISTINCT (y // 10) * 100 + x // 10) FROM px) AS DOUBLE), 6) AS occupancy
FROM truth JOIN dist USING (y, x) JOIN pr USING (y, x)""",
)

# ---------------------------------------------------------------- similarity

AGREE = "round(CASE WHEN na + nb > 0 THEN 2.0e0 * i / (na + nb) END, 6) AS dice, round(CASE WHEN na + nb - i > 0 THEN CAST(i AS DOUBLE) / (na + nb - i) END, 6) AS jaccard, round(CASE WHEN na > 0 THEN CAST(i AS DOUBLE) / na END, 6) AS a_in_b, round(CASE WHEN nb > 0 THEN CAST(i AS DOUBLE) / nb END, 6) AS b_in_a"
COUNTS = "na AS n_a, nb AS n_b, i AS intersection, na + nb - i AS \"union\""
PAIRS = f"""{ART}, n AS (SELECT a, count(*) AS n FROM art GROUP BY 1), pr AS (SELECT n1.a AS a, n2.a AS b, n1.n AS na, n2.n AS nb, (SELECT count(*)
  FROM art u JOIN art v USING (y, x) WHERE u.a = n1.a AND v.a = n2.a) AS i FROM n n1 JOIN n n2 ON n1.a < n2.a)"""


def _art(c: Ctx) -> DataFrame:
    return G.derived_supports(c.spark, c.sf_dir)


add(
    "final_agreement", lambda c: similarity.agreement(_art(c).where("a = 1"), _art(c).where("a = 2")).select("n_a", "n_b", "intersection", "union", *r6("dice", "jaccard", "a_in_b", "b_in_a")),
    f"""WITH {ART}, s AS (SELECT (SELECT count(*) FROM art WHERE a = 1) AS na, (SELECT count(*) FROM art WHERE a = 2) AS nb, (SELECT count(*)
  FROM art u JOIN art v USING (y, x) WHERE u.a = 1 AND v.a = 2) AS i) SELECT {COUNTS}, {AGREE} FROM s""",
)
add(
    "payload_agreement", lambda c: similarity.agreement(similarity.payloads(_art(c).where("a = 1"), c.free), similarity.payloads(_art(c).where("a = 2"), c.free)).select("n_a", "n_b", "intersection", "union", *r6("dice", "jaccard", "a_in_b", "b_in_a")),
    f"""WITH {SETS}, {ART}, py AS (SELECT * FROM art p WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.y = p.y AND f.x = p.x)),
  s AS (SELECT (SELECT count(*) FROM py WHERE a = 1) AS na, (SELECT count(*) FROM py WHERE a = 2) AS nb, (SELECT count(*) FROM py u
  JOIN py v USING (y, x) WHERE u.a = 1 AND v.a = 2) AS i) SELECT {COUNTS}, {AGREE} FROM s""",
)
add(
    "all_pairs_overlap", lambda c: similarity.all_pairs(_art(c), c.grid).select("a", "b", "n_a", "n_b", "intersection", "union", *r6("dice", "jaccard", "a_in_b", "b_in_a", "pearson", "pearson_support")),
    f"""WITH {SETS}, {PAIRS} SELECT a, b, {COUNTS}, {AGREE}, round((CAST(h * w AS DOUBLE) * i - CAST(na AS DOUBLE) * nb) / sqrt(CAST(na AS DOUBLE) * (h * w - na) * nb * (h * w - nb)), 6) AS pearson,
round((CAST(i AS DOUBLE) * (na + nb - i) - CAST(na AS DOUBLE) * nb) / sqrt(CAST(na AS DOUBLE) * (nb - i) * nb * (na - i)), 6) AS pearson_support FROM pr, gs""",
)
add(
    "binary_pearson", lambda c: c.px.agg(F.count("*").alias("n"), F.count_if(F.col("d") >= 5).alias("na"), F.count_if(F.col("q") > 20).alias("nb"), F.count_if((F.col("d") >= 5) & (F.col("q") > 20)).alias("i")).select(F.round(stats.binary_pearson(F.col("n"), F.col("na"), F.col("nb"), F.col("i")), 6).alias("pearson")),
    f"WITH {PX} SELECT round(corr((d >= 5)::INT, (q > 20)::INT), 6) AS pearson FROM px",
)
add(
    "bound_prune", lambda c: similarity.pair_table(_art(c)).select("a", "b", similarity.bound_prune(F.col("na"), F.col("nb"), F.col("a") == 1, F.lit(False)).alias("compared")),
    f"WITH {PAIRS} SELECT a, b, a = 1 OR 2.0e0 * least(na, nb) / greatest(na + nb, 1) >= 0.75e0 AS compared FROM pr",
)


add(
    "registry_summary", lambda c: similarity.registry_summary(_art(c), c.truth, geometry.distance(c.px, c.truth, c.grid), c.free).select("a", "n_positive", *r6("pct_on_known", "pct_within_3"), "payload"),
    f"""WITH {SETS}, {ART}, {DIST} SELECT a, count(*) AS n_positive, round(100.0e0 * avg(CASE WHEN dist = 0 THEN 1.0e0 ELSE 0.0e0 END),
  6) AS pct_on_known, round(100.0e0 * avg(CASE WHEN dist <= 3 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pct_within_3,
count(*) FILTER (f.y IS NULL) AS payload FROM art JOIN dist USING (y, x) LEFT JOIN free f ON f.y = art.y AND f.x = art.x GROUP BY 1""",
)
add(
    "surface_correlation", lambda c: similarity.surface_correlation(_art(c).where("a = 1").select("y", "x", "p"), _art(c).where("a = 2").select("y", "x", "p"), c.grid).select(*r6("pearson_full"), "n_support", *r6("pearson_support", "spearman_support")),
    f"""WITH {SETS}, {ART}, j AS (SELECT coalesce(u.p, 0.0e0) AS u, coalesce(v.p, 0.0e0) AS w FROM (SELECT * FROM art WHERE a = 1) u FULL
  JOIN (SELECT * FROM art WHERE a = 2) v ON u.y = v.y AND u.x = v.x), g AS (SELECT CAST(h AS DOUBLE) * gs.w AS n FROM gs)
SELECT round((sum(u * w) - sum(u) * sum(w) / any_value(n)) / sqrt((sum(u * u) - sum(u) * sum(u) / any_value(n)) * (sum(w * w) - sum(w) * sum(w) / any_value(n))),
  6) AS pearson_full, count(*) AS n_support, round(corr(u, w), 6) AS pearson_support, round(corr(u, w), 6) AS spearman_support FROM j, g""",
)
query(
    "ledger_resolve",
    """WITH f AS (SELECT DISTINCT p_name AS name FROM part), l AS (SELECT p_partkey AS claim, split_part(p_name, ' ', 1) AS repo, split_part(p_name, ' ', 2) AS needle FROM part),
m AS (SELECT claim, repo, needle, name, row_number() OVER (PARTITION BY claim ORDER BY CASE WHEN starts_with(name, repo || '__') THEN 0 ELSE 1 END,
  length(name), name) AS n FROM l LEFT JOIN f ON contains(name, needle)) SELECT claim, repo, needle, name FROM m WHERE n = 1""",
)(_on("part", lambda t: similarity.resolve_names(t.select(F.col("p_partkey").alias("claim"), F.split("p_name", " ")[0].alias("repo"), F.split("p_name", " ")[1].alias("needle")), t.select(F.col("p_name").alias("name")).distinct())))
query("name_rules", "SELECT DISTINCT p_name AS name, CASE WHEN p_name LIKE '%bolt%' THEN 'x' WHEN p_name LIKE '%red%' THEN 'y' END AS label FROM part")(
    _on("part", lambda t: similarity.classify_names(t.select(F.col("p_name").alias("name")).distinct(), [("x", "Bolt"), ("y", "red")]))
)
query(
    "first_match", """WITH w AS (SELECT unnest(['RED', 'bolt', 'none']) AS wanted), m AS (SELECT wanted, p_name AS name,
  row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN starts_with(lower(p_name), lower(wanted)) THEN 0 ELSE 1 END, p_partkey) AS n FROM w LEFT
  JOIN part ON contains(lower(p_name), lower(wanted))) SELECT wanted, name FROM m WHERE n = 1"""
)(_on("part", lambda t: similarity.first_match(t.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position")), ["RED", "bolt", "none"])))

# ---------------------------------------------------------------- models and sweeps


def _sweep(c: Ctx) -> DataFrame:
    """The best bar and fold score of thresholded fields: one plan for all parameters."""
    ft = folds.fold_cells(c.truth, 2, c.grid, 10)
    dots = stencil.sweep(c.px, bar=[7, 8, 9]).where("d >= bar").select("bar", "y", "x", F.lit(1.0).alias("p"))
    scored = metric.score(dots, ft, None, ("bar", "fold"))
    return metric.mean_over_folds(scored, ["bar"])


add(
    "sweep_best", lambda c: model.choose(_sweep(c), "mean_dti", ["bar"]).select("bar", "n_folds", *r6("mean_dti")),
    f"""WITH {SETS}, {CONE}, ft AS (SELECT y, x, {_block_sql(2)} AS fold FROM truth, gs), bars AS (SELECT unnest([7, 8, 9]) AS bar), dots AS (SELECT bar, y, x FROM px, bars WHERE d >= bar),
cr AS (SELECT bar, fold, t.y, t.x, max(CASE WHEN p.y IS NOT NULL THEN k ELSE 0.0e0 END) AS c FROM ft t CROSS JOIN k CROSS JOIN bars LEFT
  JOIN dots p USING (bar) WHERE true AND p.y = t.y + dy AND p.x = t.x + dx GROUP BY 1, 2, 3, 4),
tp AS (SELECT bar, fold, sum(c) AS tp FROM cr GROUP BY 1, 2), nt AS (SELECT fold, count(*) AS n FROM ft GROUP BY 1),
rc AS (SELECT bar, f.fold, p.y, p.x, coalesce(max(CASE WHEN t.y IS NOT NULL THEN k END), 0.0e0) AS k FROM dots p CROSS JOIN nt f CROSS JOIN k LEFT
  JOIN ft t ON t.fold = f.fold AND t.y = p.y + dy AND t.x = p.x + dx GROUP BY 1, 2, 3, 4),
fp AS (SELECT bar, fold, sum(1.0e0 - k) AS fp FROM rc GROUP BY 1, 2),
s AS (SELECT bar, tp / (tp + 0.2e0 * fp + 0.8e0 * (n - tp) + 1.0e-12) AS dti FROM tp JOIN fp USING (bar, fold) JOIN nt USING (fold)) SELECT bar,
  count(*) AS n_folds, round(avg(dti), 6) AS mean_dti FROM s GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1""",
)
add("best_by_block", lambda c: stats.best_by(c.px.select("y", "x", "v", folds.fixed_block().alias("block")), "v", ["block"], ["y", "x"]), f"""WITH {PX},
  {_BLOCKED} SELECT y, x, v, block FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY v DESC, y, x) AS n FROM b) WHERE n = 1""")


def _design(c: Ctx, p: int) -> DataFrame:
    e = c.spark.read.parquet(f"{c.sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(p)])


_ZSQL = """z AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS f FROM embeddings), m AS (SELECT avg(f) AS mu,
  stddev_pop(f) + 1.0e-12 AS sd, avg(y) AS yb FROM z),
  w AS (SELECT sum((f - mu) / sd * (y - yb)) / (sum((f - mu) / sd * ((f - mu) / sd)) + 10.0e0) AS w FROM z, m)"""


def _ridge_1d(c: Ctx) -> DataFrame:
    rows = _design(c, 1)
    return rows.select("vec_id", F.round(model.predict(model.ridge(rows, ["f0"], "y", 10.0), ["f0"]), 6).alias("pred"))


add("ridge_1d", _ridge_1d, f"WITH {_ZSQL} SELECT vec_id, round(yb + (f - mu) / sd * w, 6) AS pred FROM z, m, w")


def _clip(c: Ctx) -> DataFrame:
    rows = _design(c, 1)
    low = rows.where("vec_id % 2 = 0")
    return model.hull_clip(model.ridge(low, ["f0"], "y", 10.0), ["f0"], low, rows.where("vec_id % 2 = 1").select("vec_id", "f0")).select("vec_id", *r6("pred", "worst_clip"), "n_clipped")


add(
    "hull_clip", _clip,
    f"""WITH {_ZSQL.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 2 = 0)')},
  b AS (SELECT (min(f) - any_value(mu)) / any_value(sd) AS lo, (max(f) - any_value(mu)) / any_value(sd) AS hi FROM z, m), """
    """o AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) - mu) / sd AS s, yb, w, lo, hi FROM embeddings, m, w, b WHERE vec_id % 2 = 1) SELECT vec_id,
  round(yb + least(greatest(s, lo), hi) * w, 6) AS pred, round(abs(s - least(greatest(s, lo), hi)), 6) AS worst_clip, CAST(abs(s - least(greatest(s,
  lo), hi)) > 1.0e-9 AS INT) AS n_clipped FROM o""",
)
_SIX = [f"f{k}" for k in range(6)]
_LAMS = [0.3, 1.0, 3.0, 10.0]


def _loo(c: Ctx, subsets: dict[str, list[str]]) -> DataFrame:
    names = sorted({f for fs in subsets.values() for f in fs})
    loo = model.leave_one_out(_design(c, 6), "vec_id", names, "y", _LAMS, subsets)
    return model.loo_summary(loo, "vec_id").select("lam", "subset", "n", *r6("rmse", "r2", "spearman"))


#: One feature, all rows but one: the sums without that row give its fit.
_LOO_1D = """WITH z AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, CAST(embedding[@K@] AS DOUBLE) AS f FROM embeddings),
t AS (SELECT count(*) - 1 AS m, sum(f) AS sf, sum(f * f) AS sff, sum(y) AS sy, sum(f * y) AS sfy FROM z),
o AS (SELECT vec_id, y, f, m, (sf - f) / m AS mu, (sy - y) / m AS yb, sqrt((sff - f * f) / m - ((sf - f) / m) * ((sf - f) / m)) + 1.0e-12 AS sd, sfy - f * y AS xy FROM z, t),
p AS (SELECT lam, vec_id, y, yb + (f - mu) / sd * (((xy - mu * yb * m) / sd) / (m * ((sd - 1.0e-12) / sd) * ((sd - 1.0e-12) / sd) + lam)) AS pred
  FROM o, (SELECT unnest([0.3e0, 1.0e0, 3.0e0, 10.0e0]) AS lam)),
r AS (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY pred, vec_id) AS rp, row_number() OVER (PARTITION BY lam ORDER BY y, vec_id) AS rt FROM p)
SELECT lam, '@N@' AS subset, count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
  round(1.0e0 - sum((y - pred) * (y - pred)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(corr(rp, rt), 6) AS spearman
FROM r GROUP BY 1"""
add("loo_ridge", lambda c: _loo(c, {"all": _SIX, "first": ["f0"]}))
add("loo_single", lambda c: _loo(c, {f: [f] for f in _SIX[:3]}), " UNION ALL ".join(f"SELECT * FROM ({_LOO_1D.replace('@K@', str(k + 1)).replace('@N@', f'f{k}')})" for k in range(3)))


def _ranked_weights(c: Ctx) -> DataFrame:
    rows = _design(c, 2)
    return model.coefficients(c.spark, model.ridge(rows, ["f0", "f1"], "y", 10.0), ["f0", "f1"]).select("feature", "nth", *r6("weight"))


add(
    "coefficient_ranking", _ranked_weights,
    """WITH z AS (SELECT CAST(label AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) + 1.0e-12 AS da, stddev_pop(b) + 1.0e-12 AS db FROM z),
g AS (SELECT sum((a - ma) / da * ((a - ma) / da)) + 10.0e0 AS aa, sum((b - mb) / db * ((b - mb) / db)) + 10.0e0 AS bb, sum((a - ma) / da * ((b - mb) / db)) AS ab,
  sum((a - ma) / da * (y - my)) AS ay, sum((b - mb) / db * (y - my)) AS by_, any_value(da) AS da, any_value(db) AS db FROM z, m),
w AS (SELECT 'f0' AS feature, (ay * bb - by_ * ab) / (aa * bb - ab * ab) / da AS w FROM g UNION ALL SELECT 'f1', (by_ * aa - ay * ab) / (aa * bb - ab * ab) / db FROM g)
SELECT feature, CAST(row_number() OVER (ORDER BY abs(w) DESC, feature) AS INT) AS nth, round(w, 6) AS weight FROM w""",
)
add(
    "feature_correlations", lambda c: model.correlations(_design(c, 4), [f"f{k}" for k in range(4)], "y").select("feature", "nth", *r6("r")),
    "WITH r AS (" + " UNION ALL ".join(f"""SELECT 'f{k}' AS feature, corr(CAST(embedding[{k + 1}] AS DOUBLE), CAST(label AS DOUBLE)) AS r
  FROM embeddings""" for k in range(4)) + ") SELECT feature, row_number() OVER (ORDER BY abs(r) DESC, feature) AS nth, round(r, 6) AS r FROM r",
)
add(
    "grid_fit", lambda c: model.grid_fit(c.px.select("v", "q"), lambda m: F.col("v") - F.col("q") * m, 500, 2500, 50).select(F.col("param").cast("int").alias("param"), *r6("rmse")),
    f"""WITH {PX}, s AS (SELECT p AS param, sqrt(avg((v - q * p) * (v - q * p))) AS rmse FROM px, range(500, 2501, 50) t(p) GROUP BY 1)
  SELECT CAST(param AS INT) AS param, round(rmse, 6) AS rmse FROM s ORDER BY s.rmse, 1 LIMIT 1""",
)
_NEST = [(0.10, 10000.0, 0.14, 18000.0), (0.14, 18000.0, 0.2, 37000.0), (0.2, 37000.0, 0.18, 60000.0), (0.05, 5000.0, 0.10, 10000.0)]
_NEST_SQL = "pr(s0, n0, s1, n1) AS (VALUES " + ", ".join("(" + ", ".join(f"{x:e}" for x in r) + ")" for r in _NEST) + ")"


def _nested(c: Ctx) -> DataFrame:
    return c.spark.createDataFrame(_NEST, "s0 double, n0 double, s1 double, n1 double")


_T = lambda s, n: f"{s} * (0.2e0 * {n} + 0.8e0 * m) / (1.0e0 - 0.2e0 * {s})"
add(
    "mass_bounds", lambda c: model.mass_bounds(_nested(c), 1000.0, 1000000.0, 500).select(*r6("lower", "upper")),
    f"""WITH {_NEST_SQL}, g AS (SELECT 1000.0e0 * pow(pow(1000.0e0, 1.0e0 / 499), i) AS m FROM range(500) t(i))
  SELECT round((SELECT max(greatest(0.2e0 * s0 * n0 / (1.0e0 - s0), 0.2e0 * s1 * n1 / (1.0e0 - s1))) FROM pr), 6) AS lower, round((SELECT min(m)
  FROM pr, g WHERE {_T('s1', 'n1')} < {_T('s0', 'n0')}), 6) AS upper""",
)
add(
    "pair_marginals", lambda c: model.pair_marginals(_nested(c), [60988.0, 218910.0]).select("s0", "s1", "m", *r6("marginal", "elasticity")),
    f"""WITH {_NEST_SQL}, t AS (SELECT *, {_T('s0', 'n0')} AS t0, {_T('s1', 'n1')} AS t1 FROM pr, (SELECT unnest([60988.0e0, 218910.0e0]) AS m))
  SELECT s0, s1, m, round((t1 - t0) / (n1 - n0), 6) AS marginal, round(ln(t1 / t0) / ln(n1 / n0), 6) AS elasticity FROM t""",
)


def _forward(c: Ctx) -> DataFrame:
    def credit(field: DataFrame) -> float:
        dots = select.top(field, "v", 2000).select("y", "x", F.lit(1.0).alias("p"))
        return metric.credit(dots, c.truth).agg(F.round(F.sum("credit"), 6)).first()[0]

    bands = {n: c.px.select("y", "x", e.alias("v")) for n, e in (("d", F.col("d") / 10.0), ("low_q", 1 - F.col("q") / 50.0), ("v", F.col("v") / 100000.0))}
    chosen = model.forward_selection(bands, credit)
    return c.spark.createDataFrame([(k, n, float(s)) for k, (n, s) in enumerate(chosen)], "step int, field string, score double")


#: All subsets of three fields; the greedy path through them.
_FORWARD = f"""WITH {SETS}, {CONE}, f AS (SELECT y, x, d / 10.0e0 AS d, 1 - q / 50.0e0 AS low_q, v / 100000.0e0 AS v FROM px),
mix AS (SELECT @MIXES@),
r AS (SELECT name, y, x, row_number() OVER (PARTITION BY name ORDER BY val DESC, y, x) AS n FROM mix),
b AS (SELECT name, t.y, t.x, max(k) AS c FROM truth t CROSS JOIN k JOIN r ON r.y = t.y + dy AND r.x = t.x + dx AND r.n <= 2000 GROUP BY 1, 2, 3),
s AS (SELECT name, round(sum(c), 6) AS score FROM b GROUP BY 1),
s1 AS (SELECT name, score FROM s WHERE NOT contains(name, '+') ORDER BY score DESC, name DESC LIMIT 1),
s2 AS (SELECT s.name, s.score FROM s, s1 WHERE len(string_split(s.name, '+')) = 2 AND starts_with(s.name, s1.name || '+') AND s.score > s1.score + 1.0e-9 ORDER BY s.score DESC, s.name DESC LIMIT 1),
s3 AS (SELECT s.name, s.score FROM s, s2 WHERE len(string_split(s.name, '+')) = 3 AND starts_with(s.name, s2.name || '+') AND s.score > s2.score + 1.0e-9 ORDER BY s.score DESC, s.name DESC LIMIT 1)
SELECT CAST(len(string_split(name, '+')) - 1 AS INT) AS step, string_split(name, '+')[-1] AS field, score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


def _mixes() -> str:
    """Every order in which fields can be added, as the mean of the mean so far and the next one."""
    import itertools

    parts = []
    for n in (1, 2, 3):
        for names in itertools.permutations(["d", "low_q", "v"], n):
            e = names[0]
            for f in names[1:]:
                e = f"(({e}) + {f}) / 2.0e0"
            parts.append(f"'{'+'.join(names)}' AS name, y, x, {e} AS val FROM f")
    return " UNION ALL SELECT ".join(parts)


add("forward_selection", _forward, _FORWARD.replace("@MIXES@", _mixes()))


def _inversion(c: Ctx) -> DataFrame:
    """A curve of known parameters at the derived grid's values of d, fitted; the parameters come back."""
    import numpy as np

    d = np.array([r["d"] for r in c.px.select("d").distinct().orderBy("d").collect()], float)  # eleven rows
    curve = lambda t: t[0] + t[1] * np.exp(-t[2] * d)
    target = curve(np.array([2.0, 1.5, 0.3]))
    p = model.bounded_least_squares(lambda t: curve(t) - target, np.array([1.0, 1.0, 0.1]), np.array([-50.0, -50.0, 0.0]), np.array([50.0, 50.0, 5.0]))
    return c.spark.createDataFrame([(k, round(float(x), 3)) for k, x in enumerate(p)], "param int, value double")


add("curve_inversion", _inversion, "SELECT CAST(k AS INT) AS param, v AS value FROM (VALUES (0, 2.0e0), (1, 1.5e0), (2, 0.3e0)) u(k, v)")


def _blocks(c: Ctx) -> DataFrame:
    """A made-up ledger: artifacts of known block shares, inverted; the shares come back."""
    import numpy as np

    cells = _art(c).withColumn("block", folds.block_column(2, c.grid)).where("block < 4").groupBy((F.col("a") * 3 + F.col("x") % 3).alias("row"), "block").agg(F.count("*").alias("n"))
    rows = cells.groupBy("row").pivot("block", [0, 1, 2, 3]).agg(F.first("n")).na.fill(0).orderBy("row").toPandas()  # two dozen rows
    n, share = rows[["0", "1", "2", "3"]].to_numpy(float), np.array([0.02, 0.1, 0.05, 0.3])
    areas = np.full(4, 100.0)
    t = n @ share
    scores = t / (0.2 * t + 0.2 * (n @ (1 - share)) + 0.8 * (areas @ share) / K.kernel_mass() + 1e-12)
    found = model.block_inversion(n, scores, areas, K.kernel_mass())
    return c.spark.createDataFrame([(k, round(float(x), 3)) for k, x in enumerate(found["share"])], "block int, share double")


add("block_inversion", _blocks, "SELECT CAST(k AS INT) AS block, s AS share FROM (VALUES (0, 0.02e0), (1, 0.1e0), (2, 0.05e0), (3, 0.3e0)) u(k, s)")
