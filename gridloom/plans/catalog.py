"""Registry of grid queries, each with the SQL that checks it where SQL can express it.

All queries run on the grid derived from lineitem (`sources.grid.derived_grid`): pred are cells with d >= 9, truth cells with q <= 2,
free cells with q in (3, 4), and every stored cell is inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions import scalars as P
from gridloom.operators import folds, geometry, metric, select, stats, stencil
from gridloom.sources import grid as G

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- parts of the checking SQL

PX = f"px AS ({G.PX_SQL})"
SETS = f"""{PX},
pred AS (SELECT y, x, least(d / 10.0e0, 1.0e0) AS p FROM px WHERE d >= 9), truth AS (SELECT y, x FROM px WHERE q <= 2), free AS (SELECT y, x FROM px WHERE q IN (3, 4)),
gs AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px)"""
CONE = "k AS (SELECT dy, dx, 1.0e0 - sqrt(dy * dy + dx * dx) / 3.0e0 AS k FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx < 9)"
ART = """art AS (SELECT CAST(l_linenumber AS INT) AS a, CAST(floor(l_orderkey / 50) AS INT) AS y, CAST(l_partkey % 260 AS INT) AS x, max(CAST(round(l_discount * 100) AS INT) / 10.0e0) AS p
  FROM lineitem WHERE l_discount >= 0.045 GROUP BY 1, 2, 3)"""
#: Distance of every cell to truth, by brute force.
DIST = "dist AS (SELECT px.y, px.x, min(sqrt((px.y - t.y) * (px.y - t.y) + (px.x - t.x) * (px.x - t.x))) AS dist FROM px, truth t GROUP BY 1, 2)"


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


class Ctx:
    """The derived grid and its sets."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.px = spark, sf_dir, G.derived_grid(spark, sf_dir)
        self.pred = self.px.where("d >= 9").select("y", "x", F.least(F.col("d") / F.lit(10.0), F.lit(1.0)).alias("p"))
        self.truth = self.px.where("q <= 2").select("y", "x")
        self.free = self.px.where("q in (3, 4)").select("y", "x")
        self._grid: G.Grid | None = None

    @property
    def grid(self) -> G.Grid:
        self._grid = self._grid or G.shape_of(self.px)
        return self._grid


def on_grid(fn: Callable[[Ctx], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(Ctx(spark, sf_dir))


def add(name: str, fn: Callable[[Ctx], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(on_grid(fn))


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# ---------------------------------------------------------------- metric

SCORE_SQL = f"""{SETS}, {CONE},
credit AS (SELECT t.y, t.x, coalesce(max(p.p * k.k), 0.0e0) AS c FROM truth t CROSS JOIN k LEFT JOIN pred p ON p.y = t.y + k.dy AND p.x = t.x + k.dx GROUP BY 1, 2),
charged AS (SELECT * FROM pred p WHERE @RULE@),
reach AS (SELECT c.y, c.x, c.p, coalesce(max(CASE WHEN t.y IS NOT NULL THEN k.k END), 0.0e0) AS k FROM charged c CROSS JOIN k LEFT
  JOIN truth t ON t.y = c.y + k.dy AND t.x = c.x + k.dx GROUP BY 1, 2, 3),
s AS (SELECT (SELECT CAST(count(*) AS BIGINT) FROM truth) AS n_truth, (SELECT sum(c) FROM credit) AS tp, (SELECT coalesce(sum(p * (1.0e0 - k)), 0.0e0) FROM reach) AS fp)"""
ROW = "n_truth, round(tp, 6) AS tp, round(fp, 6) AS fp, round(n_truth - tp, 6) AS fn, round(tp / (tp + 0.2e0 * fp + 0.8e0 * (n_truth - tp) + 1.0e-12), 6) AS dti"
NOT_FREE = "NOT EXISTS (SELECT 1 FROM free f WHERE f.y = p.y AND f.x = p.x)"


def _row(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.col("n_truth").cast("long").alias("n_truth"), *r6("tp", "fp", "fn", "dti"))


add("dti_score", lambda c: _row(metric.score(c.pred, c.truth, c.free)), f"WITH {SCORE_SQL.replace('@RULE@', NOT_FREE)} SELECT {ROW} FROM s")
add("dti_literal_range_join", lambda c: _row(metric.score_literal(c.pred, c.truth, c.free)), f"WITH {SCORE_SQL.replace('@RULE@', NOT_FREE)} SELECT {ROW} FROM s")
add(
    "dti_free_vs_charged", lambda c: _row(metric.score(c.pred, c.truth, c.free).withColumn("mode", F.lit("free")).union(metric.score(c.pred, c.truth).withColumn("mode", F.lit("charged"))), "mode"),
    f"""SELECT 'free' AS mode, * FROM (WITH {SCORE_SQL.replace('@RULE@', NOT_FREE)} SELECT {ROW} FROM s) UNION ALL SELECT 'charged', *
  FROM (WITH {SCORE_SQL.replace('@RULE@', 'true')} SELECT {ROW} FROM s)""",
)
add(
    "credit_per_truth", lambda c: metric.credit(c.pred, c.truth).select("y", "x", *r6("credit")),
    f"WITH {SETS}, {CONE} SELECT t.y, t.x, round(coalesce(max(p.p * k.k), 0.0e0), 6) AS credit FROM truth t CROSS JOIN k LEFT JOIN pred p ON p.y = t.y + k.dy AND p.x = t.x + k.dx GROUP BY 1, 2",
)
add(
    "reach_map", lambda c: metric.reach(c.truth, grid=c.grid).select("y", "x", *r6("reach")),
    f"WITH {SETS}, {CONE} SELECT t.y + dy AS y, t.x + dx AS x, round(max(k), 6) AS reach FROM truth t, k, gs WHERE t.y + dy BETWEEN 0 AND h - 1 AND t.x + dx BETWEEN 0 AND w - 1 GROUP BY 1, 2",
)
add(
    "dilate_weighted", lambda c: metric.dilate_weighted(c.pred, c.grid).select("y", "x", *r6("reach")),
    f"WITH {SETS}, {CONE} SELECT t.y + dy AS y, t.x + dx AS x, round(max(p * k), 6) AS reach FROM pred t, k, gs WHERE t.y + dy BETWEEN 0 AND h - 1 AND t.x + dx BETWEEN 0 AND w - 1 GROUP BY 1, 2",
)


def _block_sql(n: int) -> str:
    part = lambda c, s: " + ".join(f"CASE WHEN {c} >= ({s} * {i}) // {n} THEN 1 ELSE 0 END" for i in range(1, n))
    return f"CAST(({part('y', 'h')}) * {n} + {part('x', 'w')} AS INT)"


FOLDS_SQL = f"""kb AS (SELECT y, x, {_block_sql(3)} AS fold FROM truth, gs), adm AS (SELECT fold FROM kb GROUP BY 1 HAVING count(*) >= 10), ft AS (SELECT kb.* FROM kb JOIN adm USING (fold)),
ff AS (SELECT adm.fold, kb.y, kb.x FROM kb, adm WHERE kb.fold <> adm.fold)"""
FOLD_SCORE = f"""WITH {SETS}, {CONE}, {FOLDS_SQL},
credit AS (SELECT t.fold, t.y, t.x, coalesce(max(p.p * k.k), 0.0e0) AS c FROM ft t CROSS JOIN k LEFT JOIN pred p ON p.y = t.y + k.dy AND p.x = t.x + k.dx GROUP BY 1, 2, 3),
charged AS (SELECT adm.fold, p.* FROM pred p, adm WHERE NOT EXISTS (SELECT 1 FROM ff WHERE ff.fold = adm.fold AND ff.y = p.y AND ff.x = p.x)),
reach AS (SELECT c.fold, c.y, c.x, c.p, coalesce(max(CASE WHEN t.y IS NOT NULL THEN k.k END), 0.0e0) AS k FROM charged c CROSS JOIN k LEFT
  JOIN ft t ON t.fold = c.fold AND t.y = c.y + k.dy AND t.x = c.x + k.dx GROUP BY 1, 2, 3, 4),
s AS (SELECT fold, n_truth, tp, fp FROM (SELECT fold, CAST(count(*) AS BIGINT) AS n_truth, sum(c) AS tp FROM credit GROUP BY 1) JOIN (SELECT fold,
  sum(p * (1.0e0 - k)) AS fp FROM reach GROUP BY 1) USING (fold))"""


def _fold_scores(c: Ctx) -> DataFrame:
    ft = folds.fold_cells(c.truth, 3, c.grid, least=10)
    return metric.score(c.pred, ft, folds.fold_free(c.truth, ft, 3, c.grid), ("fold",))


add("dti_by_fold", lambda c: _row(_fold_scores(c), "fold"), f"{FOLD_SCORE} SELECT fold, {ROW} FROM s")
add(
    "dti_mean_over_folds", lambda c: metric.mean_over_folds(_fold_scores(c).withColumn("all", F.lit(1)), ["all"]).select("n_folds", *r6("mean_dti"), F.array_join(F.transform("per_fold", lambda d: F.format_string("%.6f", d)), ";").alias("per_fold")),
    f"""{FOLD_SCORE} SELECT CAST(count(*) AS BIGINT) AS n_folds, round(avg(d), 6) AS mean_dti, string_agg(printf('%.6f', d), ';' ORDER BY fold) AS per_fold
FROM (SELECT fold, tp / (tp + 0.2e0 * fp + 0.8e0 * (n_truth - tp) + 1.0e-12) AS d FROM s)""",
)
add(
    "surrogate_credit", lambda c: metric.credit_and_charge(c.pred, c.truth).select(*r6("t", "f")),
    f"WITH {SCORE_SQL.replace('@RULE@', 'true')} SELECT round(tp, 6) AS t, round(fp, 6) AS f FROM s",
)
add(
    "metric_verdict", lambda c: metric.verdict(metric.score(c.pred, c.truth, c.free)).select(F.round("verdict.dti", 6).alias("dti"), F.round("verdict.coverage", 6).alias("coverage")),
    f"WITH {SCORE_SQL.replace('@RULE@', NOT_FREE)} SELECT round(tp / (tp + 0.2e0 * fp + 0.8e0 * (n_truth - tp) + 1.0e-12), 6) AS dti, round(tp / n_truth, 6) AS coverage FROM s",
)

_SU = "SELECT s / 100.0e0 AS s, u / 10.0e0 AS u FROM range(1, 60) a(s), range(0, 11) b(u)"


def _su(c: Ctx) -> DataFrame:
    return c.spark.range(1, 60).select((F.col("id") / 100.0).alias("s")).withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0))))


add(
    "break_even_table", lambda c: _su(c).select("s", "u", F.round(K.marginal_bar(F.col("s"), F.col("u")), 6).alias("bar"), F.round(K.marginal_bar_exact(F.col("s"), F.col("u")), 6).alias("bar_exact")),
    f"SELECT s, u, round(0.2e0 * s * u / (1.0e0 - 0.2e0 * s + 0.8e0 * s), 6) AS bar, round(0.2e0 * s * u / (1.0e0 - 0.2e0 * s), 6) AS bar_exact FROM ({_SU})",
)
add(
    "required_coverage_table", lambda c: _su(c).select("s", F.col("u").alias("rho"), F.round(K.required_coverage(F.col("s"), F.col("u")), 6).alias("coverage")),
    f"SELECT s, u AS rho, round(s * (0.2e0 * u + 0.8e0) / (1.0e0 - 0.2e0 * s + 0.8e0 * s), 6) AS coverage FROM ({_SU})",
)
add(
    "implied_credit", lambda c: _su(c).select("s", "u", F.round(K.implied_credit(F.col("s"), F.col("u") * 10000, F.lit(60988.0)), 6).alias("t"), F.round(K.score_identity(F.col("s") * 10000, F.col("u") * 10000, F.lit(60988.0)), 6).alias("identity")),
    f"SELECT s, u, round(s * (0.2e0 * (u * 10000) + 0.8e0 * 60988.0e0) / (1.0e0 - 0.2e0 * s), 6) AS t, round(s * 10000 / (0.2e0 * (u * 10000) + 0.8e0 * 60988.0e0), 6) AS identity FROM ({_SU})",
)
add("kernel_mass", lambda c: K.offsets_frame(c.spark, K.cone()).agg(F.count("*").alias("n"), F.round(F.sum("k"), 6).alias("mass")), f"WITH {CONE} SELECT CAST(count(*) AS BIGINT) AS n, round(sum(k), 6) AS mass FROM k")
add(
    "kernel_values", lambda c: c.spark.range(0, 9).select((F.col("id") / 2.0).alias("d")).select("d", F.round(K.kernel(F.col("d")), 6).alias("k")),
    "SELECT d / 2.0e0 AS d, round(greatest(1.0e0 - (d / 2.0e0) / 3.0e0, 0.0e0), 6) AS k FROM range(0, 9) t(d)",
)

# ---------------------------------------------------------------- sources, receipts, predicates

add(
    "format_receipt", lambda c: G.receipt(c.px.select("y", "x", (F.col("d") / 10.0).alias("p")), c.grid),
    f"""WITH {SETS}, r AS (SELECT d / 10.0e0 AS p FROM px) SELECT CAST(any_value(h * w) AS BIGINT) AS n_cells,
  CAST(any_value(h * w) - count(*) AS BIGINT) AS n_not_finite, CAST(count(*) AS BIGINT) AS n_finite, min(p) AS min, max(p) AS max,
CAST(count(*) FILTER (p > 0) AS BIGINT) AS n_positive, CASE WHEN count(*) = any_value(h * w) THEN 'zero-outside' ELSE 'nan-outside' END AS convention,
  bool_and(p BETWEEN 0 AND 1) AND count(*) FILTER (p > 0) > 0 AS format_ok FROM r, gs""",
)
def _dirty():
    return F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).when(F.col("q") % 5 == 0, F.lit(-3.4028e38)).otherwise(F.col("v"))



add("footprint_cells", lambda c: G.footprint(c.px.withColumn("v", F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))), f"WITH {PX} SELECT y, x FROM px WHERE q % 7 <> 0")
add("sentinel_clean", lambda c: c.px.select("y", "x", P.valid_or_zero(_dirty()).alias("v")), f"WITH {PX} SELECT y, x, CASE WHEN q % 7 = 0 OR q % 5 = 0 THEN 0.0e0 ELSE v END AS v FROM px")
add("finite_or_zero", lambda c: c.px.select("y", "x", P.finite_or_zero(F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v"))).alias("v")), f"WITH {PX} SELECT y, x, CASE WHEN q % 7 = 0 THEN 0.0e0 ELSE v END AS v FROM px")
add("valid_cells", lambda c: c.px.where(P.is_valid(_dirty())).select("y", "x"), f"WITH {PX} SELECT y, x FROM px WHERE NOT (q % 7 = 0 OR q % 5 = 0)")
add(
    "median_fill", lambda c: G.median_fill(c.px.withColumn("v", _dirty()).withColumn("u", F.when(F.col("q") % 3 == 0, F.lit(None)).otherwise(F.col("v"))).select("y", "x", "v", "u", "q"), ["v", "u"], F.col("q") > 2).select("y", "x", *r6("v", "u")),
    f"""WITH {PX}, a AS (SELECT y, x, q, CASE WHEN q % 7 = 0 OR q % 5 = 0 THEN NULL ELSE v END AS v FROM px), b AS (SELECT y, x, q, v, CASE WHEN q % 3 = 0 THEN NULL ELSE v END AS u FROM a),
m AS (SELECT quantile_cont(v, 0.5) FILTER (q > 2) AS mv, quantile_cont(u, 0.5) FILTER (q > 2) AS mu FROM b) SELECT y, x, round(coalesce(v, mv), 6) AS v, round(coalesce(u, mu), 6) AS u FROM b, m""",
)
add("band_union", lambda c: G.union_masks(c.truth, c.free, c.pred), f"WITH {SETS} SELECT y, x FROM truth UNION SELECT y, x FROM free UNION SELECT y, x FROM pred")
add("clip_unit", lambda c: c.px.select("y", "x", F.round(P.clip_unit((F.col("d") - 2) / 5.0), 6).alias("p")), f"WITH {PX} SELECT y, x, round(least(greatest((d - 2) / 5.0e0, 0.0e0), 1.0e0), 6) AS p FROM px")
add("mask_outside", lambda c: c.px.select("y", "x", P.inside_or_zero(F.col("v"), F.col("q") > 10).alias("v")), f"WITH {PX} SELECT y, x, CASE WHEN q > 10 THEN v ELSE 0.0e0 END AS v FROM px")
add("support_cells", lambda c: c.px.withColumn("p", F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("d").cast("double"))).where(P.in_support(F.col("p"))).select("y", "x"), f"WITH {PX} SELECT y, x FROM px WHERE q % 7 <> 0 AND d > 0")
add("payload_cells", lambda c: stencil.anti(c.pred, c.free), f"WITH {SETS} SELECT * FROM pred p WHERE {NOT_FREE}")
add(
    "load_stack", lambda c: G.load_stack({"v": c.px.select("y", "x", _dirty().alias("v"))}, c.px.select("y", "x", F.when(F.col("q") > 1, F.col("d") - 5).alias("lab")), optional={"d": c.px.where("d > 2").select("y", "x", F.col("d").cast("double").alias("d"))}),
    f"""WITH {PX} SELECT y, x, q > 1 AS inside, coalesce(q > 1 AND d > 5, false) AS known, CASE WHEN q % 7 = 0 OR q % 5 = 0 THEN NULL ELSE v END AS v,
  CASE WHEN d > 2 THEN CAST(d AS DOUBLE) END AS d FROM px""",
)
add(
    "eligible_cells", lambda c: c.px.join(geometry.distance_within(c.px, c.truth, 3).withColumnRenamed("dist", "near"), ["y", "x"]).where(P.eligible(F.col("d") >= 1, F.col("q") <= 2, F.coalesce("near", F.lit(99.0)), 2)).select("y", "x"),
    f"WITH {SETS} SELECT y, x FROM px WHERE d >= 1 AND q > 2 AND NOT EXISTS (SELECT 1 FROM truth t WHERE (t.y - px.y) * (t.y - px.y) + (t.x - px.x) * (t.x - px.x) <= 4)",
)
add("annulus_cells", lambda c: geometry.annulus(c.px, c.truth, 2, 4), f"WITH {SETS}, {DIST} SELECT y, x FROM dist WHERE dist > 2 AND dist <= 4")
add(
    "proxy_new", lambda c: stencil.anti(c.free, geometry.distance_within(c.free, c.truth, 3).where("dist is not null")),
    f"WITH {SETS} SELECT y, x FROM free f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE (t.y - f.y) * (t.y - f.y) + (t.x - f.x) * (t.x - f.x) <= 9)",
)
add(
    "surrogate_set", lambda c: stencil.anti(stencil.semi(G.union_masks(c.pred, c.free), c.px.where("d >= 1")), c.truth),
    f"""WITH {SETS} SELECT DISTINCT y, x FROM (SELECT y, x FROM pred UNION SELECT y, x FROM free) u JOIN px USING (y, x) WHERE d >= 1
  AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.y = u.y AND t.x = u.x)""",
)
_BLEND = {"d": 0.5, "q": 0.3, "absent": 0.2}
add("band_blend", lambda c: c.px.select("y", "x", F.round(P.blend(_BLEND, c.px.columns), 6).alias("v")), f"WITH {PX} SELECT y, x, round((0.5e0 * d + 0.3e0 * q) / 0.8e0, 6) AS v FROM px")
add(
    "elementwise_math", lambda c: c.px.select("y", "x", F.round(F.exp(-F.col("d") / 10.0), 6).alias("e"), F.round(F.ln(F.col("v")), 6).alias("l"), F.round(F.cbrt(F.col("v")), 6).alias("c"), F.round(F.hypot("d", "q"), 6).alias("h"), F.round(F.atan2("d", "q"), 6).alias("a"), P.half_even(F.col("d") / 2.0).alias("r")),
    f"""WITH {PX} SELECT y, x, round(exp(-d / 10.0e0), 6) AS e, round(ln(v), 6) AS l, round(cbrt(v), 6) AS c,
  round(sqrt(CAST(d * d + q * q AS DOUBLE)), 6) AS h, round(atan2(d, q), 6) AS a, CAST(round_even(d / 2.0e0, 0) AS INT) AS r FROM px""",
)


def _on(table: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")(_on("events", lambda t: t.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))))
def _hash_sql(rows: str) -> str:
    """Hashes of grid rows over rows (y, x, p), of 1,024 grid rows, and of those."""
    return f"""WITH {PX}, r AS ({rows}), l AS (SELECT y, sha256(string_agg(x || ',' || p, ';' ORDER BY x)) AS h FROM r GROUP BY 1),
b AS (SELECT y // 1024 AS b, sha256(string_agg(y || ':' || h, ';' ORDER BY y)) AS h FROM l GROUP BY 1) SELECT sha256(string_agg(b || ':' || h, ';' ORDER BY b)) AS"""


add("content_hash", lambda c: G.value_hash(c.px.select("y", "x", (F.col("d") / 8.0).alias("p"))), _hash_sql("SELECT y, x, d / 8.0e0 AS p FROM px") + " sha256_values FROM b")
add("support_hash", lambda c: G.support_hash(c.px.select("y", "x", (F.col("d") / 8.0).alias("p"))), _hash_sql("SELECT y, x, 1.0e0 AS p FROM px WHERE d > 0") + " sha256_support FROM b")
add(
    "prepare_output", lambda c: G.prepare_output(c.px.select("y", "x", _dirty().alias("p")), c.grid, outside="zero").select("y", "x", F.col("p").cast("double").alias("p")),
    f"WITH {PX} SELECT y, x, CASE WHEN q % 7 = 0 THEN 0.0e0 WHEN q % 5 = 0 THEN 0.0e0 ELSE least(greatest(v, 0.0e0), 1.0e0) END AS p FROM px",
)
query("file_listing", "SELECT p_name AS path, CAST(p_partkey AS BIGINT) AS length FROM part WHERE p_name LIKE '%bolt' AND p_partkey BETWEEN 10 AND 900")(
    _on("part", lambda t: G.listing(t.select(F.col("p_name").alias("path"), F.col("p_partkey").cast("long").alias("length")), "bolt", 10, 900))
)

# ---------------------------------------------------------------- geometry

add("edt", lambda c: geometry.distance(c.px, c.truth, c.grid).select("y", "x", *r6("dist")), f"WITH {SETS}, {DIST} SELECT y, x, round(dist, 6) AS dist FROM dist")
add(
    "dilate_diamond", lambda c: geometry.dilate(c.truth, 2, c.grid),
    f"""WITH {SETS} SELECT DISTINCT t.y + dy AS y, t.x + dx AS x FROM truth t, range(-2, 3) a(dy), range(-2, 3) b(dx), gs WHERE abs(dy) + abs(dx) <= 2
  AND t.y + dy BETWEEN 0 AND h - 1 AND t.x + dx BETWEEN 0 AND w - 1""",
)
NEIGHBOURS = """o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0), nb AS (SELECT a.y, a.x,
  CAST(count(b.y) AS BIGINT) AS n FROM pred a CROSS JOIN o LEFT JOIN pred b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2)"""
add("neighbour_count", lambda c: geometry.neighbour_count(c.pred), f"WITH {SETS}, {NEIGHBOURS} SELECT * FROM nb")
add("tips", lambda c: geometry.tips(c.pred), f"WITH {SETS}, {NEIGHBOURS} SELECT y, x FROM nb WHERE n = 1")
def _direction():
    return (((F.col("q") % 5) - 2) / 2.0).alias("cos"), (((F.col("d") % 3) - 1) / 1.0).alias("sin")



add(
    "ray_walk", lambda c: geometry.walk(c.px.where("q <= 2").select("y", "x", *_direction()), c.grid, 12),
    f"""WITH {SETS}, s AS (SELECT y, x, (q % 5 - 2) / 2.0e0 AS c, (d % 3 - 1) / 1.0e0 AS s FROM px WHERE q <= 2)
SELECT DISTINCT CAST(round_even(y + c * t, 0) AS INT) AS y, CAST(round_even(x + s * t, 0) AS INT) AS x FROM s, range(1, 13) r(t), gs
  WHERE (c <> 0 OR s <> 0) AND round_even(y + c * t, 0) BETWEEN 0 AND h - 1 AND round_even(x + s * t, 0) BETWEEN 0 AND w - 1""",
)
add(
    "pairs_within", lambda c: stencil.range_join(c.truth, c.truth, 6).where("a_y < b_y or (a_y = b_y and a_x < b_x)").select("a_y", "a_x", "b_y", "b_x", *r6("dist")),
    f"""WITH {SETS} SELECT a.y AS a_y, a.x AS a_x, b.y AS b_y, b.x AS b_x, round(sqrt(CAST((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE)), 6) AS dist
FROM truth a JOIN truth b ON b.y BETWEEN a.y - 6 AND a.y + 6 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 36 WHERE a.y < b.y OR (a.y = b.y AND a.x < b.x)""",
)
def _bridge_sql(both_ways: bool) -> str:
    ab = "abs" if both_ways else ""
    return f"""WITH {SETS}, e AS (SELECT y, x, 0.8e0 AS c, CASE WHEN d >= 5 THEN 0.6e0 ELSE -0.6e0 END * CASE WHEN q <= 1 AND d % 2 = 0 THEN 1 ELSE -1 END AS s FROM px WHERE q <= 1),
pr AS (SELECT a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx, a.c AS ac, a.s AS as_, b.c AS bc, b.s AS bs, sqrt(CAST((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE)) AS r
  FROM e a JOIN e b ON (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 196 AND (a.y < b.y OR (a.y = b.y AND a.x < b.x))),
ok AS (SELECT *, CAST(ceil(r) AS INT) AS n FROM pr
  WHERE {ab}(ac * ((by_ - ay) / r) + as_ * ((bx - ax) / r)) >= cos(radians(35.0e0)) AND {ab}(-(bc * ((by_ - ay) / r) + bs * ((bx - ax) / r))) >= cos(radians(35.0e0)))
SELECT DISTINCT y, x FROM (
  SELECT CAST(round_even(ay + (by_ - ay) * (i / CAST(n AS DOUBLE)), 0) AS INT) AS y, CAST(round_even(ax + (bx - ax) * (i / CAST(n AS DOUBLE)), 0) AS INT) AS x
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM ok)), gs WHERE y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1"""


def _bridge_ends(c: Ctx) -> DataFrame:
    sign = F.when(F.col("d") % 2 == 0, 1.0).otherwise(-1.0)
    return c.px.where("q <= 1").select("y", "x", F.lit(0.8).alias("cos"), (F.when(F.col("d") >= 5, F.lit(0.6)).otherwise(F.lit(-0.6)) * sign).alias("sin"))


add("bridge_segments", lambda c: geometry.bridges(_bridge_ends(c), c.grid, 14, 35.0, both_ways=True), _bridge_sql(True))
add("bridge_segments_signed", lambda c: geometry.bridges(_bridge_ends(c).withColumn("cos", F.when(F.col("x") % 2 == 0, F.lit(-0.8)).otherwise(F.lit(0.8))), c.grid, 14, 35.0), _bridge_sql(False).replace("0.8e0 AS c", "CASE WHEN x % 2 = 0 THEN -0.8e0 ELSE 0.8e0 END AS c"))


def _labelled(c: Ctx) -> DataFrame:
    return geometry.components(c.truth).select("y", "x", F.shiftright("label", 32).cast("int").alias("ly"), F.col("label").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("lx"))


def _comp_sql(body: str, eight: bool = True) -> str:
    near = "n.y BETWEEN r.ry - 1 AND r.ry + 1 AND n.x BETWEEN r.rx - 1 AND r.rx + 1" + ("" if eight else " AND abs(n.y - r.ry) + abs(n.x - r.rx) <= 1")
    return f"""WITH RECURSIVE {SETS}, reach(y, x, ry, rx) AS (SELECT y, x, y, x FROM truth UNION SELECT r.y, r.x, n.y, n.x FROM reach r JOIN truth n ON {near}),
lab AS (SELECT y, x, min(CAST(ry AS BIGINT) * 4294967296 + rx) AS label FROM reach GROUP BY 1, 2) {body}"""


add("components", _labelled, _comp_sql("SELECT y, x, CAST(label // 4294967296 AS INT) AS ly, CAST(label % 4294967296 AS INT) AS lx FROM lab"))
add(
    "component_stats", lambda c: stats.component_stats(c.truth).select("components", "max_size", *r6("mean_size", "pct_single")),
    _comp_sql(""", s AS (SELECT label, count(*) AS n FROM lab GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS components,
  CAST(max(n) AS BIGINT) AS max_size, round(avg(n), 6) AS mean_size, round(100.0e0 * avg(CASE WHEN n = 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pct_single
  FROM s"""),
)
add("large_components", lambda c: geometry.large_components(c.truth, 3), _comp_sql("SELECT y, x FROM lab WHERE label IN (SELECT label FROM lab GROUP BY 1 HAVING count(*) >= 3)", eight=False))
def _nearest_sql(a: str, b: str, k: int, apart: bool) -> str:
    on = "a.y <> b.y OR a.x <> b.x" if apart else "true"
    return f"""WITH {SETS}, p AS (SELECT a.y, a.x, b.y AS ny, b.x AS nx, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS s FROM ({a}) a JOIN ({b}) b ON {on}),
n AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY s, ny, nx) AS nth FROM p)
SELECT y, x, CAST(nth AS INT) AS nth, round(sqrt(CAST(s AS DOUBLE)), 6) AS dist, ny, nx FROM n WHERE nth <= {k}"""


_T, _FEW = "SELECT y, x FROM truth", "SELECT y, x FROM px WHERE q = 1 AND d = 10 AND y % 3 = 0"
_near = lambda df: df.select("y", "x", "nth", *r6("dist"), "ny", "nx")
add("nearest_neighbour", lambda c: _near(stencil.nearest(c.truth, c.truth, 8, apart=True)), _nearest_sql(_T, _T, 1, True))
add("nearest_two", lambda c: _near(stencil.nearest(c.truth, c.truth, 4, k=2)), _nearest_sql(_T, _T, 2, False))
add("nearest_of_few", lambda c: _near(stencil.nearest(c.truth, c.px.where("q = 1 and d = 10 and y % 3 = 0"), 2, k=3)), _nearest_sql(_T, _FEW, 3, False))
add(
    "bbox_by_block", lambda c: geometry.bbox(c.truth.withColumn("block", folds.block_column(3, c.grid)), c.grid, 6, ("block",)),
    f"""WITH {SETS} SELECT {_block_sql(3)} AS block, greatest(min(y) - 6, 0) AS y0, least(max(y) + 6, any_value(h) - 1) AS y1, greatest(min(x) - 6,
  0) AS x0, least(max(x) + 6, any_value(w) - 1) AS x1 FROM truth, gs GROUP BY 1""",
)
LOCAL = """o AS (SELECT dy, dx FROM range(-{r}, {r1}) a(dy), range(-{r}, {r1}) b(dx)), top AS (SELECT a.y, a.x, any_value(a.v) AS v, max(b.v) AS t
  FROM px a CROSS JOIN o JOIN px b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2)"""
add("max_filter", lambda c: geometry.max_filter(c.px.select("y", "x", "v"), "v", 1), f"WITH {PX}, {LOCAL.format(r=1, r1=2)} SELECT y, x, v, t AS top FROM top")
add("local_max3", lambda c: select.local_max(c.px.select("y", "x", "v"), "v", 1), f"WITH {PX}, {LOCAL.format(r=1, r1=2)} SELECT y, x, v FROM top WHERE v >= t")
add("local_max7_rank", lambda c: select.ranked_peaks(c.px, "v", 3), f"WITH {PX}, {LOCAL.format(r=3, r1=4)} SELECT y, x, v, row_number() OVER (ORDER BY v DESC, y, x) AS rank FROM top WHERE v >= t")
add(
    "ball_query", lambda c: geometry.ball(c.free, c.truth, 4),
    f"WITH {SETS} SELECT y, x FROM free f WHERE EXISTS (SELECT 1 FROM truth t WHERE (t.y - f.y) * (t.y - f.y) + (t.x - f.x) * (t.x - f.x) <= 16)",
)
add(
    "parallel_offsets", lambda c: geometry.parallel_strands(c.px.where("q <= 2").select("y", "x", F.lit(0.6).alias("cos"), F.lit(0.8).alias("sin")), c.truth, c.grid, (4, 6), 3),
    f"""WITH RECURSIVE {SETS}, o AS (SELECT unnest([4, -4, 6, -6]) AS o), m AS (SELECT DISTINCT y, x FROM (SELECT CAST(round_even(y - o * 0.8e0,
  0) AS INT) AS y, CAST(round_even(x + o * 0.6e0, 0) AS INT) AS x FROM truth, o), gs
  WHERE y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.y = y AND t.x = x)),
m2 AS (SELECT m.* FROM m LEFT JOIN truth t ON t.y = m.y AND t.x = m.x WHERE t.y IS NULL),
reach(y, x, ry, rx) AS (SELECT y, x, y, x FROM m2 UNION SELECT r.y, r.x, n.y, n.x FROM reach r JOIN m2 n ON n.y BETWEEN r.ry - 1 AND r.ry + 1
  AND n.x BETWEEN r.rx - 1 AND r.rx + 1 AND abs(n.y - r.ry) + abs(n.x - r.rx) <= 1),
lab AS (SELECT y, x, min(CAST(ry AS BIGINT) * 4294967296 + rx) AS label FROM reach GROUP BY 1, 2) SELECT y, x FROM lab WHERE label IN (SELECT label
  FROM lab GROUP BY 1 HAVING count(*) >= 3)""".replace(" AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.y = y AND t.x = x)", ""),
)


def queries() -> dict[str, Query]:
    from gridloom.plans import catalog_analysis, catalog_fields, catalog_similarity, catalog_sources  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from gridloom.plans import catalog_analysis, catalog_fields, catalog_similarity, catalog_sources  # noqa: F401

    return dict(_SQL)
