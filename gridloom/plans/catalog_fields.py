"""Queries of filters, hypothesis fields and field banks, each with SQL from `sqlgrid`.

Bands are expressions over the derived grid that mean the same in Spark and in DuckDB. What is known are the truth cells, inside
is d >= 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import fields, filters, folds, geometry
from gridloom.plans.catalog import Ctx, add, r6
from gridloom.plans.sqlgrid import Sql

#: Band -> expression.
BANDS = {
    "det_elev": "v / 1000.0e0", "det_elev_slope": "CAST((q * 7) % 29 AS DOUBLE)", "tmi_hg": "CAST(d AS DOUBLE)", "tmi_vg": "CAST(q % 9 AS DOUBLE)", "tc": "CAST(q AS DOUBLE)",
    "iso_grav_anom": "CAST((d * 3 + q) % 11 AS DOUBLE)", "iso_grav_anom_hg": "CAST(d % 4 AS DOUBLE)", "iso_grav_anom_vg": "CAST((q * d) % 13 AS DOUBLE)", "depth_to_base_surf": "v / q",
    "cond_surf": "CAST(d * q AS DOUBLE)", "geod_2ndinv": "CAST((y + q) % 17 AS DOUBLE)", "geod_shearrate": "CAST((x + d) % 19 AS DOUBLE)", "geod_dilaterate": "CAST((y + x) % 23 AS DOUBLE)",
    "lid_relief": "CAST(q % 6 AS DOUBLE)", "lid_step_max": "CAST((d + q) % 5 AS DOUBLE)", "lid_coh100": "CAST((d * q) % 3 AS DOUBLE)", "rad_K": "CAST(1 + q % 8 AS DOUBLE)",
    "rad_Th": "CAST(1 + d % 6 AS DOUBLE)", "rad_U": "CAST(1 + (d + q) % 7 AS DOUBLE)", "rad_TC": "CAST(d + q AS DOUBLE)", "ext_UK": "CAST((d + 2 * q) % 10 AS DOUBLE)",
}


def stack(c: Ctx) -> DataFrame:
    return c.px.select("y", "x", F.expr("d >= 1").alias("inside"), *[F.expr(e).alias(b) for b, e in BANDS.items()])


def _v(c: Ctx) -> DataFrame:
    return c.px.select("y", "x", "v")


def field(name: str, build, sql) -> None:
    """A query of y, x, v at 6 places; sql(Sql()) names the step that holds the field."""
    s = Sql()
    add(name, lambda c: build(c).select("y", "x", *r6("v")), s.field(sql(s)))


# ---------------------------------------------------------------- filters

field("gaussian_2d", lambda c: filters.gaussian(_v(c), "v", 2.0, c.grid), lambda s: s.gaussian(s.band("v"), 2.0))
field("detrend", lambda c: filters.detrend(_v(c), "v", 10.0, c.grid), lambda s: s.detrend(s.band("v"), 10.0))
field("tensor_coherence", lambda c: filters.coherence(_v(c), "v", c.grid), lambda s: s.coherence(s.band("v")))
field("tensor_anisotropy", lambda c: filters.anisotropy(_v(c), "v", c.grid), lambda s: s.anisotropy(s.band("v"), 2.0))
field("lineament", lambda c: filters.lineament(_v(c), "v", c.grid), lambda s: s.lineament(s.band("v")))
field("hessian_ridge", lambda c: filters.ridge(_v(c), "v", c.grid), lambda s: s.ridge(s.band("v")))
field("step_edge", lambda c: filters.step_edge(_v(c), "v", c.grid), lambda s: s.step_edge(s.band("v"), 2.0))
field("rank_transform", lambda c: filters.rank_transform(c.px.select("y", "x", "q", F.expr("d >= 1").alias("i")), "q", F.col("i"), "v"), lambda s: s.rank(s.band("q")))


def _pair(name: str, build, slopes) -> None:
    s = Sql()
    at = slopes(s, s.dense(s.band("d")))
    add(name, lambda c: build(c).select("y", "x", *r6("gy", "gx")), s.sql(f"SELECT g.y, g.x, round(gy, 6) AS gy, round(gx, 6) AS gx FROM {at} g JOIN px ON px.y = g.y AND px.x = g.x"))


_D = lambda c: c.px.select("y", "x", F.col("d").cast("double").alias("d"))
_pair("sobel", lambda c: filters.sobel(_D(c), "d", c.grid), lambda s, d: s.sobel(d))
_pair("gradient", lambda c: filters.gradient(_D(c), "d", c.grid), lambda s, d: s.slopes(d))

# ---------------------------------------------------------------- traces

_SKELETON = Sql("d >= 5")
add("skeleton", lambda c: geometry.skeleton(c.px.where("d >= 5")), _SKELETON.sql(f"SELECT y, x FROM {_SKELETON.skeleton('known')}"))
for _kind in ("reference", "tangent"):
    _s = Sql()
    _at = _s.strike("known", tangent=_kind == "tangent")
    add(
        "local_strike" if _kind == "reference" else "local_strike_tangent", lambda c, kind=_kind: geometry.strike(c.truth, c.grid, kind=kind).select("y", "x", *r6("cos", "sin")),
        _s.sql(f"SELECT y, x, round(c, 6) AS cos, round(s, 6) AS sin FROM {_at}"),
    )
field("tip_extension", lambda c: fields.tip_extension(c.px, c.truth, c.grid), lambda s: s.tip_extension())
field("gap_linkage", lambda c: fields.gap_linkage(c.px, c.truth, c.grid), lambda s: s.gap_linkage())
field("gap_linkage_tangent", lambda c: fields.gap_linkage(c.px, c.truth, c.grid, kind="tangent"), lambda s: s.gap_linkage(tangent=True))
field("parallel_field", lambda c: fields.parallel_field(c.px, c.truth, c.grid, least=3), lambda s: s.parallel_field(least=3))

#: A key that SQL can compute, for draws.
DRAW = "(y * 7919 + x * 104729) % 1000003"
_RUNS = Sql("d >= 7")
_THIN = _RUNS.skeleton("known")
_SEEDS = _RUNS.add(f"SELECT y, x FROM {_THIN} ORDER BY {DRAW}, y, x LIMIT 40")
_NEAR = _RUNS.add(f"SELECT DISTINCT t.y, t.x FROM {_THIN} t JOIN {_SEEDS} s ON (t.y - s.y) * (t.y - s.y) + (t.x - s.x) * (t.x - s.x) <= 36")
_WIDE = _RUNS.add(f"SELECT DISTINCT n.y + dy AS y, n.x + dx AS x FROM {_NEAR} n, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE abs(dy) + abs(dx) <= 2")


def _runs(c: Ctx) -> DataFrame:
    known = c.px.where("d >= 7").select("y", "x")
    truth, visible = folds.cut_runs(known, geometry.skeleton(known), c.grid, 40, key=F.expr(DRAW))
    return truth.withColumn("part", F.lit("truth")).union(visible.withColumn("part", F.lit("visible")))


add("cut_runs", _runs, _RUNS.sql(f"SELECT k.y, k.x, CASE WHEN w.y IS NULL THEN 'visible' ELSE 'truth' END AS part FROM known k LEFT JOIN {_WIDE} w ON w.y = k.y AND w.x = k.x"))

# ---------------------------------------------------------------- fields

_LINEAMENT = {b: (BANDS[b], w) for b, w in {
    "tc": 1.0, "tmi_hg": 0.8, "iso_grav_anom_hg": 0.8, "iso_grav_anom_vg": 0.6, "tmi_vg": 0.6, "geod_2ndinv": 0.7, "geod_shearrate": 0.5, "geod_dilaterate": 0.5, "det_elev": 0.5, "cond_surf": 0.4,
}.items()}
field("lineament_energy", lambda c: fields.lineament_energy(stack(c), c.grid), lambda s: s.lineament_energy(_LINEAMENT))
_PRED = "SELECT y, x FROM px WHERE d >= 9"
field("habitat", lambda c: fields.habitat(c.px, c.pred, c.grid), lambda s: s.blurred(s.add(_PRED), 2.0, "constant"))


def _votes(c: Ctx) -> DataFrame:
    return c.px.select("y", "x", F.expr("CAST(q % 5 AS DOUBLE)").alias("v"))


def _screened(name: str, **how) -> object:
    def build(c: Ctx) -> DataFrame:
        extra = {"votes": _votes(c)} if "votes" in how else {"prior": fields.habitat(c.px, c.pred, c.grid)} if "prior" in how else {}
        return fields.screened_fields(stack(c), c.truth, c.grid, **extra)[name]()

    return build


field("screened_step", _screened("step"), lambda s: s.basin_step(BANDS))
field("screened_lineament", _screened("lineament"), lambda s: s.lineament_energy(_LINEAMENT))
field("screened_curvature", _screened("curvature"), lambda s: s.curvature(BANDS))
field("screened_tips", _screened("tips"), lambda s: s.tip_extension())
field("screened_composite", _screened("composite"), lambda s: s.mix(s.curvature(BANDS), 0.85, s.tip_extension(), 0.15))
field("screened_composite_votes", _screened("composite", votes=True), lambda s: s.mix(s.band("CAST(q % 5 AS DOUBLE)"), 1.0, s.curvature(BANDS), 0.85))
field("screened_composite_prior", _screened("composite", prior=True), lambda s: s.mix(s.blurred(s.add(_PRED), 2.0, "constant"), 0.5, s.curvature(BANDS), 0.5))

# ---------------------------------------------------------------- candidate bank

_POSITIVE = {"det_elev_slope": 0.1573, "lid_relief": 0.1084, "lid_step_max": 0.1057, "tmi_hg": 0.0739, "ext_UK": 0.0682, "det_elev": 0.0603, "iso_grav_anom": 0.0517, "geod_dilaterate": 0.0321, "geod_2ndinv": 0.0252}
_NEGATIVE = {"rad_K": 0.1413, "tc": 0.1228, "rad_TC": 0.1226, "rad_Th": 0.0873, "rad_U": 0.0831, "depth_to_base_surf": 0.0321, "tmi_vg": 0.0262, "cond_surf": 0.0238}
_SHADOW = {
    "tmi_hg": 0.466, "lid_step_max": 0.443, "iso_grav_anom": 0.388, "det_elev_slope": 0.300, "geod_2ndinv": 0.150, "tmi_vg": -0.513, "cond_surf": -0.372, "lid_coh100": -0.260, "rad_U": -0.155,
    "tc": -0.090, "rad_TC": -0.090, "depth_to_base_surf": -0.967,
}


def _blend(s: Sql, weights: dict[str, float]) -> str:
    parts = {f"b{k}": s.rank(s.band(BANDS[b])) for k, b in enumerate(weights)}
    return s.rank(s.combine(" + ".join(f"({float(w)!r}e0) * @{n}@" for n, w in zip(parts, weights.values(), strict=True)), **parts), 9)


def _weighted(s: Sql, *parts: tuple[float, str]) -> str:
    named = {f"w{k}": f for k, (_, f) in enumerate(parts)}
    return s.rank(s.combine(" + ".join(f"{w!r}e0 * @{n}@" for n, (w, _) in zip(named, parts, strict=True)), **named), 9)


def _ranked(s: Sql, band: str) -> str:
    return s.rank(s.band(BANDS[band]), 9)


def _trendless(s: Sql, band: str, sigma: float) -> str:
    return s.detrend(s.band(BANDS[band]), sigma)


def _anomaly(s: Sql, band: str, sigma: float) -> str:
    return s.rank(s.add(f"SELECT y, x, abs(v) AS v FROM {_trendless(s, band, sigma)}"), 9)


def _log_ratio(s: Sql, a: str, b: str) -> str:
    return s.rank(s.band(f"ln(greatest({BANDS[a]}, 1.0e-6) / greatest({BANDS[b]}, 1.0e-6))"), 9)


def _steepness(s: Sql) -> str:
    g = s.slopes(s.dense(_trendless(s, "cond_surf", 30.0)))
    return s.rank(s.stored(s.add(f"SELECT y, x, sqrt(gy * gy + gx * gx) AS v FROM {g}")), 9)


def _contact(s: Sql) -> str:
    return _weighted(s, (0.4, _ranked(s, "tmi_hg")), (0.3, _ranked(s, "iso_grav_anom_hg")), (0.3, _anomaly(s, "tc", 30.0)))


_HABITAT = {**_POSITIVE, **{b: -w for b, w in _NEGATIVE.items()}}
_LIDAR = [b for b in BANDS if b.startswith("lid_")]
#: Candidate -> the step that holds it.
_CANDIDATES = {
    "curvature ridge": lambda s: s.rank(s.ridge(_trendless(s, "det_elev", 40.0)), 9),
    "fabric anisotropy": lambda s: s.rank(s.coherence(_trendless(s, "det_elev", 40.0)), 9),
    "alteration ratio": lambda s: _weighted(s, (0.4, _log_ratio(s, "rad_Th", "rad_K")), (0.4, _log_ratio(s, "rad_U", "rad_K")), (0.2, _anomaly(s, "rad_TC", 30.0))),
    "basement step": lambda s: s.rank(s.ridge(_trendless(s, "depth_to_base_surf", 40.0), (1.0, 2.0, 4.0)), 9),
    "strain corridor": lambda s: _weighted(s, (0.5, _ranked(s, "geod_2ndinv")), (0.25, _anomaly(s, "geod_dilaterate", 20.0)), (0.25, _ranked(s, "geod_shearrate"))),
    "scarp consensus": lambda s: _weighted(s, *[(1.0 / len(_LIDAR), _ranked(s, b)) for b in _LIDAR]),
    "potential contact": lambda s: s.rank(s.ridge(_contact(s), (1.0, 2.0, 4.0)), 9),
    "conductivity gradient": _steepness,
    "measured habitat": lambda s: _blend(s, _HABITAT),
    "linear habitat": lambda s: _weighted(s, (0.65, _blend(s, _HABITAT)), (0.35, s.rank(s.coherence(s.band(BANDS["lid_relief"])), 9))),
    "shadow habitat": lambda s: _blend(s, _SHADOW),
    "control: random": lambda s: s.band("((CAST(y AS BIGINT) * 7919 + CAST(x AS BIGINT) * 104729) % 1000003) / 1000003.0e0"),
    "control: distance band": lambda s: s.add(f"SELECT y, x, least(greatest(1.0e0 - abs(v - 8.0e0) / 4.0e0, 0.0e0), 1.0e0) AS v FROM {s.distance()}"),
}
for _name, _step in _CANDIDATES.items():
    field("candidate_" + _name.replace("control: ", "").replace(" ", "_"), lambda c, n=_name: fields.candidate_bank(stack(c), c.truth, c.grid)[n](), _step)

# ---------------------------------------------------------------- field screen (F27) and sweeps

_STEPS = lambda s: s.step_edge(s.band(BANDS["depth_to_base_surf"]), 2.0, 5.0)
_CONTRAST = lambda s: s.combine("sqrt(greatest(@m@ * @g@, 0.0e0))", m=s.anisotropy(s.band(BANDS["tmi_hg"]), 2.0), g=s.anisotropy(s.band(BANDS["iso_grav_anom"]), 2.0))
#: Arm -> the step that holds it before it is masked.
_ARMS = {
    "basin step": lambda s: s.basin_step(BANDS), "lineament": lambda s: s.lineament_energy(_LINEAMENT), "curvature": lambda s: s.curvature(BANDS), "tips": lambda s: s.tip_extension(),
    "wide parallel": lambda s: s.parallel_field((10, 16, 24, 32)), "wide shell": lambda s: s.shell(20.0), "basement step": _STEPS, "isostatic contrast": _CONTRAST,
}
for _name, _step in _ARMS.items():
    field("screen_" + _name.replace(" ", "_"), lambda c, n=_name: fields.screen_arms(stack(c), c.truth, c.grid)[n](), lambda s, step=_step: s.masked(step(s)))

_H = {"H1": lambda s: s.shell(6.0), "H2": lambda s: s.tip_extension(), "H3": lambda s: s.gap_linkage(), "H4": lambda s: s.parallel_field(), "H5": lambda s: s.lineament_energy(_LINEAMENT)}
_TRACED = lambda s: s.composite(_H["H2"](s), _H["H3"](s), _H["H4"](s))
_SWEEP = {
    **_H, "H2+H3+H4": _TRACED, "H1+H2+H3+H4": lambda s: s.composite(_H["H1"](s), _H["H2"](s), _H["H3"](s), _H["H4"](s)), "H5+structure": lambda s: s.composite(_H["H5"](s), _TRACED(s)),
}
for _name, _step in _SWEEP.items():
    field("sweep_" + _name.replace("+", "_"), lambda c, n=_name: fields.sweep_fields(stack(c), c.truth, c.grid)[n](), _step)
_ALL = {
    "H1+H2+H3+H4": lambda s: s.composite(_H["H1"](s), _TRACED(s)), "all": lambda s: s.composite(_H["H5"](s), s.composite(_H["H1"](s), _TRACED(s))),
}
for _name, _step in _ALL.items():
    field("near_" + _name.replace("+", "_"), lambda c, n=_name: fields.sweep_fields(stack(c), c.truth, c.grid, near=True)[n](), _step)
