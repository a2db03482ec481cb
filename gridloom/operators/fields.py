"""Hypothesis fields over bands and a known mask (F16-F28). Fields are y, x, v."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import in_support
from gridloom.operators import filters, geometry
from gridloom.operators.stencil import anti, semi
from gridloom.session import cut
from gridloom.sources.grid import Grid

#: Fixed weights of the default multi-band lineament field.
LINEAMENT_WEIGHTS = {
    "tc": 1.0, "tmi_hg": 0.8, "iso_grav_anom_hg": 0.8, "iso_grav_anom_vg": 0.6, "tmi_vg": 0.6, "geod_2ndinv": 0.7, "geod_shearrate": 0.5, "geod_dilaterate": 0.5,
    "det_elev": 0.5, "cond_surf": 0.4,
}
#: Fixed weights of the screened composite: of votes, of curvature and of tips.
W_VOTES, W_CURVATURE, W_TIPS = 1.0, 0.85, 0.15
#: Fixed scales of the curvature and of the step fields.
SCALES = (1.5, 3.0, 6.0)


def gaussian_shell(d: Column, sigma: float) -> Column:
    """exp(-(d / sigma)**2), 0 on the mask itself."""
    return F.when(d > 0, F.exp(-F.pow(d / F.lit(sigma), F.lit(2)))).otherwise(F.lit(0.0))


def near_known(cells: DataFrame, known: DataFrame, grid: Grid, sigma: float = 6.0) -> DataFrame:
    """F16: a shell around what is known."""
    return geometry.distance(cells, known, grid).select("y", "x", F.coalesce(gaussian_shell(F.col("dist"), sigma), F.lit(0.0)).alias("v"))


def _blurred(cells: DataFrame, mask: DataFrame, grid: Grid, sigma: float, border: str = "reflect") -> DataFrame:
    """The blurred mask at the stored cells; mask cells count wherever they are on the grid."""
    where = lambda df, v: df.select("y", "x", F.lit(v).alias("v"))
    ones = where(cells, 0.0).union(where(mask, 1.0)).groupBy("y", "x").agg(F.max("v").alias("v"))
    return semi(filters.gaussian(ones, "v", sigma, grid, border), cells)


def traced(known: DataFrame, grid: Grid, kind: str = "reference") -> tuple[DataFrame, DataFrame]:
    """The thinned mask and its local directions, materialised, for the fields that follow a trace."""
    thin = geometry.skeleton(known)
    return thin, cut(geometry.strike(thin, grid, kind=kind))


def tip_extension(cells: DataFrame, known: DataFrame, grid: Grid, length: int = 14, sigma: float = 2.0, kind: str = "reference", trace: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """rays from the tips of the thinned mask, outside it, blurred. trace: `traced`, if it is at hand."""
    thin, direction = trace or traced(known, grid, kind)
    rays = geometry.walk(geometry.tips(thin).join(direction, ["y", "x"]), grid, length)
    return _blurred(cells, anti(rays, known), grid, sigma)


def gap_linkage(cells: DataFrame, known: DataFrame, grid: Grid, max_gap: float = 16, sigma: float = 2.0, kind: str = "reference", trace: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """bridges between tips, outside the mask, blurred."""
    thin, direction = trace or traced(known, grid, kind)
    links = geometry.bridges(geometry.tips(thin).join(direction, ["y", "x"]), grid, max_gap, both_ways=kind == "tangent")
    return _blurred(cells, anti(links, known), grid, sigma)


def parallel_field(
    cells: DataFrame, known: DataFrame, grid: Grid, offsets: tuple[int, ...] = (4, 6, 9), sigma: float = 2.0, least: int = 25, kind: str = "reference", trace: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """strands parallel to the mask, outside it, blurred."""
    _, direction = trace or traced(known, grid, kind)
    strands = geometry.parallel_strands(direction, known, grid, offsets, least)
    return _blurred(cells, anti(strands, known), grid, sigma)


def lineament_energy(cells: DataFrame, grid: Grid, weights: dict[str, float] | None = None, sigma: float = 2.0) -> DataFrame:
    """weighted lineament energy of the bands that are present; none is an error."""
    weights = weights or LINEAMENT_WEIGHTS
    have = {b: w for b, w in weights.items() if b in cells.columns}
    if not have:
        raise KeyError("no weighted band is present")
    each = filters.lineaments(cells, list(have), grid, sigma)
    total = sum((F.lit(float(w)) * F.col(b) for b, w in have.items()), F.lit(0.0))
    return _scaled(each.select("y", "x", total.alias("v")), 8)


def _scaled(field: DataFrame, strided: int = 0) -> DataFrame:
    return filters.percentile_scale(field.select("y", "x", "v"), "v", strided=strided, out="v")


def composite(cells: DataFrame, parts: dict[str, float], strided: int = 8) -> DataFrame:
    """the weighted sum of F5-scaled columns, F5-scaled again."""
    each = filters.scale_columns(cells.select("y", "x", *parts), {c: c for c in parts}, strided=strided)
    total = sum((F.lit(float(w)) * F.col(c) for c, w in parts.items()), F.lit(0.0))
    return _scaled(each.select("y", "x", total.alias("v")), strided)


def habitat(cells: DataFrame, emission: DataFrame, grid: Grid, sep: float = 2.0) -> DataFrame:
    """the blurred support of an earlier emission, zero beyond the edge."""
    return _blurred(cells, emission.where(in_support(F.col("p"))), grid, sep, "constant")


def consensus(members: DataFrame) -> DataFrame:
    """members: y, x, score; each cell's sum of squared scores."""
    return members.groupBy("y", "x").agg(F.sum(F.col("score") * F.col("score")).alias("v"))


def shell_reweight(h: Column, d: Column, mu: float = 20.0, sigma: float = 8.0, power: float = 1.0, inside: Column | None = None) -> Column:
    """h * exp(-((d - mu) / sigma)**2 / 2)**power, 0 outside."""
    g = F.exp(F.lit(-0.5) * F.pow((d - F.lit(mu)) / F.lit(sigma), F.lit(2)))
    out = h * F.pow(g, F.lit(power))
    return out if inside is None else F.when(inside, out).otherwise(F.lit(0.0))


def distance_band(d: Column, centre: float = 8.0, half: float = 4.0) -> Column:
    """C-1: a triangle around a distance, clipped to [0, 1]."""
    return F.least(F.greatest(F.lit(1.0) - F.abs(d - F.lit(centre)) / F.lit(half), F.lit(0.0)), F.lit(1.0))


def hashed_noise() -> Column:
    """C-0: a reproducible draw in [0, 1) from the cell's place."""
    return filters.fixed_draw() / F.lit(1000003.0)


def _merge(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.select("y", "x", F.col("v").alias(name))
        out = one if out is None else out.join(one, ["y", "x"])
    return out


def _largest(*columns: str) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def curvature(cells: DataFrame, grid: Grid) -> DataFrame:
    """The largest anisotropy of the detrended elevation over the scales."""
    each = filters.anisotropies(cells, {f"a{k}": ("det_elev", s) for k, s in enumerate(SCALES)}, grid)
    return each.select("y", "x", _largest(*[f"a{k}" for k in range(len(SCALES))]).alias("v"))


def basin_step(cells: DataFrame, grid: Grid) -> DataFrame:
    """Steps of the magnetic tilt that magnetic and gravity fabric corroborate, weighted by the depth and conductivity of the fill."""
    step = filters.step_edges(cells, {f"s{k}": ("tc", s) for k, s in enumerate(SCALES)}, grid)
    fabric = filters.anisotropies(cells, {"m0": ("tmi_hg", 2.0), "m1": ("tmi_vg", 2.0), "g": ("iso_grav_anom_hg", 2.0)}, grid)
    fill = filters.scale_columns(cells.select("y", "x", "depth_to_base_surf", "cond_surf"), {"depth_to_base_surf": "d", "cond_surf": "c"}).select("y", "x", "d", "c")
    both = F.sqrt(F.greatest(F.greatest("m0", "m1") * F.col("g"), F.lit(0.0)))
    top = F.greatest(_largest(*[f"s{k}" for k in range(len(SCALES))]), F.lit(0.0))
    v = F.cbrt(top * top * both) * (F.lit(0.25) + F.lit(0.75) * (F.lit(0.5) * F.col("d") + F.lit(0.5) * F.col("c")))
    return _scaled(step.join(fabric, ["y", "x"]).join(fill, ["y", "x"]).select("y", "x", v.alias("v")))


def _mix(a: DataFrame, wa: float, b: DataFrame, wb: float) -> DataFrame:
    """The scaled sum of two scaled fields."""
    each = filters.scale_columns(_merge({"a": a, "b": b}), {"a": "a", "b": "b"})
    return _scaled(each.select("y", "x", (F.lit(wa) * F.col("a") + F.lit(wb) * F.col("b")).alias("v")))


def screened_fields(cells: DataFrame, known: DataFrame, grid: Grid, prior: DataFrame | None = None, votes: DataFrame | None = None, prior_weight: float = 0.5) -> dict[str, Callable[[], DataFrame]]:
    """step, lineament, curvature, tip and composite fields, each built when called.

    The composite mixes curvature with a prior, else with votes, else with tips.
    """
    def mixed() -> DataFrame:
        if prior is not None:
            return _mix(prior, 1.0 - prior_weight, curvature(cells, grid), prior_weight)
        if votes is not None:
            return _mix(votes, W_VOTES, curvature(cells, grid), W_CURVATURE)
        return _mix(curvature(cells, grid), W_CURVATURE, tip_extension(cells, known, grid), W_TIPS)

    return {
        "step": lambda: basin_step(cells, grid), "lineament": lambda: lineament_energy(cells, grid), "curvature": lambda: curvature(cells, grid),
        "tips": lambda: tip_extension(cells, known, grid), "composite": mixed,
    }


def signed_blend(cells: DataFrame, weights: dict[str, float], inside: Column) -> DataFrame:
    """The rank transform of a signed sum of rank-transformed bands; bands that are missing are left out."""
    have = {b: w for b, w in weights.items() if b in cells.columns}
    base = cut(cells.select("y", "x", inside.alias("inside"), *have))
    ranks = filters.rank_columns(base, {b: f"r_{b}" for b in have}, F.col("inside"), filters.fixed_draw())
    total = sum((F.lit(w) * F.coalesce(f"r_{b}", F.lit(0.0)) for b, w in have.items()), F.lit(0.0))
    blended = base.select("y", "x", "inside").join(ranks, ["y", "x"], "left").select("y", "x", "inside", F.round(total, 9).alias("v"))
    return filters.rank_transform(blended, "v", F.col("inside")).select("y", "x", F.col("z").alias("v"))


#: Fixed weights of the measured habitat and of the shadow habitat.
HABITAT_WEIGHTS = {
    "det_elev_slope": 0.1573, "lid_upface_max": 0.1391, "lid_downface_max": 0.1246, "lid_lappos_max": 0.1213, "lid_cross_max": 0.1210, "lid_lapneg_max": 0.1174, "lid_ex_max": 0.1126,
    "lid_relief": 0.1084, "lid_step_max": 0.1057, "lid_ex_mean": 0.0942, "tmi_hg": 0.0739, "ext_UK": 0.0682, "ext_UTh": 0.0521, "det_elev": 0.0603, "iso_grav_anom": 0.0517,
    "geod_dilaterate": 0.0321, "deq_n100a15": 0.0290, "geod_2ndinv": 0.0252, "rad_K": -0.1413, "tc": -0.1228, "rad_TC": -0.1226, "rad_Th": -0.0873, "rad_U": -0.0831,
    "depth_to_base_surf": -0.0321, "tmi_vg": -0.0262, "cond_surf": -0.0238,
}
SHADOW_WEIGHTS = {
    "lid_upface_max": 0.578, "lid_ex_max": 0.518, "tmi_hg": 0.466, "lid_step_max": 0.443, "iso_grav_anom": 0.388, "det_elev_slope": 0.300, "geod_2ndinv": 0.150, "tmi_vg": -0.513,
    "cond_surf": -0.372, "lid_coh100": -0.260, "rad_U": -0.155, "tc": -0.090, "rad_TC": -0.090, "depth_to_base_surf": -0.967,
}


def candidate_bank(cells: DataFrame, known: DataFrame, grid: Grid) -> dict[str, Callable[[], DataFrame]]:
    """eleven hypotheses and two controls by name; each is built when called. cells: y, x, inside and bands."""
    inside = F.col("inside")
    have = cells.columns
    base = cells.select("y", "x", "inside")
    # equal values of a filter may differ by rounding errors: they are ranked at 9 places
    rank = lambda df: filters.rank_transform(base.join(df.select("y", "x", F.round("v", 9).alias("v")), ["y", "x"], "left"), "v", inside, "v")
    band = lambda b: cells.select("y", "x", F.col(b if b in have else "det_elev").cast("double").alias("v"))
    trendless = lambda b, s: filters.detrend(cells, b if b in have else "det_elev", s, grid)
    absolute = lambda df: df.select("y", "x", F.abs("v").alias("v"))

    def weighted(parts: list[tuple[float, DataFrame]]) -> DataFrame:
        merged = _merge({f"w{k}": df for k, (_, df) in enumerate(parts)})
        return rank(merged.select("y", "x", sum((F.lit(w) * F.col(f"w{k}") for k, (w, _) in enumerate(parts)), F.lit(0.0)).alias("v")))

    def ratio(a: str, b: str) -> DataFrame:
        part = lambda c: F.greatest(F.col(c).cast("double") if c in have else F.lit(0.0), F.lit(1e-6))
        return cells.select("y", "x", F.ln(part(a) / part(b)).alias("v"))

    def scarps() -> DataFrame:
        names = [b for b in have if b.startswith("lid_") and b != "lid_valid"]
        return weighted([(1.0 / len(names), rank(band(b))) for b in names])

    def linear_habitat() -> DataFrame:
        relief = filters.coherence(cells, "lid_relief" if "lid_relief" in have else "det_elev", grid)
        return weighted([(0.65, signed_blend(cells, HABITAT_WEIGHTS, inside)), (0.35, rank(relief))])

    def conductivity() -> DataFrame:
        g = filters.gradient(trendless("cond_surf", 30.0), "v", grid)
        return rank(g.select("y", "x", F.hypot("gy", "gx").alias("v")))

    bank = {
        "curvature ridge": lambda: rank(filters.ridge(trendless("det_elev", 40.0), "v", grid)),
        "fabric anisotropy": lambda: rank(filters.coherence(trendless("det_elev", 40.0), "v", grid)),
        "alteration ratio": lambda: weighted([(0.4, rank(ratio("rad_Th", "rad_K"))), (0.4, rank(ratio("rad_U", "rad_K"))), (0.2, rank(absolute(trendless("rad_TC", 30.0))))]),
        "basement step": lambda: rank(filters.ridge(trendless("depth_to_base_surf", 40.0), "v", grid, (1.0, 2.0, 4.0))),
        "strain corridor": lambda: weighted([(0.5, rank(band("geod_2ndinv"))), (0.25, rank(absolute(trendless("geod_dilaterate", 20.0)))), (0.25, rank(band("geod_shearrate")))]),
        "potential contact": lambda: rank(filters.ridge(weighted([(0.4, rank(band("tmi_hg"))), (0.3, rank(band("iso_grav_anom_hg"))), (0.3, rank(absolute(trendless("tc", 30.0))))]), "v", grid, (1.0, 2.0, 4.0))),
        "conductivity gradient": conductivity,
        "measured habitat": lambda: signed_blend(cells, HABITAT_WEIGHTS, inside),
        "linear habitat": linear_habitat,
        "shadow habitat": lambda: signed_blend(cells, SHADOW_WEIGHTS, inside),
        "control: random": lambda: cells.select("y", "x", hashed_noise().alias("v")),
        "control: distance band": lambda: geometry.distance(cells, known, grid).select("y", "x", F.coalesce(distance_band(F.col("dist")), F.lit(0.0)).alias("v")),
    }
    if any(b.startswith("lid_") and b != "lid_valid" for b in have):
        bank["scarp consensus"] = scarps
    return bank


def screen_arms(cells: DataFrame, known: DataFrame, grid: Grid) -> dict[str, Callable[[], DataFrame]]:
    """the eight arms of the field screen, each 0 outside the footprint and on what is known. cells: y, x, inside and bands."""
    def steps() -> DataFrame:
        each = filters.step_edges(cells, {"s0": ("depth_to_base_surf", 2.0), "s1": ("depth_to_base_surf", 5.0)}, grid)
        return each.select("y", "x", F.greatest("s0", "s1").alias("v"))

    def contrast() -> DataFrame:
        each = filters.anisotropies(cells, {"m": ("tmi_hg", 2.0), "g": ("iso_grav_anom", 2.0)}, grid)
        return each.select("y", "x", F.sqrt(F.greatest(F.col("m") * F.col("g"), F.lit(0.0))).alias("v"))

    arms = {
        "basin step": lambda: basin_step(cells, grid), "lineament": lambda: lineament_energy(cells, grid), "curvature": lambda: curvature(cells, grid),
        "tips": lambda: tip_extension(cells, known, grid), "wide parallel": lambda: parallel_field(cells, known, grid, (10, 16, 24, 32)),
        "wide shell": lambda: near_known(cells, known, grid, 20.0), "basement step": steps, "isostatic contrast": contrast,
    }
    place = cells.select("y", "x", "inside").join(known.select("y", "x", F.lit(True).alias("known")), ["y", "x"], "left")
    use = F.col("inside") & F.col("known").isNull()

    def masked(build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: build().join(place, ["y", "x"]).select("y", "x", F.when(use, F.col("v")).otherwise(F.lit(0.0)).alias("v"))

    return {name: masked(build) for name, build in arms.items()}


def sweep_fields(cells: DataFrame, known: DataFrame, grid: Grid, bands: bool = True, near: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """the sweep's fields and their composites (F21, of equal weights), each built when called.

    near: the composites of the near-field sweep, which take the composite of H2 to H4 as one part and add one of everything.
    """
    def joint(*builds: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: composite(_merge({f"p{k}": b() for k, b in enumerate(builds)}), {f"p{k}": 1.0 for k in range(len(builds))})

    trace = functools.cache(lambda: traced(known, grid))
    out = {
        "H1": lambda: near_known(cells, known, grid), "H2": lambda: tip_extension(cells, known, grid, trace=trace()), "H3": lambda: gap_linkage(cells, known, grid, trace=trace()),
        "H4": lambda: parallel_field(cells, known, grid, trace=trace()),
    }
    out["H2+H3+H4"] = joint(out["H2"], out["H3"], out["H4"])
    out["H1+H2+H3+H4"] = joint(out["H1"], out["H2+H3+H4"]) if near else joint(out["H1"], out["H2"], out["H3"], out["H4"])
    if bands:
        out["H5"] = lambda: lineament_energy(cells, grid)
        out["H5+structure"] = joint(out["H5"], out["H2+H3+H4"])
        if near:
            out["all"] = joint(out["H5"], out["H1+H2+H3+H4"])
    return out
