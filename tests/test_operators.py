"""Operators against hand-computed cases and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions import scalars as P
from gridloom.operators import fields, filters, folds, geometry, metric, model, select, similarity, stats, stencil
from gridloom.sources import grid as G


def cells(spark, pairs, p=None):
    if p is None:
        return spark.createDataFrame([(int(y), int(x)) for y, x in pairs], "y int, x int")
    return spark.createDataFrame([(int(y), int(x), float(v)) for (y, x), v in zip(pairs, p, strict=True)], "y int, x int, p double")


def dense(spark, a, name="v"):
    h, w = a.shape
    return spark.createDataFrame([(y, x, float(a[y, x])) for y in range(h) for x in range(w)], f"y int, x int, {name} double")


def image(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r[name] is None else r[name]
    return out


def brute_score(pred, truth, free):
    k = lambda d: max(1 - d / 3, 0)
    tp = sum(max([p * k(math.dist(t, c)) for c, p in pred.items()], default=0.0) for t in truth)
    fp = sum(p * (1 - max([k(math.dist(t, c)) for t in truth], default=0.0)) for c, p in pred.items() if c not in free)
    fn = len(truth) - tp
    return tp, fp, fn, tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12)


def test_hand_computed_score(spark):
    truth = [(y, 4) for y in range(6)]
    pred = [(0, 4), (1, 4), (2, 4), (3, 3)]
    r = metric.score(cells(spark, pred, [1.0] * 4), cells(spark, truth)).first()
    assert (round(r.tp, 6), round(r.fp, 6), round(r.fn, 6), round(r.dti, 6)) == (4.449906, 0.333333, 1.550094, 0.773003)


@pytest.mark.parametrize("seed", [7, 11])
def test_score_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    truth = [tuple(map(int, c)) for c in np.argwhere(rng.random((28, 28)) > 0.94)]
    pred = {tuple(map(int, c)): float(rng.choice([0.25, 1.0])) for c in np.argwhere(rng.random((28, 28)) > 0.95)}
    free = {c for c in pred if rng.random() < 0.3}
    want = brute_score(pred, truth, free)
    for fn in (metric.score, metric.score_literal):
        r = fn(cells(spark, list(pred), list(pred.values())), cells(spark, truth), cells(spark, list(free))).first()
        assert np.allclose([r.tp, r.fp, r.fn, r.dti], want)


def test_empty_truth_and_empty_pred(spark):
    none = cells(spark, [])
    r = metric.score(cells(spark, [(1, 1), (5, 5)], [1.0, 0.5]), none, cells(spark, [(1, 1)])).first()
    assert (r.dti, r.fp, r.n_truth) == (0.0, 1.5, 0)
    r = metric.score(cells(spark, [], []), cells(spark, [(5, 5)])).first()
    assert (r.tp, r.fp, r.dti) == (0.0, 0.0, 0.0)


def test_kernel_and_bars(spark):
    assert [round(K.kernel(d), 6) for d in (0, 1, 2, 3, 3.5)] == [1, 0.666667, 0.333333, 0, 0]
    assert len(K.cone()) == 25 and round(K.kernel_mass(), 6) == 9.380298
    r = spark.range(1).select(K.marginal_bar(F.lit(0.28), F.lit(1.0)).alias("b"), K.marginal_bar(F.lit(0.28), F.lit(0.0)).alias("z")).first()
    assert round(r.b, 6) == 0.047945 and r.z == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_distance_transform(spark, seed):
    rng = np.random.default_rng(seed)
    m = np.argwhere(rng.random((40, 33)) > 0.985)
    grid = G.Grid(40, 33)
    got = image(geometry.distance(dense(spark, np.zeros((40, 33))), cells(spark, m), grid, band=8), (40, 33), "dist")
    yy, xx = np.mgrid[:40, :33]
    assert np.allclose(got, np.sqrt(((yy[..., None] - m[:, 0]) ** 2 + (xx[..., None] - m[:, 1]) ** 2).min(-1)))


def test_distance_of_nothing(spark):
    assert geometry.distance(cells(spark, [(0, 0)]), cells(spark, []), G.Grid(3, 3)).where("dist is not null").count() == 0


@pytest.mark.parametrize("eight", [True, False])
def test_components(spark, eight):
    rng = np.random.default_rng(3)
    m = rng.random((25, 25)) > 0.6
    got = geometry.components(cells(spark, np.argwhere(m)), eight).collect()
    seen, label = {}, {}
    for c in map(tuple, np.argwhere(m)):
        if c in seen:
            continue
        stack, seen[c] = [c], c
        while stack:
            y, x = stack.pop()
            label[y, x] = c
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (y + dy, x + dx)
                    if (eight or abs(dy) + abs(dx) == 1) and 0 <= n[0] < 25 and 0 <= n[1] < 25 and m[n] and n not in seen:
                        seen[n] = c
                        stack.append(n)
    assert {(r.y, r.x): (r.label >> 32, r.label & 0xFFFFFFFF) for r in got} == {tuple(map(int, k)): tuple(map(int, v)) for k, v in label.items()}


def test_greedy_nms_equals_loop(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.random((30, 30)), 2)  # many ties
    order = sorted(((-a[y, x], y, x) for y in range(30) for x in range(30)))
    taken = []
    for _, y, x in order:
        if all(math.hypot(y - u, x - v) >= 3 for u, v in taken):
            taken.append((y, x))
    got = select.greedy_nms(dense(spark, a), "v", 3.0).orderBy("rank").collect()
    assert [(r.y, r.x) for r in got] == taken and [r["rank"] for r in got] == list(range(1, len(taken) + 1))
    assert [(r.y, r.x) for r in select.greedy_nms(dense(spark, a), "v", 3.0, n=10).orderBy("rank").collect()] == taken[:10]


def test_round_robin_and_quotas(spark):
    rows = [(k, 0, float(v), b) for k, (v, b) in enumerate(zip([9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [0, 0, 0, 1, 1, 2, 2, 2, 2, 3], strict=True))]
    df = spark.createDataFrame(rows, "y int, x int, v double, block int")
    first = select.round_robin(df, "v", "block").where("rank <= 4").collect()
    assert {r.block for r in first} == {0, 1, 2, 3}
    assert sum(select.quotas([0.02, 0.04, 0.06, 0.12, 0.18, 0.25, 0.55, 0.95], 1200)) == 1200


def test_stratified_selection_keeps_the_profile(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 60), int(i % 60), float(rng.random()), float(rng.exponential(6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "y int, x int, v double, d double").withColumn("block", folds.fixed_block(20, 20))
    got = select.stratified_select(df, "v", "d", "block", [1.0, 5.0, 20.0], [0.1, 0.5, 0.9], 300).collect()
    assert len(got) == 300 and len({(r.y, r.x) for r in got}) == 300
    assert [sum(r.d <= e for r in got) for e in (1.0, 5.0)] == [30, 150]


def blur_brute(a, sigma, mode):
    k = filters.taps(sigma)
    r = len(k) // 2
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode=mode)
        a = sum(w * (p[i : i + a.shape[0]] if axis == 0 else p[:, i : i + a.shape[1]]) for i, w in enumerate(k))
    return a


@pytest.mark.parametrize("border,mode", [("reflect", "symmetric"), ("nearest", "edge"), ("constant", "constant")])
def test_gaussian_borders_and_tiles(spark, border, mode):
    a = np.random.default_rng(9).random((50, 41))
    df, grid = dense(spark, a), G.Grid(50, 41)
    want = blur_brute(a, 1.5, mode)
    assert np.allclose(image(filters.gaussian(df, "v", 1.5, grid, border), a.shape), want)
    small = stencil.tile_halo_apply(df, ["v"], lambda t, edge: {"v": filters.blur(t["v"], 1.5)}, ["v"], grid, 6, tile=16, border=border)
    assert np.allclose(image(small, a.shape), want)


def test_gaussian_axis_equals_tiles(spark):
    a = np.random.default_rng(2).random((12, 30))
    got = image(filters.gaussian_axis(dense(spark, a), "v", 1.5, G.Grid(12, 30)), a.shape, "blur")
    k = filters.taps(1.5)
    p = np.pad(a, ((0, 0), (6, 6)), mode="symmetric")
    assert np.allclose(got, sum(w * p[:, i : i + 30] for i, w in enumerate(k)))


def test_sobel_and_gradient(spark):
    a = np.random.default_rng(4).random((20, 17))
    df, grid = dense(spark, a), G.Grid(20, 17)
    p = np.pad(a, 1, mode="symmetric")
    s = filters.sobel(df, "v", grid)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    assert np.allclose(image(s, a.shape, "gx"), gx)
    g = filters.gradient(df, "v", grid)
    wy, wx = np.gradient(a)
    assert np.allclose(image(g, a.shape, "gy"), wy) and np.allclose(image(g, a.shape, "gx"), wx)


def test_ridge_and_coherence_answer_a_line(spark):
    a = np.zeros((41, 41))
    a[:, 20] = 1.0
    df, grid = dense(spark, a), G.Grid(41, 41)
    for f in (filters.ridge, filters.coherence):
        v = image(f(df, "v", grid, (1.0, 2.0)), a.shape)
        assert v[20, 20] > v[20, 2] + 1e-3


def test_skeleton_is_thin_connected_and_inside(spark):
    m = [(y, x) for y in range(5, 12) for x in range(3, 40)]
    thin = {(r.y, r.x) for r in geometry.skeleton(cells(spark, m)).collect()}
    assert thin <= set(m) and 20 <= len(thin) <= 60
    assert geometry.components(cells(spark, list(thin))).select("label").distinct().count() == 1
    assert {(r.y, r.x) for r in geometry.skeleton(cells(spark, [(4, x) for x in range(9)])).collect()} == {(4, x) for x in range(9)}


def thinned(m):
    """Two-pass thinning, cell by cell."""
    m, ring = set(m), ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        size = len(m)
        for first in (True, False):
            gone = set()
            for y, x in m:
                p = [(y + a, x + b) in m for a, b in ring]
                n, e, s, w = p[0], p[2], p[4], p[6]
                corner = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1 and corner:
                    gone.add((y, x))
            m -= gone
        if len(m) == size:
            return m


@pytest.mark.parametrize(("tile", "rounds"), [(256, 8), (16, 1), (7, 3)])
def test_skeleton_equals_plain_thinning_without_joins(spark, tmp_path, monkeypatch, tile, rounds):
    rng = np.random.default_rng(tile)
    a = rng.random((70, 300)) > 0.3
    a[5:50, 100:190] = a[60, :] = True  # more rounds than one exchange of edges
    a[40:44, :40] = False
    m = [(int(y) - 20, int(x) - 30) for y, x in np.argwhere(a)]
    cells(spark, m).union(spark.createDataFrame([(None, 3), (None, 3), (4, None), (None, None)], "y int, x int")).coalesce(1).write.parquet(f"{tmp_path}/m")
    plans = []
    monkeypatch.setattr(geometry, "cut", lambda df, f=geometry.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    monkeypatch.setattr(geometry, "THIN_TILE", tile, raising=False)
    monkeypatch.setattr(geometry, "THIN_ROUNDS", rounds, raising=False)
    mask = spark.read.parquet(f"{tmp_path}/m")
    got = geometry.skeleton(mask)
    assert got.dtypes == mask.dtypes and plans and not any("Join" in p for p in plans)
    assert sorted(map(str, got.collect())) == sorted(f"Row(y={y}, x={x})" for y, x in [*thinned(m), (None, 3), (4, None), (None, None)])
    assert geometry.skeleton(mask.limit(0)).count() == 0


def test_strike_kinds(spark):
    line = cells(spark, [(k, k) for k in range(30)])
    at = lambda kind: geometry.strike(line, G.Grid(40, 40), kind=kind).where("y = 15").first()
    ref, tan = at("reference"), at("tangent")
    assert round(abs(ref.cos), 2) == round(abs(ref.sin), 2) == 0.71 and ref.cos * ref.sin < 0  # across the trace
    assert tan.cos * tan.sin > 0  # along it


def test_rank_ties_get_distinct_ranks(spark):
    a = np.array([[9.0, 9, 9, 9], [1, 2, 3, 4]])
    for f in (lambda d: filters.pct_rank(d, "v", out="z"), lambda d: filters.rank_transform(d, "v")):
        z = sorted(r.z for r in f(dense(spark, a)).collect())
        assert np.allclose(z, np.arange(8) / 7)


def test_ranked_is_a_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id"))
    got = G.ranked(df, F.col("v").desc(), F.col("id").asc(), partitions=7).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.v for r in got), reverse=True)


def test_ridge_recovery_and_collinearity(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    y = 3 * x[:, 0] - 1.5 * x[:, 1] + 0.4 + rng.normal(scale=0.01, size=60)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, f0 double, f1 double, f2 double, f3 double, y double")
    f = ["f0", "f1", "f2", "f3"]
    m = model.ridge(df, f, "y", 1e-6)
    assert np.allclose(m.weights / m.deviation, [3, -1.5, 0, 0], atol=0.02)
    q = model.loo_summary(model.leave_one_out(df, "id", f, "y", [1e-6])).first()
    assert q.r2 > 0.99 and q.rmse < 0.05
    twin = df.withColumn("f4", F.col("f0") + F.rand(1) * 1e-6)
    assert abs(model.ridge(twin, [*f, "f4"], "y", 1e-8).weights).max() > abs(model.ridge(twin, [*f, "f4"], "y", 10.0).weights).max()


def registry(spark):
    free = [(y, x) for y in range(50) for x in range(40)]
    rng = [np.random.default_rng(s) for s in (1, 2)]
    extra = [[(100 + int(r.integers(0, 200)), int(r.integers(0, 300))) for _ in range(50)] for r in rng]
    rows = [(n, y, x, 1.0) for n, e in (("a", extra[0]), ("b", extra[1]), ("c", extra[0])) for y, x in {*free, *e}]
    return spark.createDataFrame(rows, "a string, y int, x int, p double"), cells(spark, free)


def test_gate_refuses_copies_and_allows_new_payloads(spark):
    art, free = registry(spark)
    grid = G.Grid(400, 400)
    one = lambda n: art.where(F.col("a") == n)
    whole = similarity.agreement(one("a"), one("b")).first()
    pay = similarity.agreement(similarity.payloads(one("a"), free), similarity.payloads(one("b"), free)).first()
    assert whole.dice > 0.9 and pay.dice < 0.1
    entries = one("a")
    reg = entries.select("a").distinct().withColumn("score", F.lit(0.1))
    judge = lambda n, f: similarity.gate(one(n).select("y", "x", "p"), reg, entries, grid, f)[1].first()
    assert judge("c", free).blocking_rules[0] == "exact/support_duplicate" and judge("b", free).allowed and judge("b", free).max_dice_against == "a"
    assert judge("b", None).blocking_rules == ["near_duplicate_final"] and not judge("b", None).allowed
    strict = lambda n: similarity.strict_gate(one(n).select("y", "x", "p"), entries, grid, free)[1].first()
    assert strict("c").subset == ["a"] and not strict("c").allowed and strict("b").final == ["a"] and strict("b").subset == []


def test_hashes_ignore_order_and_see_values(spark):
    art, _ = registry(spark)
    h = {r.a: r.sha256_values for r in G.value_hash(art.orderBy(F.rand(3)), "p", ["a"]).collect()}
    assert h["a"] == h["c"] != h["b"]


def test_output_round_trip(spark, tmp_path):
    grid = G.Grid(30, 30)
    df = spark.createDataFrame([(y, x, v) for y in range(30) for x in range(30) for v in [float("nan") if (y, x) == (0, 0) else -5.0 if y == 1 else 7.0 if y == 2 else 0.4]], "y int, x int, p double")
    r = G.write_output(df, grid, str(tmp_path / "a"))
    assert (r["n_finite"], r["min"], r["max"], r["convention"], r["format_ok"]) == (899, 0.0, 1.0, "nan-outside", True)
    assert G.write_output(df, grid, str(tmp_path / "b"), outside="zero")["convention"] == "zero-outside"
    with pytest.raises(ValueError):
        G.write_output(df, G.Grid(10, 10), str(tmp_path / "c"))


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "x.1").write_bytes(b"ab")
    (tmp_path / "parts" / "x.2").write_bytes(b"cd")
    import hashlib

    parts = G.assemble_parts(spark, str(tmp_path / "parts"))
    assert [(r.part, r.offset) for r in parts.orderBy("offset").collect()] == [("x.1", 0), ("x.2", 2)]
    r = G.verify_parts(parts, {"x": hashlib.sha256(b"abcd").hexdigest()}).first()
    assert r.verified and r.n_parts == 2 and r.length == 4 and G.file_hashes(spark, str(tmp_path / "parts")).count() == 2
    assert not G.verify_parts(parts, {"x": "0"}).first().verified
    G.write_document({"a": 1}, spark, str(tmp_path / "doc.json"))
    assert (tmp_path / "doc.json").read_text() == '{\n  "a": 1\n}\n'
    G.write_registry(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "reg"))
    assert G.read_registry(spark, str(tmp_path / "reg")).first().name == "a"
    assert "&lt;b&gt;" in G.report_table(spark.createDataFrame([("<b>",)], "c string"), ["c"], 5)


def test_nodata_rules(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-3.4e38,), (2.0,), (None,)], "v double")
    r = df.select(P.finite_or_zero(F.col("v")).alias("a"), P.valid_or_zero(F.col("v")).alias("b"), P.in_support(F.col("v")).alias("c")).collect()
    assert [x.a for x in r] == [0.0, 0.0, -3.4e38, 2.0, 0.0] and [x.b for x in r] == [0.0, 0.0, 0.0, 2.0, 0.0] and [bool(x.c) for x in r] == [False, False, False, True, False]


def test_shell_peaks_on_its_ring(spark):
    r = spark.range(0, 41).select(fields.shell_reweight(F.lit(1.0), F.col("id").cast("double"), 20.0, 5.0).alias("v"), "id").orderBy(F.desc("v")).first()
    assert r.id == 20 and r.v == 1.0


def test_folds_and_runs(spark):
    rng = np.random.default_rng(1)
    known = cells(spark, {tuple(map(int, c)) for c in rng.integers(0, 60, (400, 2))})
    grid = G.Grid(60, 60)
    f = folds.fold_cells(known, 2, grid, 10)
    assert f.count() == known.count() and f.select("fold").distinct().count() == 4
    truth, seen = folds.cut_runs(known, known, grid, 10)
    assert truth.count() + seen.count() == known.count() and truth.count() >= 10


def test_spearman_and_binary_pearson(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i * 5) % 11)) for i in range(50)], "id long, a double, b double")
    p = df.toPandas()
    got = stats.spearman(df, "a", "b", "average").first().spearman
    ra, rb = p.a.rank(), p.b.rank()
    assert abs(got - np.corrcoef(ra, rb)[0, 1]) < 1e-9
    u, w = np.arange(100) < 30, np.arange(100) % 3 == 0
    r = spark.range(1).select(stats.binary_pearson(F.lit(100), F.lit(int(u.sum())), F.lit(int(w.sum())), F.lit(int((u & w).sum()))).alias("r")).first().r
    assert abs(r - np.corrcoef(u, w)[0, 1]) < 1e-9


def test_golden_section_and_least_squares(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x) for x in range(1, 20)], "x double, y double")
    m, loss = model.golden_section(df, lambda v: F.col("y") - F.lit(v) * F.col("x"), 0.0, 10.0)
    assert abs(m - 3) < 1e-4 and loss < 1e-2
    t = np.linspace(0, 5, 30)
    p = model.bounded_least_squares(lambda q: q[0] * np.exp(-q[1] * t) - 2 * np.exp(-0.7 * t), np.array([1.0, 0.1]), np.zeros(2), np.full(2, 5.0))
    assert np.allclose(p, [2, 0.7], atol=1e-5)


def test_forward_selection_stops(spark):
    f = {n: cells(spark, [(0, 0)]).withColumn("v", F.lit(v)) for n, v in (("a", 1.0), ("b", 3.0), ("c", 2.0))}
    assert [n for n, _ in model.forward_selection(f, lambda d: d.first().v)] == ["b"]


def test_stream_gate(spark, tmp_path):
    from gridloom.streaming.gate import stream_gate

    cells(spark, [(1, 1), (2, 2)], [1.0, 0.5]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("y int, x int, p double").parquet(str(tmp_path / "in"))
    stream_gate(stream, lambda b: b.agg(F.count("*").alias("n"), F.sum("p").alias("mass")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().mass == 1.5


def test_surface_correlation_ranks_ties(spark):
    rng = np.random.default_rng(3)
    at = [(y, x) for y in range(12) for x in range(12)]
    u = np.round(rng.random(144), 1) + 0.1
    w = u + rng.choice([0.0, 0.05], 144)
    r = similarity.surface_correlation(cells(spark, at, u), cells(spark, at, w), G.Grid(20, 20)).first()
    import pandas as pd

    assert r.pearson_support == pytest.approx(np.corrcoef(u, w)[0, 1]) and r.pearson_support > 0.9
    assert r.spearman_support == pytest.approx(np.corrcoef(pd.Series(u.round(6)).rank(), pd.Series(w.round(6)).rank())[0, 1], abs=1e-6)
    full = np.zeros((2, 400))
    full[0, :144], full[1, :144] = u, w
    assert r.pearson_full == pytest.approx(np.corrcoef(full)[0, 1])


# ---------------------------------------------------------------- exact quantiles


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 399, 5000, 60_000])
def test_quantiles_equal_numpy(spark, n):
    from gridloom.functions.quantiles import quantiles

    rng = np.random.default_rng(n)
    for a in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.full(n, 2.5), rng.exponential(size=n) ** 6):
        df = spark.createDataFrame([(float(v),) for v in a] + [(None,)] * 3, "v double").repartition(5)
        qs = [0.0, 0.01, 0.1, 0.5, 0.75, 0.99, 1.0]
        got = quantiles(df, "v", qs).first()
        if n == 0:
            assert got.q0 is None
        else:
            assert np.allclose([got[f"q{k}"] for k in range(len(qs))], np.quantile(a, qs), rtol=1e-12)


def test_quantiles_by_group(spark):
    from gridloom.functions.quantiles import quantiles

    rng = np.random.default_rng(1)
    rows = [(g if g else None, float(v)) for g in range(4) for v in rng.normal(size=1 + 700 * g)]
    got = {r.g: r.q0 for r in quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0.9], ("g",)).collect()}
    assert got.keys() == {None, 1, 2, 3}
    for g in got:
        assert np.isclose(got[g], np.quantile([v for h, v in rows if h == g], 0.9))


# ---------------------------------------------------------------- filters and fields against numpy


def np_blur(a, sigma, mode):
    return blur_brute(a, sigma, mode)


def np_sobel(a):
    p = np.pad(a, 1, mode="symmetric")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gy, gx


def np_energy(a, sigma, mode="symmetric", slopes=np_sobel):
    """l1 - l2 by eigenvalues of the blurred tensor, cell by cell."""
    gy, gx = slopes(a)
    j = [np_blur(p, sigma, mode) for p in (gx * gx, gx * gy, gx * gy, gy * gy)]
    e = np.linalg.eigvalsh(np.stack(j, axis=-1).reshape(*a.shape, 2, 2))
    return e[..., 1] - e[..., 0], e[..., 1] + e[..., 0]


def np_scale(a, strided=False):
    s = a[::8, ::8] if strided else a
    lo, hi = np.percentile(s, 1), np.percentile(s, 99)
    return np.zeros_like(a) if hi <= lo + (1e-7 if strided else 0) else np.clip((a - lo) / (hi - lo), 0, 1)


def many(spark, bands):
    names = list(bands)
    h, w = bands[names[0]].shape
    rows = [(y, x, True, *(float(bands[n][y, x]) for n in names)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "y int, x int, inside boolean, " + ", ".join(f"{n} double" for n in names))


#: Entered by hand from the published table.
HAND_WEIGHTS = [("tc", 1.0), ("tmi_hg", 0.8), ("iso_grav_anom_hg", 0.8), ("iso_grav_anom_vg", 0.6), ("tmi_vg", 0.6), ("geod_2ndinv", 0.7), ("geod_shearrate", 0.5), ("geod_dilaterate", 0.5), ("det_elev", 0.5), ("cond_surf", 0.4)]
SHAPE = (37, 44)


def random_bands(seed=2):
    rng = np.random.default_rng(seed)
    return {n: np_blur(rng.normal(size=SHAPE), 1.0, "symmetric") for n in [*dict(HAND_WEIGHTS), "iso_grav_anom", "depth_to_base_surf"]}


def np_lineament(bands):
    return np_scale(sum(w * np_scale(np_energy(np_scale(bands[b], True), 2.0)[0], True) for b, w in HAND_WEIGHTS), True)


def np_curvature(bands):
    return np.max([np_scale(np_energy(bands["det_elev"], s)[0]) for s in (1.5, 3.0, 6.0)], axis=0)


def np_step(a, s):
    return np_scale(np.hypot(*np_sobel(np_blur(a, s, "symmetric"))))


def test_lineament_and_curvature_fields_equal_numpy(spark):
    bands = random_bands()
    df, grid = many(spark, bands), G.Grid(*SHAPE)
    assert np.allclose(image(fields.lineament_energy(df, grid), SHAPE), np_lineament(bands), atol=1e-9)
    assert np.allclose(image(fields.curvature(df, grid), SHAPE), np_curvature(bands), atol=1e-9)
    some = {b: bands[b] for b in ("tc", "cond_surf")}
    part = np_scale(sum(w * np_scale(np_energy(np_scale(some[b], True), 2.0)[0], True) for b, w in HAND_WEIGHTS if b in some), True)
    assert np.allclose(image(fields.lineament_energy(many(spark, some), grid), SHAPE), part, atol=1e-9)
    with pytest.raises(KeyError):
        fields.lineament_energy(df.select("y", "x"), grid)


def test_basin_step_and_screen_arms_equal_numpy(spark):
    bands, grid = random_bands(3), G.Grid(*SHAPE)
    known = [(y, 20) for y in range(5, 30)]
    df = many(spark, bands).withColumn("inside", F.col("x") > 2)
    arms = fields.screen_arms(df, cells(spark, known), grid)
    one = lambda b, s=2.0: np_scale(np_energy(bands[b], s)[0])
    both = np.sqrt(np.maximum(one("tmi_hg"), one("tmi_vg")) * one("iso_grav_anom_hg"))
    top = np.max([np_step(bands["tc"], s) for s in (1.5, 3.0, 6.0)], axis=0)
    want = {
        "basin step": np_scale(np.cbrt(top**2 * both) * (0.25 + 0.75 * (0.5 * np_scale(bands["depth_to_base_surf"]) + 0.5 * np_scale(bands["cond_surf"])))),
        "basement step": np.maximum(np_step(bands["depth_to_base_surf"], 2.0), np_step(bands["depth_to_base_surf"], 5.0)),
        "isostatic contrast": np.sqrt(one("tmi_hg") * one("iso_grav_anom")), "curvature": np_curvature(bands),
    }
    yy, xx = np.mgrid[: SHAPE[0], : SHAPE[1]]
    for y, x in known:
        for a in want.values():
            a[y, x] = 0.0
    for name, a in want.items():
        assert np.allclose(image(arms[name](), SHAPE), np.where(xx > 2, a, 0.0), atol=1e-9), name


def test_composites_equal_numpy(spark):
    bands, grid = random_bands(4), G.Grid(*SHAPE)
    df, known = many(spark, bands), cells(spark, [(y, 20) for y in range(5, 30)] + [(20, x) for x in range(3, 15)])
    tips, curvature = image(fields.tip_extension(df, known, grid), SHAPE), np_curvature(bands)
    got = image(fields.screened_fields(df, known, grid)["composite"](), SHAPE)
    assert np.allclose(got, np_scale(0.85 * np_scale(curvature) + 0.15 * np_scale(tips)), atol=1e-9)
    votes = dense(spark, bands["tc"] ** 2)
    got = image(fields.screened_fields(df, known, grid, votes=votes)["composite"](), SHAPE)
    assert np.allclose(got, np_scale(1.0 * np_scale(bands["tc"] ** 2) + 0.85 * np_scale(curvature)), atol=1e-9)
    got = image(fields.screened_fields(df, known, grid, prior=votes)["composite"](), SHAPE)
    assert np.allclose(got, np_scale(0.5 * np_scale(bands["tc"] ** 2) + 0.5 * np_scale(curvature)), atol=1e-9)
    sweep = fields.sweep_fields(df, known, grid)
    parts = {n: image(sweep[n](), SHAPE) for n in ("H1", "H2", "H3", "H4", "H2+H3+H4")}
    assert np.allclose(parts["H2+H3+H4"], np_scale(sum(np_scale(parts[n], True) for n in ("H2", "H3", "H4")), True), atol=1e-9)
    assert np.allclose(image(sweep["H1+H2+H3+H4"](), SHAPE), np_scale(sum(np_scale(parts[n], True) for n in ("H1", "H2", "H3", "H4")), True), atol=1e-9)


def test_coherence_and_ridge_equal_numpy(spark):
    a, grid = random_bands(5)["tc"], G.Grid(*SHAPE)
    best = np.zeros(SHAPE)
    for s in (1.5, 3.0, 6.0):
        diff, trace = np_energy(np_blur(a, s * 0.5, "edge"), s, "edge", np.gradient)
        best = np.maximum(best, diff / np.maximum(trace, 1e-9))
    assert np.allclose(image(filters.coherence(dense(spark, a), "v", grid), SHAPE), best, atol=1e-9)

    def second(sigma, oy, ox):
        out = a
        for axis, o in ((0, oy), (1, ox)):
            k = filters.taps(sigma, o)[::-1]
            r = len(k) // 2
            p = np.pad(out, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
            out = sum(w * (p[i : i + a.shape[0]] if axis == 0 else p[:, i : i + a.shape[1]]) for i, w in enumerate(k))
        return out

    best = np.zeros(SHAPE)
    for s in (1.0, 2.0, 4.0):
        h = np.stack([second(s, 2, 0), second(s, 1, 1), second(s, 1, 1), second(s, 0, 2)], axis=-1).reshape(*SHAPE, 2, 2)
        best = np.maximum(best, s * s * np.abs(np.linalg.eigvalsh(h)).max(axis=-1))
    assert np.allclose(image(filters.ridge(dense(spark, a), "v", grid, (1.0, 2.0, 4.0)), SHAPE), best, atol=1e-9)


def test_scales_leave_out_what_is_no_value(spark):
    rows = [(k // 40, k % 40, float(k)) for k in range(1600)] + [(50, 0, float("nan")), (50, 1, -3.4e38), (50, 2, None), (50, 3, float("inf")), (48, 0, 2e30)]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    z = {(r.y, r.x): r.z for r in filters.percentile_scale(df, "v").collect()}
    lo, hi = np.percentile(np.arange(1600), [1, 99])
    assert all(z[50, k] == 0 for k in range(4)) and z[48, 0] == 0 and np.isclose(z[20, 0], (800 - lo) / (hi - lo)) and z[39, 39] == 1
    narrow = spark.createDataFrame([(0, k, 1.0 + k * 1e-9) for k in range(40)], "y int, x int, v double")
    assert filters.percentile_scale(narrow, "v").agg(F.max("z")).first()[0] == 1.0  # F6 has no margin
    assert filters.percentile_scale(narrow, "v", strided=8).agg(F.max("z")).first()[0] == 0.0


# ---------------------------------------------------------------- neighbours, scores, names


@pytest.mark.parametrize("k", [1, 2, 3])
def test_nearest_loses_no_cell(spark, k):
    rng = np.random.default_rng(k)
    a = {tuple(map(int, c)) for c in rng.integers(0, 60, (40, 2))} | {(0, 0), (100, 100), (700, 3)}
    for b in ({(1, 1)}, {(1, 1), (650, 650), (2, 2)}, {tuple(map(int, c)) for c in rng.integers(0, 60, (70, 2))}, set()):
        for apart in (False, True):
            got = sorted((r.y, r.x, r.nth, round(r.dist, 9), r.ny, r.nx) for r in stencil.nearest(cells(spark, a), cells(spark, b), 8, k, apart).collect())
            want = []
            for y, x in a:
                order = sorted(((y - u) ** 2 + (x - v) ** 2, u, v) for u, v in b if not apart or (u, v) != (y, x))
                want += [(y, x, n + 1, round(math.sqrt(s), 9), u, v) for n, (s, u, v) in enumerate(order[:k])]
            assert got == sorted(want)


def test_scores_by_group_need_no_copies(spark):
    rng = np.random.default_rng(8)
    at = lambda p: [tuple(map(int, c)) for c in np.argwhere(rng.random((20, 20)) > p)]
    truth, free = {f: at(0.95) for f in (0, 1, 2)}, {f: at(0.9) for f in (0, 1, 2, 3)}
    pred = {bar: {c: float(rng.choice([0.5, 1.0])) for c in at(0.9)} for bar in (7, 8)}
    t = spark.createDataFrame([(f, *c) for f, cs in truth.items() for c in cs], "fold int, y int, x int")
    fr = spark.createDataFrame([(f, *c) for f, cs in free.items() for c in cs], "fold int, y int, x int")
    p = spark.createDataFrame([(b, *c, v) for b, d in pred.items() for c, v in d.items()], "bar int, y int, x int, p double")
    groups = spark.createDataFrame([(f,) for f in range(4)], "fold int")
    got = {(r.bar, r.fold): (r.tp, r.fp, r.fn, r.dti, r.n_truth) for r in metric.score(p, t, fr, ("bar", "fold"), groups).collect()}
    assert len(got) == 8
    for (bar, fold), row in got.items():
        if fold == 3:
            assert row == (0.0, pytest.approx(sum(pred[bar].values())), 0.0, 0.0, 0)
        else:
            assert np.allclose(row[:4], brute_score(pred[bar], truth[fold], set(free[fold]))) and row[4] == len(truth[fold])


def test_names_are_found_wherever_they_stand(spark):
    import random

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abC_.") for _ in range(rng.randrange(9))) for _ in range(80)})
    ledger = [(k, rng.choice(["ab", "C"]), "".join(rng.choice("abC_.") for _ in range(rng.randrange(5)))) for k in range(60)]
    got = {r.claim: r.name for r in similarity.resolve_names(spark.createDataFrame(ledger, "claim int, repo string, needle string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    for claim, repo, needle in ledger:
        found = sorted((not n.startswith(repo + "__"), len(n), n) for n in names if needle in n)
        assert got[claim] == (found[0][2] if found else None)


def broadcasts(df):
    """What stands below each broadcast of a plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for k in (k for k, x in enumerate(lines) if "BroadcastExchange" in x):
        end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        out.append("\n".join(lines[k:end]))
    return out


def test_lists_of_runs_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, n) for k, n in enumerate(["a Red Bolt", "red", "bolts", "BOLT", "x"])], "position int, name string").coalesce(1).write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    first = lambda: similarity.first_match(names, ["RED", "bolt", "none", ""])
    assert {r.wanted: r.name for r in first().collect()} == {"RED": "red", "bolt": "bolts", "none": None, "": "a Red Bolt"}
    claims = names.select(F.col("position").alias("claim"), F.lit("re").alias("repo"), F.substring("name", 1, 2).alias("needle"))
    found = similarity.resolve_names(claims, names.select("name"))
    assert {r.claim: r.name for r in found.collect()} == {0: "a Red Bolt", 1: "red", 2: "bolts", 3: "BOLT", 4: "x"}
    # where a list stands below a broadcast, a shuffle between them tells its size first
    assert not any("explode" in b.split(" Exchange hashpartitioning")[0] for b in broadcasts(similarity.holding(names, "name", claims, "needle")) + broadcasts(first()))


def test_first_match_takes_the_first_of_equal_names_and_null_positions_last(spark):
    rows = [(None, "bolt a"), (5, "red bolt"), (2, "red bolt"), (3, "Bolt b"), (None, "Bolt b"), (None, "red x"), (1, None)]
    got = similarity.first_match(spark.createDataFrame(rows, "position int, name string"), ["bolt", "ed b", "red", "x"])
    assert {r.wanted: r.name for r in got.collect()} == {"bolt": "Bolt b", "ed b": "red bolt", "red": "red bolt", "x": "red x"}


def test_fingerprint_samples_the_fixed_sites(spark):
    grid = G.Grid(40, 50)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((40, 50)) > 0.5, rng.random((40, 50)), 0.0)
    df = dense(spark, a, "p").withColumn("a", F.lit("x"))
    r = similarity.fingerprint(df, grid, similarity.sample_sites(spark, grid)).first()
    draw = np.random.RandomState(3400)
    ys, xs = draw.randint(0, 40, 8192), draw.randint(0, 50, 8192)
    assert np.allclose(r["sample"], np.round(a[ys, xs], 6)) and (r.n_finite, r.n_positive) == (2000, int((a > 0).sum()))


def test_leave_one_out_equals_plain_fits(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=25)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, f0 double, f1 double, f2 double, y double")
    got = {r.lam: r for r in model.loo_summary(model.leave_one_out(df, "id", ["f0", "f1", "f2"], "y", [1.0, 10.0]), "id").collect()}
    for lam in (1.0, 10.0):
        pred = []
        for i in range(25):
            k = np.arange(25) != i
            m, d = x[k].mean(0), x[k].std(0) + 1e-12
            z = (x[k] - m) / d
            pred.append(y[k].mean() + ((x[i] - m) / d) @ np.linalg.inv(z.T @ z + lam * np.eye(3)) @ z.T @ (y[k] - y[k].mean()))
        rank = lambda v: np.argsort(np.argsort(v))
        assert np.isclose(got[lam].rmse, np.sqrt(np.mean((np.array(pred) - y) ** 2))) and np.isclose(got[lam].spearman, np.corrcoef(rank(pred), rank(y))[0, 1])


def left_out(x, y, lam):
    """The prediction of each row by the fit to the others, one by one."""
    out = []
    for i in range(len(y)):
        k = np.arange(len(y)) != i
        m, d = x[k].mean(0), x[k].std(0) + 1e-12
        z = (x[k] - m) / d
        out.append(y[k].mean() + ((x[i] - m) / d) @ np.linalg.solve(z.T @ z + lam * np.eye(x.shape[1]), z.T @ (y[k] - y[k].mean())))
    return np.array(out)


@pytest.mark.parametrize("odd", ["plain", "far", "lonely", "constant", "two", "twins"])
def test_leave_one_out_has_no_task_with_all_rows(spark, odd):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 3)) + 1e4, rng.normal(size=40)
    if odd == "far":  # without the row hardly anything would be left of the sums
        x[7, 0], x[9, 1], y[7] = 1e10, -1e9, 1e8
    if odd == "lonely":
        x[:, 1] = 0.0
        x[3, 1] = 0.7
    if odd == "constant":
        x[:, 2] = 1e6 + 0.1
    if odd == "two":
        x, y = x[:2], y[:2]
    if odd == "twins":
        x[20:], y[20:] = x[:20], y[:20]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double")
    loo = model.leave_one_out(df, "id", ["a", "b", "c"], "y", [0.3, 10.0], {"all": ["a", "b", "c"], "two": ["c", "a"]})
    assert "MapInPandas" in (plan := loo._jdf.queryExecution().executedPlan().toString()) and "Groups" not in plan
    summary = {(r.lam, r["subset"]): r for r in model.loo_summary(loo, "id").collect()}
    for lam in (0.3, 10.0):
        for name, at in (("all", [0, 1, 2]), ("two", [2, 0])):
            want = left_out(x[:, at], y, lam)
            got = np.array([r.pred for r in loo.where(f"lam = {lam} and subset = '{name}'").orderBy("id").collect()])
            assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
            r = summary[lam, name]
            place = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
            assert r.n == len(y) and np.isclose(r.spearman, np.corrcoef(place(got), place(y))[0, 1]) and np.isclose(r.rmse, np.sqrt(np.mean((want - y) ** 2)))


def test_leave_one_out_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 2.0, 1.0)], "id long, f double, y double")
    assert model.loo_summary(model.leave_one_out(df.limit(0), "id", ["f"], "y", [1.0]), "id").count() == 0
    assert [r.pred for r in model.leave_one_out(df, "id", ["f"], "y", [1.0]).collect()] == [None] * 3
    assert [r.pred for r in model.leave_one_out(df.limit(1), "id", ["f"], "y", [1.0]).collect()] == [None]


def test_block_inversion_finds_the_shares():
    rng = np.random.default_rng(7)
    n, share, areas = rng.integers(0, 400, (30, 16)).astype(float), rng.uniform(0.01, 0.3, 16), np.full(16, 2500.0)
    t = n @ share
    scores = t / (0.2 * t + 0.2 * (n @ (1 - share)) + 0.8 * areas @ share / K.kernel_mass() + 1e-12)
    got = model.block_inversion(n, scores, areas, K.kernel_mass())
    assert np.allclose(got["share"], share, atol=2e-3) and got["rmse"] < 1e-6 and got["loo_corr"] > 0.99


def test_no_shared_folder_off_local_mode():
    from gridloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
