"""Checking SQL for filters and fields, put together from common table expressions.

Every step is written from its definition on the whole grid: separable filters are joins with a table of targets, sources and
weights that holds the border rule, percentiles are DuckDB's own, thinning and components are recursive queries. Nothing here
follows how the operators work (tiles, halos, sketches, rounds).
"""

from __future__ import annotations

from gridloom.sources.grid import PX_SQL


class Sql:
    """Named steps of one query. Methods add steps and return their names; a field is a table y, x, v."""

    def __init__(self, known: str = "q <= 2", inside: str = "d >= 1"):
        self.steps: list[str] = []
        self.n = 0
        self.add(PX_SQL, "px")
        self.add("SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px", "gs")
        self.add("SELECT y, x FROM (SELECT unnest(range(h)) AS y FROM gs), (SELECT unnest(range(w)) AS x FROM gs)", "every")
        self.add(f"SELECT y, x FROM px WHERE {known}", "known")
        self.add(f"SELECT y, x, {inside} AS inside FROM px", "place")

    def add(self, body: str, name: str | None = None, recursive: bool = False) -> str:
        if name is None:
            self.n += 1
            name = f"t{self.n}"
        head = name if recursive else f"{name} AS MATERIALIZED"
        self.steps.append(f"{head} ({body})" if not recursive else f"{name.split('(')[0]}({name.split('(')[1]} AS ({body})")
        return name.split("(")[0]

    def sql(self, final: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.steps) + "\n" + final

    def field(self, name: str) -> str:
        """The whole query that returns a field at 6 places."""
        return self.sql(f"SELECT y, x, round(v, 6) AS v FROM {name}")

    # ------------------------------------------------------------ filters

    def band(self, expr: str, source: str = "px") -> str:
        return self.add(f"SELECT y, x, {expr} AS v FROM {source}")

    def dense(self, source: str, columns: tuple[str, ...] = ("v",)) -> str:
        """All cells of the grid; those that the source lacks are 0."""
        cols = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), 0.0e0) AS {c}" for c in columns)
        return self.add(f"SELECT e.y, e.x, {cols} FROM every e LEFT JOIN {source} s ON s.y = e.y AND s.x = e.x")

    def stored(self, source: str) -> str:
        return self.add(f"SELECT s.* FROM {source} s JOIN px ON px.y = s.y AND px.x = s.x")

    def axis(self, source: str, axis: str, taps: str, mode: str, columns: tuple[str, ...] = ("v",)) -> str:
        """A convolution along an axis: out[t] is the sum of k(o) in[t - o]; taps: SQL of a table o, k."""
        n = "h" if axis == "y" else "w"
        at = {
            "reflect": f"CASE WHEN ((i % (2 * n)) + 2 * n) % (2 * n) >= n THEN 2 * n - 1 - ((i % (2 * n)) + 2 * n) % (2 * n) ELSE ((i % (2 * n)) + 2 * n) % (2 * n) END",
            "nearest": "greatest(0, least(n - 1, i))", "constant": "i",
        }[mode]
        table = self.add(
            f"SELECT t, {at} AS s, sum(k) AS k FROM (SELECT t, n, t - o AS i, k FROM (SELECT unnest(range({n})) AS t, {n} AS n FROM gs), ({taps}))"
            + (" WHERE i BETWEEN 0 AND n - 1" if mode == "constant" else "") + " GROUP BY 1, 2"
        )
        other = "x" if axis == "y" else "y"
        cols = ", ".join(f"sum(s.{c} * m.k) AS {c}" for c in columns)
        return self.add(f"SELECT CAST(m.t AS INT) AS {axis}, s.{other}, {cols} FROM {source} s JOIN {table} m ON m.s = s.{axis} GROUP BY m.t, s.{other}")

    @staticmethod
    def taps(sigma: float, order: int = 0) -> str:
        r = int(4 * sigma + 0.5)
        factor = {0: "1.0e0", 1: f"(-o / {sigma**2!r}e0)", 2: f"(o * o / {sigma**4!r}e0 - 1.0e0 / {sigma**2!r}e0)"}[order]
        return f"SELECT o, g / sum(g) OVER () * {factor} AS k FROM (SELECT o, exp(-0.5e0 * pow(o / {float(sigma)!r}e0, 2)) AS g FROM (SELECT unnest(range(-{r}, {r + 1})) AS o))"

    def blur(self, source: str, sigma: float, mode: str = "reflect", orders: tuple[int, int] = (0, 0), columns: tuple[str, ...] = ("v",)) -> str:
        return self.axis(self.axis(source, "y", self.taps(sigma, orders[0]), mode, columns), "x", self.taps(sigma, orders[1]), mode, columns)

    def sobel(self, source: str) -> str:
        """gy, gx of a dense field, reflected at the edge."""
        d, s = "SELECT * FROM (VALUES (-1, 1.0e0), (1, -1.0e0)) u(o, k)", "SELECT * FROM (VALUES (-1, 1.0e0), (0, 2.0e0), (1, 1.0e0)) u(o, k)"
        gy = self.axis(self.axis(source, "y", d, "reflect"), "x", s, "reflect")
        gx = self.axis(self.axis(source, "y", s, "reflect"), "x", d, "reflect")
        return self.add(f"SELECT a.y, a.x, a.v AS gy, b.v AS gx FROM {gy} a JOIN {gx} b ON b.y = a.y AND b.x = a.x")

    def slopes(self, source: str) -> str:
        """gy, gx: central differences of a dense field, one-sided at the edge."""
        part = lambda a, b, c: f"CASE WHEN {a}.v IS NOT NULL AND {b}.v IS NOT NULL THEN ({b}.v - {a}.v) / 2.0e0 ELSE coalesce({b}.v - {c}.v, {c}.v - {a}.v, 0.0e0) END"
        near = lambda a, dy, dx: f"LEFT JOIN {source} {a} ON {a}.y = c.y + {dy} AND {a}.x = c.x + {dx}"
        return self.add(f"SELECT c.y, c.x, {part('u', 'd', 'c')} AS gy, {part('l', 'r', 'c')} AS gx FROM {source} c {near('u', -1, 0)} {near('d', 1, 0)} {near('l', 0, -1)} {near('r', 0, 1)}")

    def tensor(self, slopes: str, sigma: float, mode: str = "reflect") -> str:
        """a, b, c: the blurred products gx gx, gy gy and gx gy."""
        products = self.add(f"SELECT y, x, gx * gx AS a, gy * gy AS b, gx * gy AS c FROM {slopes}")
        return self.blur(products, sigma, mode, columns=("a", "b", "c"))

    # ------------------------------------------------------------ scales

    def scale(self, source: str, strided: bool = False) -> str:
        """Clipped to the 1st and 99th percentile, of every eighth row and column or of all cells, and scaled."""
        where, margin = (" WHERE y % 8 = 0 AND x % 8 = 0", "1.0e-7") if strided else ("", "0.0e0")
        ends = self.add(f"SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {source}{where}")
        return self.add(f"SELECT y, x, CASE WHEN hi <= lo + {margin} THEN 0.0e0 ELSE least(greatest((v - lo) / (hi - lo), 0.0e0), 1.0e0) END AS v FROM {source}, {ends}")

    def rank(self, source: str, digits: int | None = None) -> str:
        """Ranks of inside cells, ties by the fixed draw and then by place, 0 outside."""
        v = "v" if digits is None else f"round(v, {digits})"
        draw = "(CAST(s.y AS BIGINT) * 7919 + CAST(s.x AS BIGINT) * 104729) % 1000003"
        ranks = self.add(
            f"SELECT s.y, s.x, (row_number() OVER (ORDER BY {v}, {draw}, s.y, s.x) - 1) / CAST(greatest(count(*) OVER () - 1, 1) AS DOUBLE) AS z"
            f" FROM {source} s JOIN place p ON p.y = s.y AND p.x = s.x WHERE p.inside"
        )
        return self.add(f"SELECT p.y, p.x, coalesce(r.z, 0.0e0) AS v FROM place p LEFT JOIN {ranks} r ON r.y = p.y AND r.x = p.x")

    def combine(self, expr: str, **fields: str) -> str:
        """An expression over several fields' values, by their letters."""
        names = list(fields)
        joins = " ".join(f"JOIN {fields[n]} {n} ON {n}.y = {names[0]}.y AND {n}.x = {names[0]}.x" for n in names[1:])
        for n in names:
            expr = expr.replace(f"@{n}@", f"{n}.v")
        return self.add(f"SELECT {names[0]}.y, {names[0]}.x, {expr} AS v FROM {fields[names[0]]} {names[0]} {joins}")

    def composite(self, *fields: str) -> str:
        scaled = {f"f{k}": self.scale(f, True) for k, f in enumerate(fields)}
        return self.scale(self.combine(" + ".join(f"1.0e0 * @{n}@" for n in scaled), **scaled), True)

    # ------------------------------------------------------------ F10-F15, F20

    def gaussian(self, source: str, sigma: float) -> str:
        return self.stored(self.blur(self.dense(source), sigma))

    def detrend(self, source: str, sigma: float) -> str:
        wide = self.blur(self.dense(source), sigma, "nearest")
        return self.add(f"SELECT s.y, s.x, s.v - b.v AS v FROM {source} s JOIN {wide} b ON b.y = s.y AND b.x = s.x")

    def coherence(self, source: str, sigmas: tuple[float, ...] = (1.5, 3.0, 6.0)) -> str:
        dense, parts = self.dense(source), {}
        for k, s in enumerate(sigmas):
            t = self.tensor(self.slopes(self.blur(dense, s * 0.5, "nearest")), s, "nearest")
            parts[f"f{k}"] = self.add(f"SELECT y, x, sqrt(greatest((a - b) * (a - b) + 4 * c * c, 0.0e0)) / greatest(a + b, 1.0e-9) AS v FROM {t}")
        return self.stored(self.combine("greatest(0.0e0, " + ", ".join(f"@{n}@" for n in parts) + ")", **parts))

    def energy(self, source: str, sigma: float) -> str:
        t = self.tensor(self.sobel(self.dense(source)), sigma)
        return self.stored(self.add(f"SELECT y, x, sqrt(greatest((a - b) * (a - b) + 4 * c * c, 0.0e0)) AS v FROM {t}"))

    def anisotropy(self, source: str, *sigmas: float) -> str:
        """The largest over several scales."""
        parts = {f"f{k}": self.scale(self.energy(source, s)) for k, s in enumerate(sigmas)}
        return self.combine(f"greatest({', '.join(f'@{n}@' for n in parts)})", **parts) if len(parts) > 1 else parts["f0"]

    def lineament(self, source: str, sigma: float = 2.0) -> str:
        return self.scale(self.energy(self.scale(source, True), sigma), True)

    def lineament_energy(self, bands: dict[str, tuple[str, float]]) -> str:
        """bands: name -> (expression, weight)."""
        parts = {n: self.lineament(self.band(e)) for n, (e, _) in bands.items()}
        return self.scale(self.combine(" + ".join(f"{float(w)!r}e0 * @{n}@" for n, (_, w) in bands.items()), **parts), True)

    def ridge(self, source: str, sigmas: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0)) -> str:
        dense, parts = self.dense(source), {}
        for k, s in enumerate(sigmas):
            yy, xy, xx = (self.blur(dense, s, "nearest", o) for o in ((2, 0), (1, 1), (0, 2)))
            expr = f"{float(s * s)!r}e0 * (abs(0.5e0 * (@xx@ + @yy@)) + 0.5e0 * sqrt((@xx@ - @yy@) * (@xx@ - @yy@) + 4 * @xy@ * @xy@))"
            parts[f"f{k}"] = self.combine(expr, yy=yy, xy=xy, xx=xx)
        return self.stored(self.combine("greatest(0.0e0, " + ", ".join(f"@{n}@" for n in parts) + ")", **parts))

    def step_edge(self, source: str, *sigmas: float) -> str:
        parts = {}
        for k, s in enumerate(sigmas):
            g = self.sobel(self.blur(self.dense(source), s))
            parts[f"f{k}"] = self.scale(self.stored(self.add(f"SELECT y, x, sqrt(gy * gy + gx * gx) AS v FROM {g}")))
        return self.combine(f"greatest({', '.join(f'@{n}@' for n in parts)})", **parts) if len(parts) > 1 else parts["f0"]

    # ------------------------------------------------------------ traces

    def skeleton(self, mask: str, passes: int = 24) -> str:
        """Two-pass thinning; `passes` half rounds, more than any mask here needs."""
        ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        offsets = self.add("SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(ring)) + ") u(k, dy, dx)")
        p = [f"((code >> {k}) & 1)" for k in range(8)]
        runs = " + ".join(f"(CASE WHEN {p[k]} = 0 AND {p[(k + 1) % 8]} = 1 THEN 1 ELSE 0 END)" for k in range(8))
        n, e, s, w = p[0], p[2], p[4], p[6]
        first, second = f"{n} * {e} * {s} = 0 AND {e} * {s} * {w} = 0", f"{n} * {e} * {w} = 0 AND {n} * {s} * {w} = 0"
        goes = f"({' + '.join(p)}) BETWEEN 2 AND 6 AND ({runs}) = 1 AND CASE WHEN step % 2 = 0 THEN {first} ELSE {second} END"
        self.n += 1
        name = f"t{self.n}"
        self.add(
            f"SELECT 0, y, x FROM {mask} UNION ALL SELECT step + 1, y, x FROM (SELECT a.step, a.y, a.x, CAST(sum(CASE WHEN b.y IS NULL THEN 0 ELSE 1 << o.k END) AS INT) AS code"
            f" FROM {name} a CROSS JOIN {offsets} o LEFT JOIN {name} b ON b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY 1, 2, 3) WHERE step < {passes} AND NOT ({goes})",
            f"{name}(step, y, x)", recursive=True,
        )
        return self.add(f"SELECT y, x FROM {name} WHERE step = {passes}")

    def strike(self, mask: str, sigma: float = 5.0, tangent: bool = False) -> str:
        ones = self.add(f"SELECT y, x, 1.0e0 AS v FROM {mask}")
        t = self.tensor(self.sobel(self.dense(ones)), sigma)
        theta = self.add(f"SELECT t.y, t.x, 0.5e0 * atan2(2 * (round(c, 12) + 0.0e0), (round(a, 12) + 0.0e0) - (round(b, 12) + 0.0e0) + 0.0e0) AS o FROM {t} t JOIN {mask} m ON m.y = t.y AND m.x = t.x")
        return self.add(f"SELECT y, x, cos(o) AS c, {'-' if tangent else ''}sin(o) AS s FROM {theta}")

    def tips(self, mask: str) -> str:
        return self.add(f"SELECT a.y, a.x FROM {mask} a JOIN {mask} b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY 1, 2 HAVING count(*) = 1")

    def ends(self, mask: str, tangent: bool = False) -> str:
        return self.add(f"SELECT s.* FROM {self.strike(mask, tangent=tangent)} s JOIN {self.tips(mask)} t ON t.y = s.y AND t.x = s.x")

    def rays(self, ends: str, length: int) -> str:
        return self.add(
            f"SELECT DISTINCT CAST(round_even(y + c * t, 0) AS INT) AS y, CAST(round_even(x + s * t, 0) AS INT) AS x FROM {ends}, range(1, {length + 1}) r(t), gs"
            " WHERE (c <> 0 OR s <> 0) AND round_even(y + c * t, 0) BETWEEN 0 AND h - 1 AND round_even(x + s * t, 0) BETWEEN 0 AND w - 1"
        )

    def bridges(self, ends: str, gap: int, both_ways: bool = False) -> str:
        ab = "abs" if both_ways else ""
        pairs = self.add(
            f"SELECT a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx, a.c AS ac, a.s AS as_, b.c AS bc, b.s AS bs, sqrt(CAST((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE)) AS r"
            f" FROM {ends} a JOIN {ends} b ON b.y BETWEEN a.y - {gap} AND a.y + {gap} AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {gap * gap} AND (a.y < b.y OR (a.y = b.y AND a.x < b.x))"
        )
        ok = self.add(
            f"SELECT *, CAST(ceil(r) AS INT) AS n FROM {pairs} WHERE {ab}(ac * ((by_ - ay) / r) + as_ * ((bx - ax) / r)) >= cos(radians(35.0e0))"
            f" AND {ab}(-(bc * ((by_ - ay) / r) + bs * ((bx - ax) / r))) >= cos(radians(35.0e0))"
        )
        return self.add(
            "SELECT DISTINCT y, x FROM (SELECT CAST(round_even(ay + (by_ - ay) * (i / CAST(n AS DOUBLE)), 0) AS INT) AS y, CAST(round_even(ax + (bx - ax) * (i / CAST(n AS DOUBLE)), 0) AS INT) AS x"
            f" FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM {ok})), gs WHERE y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1"
        )

    def minus(self, cells: str, other: str) -> str:
        return self.add(f"SELECT a.y, a.x FROM {cells} a LEFT JOIN {other} b ON b.y = a.y AND b.x = a.x WHERE b.y IS NULL")

    def large(self, mask: str, least: int) -> str:
        """Cells of 4-connected components of so many cells."""
        self.n += 1
        name = f"t{self.n}"
        self.add(
            f"SELECT y, x, y, x FROM {mask} UNION SELECT r.y, r.x, n.y, n.x FROM {name} r JOIN {mask} n ON n.y BETWEEN r.ry - 1 AND r.ry + 1 AND n.x BETWEEN r.rx - 1 AND r.rx + 1"
            " AND abs(n.y - r.ry) + abs(n.x - r.rx) <= 1", f"{name}(y, x, ry, rx)", recursive=True,
        )
        return self.add(f"SELECT y, x FROM {name} GROUP BY 1, 2 HAVING count(*) >= {least}")  # each cell reaches its whole component

    def strands(self, trace: str, offsets: tuple[int, ...], least: int) -> str:
        moved = self.add(
            f"SELECT DISTINCT y, x FROM (SELECT CAST(round_even(y - o * s, 0) AS INT) AS y, CAST(round_even(x + o * c, 0) AS INT) AS x FROM {trace}, (SELECT unnest([{', '.join(f'{k}, {-k}' for k in offsets)}]) AS o)), gs"
            " WHERE y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1"
        )
        return self.large(self.minus(moved, "known"), least)

    def blurred(self, cells: str, sigma: float = 2.0, mode: str = "reflect") -> str:
        ones = self.add(f"SELECT y, x, 1.0e0 AS v FROM {cells}")
        return self.stored(self.blur(self.dense(ones), sigma, mode))

    # ------------------------------------------------------------ F16-F19

    def distance(self) -> str:
        return self.add("SELECT px.y, px.x, min(sqrt(CAST((px.y - t.y) * (px.y - t.y) + (px.x - t.x) * (px.x - t.x) AS DOUBLE))) AS v FROM px, known t GROUP BY 1, 2")

    def shell(self, sigma: float) -> str:
        return self.add(f"SELECT y, x, CASE WHEN v > 0 THEN exp(-pow(v / {sigma!r}e0, 2)) ELSE 0.0e0 END AS v FROM {self.distance()}")

    def tip_extension(self, length: int = 14) -> str:
        return self.blurred(self.minus(self.rays(self.ends(self.skeleton("known")), length), "known"))

    def gap_linkage(self, gap: int = 16, tangent: bool = False) -> str:
        return self.blurred(self.minus(self.bridges(self.ends(self.skeleton("known"), tangent), gap, tangent), "known"))

    def parallel_field(self, offsets: tuple[int, ...] = (4, 6, 9), least: int = 25) -> str:
        return self.blurred(self.strands(self.strike(self.skeleton("known")), offsets, least))

    # ------------------------------------------------------------ F24, F27

    def basin_step(self, bands: dict[str, str]) -> str:
        step = self.step_edge(self.band(bands["tc"]), 1.5, 3.0, 6.0)
        parts = {"m": self.anisotropy(self.band(bands["tmi_hg"]), 2.0), "v": self.anisotropy(self.band(bands["tmi_vg"]), 2.0), "g": self.anisotropy(self.band(bands["iso_grav_anom_hg"]), 2.0)}
        fill = {"d": self.scale(self.band(bands["depth_to_base_surf"])), "c": self.scale(self.band(bands["cond_surf"]))}
        expr = "cbrt(@s@ * @s@ * sqrt(greatest(greatest(@m@, @v@) * @g@, 0.0e0))) * (0.25e0 + 0.75e0 * (0.5e0 * @d@ + 0.5e0 * @c@))"
        return self.scale(self.combine(expr, s=step, **parts, **fill))

    def curvature(self, bands: dict[str, str]) -> str:
        return self.anisotropy(self.band(bands["det_elev"]), 1.5, 3.0, 6.0)

    def mix(self, a: str, wa: float, b: str, wb: float) -> str:
        return self.scale(self.combine(f"{wa!r}e0 * @a@ + {wb!r}e0 * @b@", a=self.scale(a), b=self.scale(b)))

    def masked(self, source: str) -> str:
        return self.add(f"SELECT s.y, s.x, CASE WHEN p.inside AND k.y IS NULL THEN s.v ELSE 0.0e0 END AS v FROM {source} s JOIN place p ON p.y = s.y AND p.x = s.x LEFT JOIN known k ON k.y = s.y AND k.x = s.x")
