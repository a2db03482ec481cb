"""Fingerprints, agreement between artifacts, and the duplicate gate.

Supports are sparse tables (a, y, x, p): a names the artifact. Rows with p <= 0 or null are no part of a support.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles
from gridloom.functions.scalars import in_support, is_finite
from gridloom.operators.stats import average_ranks, binary_pearson, block_density, centroid, density_array, fraction_within, is_binary
from gridloom.session import cut
from gridloom.sources.grid import Grid, support_hash, value_hash

#: Fixed thresholds of the gate.
MAX_PEARSON, MAX_DICE, BOUND = 0.98, 0.95, 0.75


def supports(cells: DataFrame) -> DataFrame:
    return cells.where(in_support(F.col("p")))


def payloads(cells: DataFrame, free: DataFrame | None) -> DataFrame:
    """P5: the support outside the free mask."""
    s = supports(cells)
    return s if free is None else s.join(free.select("y", "x"), ["y", "x"], "left_anti")


def sample_sites(spark: SparkSession, grid: Grid, n: int = 8192, seed: int = 3400) -> DataFrame:
    """Site, y, x: the fixed sites at which fingerprints sample a grid; a rule of the grid's shape, n and the seed."""
    draw = np.random.RandomState(seed)
    ys, xs = draw.randint(0, grid.h, n), draw.randint(0, grid.w, n)
    return spark.createDataFrame([(k, int(y), int(x)) for k, (y, x) in enumerate(zip(ys, xs, strict=True))], "site int, y int, x int")


def fingerprint(cells: DataFrame, grid: Grid, sites: DataFrame | None = None) -> DataFrame:
    """Hashes, counts, range, block densities, centroid and (with sites: site, y, x) the sample of each artifact, rounded to 6 places."""
    s = supports(cells)
    p, finite = F.col("p").cast("double"), is_finite(F.col("p"))
    stats = cells.groupBy("a").agg(
        F.count_if(in_support(F.col("p"))).alias("n_positive"), F.count_if(finite).alias("n_finite"), F.min(F.when(finite, p)).alias("min"), F.max(F.when(finite, p)).alias("max"),
        is_binary(F.when(finite, p)).alias("is_binary"),
    )
    out = stats.join(value_hash(cells, "p", ["a"]), "a").join(support_hash(cells, "p", ["a"]), "a", "left")
    out = out.join(density_array(block_density(s, grid, 32, ("a",)), grid, 32, ("a",)), "a", "left").join(centroid(s, ("a",)), "a", "left")
    if sites is not None:
        names = cells.select("a").distinct()
        at = names.crossJoin(F.broadcast(sites)).join(cells.where(finite).select("a", "y", "x", "p"), ["a", "y", "x"], "left")  # sites: a fixed number
        one = F.struct("site", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("p"))
        sample = at.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["p"]).alias("sample"))
        out = out.join(sample.withColumn("sample_hash", F.sha2(F.array_join(F.col("sample").cast("array<string>"), ","), 256)), "a")
    return out


def ratio(top: Column, bottom: Column, empty: str = "null") -> Column:
    """top / bottom; without any cells null, or 1 in the strict mode."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(1.0) if empty == "one" else F.lit(None).cast("double"))


def agreement(a: DataFrame, b: DataFrame, empty: str = "null", prefix: str = "") -> DataFrame:
    """One row of counts, Dice, Jaccard and both containments of two supports (y, x)."""
    both = a.select("y", "x").join(b.select("y", "x"), ["y", "x"]).agg(F.count("*").alias("i"))
    counts = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb"))).crossJoin(both)  # single rows
    return counts.select(*_agreement_columns(F.col("na"), F.col("nb"), F.col("i"), empty, prefix))


def _agreement_columns(na: Column, nb: Column, i: Column, empty: str = "null", prefix: str = "") -> list[Column]:
    return [
        na.alias(f"{prefix}n_a"), nb.alias(f"{prefix}n_b"), i.alias(f"{prefix}intersection"), (na + nb - i).alias(f"{prefix}union"),
        ratio(2 * i, na + nb, empty).alias(f"{prefix}dice"), ratio(i, na + nb - i).alias(f"{prefix}jaccard"), ratio(i, na).alias(f"{prefix}a_in_b"), ratio(i, nb).alias(f"{prefix}b_in_a"),
    ]


def overlaps(cells: DataFrame) -> DataFrame:
    """Co-occurrence counts a < b of supports (a, y, x): cells that share a place are gathered once, then paired.

    The pairs of a place are at most the number of artifacts squared over two, which a registry bounds; the counts shrink before
    the shuffle.
    """
    left = cells.select("a", "y", "x")
    right = cells.select(F.col("a").alias("b"), "y", "x")
    return left.join(right, ["y", "x"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))


def pair_table(cells: DataFrame) -> DataFrame:
    """All pairs a < b of artifacts with their counts, also those that share nothing."""
    n = cells.groupBy("a").agg(F.count("*").alias("na"))
    other = n.select(F.col("a").alias("b"), F.col("na").alias("nb"))
    return n.join(other, F.col("a") < F.col("b")).join(overlaps(cells), ["a", "b"], "left").withColumn("i", F.coalesce("i", F.lit(0)))  # a row per artifact


def all_pairs(cells: DataFrame, grid: Grid) -> DataFrame:
    """Agreement and closed-form correlations of all pairs of supports, on the whole grid and on their union.

    The result has a row for each pair of artifacts, as a registry of some hundreds allows.
    """
    n = F.lit(grid.h * grid.w)
    p = pair_table(supports(cells))
    na, nb, i = (F.col(c).cast("double") for c in ("na", "nb", "i"))
    u = na + nb - i
    spread = na * (u - na) * nb * (u - nb)
    on_union = F.when((u > 8) & (na > 0) & (nb > 0), F.when((i == na) & (i == nb), F.lit(1.0)).when(spread > 0, (i * u - na * nb) / F.sqrt(spread)))
    return p.select("a", "b", *_agreement_columns(F.col("na"), F.col("nb"), F.col("i")), binary_pearson(n, F.col("na"), F.col("nb"), F.col("i")).alias("pearson"), on_union.alias("pearson_support"))


def containment_chain(cells: DataFrame, free: DataFrame, distances: DataFrame | None = None, least: float = 0.999) -> DataFrame:
    """Pairs of a support that is contained in a larger one at `least` or more, and what the larger adds.

    smaller, larger, n_smaller, n_larger, added, added_on_free, added_on_free_pct, added_charged, spared_charge, payload_smaller,
    payload_larger, payload_identical; with distances (y, x, dist) also the median distance of the added cells and the percentage of
    them within 3.
    """
    s = cut(supports(cells).select("a", "y", "x").join(free.select("y", "x", F.lit(1).alias("f")), ["y", "x"], "left").select("a", "y", "x", F.col("f").isNotNull().alias("f")))
    p = pair_table(s)
    both = p.select(F.col("a").alias("smaller"), F.col("b").alias("larger"), F.col("na").alias("n_smaller"), F.col("nb").alias("n_larger"), "i").union(p.select("b", "a", "nb", "na", "i"))
    held = cut(both.where((F.col("n_smaller") > 0) & (F.col("n_smaller") < F.col("n_larger")) & (F.col("i") >= F.lit(least) * F.col("n_smaller"))))
    # of the few pairs that are held, the cells of the larger with a mark where the smaller has them, too
    inner = s.select(F.col("a").alias("smaller"), "y", "x", F.lit(1).alias("hit"))
    rows = held.select("smaller", "larger").join(s.withColumnRenamed("a", "larger"), "larger").join(inner, ["smaller", "y", "x"], "left")
    added, on = F.col("hit").isNull(), F.col("f")
    got = rows.groupBy("smaller", "larger").agg(
        F.count_if(added).alias("added"), F.count_if(added & on).alias("added_on_free"), F.count_if(~on).alias("payload_larger"), F.count_if(~added & ~on).alias("payload_both"),
    )
    size = s.groupBy(F.col("a").alias("smaller")).agg(F.count_if(~F.col("f")).alias("payload_smaller"))
    out = held.drop("i").join(got, ["smaller", "larger"]).join(size, "smaller").where("added > 0")
    charged = F.col("added") - F.col("added_on_free")
    out = out.select(
        "smaller", "larger", "n_smaller", "n_larger", "added", "added_on_free", F.round(F.lit(100.0) * F.col("added_on_free") / F.col("added"), 2).alias("added_on_free_pct"),
        charged.alias("added_charged"), F.round(F.lit(0.2) * charged, 1).alias("spared_charge"), "payload_smaller", "payload_larger",
        ((F.col("payload_smaller") == F.col("payload_larger")) & (F.col("payload_both") == F.col("payload_larger"))).alias("payload_identical"),
    )
    if distances is None:
        return out
    far = rows.where(added).select("smaller", "larger", "y", "x").join(distances.select("y", "x", "dist"), ["y", "x"])
    near = far.groupBy("smaller", "larger").agg(F.round(F.lit(100.0) * fraction_within(F.col("dist"), 3), 2).alias("pct_added_within_3"))
    median = quantiles(far, "dist", [0.5], ("smaller", "larger")).select("smaller", "larger", F.round("q0", 2).alias("median_dist_added"))
    return out.join(near, ["smaller", "larger"], "left").join(median, ["smaller", "larger"], "left")


def _full_pearson(n: Column, su: Column, sw: Column, suu: Column, sww: Column, suw: Column) -> Column:
    """Pearson on a whole grid of n cells from the sums over the cells that are not 0; constant surfaces give 1 (both) or 0."""
    vu, vw = suu - su * su / n, sww - sw * sw / n
    return F.when((vu > 0) & (vw > 0), (suw - su * sw / n) / F.sqrt(vu * vw)).when((vu <= 0) & (vw <= 0), F.lit(1.0)).otherwise(F.lit(0.0))


def surface_correlation(a: DataFrame, b: DataFrame, grid: Grid, inside: DataFrame | None = None) -> DataFrame:
    """R2: full-grid, support-restricted Pearson and Spearman of two sparse surfaces (y, x, p); absent cells are 0.

    Zeros are never stored: the full-grid figures come from sums with n = h * w. Spearman is Pearson below 0.9 and for 0/1 surfaces,
    else that of average ranks. With a footprint (inside: y, x), cells outside it count as 0.
    """
    n = F.lit(float(grid.h * grid.w))
    if inside is not None:
        a, b = (s.join(inside.select("y", "x"), ["y", "x"], "left_semi") for s in (a, b))
    j = a.select("y", "x", F.col("p").cast("double").alias("u")).join(b.select("y", "x", F.col("p").cast("double").alias("w")), ["y", "x"], "full")
    j = cut(j.select("y", "x", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("w", F.lit(0.0)).alias("w")))
    sums = j.agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(c) for c, e in (("su", F.col("u")), ("sw", F.col("w")), ("suu", F.col("u") * F.col("u")), ("sww", F.col("w") * F.col("w")), ("suw", F.col("u") * F.col("w")))])
    full = _full_pearson(n, *[F.col(c) for c in ("su", "sw", "suu", "sww", "suw")])
    s = j.where("u > 0 or w > 0")
    part = s.agg(F.count("*").alias("n_support"), F.corr("u", "w").alias("r"), (is_binary(F.col("u")) & is_binary(F.col("w"))).alias("binary"))
    out = sums.select(full.alias("pearson_full")).crossJoin(part)
    first = out.first()
    r = F.when((F.col("n_support") > 8) & ~F.isnan("r"), F.col("r"))
    out = out.select("pearson_full", "n_support", r.alias("pearson_support"), "binary")
    if first["n_support"] > 8 and first["r"] is not None and first["r"] >= 0.9 and not first["binary"]:
        ranks = average_ranks(s, ["u", "w"], ["y", "x"]).agg(F.corr("r_u", "r_w").alias("spearman_support"))
        return out.crossJoin(ranks).drop("binary")
    return out.withColumn("spearman_support", F.col("pearson_support")).drop("binary")


def bound_prune(candidate_n: Column, entry_n: Column, scored: Column, duplicate: Column) -> Column:
    """Whether an entry needs the full comparison: its best possible Dice reaches BOUND, or it is scored or a duplicate."""
    best = F.lit(2.0) * F.least(candidate_n, entry_n) / F.greatest(candidate_n + entry_n, F.lit(1))
    return scored | duplicate | (best >= F.lit(BOUND))


def _compared(candidate: DataFrame, entries: DataFrame, grid: Grid, free: DataFrame | None, inside: DataFrame | None) -> DataFrame:
    """Counts and sums of the candidate (y, x, p) against each entry (a, y, x, p): one pass over the entries' cells.

    na, nb, i: supports and their intersection; fa, fb, fi: the same on the free mask; su .. suw: sums of values inside the footprint;
    binary: whether all values are 0 or 1.
    """
    flagged = lambda s: s.withColumn("f", F.lit(False) if free is None else F.col("f").isNotNull())
    with_free = lambda s: flagged(s if free is None else s.join(free.select("y", "x", F.lit(1).alias("f")), ["y", "x"], "left"))
    with_in = lambda s: s.withColumn("g", F.lit(True)) if inside is None else s.join(inside.select("y", "x", F.lit(1).alias("g")), ["y", "x"], "left").withColumn("g", F.col("g").isNotNull())
    c = cut(with_in(with_free(supports(candidate).select("y", "x", F.col("p").cast("double").alias("u")))))
    e = with_in(with_free(supports(entries).select("a", "y", "x", F.col("p").cast("double").alias("w"))))
    met = e.join(c.select("y", "x", "u"), ["y", "x"], "left")
    both = F.col("u").isNotNull()
    value = lambda x: F.coalesce(F.sum(F.when(F.col("g"), x)), F.lit(0.0))
    theirs = met.groupBy("a").agg(
        F.count("*").alias("nb"), F.count_if(both).alias("i"), F.count_if("f").alias("fb"), F.count_if(both & F.col("f")).alias("fi"), F.count_if(F.col("g")).alias("gb"), F.count_if(both & F.col("g")).alias("gi"),
        value(F.col("w")).alias("sw"), value(F.col("w") * F.col("w")).alias("sww"), value(F.col("u") * F.col("w")).alias("suw"), is_binary(F.col("w")).alias("binary"),
    )
    own = c.agg(F.count("*").alias("na"), F.count_if("f").alias("fa"), F.count_if("g").alias("ga"), value(F.col("u")).alias("su"), value(F.col("u") * F.col("u")).alias("suu"), is_binary(F.col("u")).alias("own_binary"))
    return theirs.crossJoin(own).withColumn("binary", F.col("binary") & F.col("own_binary")).drop("own_binary")  # own: a single row


def _spearman_by_entry(candidate: DataFrame, entries: DataFrame, inside: DataFrame | None) -> DataFrame:
    """a, spearman: correlation of average ranks on the union of the candidate's support and each entry's."""
    c, e = supports(candidate).select("y", "x", F.col("p").cast("double").alias("u")), supports(entries).select("a", "y", "x", F.col("p").cast("double").alias("w"))
    if inside is not None:
        c, e = (s.join(inside.select("y", "x"), ["y", "x"], "left_semi") for s in (c, e))
    mine = c.crossJoin(e.select("a").distinct())  # the candidate once for each of the few entries that come this far
    j = mine.join(e, ["a", "y", "x"], "full").select("a", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("w", F.lit(0.0)).alias("w"))
    for v in ("u", "w"):
        each = j.groupBy("a", v).agg(F.count("*").alias("c"))
        before = F.sum("c").over(Window.partitionBy("a").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        j = j.join(each.select("a", v, (before + (F.col("c") + 1) / F.lit(2.0)).alias(f"r_{v}")), ["a", v])
    return j.groupBy("a").agg(F.corr("r_u", "r_w").alias("spearman"))


def _names(hit: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(F.coalesce(hit, F.lit(False)), F.col("a"))))


def gate(candidate: DataFrame, registry: DataFrame, entries: DataFrame, grid: Grid, free: DataFrame | None = None, inside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Detail rows against each registry entry, and one verdict row.

    candidate: y, x, p. registry: a, score. entries: a, y, x, p of all entries. Entries that R6 leaves out have zeros for what was not
    compared. With a free mask the payload rule replaces the Dice rule, which then is reported and does not block.
    """
    c = candidate.withColumn("a", F.lit("candidate"))
    es = entries.withColumn("a", F.col("a").cast("string"))
    hashes = value_hash(es, "p", ["a"]).join(support_hash(es, "p", ["a"]), "a", "left")
    own = value_hash(c, "p", ["a"]).join(support_hash(c, "p", ["a"]), "a", "left").select(F.col("sha256_values").alias("cv"), F.col("sha256_support").alias("cs"))
    sizes = supports(es).groupBy("a").agg(F.count("*").alias("n_b"))
    n_a = supports(c).agg(F.count("*").alias("n_a"))
    rows = registry.select(F.col("a").cast("string").alias("a"), F.col("score").cast("double").alias("score")).join(hashes, "a", "left").join(sizes, "a", "left").crossJoin(own).crossJoin(n_a)
    rows = rows.select(
        "a", "score", "n_a", F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce(F.col("cv") == F.col("sha256_values"), F.lit(False)).alias("exact_duplicate"),
        F.coalesce(F.col("cs") == F.col("sha256_support"), F.lit(False)).alias("support_duplicate"),
    )
    duplicate = F.col("exact_duplicate") | F.col("support_duplicate")
    rows = cut(rows.withColumn("compared", bound_prune(F.col("n_a"), F.col("n_b"), F.col("score").isNotNull(), duplicate)))
    use = es.join(rows.where("compared").select("a"), "a", "left_semi")
    met = _compared(candidate, use, grid, free, inside)
    n = F.lit(float(grid.h * grid.w))
    u = F.col("ga") + F.col("gb") - F.col("gi")
    va, vb = F.col("suu") - F.col("su") * F.col("su") / u, F.col("sww") - F.col("sw") * F.col("sw") / u
    on_union = F.when((u > 8) & (va > u * 1e-24) & (vb > u * 1e-24), (F.col("suw") - F.col("su") * F.col("sw") / u) / F.sqrt(va * vb))
    full = _full_pearson(n, *[F.col(x) for x in ("su", "sw", "suu", "sww", "suw")])
    met = cut(met.withColumn("r_full", full).withColumn("r", on_union))
    ranked_ones = met.where((F.col("i") > 0) & (F.col("r") >= 0.9) & ~F.col("binary")).select("a")
    if ranked_ones.isEmpty():
        met = met.withColumn("rho", F.col("r"))
    else:
        met = met.join(_spearman_by_entry(candidate, use.join(ranked_ones, "a", "left_semi"), inside), "a", "left").withColumn("rho", F.coalesce("spearman", "r"))
    pa, pb, pi = F.col("na") - F.col("fa"), F.col("nb") - F.col("fb"), F.col("i") - F.col("fi")
    some = F.col("i") > 0
    known = met.select(
        "a", F.col("i").alias("intersection"), (F.col("na") + F.col("nb") - F.col("i")).alias("union"), ratio(2 * F.col("i"), F.col("na") + F.col("nb")).alias("dice"),
        ratio(F.col("i"), F.col("na") + F.col("nb") - F.col("i")).alias("jaccard"), ratio(F.col("i"), F.col("na")).alias("a_in_b"), ratio(F.col("i"), F.col("nb")).alias("b_in_a"),
        *[F.when(some, F.col(x)).otherwise(F.lit(0.0)).alias(name) for x, name in (("r_full", "pearson_full"), ("r", "pearson_support"), ("rho", "spearman_support"))],
        pa.alias("payload_a"), pb.alias("payload_b"), pi.alias("payload_intersection"), ratio(2 * pi, pa + pb).alias("payload_dice"), ratio(pi, pa + pb - pi).alias("payload_jaccard"),
        ratio(pi, pa).alias("payload_a_in_b"), ratio(pi, pb).alias("payload_b_in_a"),
    )
    own_payload = payloads(candidate, free).agg(F.count("*").alias("own_payload"))
    detail = rows.join(known, "a", "left").crossJoin(own_payload)
    blank = {"intersection": F.lit(0), "union": F.col("n_a") + F.col("n_b"), "payload_a": F.col("own_payload"), "payload_b": F.col("n_b"), "payload_intersection": F.lit(0)}
    left_out = ~F.col("compared")
    detail = detail.select(*rows.columns, *[F.when(left_out | F.col("intersection").isNull(), blank.get(x, F.lit(0.0))).otherwise(F.col(x)).alias(x) for x in known.columns if x != "a"])
    hit = {
        "duplicates": duplicate, "near_raw": F.col("pearson_support") >= MAX_PEARSON, "near_final": F.col("dice") >= MAX_DICE,
        "near_payload": F.lit(free is not None) & (F.col("payload_dice") >= MAX_DICE),
    }
    best = F.min(F.when(F.col("dice") > 0, F.struct((-F.col("dice")).alias("minus"), "a")))
    verdict = detail.agg(*[_names(v).alias(k) for k, v in hit.items()], F.max("dice").alias("max_dice"), best.alias("best"))
    blocks = {"exact/support_duplicate": F.size("duplicates") > 0, "near_duplicate_raw": F.size("near_raw") > 0, "near_duplicate_final": F.lit(free is None) & (F.size("near_final") > 0), "near_duplicate_payload": F.size("near_payload") > 0}
    rules = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in blocks.items()]))
    return detail, verdict.select(*hit, F.coalesce("max_dice", F.lit(0.0)).alias("max_dice"), F.col("best.a").alias("max_dice_against"), rules.alias("blocking_rules"), (F.size(rules) == 0).alias("allowed"))


def strict_pairs(candidate: DataFrame, entries: DataFrame, grid: Grid, free: DataFrame) -> DataFrame:
    """The candidate against each entry: whole-grid Pearson (null for a constant surface), Dice of supports and payloads (1 for two
    empty ones), containment, and the cells that the entry adds."""
    met = _compared(candidate, entries, grid, free, None)
    n = F.lit(float(grid.h * grid.w))
    vu, vw = F.col("suu") - F.col("su") * F.col("su") / n, F.col("sww") - F.col("sw") * F.col("sw") / n
    pearson = F.when((vu > 0) & (vw > 0), (F.col("suw") - F.col("su") * F.col("sw") / n) / F.sqrt(vu * vw))
    pa, pb, pi = F.col("na") - F.col("fa"), F.col("nb") - F.col("fb"), F.col("i") - F.col("fi")
    added, on = F.col("nb") - F.col("i"), F.col("fb") - F.col("fi")
    return met.select(
        F.col("a").cast("string").alias("a"), F.round(pearson, 6).alias("pearson_raw"), F.round(ratio(2 * F.col("i"), F.col("na") + F.col("nb"), "one"), 6).alias("dice_final"),
        F.round(ratio(2 * pi, pa + pb, "one"), 6).alias("dice_payload"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"), pa.alias("payload_a"), pb.alias("payload_b"),
        F.col("i").alias("intersection"), pi.alias("payload_intersection"), F.round(F.col("i") / F.greatest(F.col("na"), F.lit(1)), 6).alias("a_in_b"), added.alias("added"), on.alias("added_on_free"),
        F.round(F.lit(100.0) * on / F.greatest(added, F.lit(1)), 2).alias("added_on_free_pct"), ((pa == pb) & (pi == pa)).alias("payload_identical"),
    )


def strict_gate(candidate: DataFrame, entries: DataFrame, grid: Grid, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`strict_pairs`, and a verdict in which every rule blocks, with one more: an entry that has the very cells of the candidate."""
    rows = strict_pairs(candidate, entries, grid, free)
    hit = {
        "payload": F.col("dice_payload") >= MAX_DICE, "final": F.col("dice_final") >= MAX_DICE, "raw": F.col("pearson_raw") >= MAX_PEARSON,
        "subset": (F.col("added") == 0) & (F.col("a_in_b") == 1.0),
    }
    verdict = rows.agg(F.count("*").alias("n_compared"), F.max("dice_payload").alias("max_dice_payload"), F.max("dice_final").alias("max_dice_final"), *[_names(v).alias(k) for k, v in hit.items()])
    return rows, verdict.withColumn("allowed", sum((F.size(k) for k in hit), F.lit(0)) == 0)


#: The names of what may explain artifacts of one score.
MECHANISMS = {
    "few": "INSUFFICIENT EVIDENCE", "file": "LITERAL FILE REUSE (byte-identical artifacts)", "support": "SAME EMITTED PIXEL SET, DIFFERENT ENCODING",
    "placement": "PLACEMENT-STEP COLLAPSE (raw surfaces differ, final outputs agree)", "distinct": "DISTINCT ARTIFACTS", "free": "FREE-MASK SATURATION (metrically inert additions)",
}


def diagnose(registry: DataFrame, pairs: DataFrame, score: float, chain: DataFrame | None = None) -> DataFrame:
    """One row: why the artifacts of this score agree: mechanism, whether they collapse after the field, mean correlation and Dice.

    registry: a, score, sha256_values, sha256_support. pairs: a, b, pearson_support, dice (`all_pairs`). chain (`containment_chain`): if
    any pair in it has equal payloads and adds on the free mask only (99 % or more), that is the mechanism.
    """
    mine = registry.where(F.col("score") == F.lit(score)).select("a", "sha256_values", "sha256_support")
    who = mine.agg(F.count("*").alias("n"), F.count_distinct("sha256_values").alias("values"), F.count_distinct("sha256_support").alias("cells"))
    one, two = mine.select(F.col("a")), mine.select(F.col("a").alias("b"))
    met = pairs.join(one, "a", "left_semi").join(two, "b", "left_semi").agg(F.avg("pearson_support").alias("raw"), F.avg("dice").alias("dice"))
    free = chain.agg(F.coalesce(F.bool_or(F.col("payload_identical") & (F.col("added_on_free_pct") >= 99.0)), F.lit(False)).alias("free")) if chain is not None else None
    row = who.crossJoin(met)  # single rows
    row = row.crossJoin(free) if free is not None else row.withColumn("free", F.lit(False))
    kind = (
        F.when(F.col("free"), "free").when(F.col("n") < 2, "few").when(F.col("values") == 1, "file").when(F.col("cells") == 1, "support")
        .when((F.col("raw") < 0.9) & (F.col("dice") > 0.95), "placement").otherwise("distinct")
    )
    name = F.create_map(*[F.lit(x) for item in MECHANISMS.items() for x in item])[kind]
    return row.select("n", name.alias("mechanism"), kind.isin("free", "placement").alias("collapses"), "raw", "dice")


def saturation(base: DataFrame, others: DataFrame, grid: Grid, free: DataFrame) -> DataFrame:
    """The trio rule: whether every other artifact has the base's payload and adds on the free mask only (99.9 % or more)."""
    rows = strict_pairs(base, others, grid, free)
    all_ = F.coalesce(F.bool_and(F.col("payload_identical") & (F.col("added_on_free_pct") >= 99.9)), F.lit(True))
    return rows.agg(F.when(all_, F.lit("FREE-MASK SATURATION")).otherwise(F.lit("NOT REPRODUCED")).alias("mechanism"), F.count("*").alias("n"))


def registry_summary(cells: DataFrame, known: DataFrame, distances: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Each artifact's cells, percentage on the known mask and within 3 cells of it, and payload. distances: y, x, dist."""
    s = supports(cells).join(known.select("y", "x", F.lit(1).alias("k")), ["y", "x"], "left").join(distances, ["y", "x"], "left")
    free = known if free is None else free
    s = s.join(free.select("y", "x", F.lit(1).alias("f")), ["y", "x"], "left")
    pct = lambda c: F.lit(100.0) * F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    return s.groupBy("a").agg(F.count("*").alias("n_positive"), pct(F.col("k").isNotNull()).alias("pct_on_known"), pct(F.col("dist") <= 3).alias("pct_within_3"), F.count_if(F.col("f").isNull()).alias("payload"))


#: Length of the character runs by which names are looked up.
GRAM = 3


def holding(names: DataFrame, name: str, needles: DataFrame, needle: str, few: bool = False) -> DataFrame:
    """Rows of needles with those of names whose text holds the needle's: an equi-join on a run of characters, then the exact test.

    A name is listed under its runs of up to GRAM characters, a needle is looked up by its first ones (an empty needle under the empty
    run, which every name has). The list of runs is many times the size that the optimiser takes from the names' file, so it is not
    left to choose a broadcast by that: few needles (those of a call) go to the names, else the list is shuffled, and its size is known.
    """
    runs = [F.array(F.lit("")), *[_runs(name, k) for k in range(1, GRAM + 1)]]
    listed = names.withColumn("_run", F.explode(F.array_distinct(F.concat(*runs))))
    asked = needles.withColumn("_run", F.substring(needle, 1, GRAM))
    met = F.broadcast(asked).join(listed, "_run") if few else asked.join(listed.repartition("_run"), "_run")
    return met.where(F.contains(F.col(name), F.col(needle))).drop("_run")


def _runs(name: str, k: int) -> Column:
    """The runs of k characters of a name; none if it is shorter."""
    return F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - (k - 1)), lambda i: F.substring(F.col(name), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def resolve_names(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Each claim's file: its repository's files with the needle, else any file with it; the shortest name, then the first.

    ledger: claim, repo, needle; files: name. Claims without a file keep a null.
    """
    met = holding(files.select("name"), "name", ledger.select("claim", "repo", "needle"), "needle")
    tier = F.when(F.startswith(F.col("name"), F.concat(F.col("repo"), F.lit("__"))), 0).otherwise(1)
    best = met.groupBy("claim").agg(F.min(F.struct(tier.alias("tier"), F.length("name").alias("size"), F.col("name").alias("name"))).alias("best"))
    return ledger.join(best, "claim", "left").select("claim", "repo", "needle", F.col("best.name").alias("name"))


def classify_names(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The first rule (label, substring) that a name matches; null without one."""
    label = F.coalesce(*[F.when(F.contains(F.lower("name"), F.lit(sub.lower())), F.lit(lab)) for lab, sub in rules])
    return files.withColumn("label", label)


def first_match(names: DataFrame, wanted: list[str]) -> DataFrame:
    """For each wanted name the first of names (by position) that starts with it, or else holds it, whatever the case."""
    w = names.sparkSession.createDataFrame([(x, x.lower()) for x in wanted], "wanted string, low string")
    names = names.groupBy("name").agg(F.min("position").alias("position"))  # only the first of equal names can be the answer
    met = holding(names.select("name", "position", F.lower("name").alias("lower_name")), "lower_name", w, "low", few=True)
    tier = F.when(F.startswith("lower_name", "low"), 0).otherwise(1)
    best = met.groupBy("wanted").agg(F.min(F.struct(tier.alias("tier"), F.isnull("position").alias("last"), F.col("position").alias("position"), F.col("name").alias("name"))).alias("best"))
    return w.join(best, "wanted", "left").select("wanted", F.col("best.name").alias("name"))
