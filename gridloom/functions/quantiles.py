"""Exact quantiles of any number of rows, with bounded memory.

The built-in exact percentile keeps a count of every distinct value in one place. Here a mergeable sketch first gives, for each
wanted quantile, two values that enclose it closely; then rows below and above them are only counted, and just the values between
(a few thousandths of a percent of all) are ranked. Two scans of the rows, and results equal to linear interpolation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are off by at most one part in so many.
ACCURACY = 10_000


def quantiles(rows: DataFrame, v: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q0, q1, ...: each quantile of v (nulls left out) by linear interpolation; groups without values have no row.

    Without `by` there is one row always, of nulls where there are no values.
    """
    by = list(by)
    x = rows.select(*by, F.col(v).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 2.0 / ACCURACY
    ends = [e for q in qs for e in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = x.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(float(e)) for e in ends]), F.lit(ACCURACY)).alias("_e"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i, q in enumerate(qs)])
    sketch = sketch.where("_n > 0").select(*by, "_n", pairs.alias("_p"))
    met = x.join(sketch.select(*[F.col(c).alias(f"_{c}_of") for c in by], "_n", "_p"), [x[c].eqNullSafe(F.col(f"_{c}_of")) for c in by]) if by else x.crossJoin(F.broadcast(sketch))  # a single row
    each = met.select(*by, "_v", "_n", F.explode("_p").alias("_p"))
    zone = F.when(F.col("_v") < F.col("_p.lo"), -1).when(F.col("_v") > F.col("_p.hi"), 1).otherwise(0)
    each = each.select(*by, F.col("_p.i").alias("_i"), F.col("_p.q").alias("_q"), "_n", zone.alias("_z"), "_v")
    counted = each.groupBy(*by, "_i", "_q", "_n", "_z", F.when(F.col("_z") == 0, F.col("_v")).alias("_k")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    after = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_z", "_k").rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_q") * (F.col("_n") - 1)
    placed = counted.select("*", after.alias("_to"), place.alias("_at"), F.floor(place).alias("_f"))

    def value(rank):
        """The value of a rank, where this row holds it."""
        held = (rank >= F.col("_to") - F.col("_c")) & (rank < F.col("_to"))
        return F.max(F.when((F.col("_z") == 0) & held, F.col("_k")).when((F.col("_z") == -1) & (rank == F.col("_to") - 1), F.col("_hi")).when((F.col("_z") == 1) & (rank == F.col("_to") - F.col("_c")), F.col("_lo")))

    found = placed.groupBy(*by, "_i").agg(value(F.col("_f")).alias("_a"), value(F.least(F.col("_f") + 1, F.col("_n") - 1)).alias("_b"), F.max(F.col("_at") - F.col("_f")).alias("_t"))
    found = found.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"q{i}") for i in range(len(qs))])


def column_quantiles(rows: DataFrame, columns: dict[str, object], qs: list[float]) -> DataFrame:
    """One row: <name>_q<i> of several columns at once; columns: name -> expression, null where a row does not count."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), e.cast("double").alias("v")) for n, e in columns.items()])).alias("s")).select("s.c", "s.v")
    got = quantiles(long, "v", qs, ("c",))
    return got.agg(*[F.max(F.when(F.col("c") == n, F.col(f"q{i}"))).alias(f"{n}_q{i}") for n in columns for i in range(len(qs))])
