"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets exact counts (`measures`) and a few integer metrics. For every language and source, and every metric, a
mergeable quantile sketch is kept: counts per logarithmic bucket (16 buckets per power of two, so a quantile is off by at most
1/16; merging sketches adds counts, so the result depends on no order). Thresholds are far-out fences of the sketches'
quartiles; documents beyond a fence of their own language and source fail, as do those that fail the fixed base rules.

Defined results: null text has no words and fails the base; null languages and sources are groups of their own; a group's fence
never lies closer to the upper quartile than the metric's least spread, so uniform groups reject nobody; equal rows are judged
alike; an empty table gives an empty result; very long texts are measured whole, within their row; of the input only doc_id, text,
lang and source are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut

#: metric -> (expression in parts per million, least spread, fence in spreads above the upper quartile)
METRICS = {
    "symbols": ("CASE WHEN word_chars > 0 THEN (1000000 * n_symbols) DIV word_chars ELSE 0 END", 10_000, 5),
    "dup_lines": ("CASE WHEN n_lines > 0 THEN (1000000 * n_dup_lines) DIV n_lines ELSE 0 END", 100_000, 5),
    "word_length": ("CASE WHEN n_words > 0 THEN (100000 * word_chars) DIV n_words ELSE 0 END", 100_000, 8),
}
MIN_WORDS, MAX_REPEAT = 10, 20
WINDOW = 5

_WS = r"\x20\x09-\x0D"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the exact counts of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    trimmed = F.btrim("t", F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{_WS}]+")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{_WS}]")))
    counted = rows.select(
        "doc_id", "lang", "source", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # windows as hashes; only where two are equal, order them to find the repeated ones and the words they cover
    hashed = counted.withColumn("h", F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) ELSE cast(array() AS array<bigint>) END")).drop("w")
    ordered = hashed.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i))) END")).drop("h")
    placed = ordered.withColumn("p", F.expr("sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))")).drop("s")
    covered = F.expr(f"CASE WHEN p IS NULL THEN 0 ELSE aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least({WINDOW}, b - a)), {WINDOW}, (n, x) -> n + x) END")
    return placed.withColumn("n_repeat_words", covered.cast("long")).drop("p")


def bucket(v: str) -> str:
    """SQL for the sketch bucket of a count: exact below 32, then 16 buckets per power of two."""
    shift = f"greatest(0, length(bin({v})) - 5)"
    return f"{shift} * 16 + shiftright({v}, {shift})"


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.lit(0), F.floor((b - 16) / 16)).cast("int")
    return F.when(b < 32, b).otherwise((b - shift * 16 + 1) * F.pow(F.lit(2), shift).cast("long") - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the sketches; merge two by adding n."""
    each = F.array(*[F.expr(f"named_struct('metric', '{m}', 'v', cast({e} AS bigint))") for m, (e, _, _) in METRICS.items()])
    rows = measured.select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.metric", "x.v")
    return rows.groupBy("lang", "source", "metric", F.expr(bucket("v")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence for each metric: one row per group."""
    group = Window.partitionBy("lang", "source", "metric")
    below = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumn("below", below).withColumn("total", F.sum("n").over(group))
    quarter = lambda k: bucket_top(F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bucket"))))
    quartiles = ranked.groupBy("lang", "source", "metric").agg(quarter(1).alias("q1"), quarter(3).alias("q3"))
    of = {m: (spread, times) for m, (_, spread, times) in METRICS.items()}
    per = [F.max(F.when(F.col("metric") == m, F.col("q3") + times * F.greatest(F.lit(spread).cast("long"), F.col("q3") - F.col("q1")))).cast("long").alias(f"max_{m}") for m, (spread, times) in of.items()]
    return quartiles.groupBy("lang", "source").agg(*per)


def judge(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    measured = cut(measures(docs))
    limits = fences(sketches(measured)).withColumnRenamed("lang", "of_lang").withColumnRenamed("source", "of_source")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    within = F.expr(" AND ".join(f"coalesce(cast({e} AS bigint) <= max_{m}, true)" for m, (e, _, _) in METRICS.items()))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"))
