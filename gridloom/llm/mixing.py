"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's size, and the excess is shared again by weight until none is above (`targets`).

Quotas. Documents are dealt into shards by a seeded hash. Within a shard, a source's documents stand in seeded hash order and
their words form blocks of BLOCK words each. The shard's seats (its share of the targets, in blocks) go to its sources by
highest quotients v / (2 k + 1), at most two per block (`apportion`).

Selection. A quota of q seats over b blocks takes every block q div b times, and q mod b further blocks: a run that starts at
a seeded block and wraps around, in the seeded document order. What a document gives is the overlap of its words with the
taken blocks, so it never gives more than twice its size, and no block is ever made a row.

Nothing depends on partitioning: reruns agree. Shards are sized by the number of documents, so a source with a third of all
rows is spread over all of them, and a shard has no more sources than documents; sources stay a table, however many there are.

Defined results: null, empty and wordless texts have size 0 and give 0 words; a source of size 0 has target 0; ties in the hash
order go to the smaller doc_id, then to the smaller size and text hash (null doc_ids are spread by the text hash); very long texts
are counted and cut whole; an empty table gives an empty result; `mix` carries further columns of any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, map_arrow, ship_package
from gridloom.sources.grid import ranked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 16
SEED = 20_240_501
DOCS_PER_SHARD = 20_000
MIN_SHARDS = 256

#: Sources in one partition of the table of sources.
SOURCES_PER_PART = 100_000
#: Rows whose texts are cut at a time.
ROWS = 512

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> dict[str | None, float]:
    """Each source's target words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        capped = [s for s in names if s in free and left * weight[s] / total >= repeat * sizes[s]]
        if not capped:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in capped:
            out[s] = float(repeat * sizes[s])
        free -= set(capped)
        left = max(0.0, left - sum(out[s] for s in capped))
    return out


def apportion(votes: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague seats: the highest quotients votes / (2 k + 1), at most limits each; ties go to the earlier party."""
    seats = min(int(seats), int(limits.sum()))
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    lo, hi = 0.0, float(2 * votes.max() + 1)  # a divisor: a party has as many seats as quotients v / (2k + 1) reach it
    given = lambda d: np.minimum(limits, np.floor((votes / max(d, 1e-300) + 1) / 2)).astype(np.int64)
    for _ in range(200):
        mid = (lo + hi) / 2
        if given(mid).sum() >= seats:
            lo = mid
        else:
            hi = mid
    got = given(hi)
    while got.sum() < seats:
        quotient = np.where(got < limits, votes / (2 * got + 1), -1.0)
        best = int(np.argmax(quotient))
        if quotient[best] <= 0:
            break
        got[best] += 1
    return got


def taken_words(lo: Column, hi: Column, size: Column, quota: Column, start: Column, block: int) -> Column:
    """Words of [lo, hi) in the taken blocks of a cell of `size` words; see the module's text."""
    blocks = F.ceil(size / F.lit(block)).cast("long")
    extra, times = quota % blocks, F.floor(quota / blocks).cast("long")
    first = start * block
    end = first + extra * block  # may pass the last block; then it goes on from the first
    wrapped = F.greatest(F.lit(0).cast("long"), (start + extra - blocks) * block)
    upto = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(hi, b) - F.greatest(lo, a))
    return F.when(blocks > 0, times * (hi - lo) + upto(first, F.least(end, size)) + upto(F.lit(0).cast("long"), wrapped)).otherwise(F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target of a table (source, source_size), as `targets` gives them, for any number of sources.

    A source gets its weight times a level, or stops at its limit. The level that uses up the share rises from round to round, each
    an aggregate over the sources, as the excess of those that stop is spread over the rest.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(repeat))
    parts = max(1, -(-sizes.count() // SOURCES_PER_PART))
    rows = cut(ranked(sizes, F.col("source").asc_nulls_last(), name="nth", partitions=parts).select("source", "source_size", weight.alias("weight")))
    whole = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * whole[0] / whole[1] if whole[1] else 0.0
    while whole[1]:
        free = F.col("weight") * F.lit(level) < limit
        r = rows.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, limit))).first()
        new = max(0.0, share * whole[0] - (r[1] or 0.0)) / r[0] if r[0] else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, key (a hash of the text), and the row's word interval lo, hi with its cell's size, quota, start."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("key")))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    shards = max(MIN_SHARDS, 2 ** math.ceil(math.log2(max(1, (sizes.agg(F.sum("n")).first()[0] or 0) / DOCS_PER_SHARD))))
    known = source_targets(sizes.select("source", "source_size")).withColumnRenamed("source", "of")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "key")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))

    cell = rows.groupBy("shard", "source").agg(F.sum("size").alias("cell_size"))
    cell = cell.join(known, cell["source"].eqNullSafe(known["of"])).drop("of")

    def seats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        size = pdf["cell_size"].to_numpy(np.int64)
        blocks = -(-size // block)  # the last one may be short: votes are in blocks of the cell's mean length
        votes = np.where(pdf["source_size"] > 0, pdf["target"] * blocks / np.maximum(pdf["source_size"], 1), 0.0)
        pdf["quota"] = apportion(votes, REPEAT * blocks, round(float(votes.sum())))
        return pdf

    quotas = cell.groupBy("shard").applyInPandas(seats, "shard int, source string, cell_size long, source_size long, target double, quota long")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("cell_size") / F.lit(block)).cast("long"))
    quotas = cut(quotas.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 1), "shard", "source"), blocks)))

    order = Window.partitionBy("shard", "source").orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("hi", F.sum("size").over(order)).withColumn("lo", F.col("hi") - F.col("size"))
    q = quotas.select(F.col("shard").alias("q_shard"), F.col("source").alias("q_source"), "cell_size", "source_size", "target", "quota", "start")
    joined = placed.join(q, (placed["shard"] == q["q_shard"]) & placed["source"].eqNullSafe(q["q_source"]))
    taken = taken_words(F.col("lo"), F.col("hi"), F.col("cell_size"), F.col("quota"), F.col("start"), block)
    return joined.withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", "key", "lo", "hi", "cell_size", "quota", "start")


def pieces(lo: int, hi: int, size: int, quota: int, start: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """Word intervals, relative to the document, that the mix takes of it; whole copies first."""
    blocks = -(-size // block)
    if not blocks or hi <= lo:
        return []
    out = [(0, hi - lo)] * (quota // blocks)
    extra = quota % blocks
    for a, b in ((start * block, min((start + extra) * block, size)), (0, max(0, (start + extra - blocks) * block))):
        if max(lo, a) < min(hi, b):
            out.append((max(lo, a) - lo, min(hi, b) - lo))
    return out


def cut_words(text: str, a: int, b: int) -> str:
    """Words a to b of the text, with the white space between them; the whole text where all words are taken."""
    if a == 0 and b == len(text.encode().split()):
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    return text[spans[a][0] : spans[b - 1][1]]


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each taken run of a document's words (twice for two copies).

    Rows of equal doc_id, size, source and text hash share a place in the order; they are numbered, by text and then the other
    columns, before those that give nothing are left out, and each takes what the plan says for its number.
    """
    cols = docs.columns
    same = Window.partitionBy("doc_id", "size", "source", "key").orderBy("lo")
    planned = plan(docs).where("size > 0").withColumn("nth", F.row_number().over(same))
    planned = cut(planned.select("taken", *[F.col(c).alias(f"m_{c}") for c in ("doc_id", "size", "source", "key", "nth", "lo", "hi", "cell_size", "quota", "start")]))
    twins = not planned.where("m_nth > 1").isEmpty()
    planned = planned.where("taken > 0").drop("taken")
    left = docs.select(*[F.col(f"`{c}`").alias(f"d_{k}") for k, c in enumerate(cols)])
    doc_id, text = F.col(f"d_{cols.index('doc_id')}").cast("long"), F.col(f"d_{cols.index('text')}").cast("string")
    source = F.col(f"d_{cols.index('source')}").cast("string")
    left = left.withColumn("m_size_here", word_count(text)).withColumn("m_key_here", F.xxhash64(text))
    on = doc_id.eqNullSafe(F.col("m_doc_id")) & (F.col("m_size_here") == F.col("m_size")) & source.eqNullSafe(F.col("m_source")) & (F.col("m_key_here") == F.col("m_key"))
    if twins:
        left = left.withColumn("m_nth_here", F.row_number().over(Window.partitionBy(doc_id, "m_size_here", source, "m_key_here").orderBy(text, *[f"d_{k}" for k in range(len(cols))])))
        on = on & (F.col("m_nth_here") == F.col("m_nth"))
    joined = left.join(planned, on).drop("m_size_here", "m_key_here", "m_nth_here", "m_doc_id", "m_size", "m_source", "m_key", "m_nth")
    kept = [f"d_{k}" for k in range(len(cols))]
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for from_ in range(0, whole.num_rows, ROWS):
                batch = whole.slice(from_, ROWS)
                place = zip(*(batch.column(f"m_{c}").to_pylist() for c in ("lo", "hi", "cell_size", "quota", "start")), strict=True)
                index, texts = [], []
                for k, (text, p) in enumerate(zip(batch.column(f"d_{at}").to_pylist(), place, strict=True)):
                    for a, b in pieces(*p):
                        index.append(k)
                        texts.append(cut_words(text or "", a, b))
                rows = batch.take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(f"d_{at}").type) if c == f"d_{at}" else rows.column(c) for c in kept], names=kept)

    schema = joined.select(*kept).schema
    return map_arrow(joined, run, schema).select(*[F.col(f"d_{k}").alias(c) for k, c in enumerate(cols)])
