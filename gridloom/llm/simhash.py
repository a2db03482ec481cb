"""Near-duplicate classes by SimHash, joined through a segment-popcount embedding.

Fingerprints: 64 bits over the XXH64 (seed 42) of all word shingles. Two fingerprints link at MAX_BITS or fewer differing
bits. The join never compares all pairs:

* Embedding. Each fingerprint is cut into 32 segments of two bits; its vector holds the number of set bits of each segment.
  The Manhattan distance of two vectors is at most the Hamming distance of the fingerprints.
* Grid. The segments form b blocks (BLOCKS or more, see `choose_blocks`). Vectors at Manhattan distance 4 or less differ in at
  most 4 blocks, so they agree in b - 4 or more: every fingerprint goes to one grid cell for each choice of b - 4 blocks (35 tables
  for 7 blocks), its counts there being the cell's coordinates. Every linked pair meets in a cell, whatever b is.
* Lower bound. Within a cell, pairs whose vectors are more than 4 apart in Manhattan distance are left out: in unary (a count c as c
  low bits) the distance is the number of differing bits.
* Verification. The Hamming distance of the rest decides. A breadth-first search emits a spanning forest of the cell's links,
  never all its pairs.
* Hot cells. A cell with more than TILE fingerprints is cut into chunks, and each pair of chunks is searched by itself. Hot cells
  are found on a hash sample of the fingerprints, so the grid is shuffled once; the sample settles only how work is dealt out, never
  which pairs are compared.

Exact copies are merged before the join (one row per distinct fingerprint), and classes are found by label propagation with
pointer jumping over the links, each round cut by a reliable checkpoint.

Defined results: null and wordless texts have fingerprint zero and link like any other; rows with a null doc_id get a null
component unless their fingerprint links to rows that have one; repeated rows fall into one class; very long texts are hashed whole,
a bounded number of shingles at a time; an empty table gives an empty result; of the input only doc_id and text are read, and `dedup`
carries further columns of any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER_TABLE, cut, map_arrow, text_bytes

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCKS = 7
TILE = 50_000
#: One fingerprint in so many is looked at for hot cells.
SAMPLE = 64


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word k-shingles (the whole sequence where there are fewer words), in bounded pieces."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    for lo in range(0, len(words) - k + 1, 1 << 15):
        a = starts[lo : min(lo + (1 << 15), len(words) - k + 1)]
        b = ends[lo + k - 1 : lo + k - 1 + len(a)]
        yield np.frombuffer(b"".join([digest(line[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)]), ">u8")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, k) for t in text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The 32 counts of the two-bit segments, packed into one long in two bits each."""
    low, high = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    # two bits add up to their exclusive or, and carry their conjunction
    return fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Bits of the packed vector that belong to each block of segments, as signed longs."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def choose_blocks(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks that makes the least work for n fingerprints: more blocks mean more tables with smaller cells.

    Two fingerprints agree in a segment's count three times in eight; comparing a pair costs about a fiftieth of a table's row.
    """
    def work(blocks: int) -> float:
        return math.comb(blocks, max_bits) * (1 + n * 0.375 ** (32 * (blocks - max_bits) / blocks) / 50)

    return min(range(BLOCKS, 13), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(fps: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """A row (cell, fp, rep) for each table: the cell's coordinates are the counts of the chosen blocks."""
    masks = block_masks(blocks)
    v = F.col("v")
    keys = [F.xxhash64(F.lit(t), v.bitwiseAND(F.lit(_signed(sum(masks[i] for i in c))))) for t, c in enumerate(combinations(range(blocks), blocks - max_bits))]
    return fps.withColumn("v", popcounts(F.col("fp"))).select(F.explode(F.array(*keys)).alias("cell"), "fp", "rep")


def unary(fp: np.ndarray) -> np.ndarray:
    """The segment counts in unary: both bits of a segment in order, so that vectors' Manhattan distance is their number of differing bits."""
    low, high = fp & np.uint64(0x5555555555555555), (fp >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | ((low & high) << np.uint64(1))


def _near(a: np.ndarray, b, u: np.ndarray, v, max_bits: int) -> np.ndarray:
    """Places where fingerprints a and b link; u and v are their vectors, whose distance rules out most pairs first."""
    at = np.flatnonzero(np.bitwise_count(u ^ v) <= max_bits)
    b = b if np.ndim(b) == 0 else b[at]
    return at[np.bitwise_count(a[at] ^ b) <= max_bits]


def forest(fp: np.ndarray, rep: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) that connect what links in one cell: a breadth-first search over the unvisited rest."""
    out, rest_fp, rest_rep, rest_u = [], fp, rep, unary(fp)
    frontier: list[tuple[np.uint64, int, np.uint64]] = []
    while len(rest_fp):
        if frontier:
            x, r, u = frontier.pop()
        else:
            x, r, u, rest_fp, rest_rep, rest_u = rest_fp[0], rest_rep[0], rest_u[0], rest_fp[1:], rest_rep[1:], rest_u[1:]
        hit = _near(rest_fp, x, rest_u, u, max_bits)
        if len(hit):
            out.append((np.full(len(hit), r), rest_rep[hit]))
            frontier += list(zip(rest_fp[hit], rest_rep[hit], rest_u[hit], strict=True))
            left = np.ones(len(rest_fp), bool)
            left[hit] = False
            rest_fp, rest_rep, rest_u = rest_fp[left], rest_rep[left], rest_u[left]
    return out


def _links(max_bits: int):
    """Scans rows sorted by cell; small cells are compared by shifts, larger ones by `forest`."""

    def scan(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        size = np.diff(np.append(start, len(cell)))
        small, u = np.repeat(size <= 16, size), unary(fp)
        for k in range(1, min(16, int(size.max(initial=0)))):
            i = np.flatnonzero((cell[k:] == cell[:-k]) & small[k:])
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + k], u[i], u[i + k], max_bits)]
            yield rep[i], rep[i + k]
        for s, n in zip(start[size > 16], size[size > 16], strict=True):
            yield from forest(fp[s : s + n], rep[s : s + n], max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            got = list(scan(*(np.concatenate(x) for x in zip(*parts, strict=True)))) if parts else []
            a = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in got]) if got else np.zeros(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            cell, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "rep"))
            if not len(cell):
                continue
            other = np.flatnonzero(cell != cell[-1])
            last = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            fp = fp.view(np.uint64)
            held.append((cell[:last], fp[:last], rep[:last]))
            if last or (held[0][0].size and held[0][0][0] != cell[-1]):
                yield found(held)
                held = []
            held.append((cell[last:], fp[last:], rep[last:]))
        if held:
            yield found(held)

    return run


def links(fps: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Distinct links (a < b) between representatives that connect all fingerprints at max_bits or fewer; fps: fp, rep."""
    spark = fps.sparkSession
    grid = cells(fps, blocks, max_bits)
    some = cells(fps.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(sample)) == 0), blocks, max_bits)
    hot = some.groupBy("cell").agg((F.count("*") * sample).alias("n")).where(F.col("n") > tile)
    hot = cut(hot.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("chunks")))
    if not hot.isEmpty():  # each pair of a hot cell's chunks becomes a cell of its own
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        grid = (
            grid.join(hot, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(F.when(F.col("chunks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other"))).alias("cell"), "fp", "rep")
        )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.repartition(n, "cell").sortWithinPartitions("cell")
    return map_arrow(dealt, _links(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node that has a link. edges: a, b."""
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = cut(step.join(jump, step["new"] == jump["via"], "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def classes(docs: DataFrame, k: int = SHINGLE, blocks: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row; blocks by the number of distinct fingerprints unless given."""
    fps = cut(fingerprints(docs, k))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    blocks = blocks or choose_blocks(distinct.count(), max_bits)
    # nodes are the fingerprints: those without any doc_id link others too
    label = components(links(distinct.select("fp", F.col("fp").alias("rep")), blocks, max_bits))
    least = distinct.join(label, distinct["fp"] == label["node"]).groupBy("label").agg(F.min("rep").alias("least")).withColumnRenamed("label", "class")
    label = label.join(least, label["label"] == least["class"]).select("node", "least")
    named = distinct.join(label, distinct["fp"] == label["node"], "left").select(F.col("fp").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    return fps.join(named, fps["fp"] == named["of"], "left").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, the one whose doc_id is the class id; rows without a doc_id stay.

    Of several rows with the kept doc_id, the first by text (then by the other columns) stays: a least row, which partial aggregates
    find, so that no group of them is gathered.
    """
    found = cut(classes(docs))
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("keep_n")).withColumnRenamed("doc_id", "keep_id")
    keep = cut(keep)
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    mine = lambda k: docs.alias("d").join(k.alias("k"), F.col("d.doc_id") == F.col("k.keep_id")).select(*cols)
    kept = mine(keep.where("keep_n = 1")).union(docs.where(F.col("doc_id").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]))
    again = keep.where("keep_n > 1")
    if not again.isEmpty():
        order = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
        rows = mine(again).groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)])).alias("first_row"))
        kept = kept.union(rows.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"first_row.c{order.index(c)}").alias(c) for c in docs.columns]))
    return kept
