"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark item (an item with fewer words, but not none, is one
window). The searcher follows Wu and Manber: a shift table over blocks of two words says how far the cursor may jump
without missing an occurrence, blocks that end a pattern (shift 0) lead to a bucket, a prefix hash selects the patterns in
it, and a direct comparison confirms. Words rather than bytes are the symbols, so that a jump passes up to WINDOW - 1 words.

The benchmark never stands whole on the driver. It is cut on the executors into pieces of at most PIECE_WORDS words (pieces of one
item overlap by WINDOW - 1 words, so no window is lost), which are dealt by hash into blocks of about WORDS_PER_BLOCK words. Only one
block at a time is gathered and broadcast, so the bound holds for any benchmark; each worker compiles it once. A benchmark of one
block, as usual, takes one pass over the documents and no shuffle; a larger one takes a pass, cut by a checkpoint, for each block.

Defined results: a null or wordless text has no words, no hits and is not contaminated; an empty benchmark hits nothing; items are
told apart by their item_id as text, of whatever type; items with equal windows are all reported; items with a null item_id are
searched like any other and count together as one item, which has no entry in the item list; rows with equal doc_id are judged each
on its own text; very long texts are searched whole; an empty table gives an empty result; further columns of the input may have any
name (they are carried under a prefix).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM_TABLE, cut, map_arrow, text_bytes

WINDOW = 13
#: Benchmark words compiled into one searcher, on average; a larger benchmark is searched in several passes.
WORDS_PER_BLOCK = 2_000_000
#: Words of one piece of a benchmark item, at most (and WINDOW - 1 more).
PIECE_WORDS = 50_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


class WuManber:
    """Searcher for word patterns of one length m (blocks of min(2, m) words)."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for j in range(self.b, m + 1):  # block ends before word j
                key = p[j - 1] if self.b == 1 else (p[j - 2], p[j - 1])
                if (s := m - j) < self.shift.get(key, self.default):
                    self.shift[key] = s
            last = p[-1] if self.b == 1 else (p[-2], p[-1])
            self.buckets[last][hash(p[: self.b])].append((list(p), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str | None]]]:
        """(start, items) of every occurrence, by start."""
        m, default, get, n = self.m, self.default, self.shift.get, len(words)
        end = m - 1
        single = self.b == 1
        while end < n:
            key = words[end] if single else (words[end - 1], words[end])
            s = get(key, default)
            if s:
                end += s
                continue
            start = end - m + 1
            for p, items in self.buckets[key].get(hash(tuple(words[start : start + self.b])), ()):
                if words[start : end + 1] == p:
                    yield start, items
            end += 1


def compile_searchers(items: Iterable[tuple[str | None, bytes]]) -> list[WuManber]:
    """One searcher per pattern length: WINDOW, and any shorter whole items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        w = words_of(text)
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length[m][tuple(w[i : i + m])].add(item_id)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def find(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Merged [start, end) runs of hit words, and the items with an occurring window."""
    spans, items = [], set()
    for s in searchers:
        for start, found in s.search(words):
            items |= found
            spans.append((start, start + s.m))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text")), strict=True):
            w = words_of(text)
            parts = [w[k : k + PIECE_WORDS + WINDOW - 1] for k in range(0, max(1, len(w) - WINDOW + 1), PIECE_WORDS)] if w else []
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array([b" ".join(p).decode() for p in parts], pa.string()), pa.array([len(p) for p in parts], pa.int64())], names=["item", "words", "n"])


def pieces(benchmark: DataFrame) -> DataFrame:
    """item, words (joined by blanks) and n of every piece of every item that has words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _cut_items, "item string, words string, n long")


#: The searchers of the last block that this worker met.
_COMPILED: dict[str, list[WuManber]] = {}


def _pass(shared, key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = compile_searchers((item, words.encode()) for item, words in shared.value)
        searchers = _COMPILED[key]
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            had = [batch.column(c).to_pylist() for c in ("wm_from", "wm_to", "wm_items")]
            for k, text in enumerate(text_bytes(batch.column("text"))):
                w = words_of(text)
                spans, found = find(searchers, w)
                n_words.append(len(w))
                starts.append(had[0][k] + [a for a, _ in spans])
                ends.append(had[1][k] + [b for _, b in spans])
                items.append(sorted({*had[2][k], *found}, key=lambda x: (x is None, x or "")))
            new = {"wm_words": pa.array(n_words, pa.int64()), "wm_from": pa.array(starts, longs), "wm_to": pa.array(ends, longs), "wm_items": pa.array(items, strings)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """text, wm_words, wm_from, wm_to (runs of hit words, one list per benchmark block), wm_items, and keep_<c> of every kept column c."""
    spark = docs.sparkSession
    longs = F.array().cast("array<long>")
    kept = [F.col(f"`{c}`").alias(f"keep_{c}") for c in keep or [] if c != "text"]
    df = docs.select(F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("wm_words"), longs.alias("wm_from"), longs.alias("wm_to"), F.array().cast("array<string>").alias("wm_items"), *kept)
    cut_up = cut(pieces(benchmark))
    blocks = max(1, -(-(cut_up.agg(F.sum("n")).first()[0] or 0) // WORDS_PER_BLOCK))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for k in range(blocks):
        last = k == blocks - 1
        shared = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in cut_up.where(block == k).select("item", "words").collect()])  # about WORDS_PER_BLOCK words
        out = df.drop("text") if last and "text" not in (keep or []) else df
        df = map_arrow(df, _pass(shared, uuid.uuid4().hex, out.columns), out.schema)
        if not last:
            df = cut(df)
            shared.destroy()
    return df


def n_hit():
    """The number of distinct hit words over `scan`'s rows."""
    return F.expr(
        "aggregate(array_sort(arrays_zip(wm_from, wm_to)), named_struct('n', 0L, 'last', 0L), "
        "(acc, s) -> named_struct('n', acc.n + greatest(0L, s.wm_to - greatest(s.wm_from, acc.last)), 'last', greatest(acc.last, s.wm_to)), acc -> acc.n)"
    )


def contaminated(hit, words):
    """The contract's rule."""
    return (hit > 0) & (20 * hit >= words)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return (
        scan(docs, benchmark, ["doc_id"])
        .select(F.col("keep_doc_id").cast("long").alias("doc_id"), F.col("wm_words").alias("n_words"), n_hit().alias("n_hit"), F.col("wm_items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("wm_items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("wm_items"), ","), 256).alias("items_sha256"),
            contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    back = [F.col("text") if c == "text" else F.col(f"`keep_{c}`").alias(c) for c in docs.columns]
    return scan(docs, benchmark, docs.columns).where(~contaminated(n_hit(), F.col("wm_words"))).select(*back)
