"""A quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a fixed vector of statistics (`FEATURES`). Trees are grown on histograms of quantile bins with second-order
gains, and flattened into arrays; scoring walks all trees for a batch of rows at once with numpy. The trees are fitted on a
bounded sample of labelled rows (MAX_ROWS), chosen by a hash of the id among those outside the held-out fold.

Defined results: null and empty texts have all statistics 0 and are scored like any other; without labelled rows every score
is 0.5; rows with several labels are all used; repeated rows are scored alike; only the text column is read for a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, map_arrow, text_bytes

MAX_ROWS = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAF = 64, 80, 4, 0.15, 1.0, 20.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "same_as_last", "symbols", "pipes", "exclamations", "upper", "digits", "punctuation",
    "non_ascii", "line_bytes", "repeated_lines", "short_words", "long_words", "sentence_words", "words_with_symbol", "compressed",
)


def statistics(text: bytes) -> tuple[float, ...]:
    n = len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    without = lambda drop: (n - len(text.translate(None, drop))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (
        np.log1p(n), np.log1p(len(words)), float(sizes.sum()) / m, len(counts) / m, top / m, sum(map(bytes.__eq__, words[1:], words)) / m,
        without(b"#*$%&<>"), without(b"|"), without(b"!"), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b".,;:?"),
        without(_NON_ASCII), np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
        float((sizes <= 3).sum()) / m, float((sizes >= 12).sum()) / m, np.log1p(m / (text.count(b".") + 1)), sum(c for w, c in counts.items() if w[-1:] in _MARKS) / m,
        len(zlib.compress(text, 1)) / n,
    )


_NON_ASCII = bytes(range(128, 256))
_MARKS = {bytes([c]) for c in b"#*$%&|<>!"}


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """Trees of equal depth as arrays: node k of tree t splits on feature[t, k] at threshold[t, k]; leaves hold values."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost logistic loss; splits are found on histograms of at most BINS quantile bins a feature."""
    n, d = x.shape
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0 if not n else float(np.clip(8 * (2 * y[0] - 1), -8, 8)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(d) * BINS
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            hist = [np.bincount(key, weights=np.repeat(w, d), minlength=width * d * BINS).reshape(width, d, BINS) for w in (g, h)]
            gl, hl = np.cumsum(hist[0], axis=2), np.cumsum(hist[1], axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAF / 8) | (ht - hl < LEAF / 8)] = 0.0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0.0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = -rate * gs / (hs + L2)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), bias)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *[pa.array(x[:, j]) for j in range(len(FEATURES))]], names=["doc_id", "y", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int | None = 5, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on about max_rows labelled rows outside the held-out remainder 0.

    An id of several labels counts by their mean; of rows with one id many times over, 2 * max_rows in hash order are taken at most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("y")).where("of is not null and y in (0, 1)")
    if held_out_mod:
        known = known.where(crc_mod(F.col("of"), held_out_mod) != 0)
    known = known.groupBy("of").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = known.count()
    share = min(1_000_000, 1_000_000 * max_rows // max(n, 1) + 1)
    sample = known.where(F.pmod(F.xxhash64("of", F.lit(11)), F.lit(1_000_000)) < share)  # about max_rows rows of 12 bytes: broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["of"]).select("doc_id", "text", "y")
    found = map_arrow(rows, _featurise, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    found = found.orderBy(F.xxhash64("doc_id", *FEATURES), "doc_id", *FEATURES).limit(2 * max_rows)  # rows of numbers only
    got = found.toArrow().sort_by([(c, "ascending") for c in ("doc_id", "y", *FEATURES)])
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.score(matrix(text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")
