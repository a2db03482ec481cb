"""Language identification by segmentation-marginalised unigram models.

The vocabulary is a fixed public one (byte-level BPE pieces). A text is cut into words (a letter and the letters and marks that
follow it, at most MAX_WORD characters, lower-cased, with the vocabulary's leading-blank mark; WORD is the one definition, in
training and in scoring); a language gives every piece a probability, and the
probability of a word is the sum over all its segmentations into pieces of the product of the piece probabilities, which
the forward algorithm computes. A text's score is the product over its words. Piece probabilities are fitted by
expectation-maximisation on word counts of a bounded sample of labelled documents.

Scoring is exact over whole texts. Distinct words are scored once per task and kept in a bounded table.

A longer run of letters goes on as a further word, so runs of any length count whole. The lattice of a word is rescaled as it
shrinks, so a word of many bytes keeps its weight in training as in scoring.

Defined results: null, empty and letterless texts (digits, fractions, symbols and numerals are no letters) are `und` with score 0;
ties go to the language first in code point order; an empty training set makes every text `und`; very long texts are scored whole;
repeated rows are scored alike; an empty table gives an empty result; only the text column is read, and kept columns may have any
name. Rows without a doc_id are not learned from and are not held out.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, cut, map_arrow

MAX_WORD = 64
MAX_PIECE = 16
#: Bound of the labelled sample per language (rows, on average; chosen by a hash of the id), and of its distinct words (the most frequent ones of each language).
SAMPLE_DOCS = 600
SAMPLE_WORDS = 120_000
EM_ROUNDS = 4
KNOWN_WORDS = 400_000

#: More languages than this are not learned: the most frequent ones are.
MAX_LANGUAGES = 1000

#: A word; both the JVM and `regex` read it alike.
WORD = rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{MAX_WORD - 1}}}"
_WORDS = regex.compile(WORD)
#: Blanks out every ASCII byte that is no lower-case letter, so that most tokens are words already.
_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def byte_pieces(path: str) -> list[bytes]:
    """The letter pieces of a byte-level BPE vocabulary file, as bytes, in id order; a leading blank is kept."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = []
    for piece, _ in sorted(vocab.items(), key=lambda x: x[1]):
        raw = bytes(back[c] for c in piece) if all(c in back for c in piece) else b""
        if 0 < len(raw) <= MAX_PIECE and raw.lower() == raw and re.fullmatch(rb" ?[a-z\x80-\xff]*", raw):
            found.append(raw)
    return found


class Trie:
    """Pieces as a dense transition table over the byte classes that occur; state 0 is dead, 1 the root."""

    def __init__(self, pieces: list[bytes]):
        self.cls = np.zeros(256, np.int32)
        for k, b in enumerate(sorted({b for p in pieces for b in p}), 1):
            self.cls[b] = k
        n = int(self.cls.max()) + 1
        states: list[dict[int, int]] = [{}, {}]
        ends = {}
        for i, p in enumerate(pieces):
            s = 1
            for b in p:
                c = int(self.cls[b])
                if c not in states[s]:
                    states[s][c] = len(states)
                    states.append({})
                s = states[s][c]
            ends[s] = i
        self.next = np.zeros((len(states), n), np.uint16 if len(states) <= 1 << 16 else np.int32)
        for s, row in enumerate(states):
            for c, t in row.items():
                self.next[s, c] = t
        self.piece = np.full(len(states), -1, np.int32)
        for s, i in ends.items():
            self.piece[s] = i


def _matrix(words: list[bytes], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of the words, padded with class 0, and their lengths."""
    length = np.fromiter(map(len, words), np.int32, len(words))
    width = int(length.max(initial=0))
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    classes = trie.cls[flat]
    classes[np.arange(width)[None, :] >= length[:, None]] = 0
    return classes, length


def _spans(classes: np.ndarray, length: np.ndarray, trie: Trie) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For start i and end j: the rows that have a piece between them, and the piece."""
    found, width = {}, classes.shape[1]
    for i in range(width):
        rows = np.nonzero(length > i)[0]
        state = np.ones(len(rows), np.int32)
        for j in range(i, min(width, i + MAX_PIECE)):
            state = trie.next[state, classes[rows, j]]
            alive = np.nonzero(state)[0]
            if not len(alive):
                break
            rows, state = rows[alive], state[alive]
            has = np.nonzero(trie.piece[state] >= 0)[0]
            if len(has):
                found[i, j + 1] = (rows[has], trie.piece[state[has]])
    return found


class Model:
    """Languages, pieces and log probabilities; scores words by the forward algorithm."""

    def __init__(self, langs: list[str], pieces: list[bytes], probs: np.ndarray, floor: np.ndarray):
        self.langs, self.probs, self.floor = langs, probs, floor  # probs: (pieces + 1, languages); the last row is 0
        self.trie = Trie(pieces)

    def forward(self, words: list[bytes]) -> np.ndarray:
        """(words, languages): the log of each word's probability summed over its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        if not self.langs:
            return out
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), 2048):
            idx = order[lo : lo + 2048]
            classes, length = _matrix([words[k] for k in idx], self.trie)
            spans = _spans(classes, length, self.trie)
            alpha = np.zeros((classes.shape[1] + 1, len(idx), len(self.langs)))
            alpha[0], shift = 1.0, np.zeros((len(idx), 1))
            result = np.zeros((len(idx), len(self.langs)))
            for j in range(1, classes.shape[1] + 1):
                a = alpha[j - 1] * self.floor  # a byte outside every piece, or a rare one
                for i in range(max(0, j - MAX_PIECE), j):
                    if (x := spans.get((i, j))) is not None:
                        a[x[0]] += alpha[i, x[0]] * self.probs[x[1]]
                alpha[j] = a
                if (small := a.max(axis=1) < 1e-120).any():  # keep the window of earlier columns on the same scale
                    alpha[max(0, j - MAX_PIECE) : j + 1, small] *= 1e120
                    shift[small] -= np.log(1e120)
                if (done := length == j).any():
                    result[done] = np.log(np.maximum(alpha[j][done], 1e-300)) + shift[done]
            out[idx] = result
        return out


#: A lattice value below SMALL is multiplied by 1 / SMALL, with the window of values that it will meet.
SMALL = 1e-100


def _lattice(spans, length: np.ndarray, width: int, p: np.ndarray, floor: float, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward (or backward) sums of one language over a batch of words, and how often each was rescaled."""
    n = len(length)
    value, scaled = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
    if not back:
        value[0] = 1.0
    for j in range(width, -1, -1) if back else range(1, width + 1):
        a = value[j]
        if back:
            a += length == j
            others = range(j + 1, min(width, j + MAX_PIECE) + 1)
        else:
            others = range(max(0, j - MAX_PIECE), j)
        if 0 <= (before := j + 1 if back else j - 1) <= width:
            a += value[before] * floor
        for i in others:
            if (x := spans.get((j, i) if back else (i, j))) is not None:
                a[x[0]] += value[i, x[0]] * p[x[1]]
        small = (a > 0) & (a < SMALL)
        # values of one window share their scale
        scaled[j] = np.where(a > 0, scaled[before] if 0 <= before <= width else 0, 0)
        if small.any():
            window = slice(j, min(width, j + MAX_PIECE) + 1) if back else slice(max(0, j - MAX_PIECE), j + 1)
            value[window, small] /= SMALL
            scaled[window, small] += 1
    return value, scaled


def fit(counts: dict[str, Counter], pieces: list[bytes], rounds: int = EM_ROUNDS) -> Model:
    """Expectation-maximisation of each language's piece probabilities from its word counts."""
    langs = sorted(counts)
    trie = Trie(pieces)
    probs = np.zeros((len(pieces) + 1, len(langs)))
    size = np.array([len(p) for p in pieces])
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        raw = [f" {w}".encode() for w in words]
        weight = np.array([counts[lang][w] for w in words], float)
        order = sorted(range(len(raw)), key=lambda x: (len(raw[x]), raw[x]))
        p = np.append(1.0 / len(pieces) ** np.minimum(size, 1), 0.0)
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 1)
            for lo in range(0, len(order), 4096):
                idx = order[lo : lo + 4096]
                classes, length = _matrix([raw[x] for x in idx], trie)
                spans, width = _spans(classes, length, trie), classes.shape[1]
                alpha, up = _lattice(spans, length, width, p, 1e-9, False)
                beta, down = _lattice(spans, length, width, p, 1e-9, True)
                at = np.arange(len(idx))
                total, whole = alpha[length, at], up[length, at]
                plain = not (whole.any() or down.any())
                scale = weight[idx] / np.maximum(total, 1e-280)
                for (i, j), (rows, s) in spans.items():
                    if plain:
                        share = alpha[i, rows] * p[s] * beta[j, rows] * scale[rows]
                    else:  # in logarithms: each factor has its own scale
                        with np.errstate(divide="ignore"):
                            log = np.log(alpha[i, rows]) + np.log(p[s]) + np.log(beta[j, rows]) - np.log(total[rows])
                        share = np.exp(np.minimum(log + (up[i, rows] + down[j, rows] - whole[rows]) * np.log(SMALL), 0.0)) * weight[idx][rows]
                    expected += np.bincount(s, weights=share, minlength=len(pieces) + 1)
            expected[-1] = 0.0
            p = (expected + 0.01 * (np.append(size, 0) == 1)) / max(expected.sum() + 0.01 * (size == 1).sum(), 1e-9)
        probs[:, k] = p
    probs[:-1] = 0.999 * probs[:-1] + 0.001 / max(len(pieces), 1)  # every piece stays possible in every language
    return Model(langs, pieces, probs, np.full(len(langs), 1e-7))


class Scorer:
    """Adds up word scores over a text, keeping the scores of its tokens in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.langs) + 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, self.width))

    def learn(self, tokens: set[bytes]) -> None:
        names = list(tokens)
        parts = [[t] if len(t) <= MAX_WORD and t.isascii() else [w.encode() for w in words_of(t.decode())] for t in names]
        distinct = list({w for p in parts for w in p})
        where = {w: k for k, w in enumerate(distinct)}
        logs = np.ones((len(distinct) + 1, self.width))
        logs[-1] = 0.0
        logs[:-1, :-1] = self.model.forward([b" " + w for w in distinct])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((where[w] for p in parts for w in p), np.int64, int(sizes.sum()))
        rows = np.zeros((len(names), self.width))
        np.add.at(rows, np.repeat(np.arange(len(names)), sizes), logs[flat])
        base = len(self.table)
        self.table = np.concatenate([self.table, rows])
        self.known.update(zip(names, range(base, base + len(names)), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language or und, posterior, words) of each text."""
        out = []
        for lo in range(0, len(texts), 512):
            tokens = [(t or "").lower().encode().translate(_BLANK).split() for t in texts[lo : lo + 512]]
            seen = set().union(*tokens)
            if new := seen.difference(self.known):
                if len(self.known) + len(new) > KNOWN_WORDS:
                    self.forget()
                    new = seen
                self.learn(new)
            get = self.known.__getitem__
            for t in tokens:
                total = self.table[np.fromiter(map(get, t), np.int64, len(t))].sum(axis=0)
                if total[-1] == 0 or not self.model.langs:
                    out.append(("und", 0.0, 0))
                    continue
                lp = total[:-1] - total[:-1].max()
                out.append((self.model.langs[int(np.argmax(lp))], float(1.0 / np.exp(lp).sum()), int(total[-1])))
        return out


def train(docs: DataFrame, vocabulary: str, held_out_mod: int | None = 3, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about sample_docs documents per language: rows with a language, outside the held-out remainder 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null")
    if held_out_mod:
        rows = rows.where(crc_mod(F.col("doc_id"), held_out_mod) != 1)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    counts: dict[str, Counter] = defaultdict(Counter)
    if sizes:
        limits = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(int(min(1_000_000, 1 + 1_000_000 * sample_docs // n))))])
        sample = rows.where(ticket < limits[F.col("lang")]).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
        grouped = cut(sample.groupBy("lang", "w").agg(F.count("*").alias("n")))
        large = sorted(r["lang"] for r in grouped.groupBy("lang").agg(F.count("*").alias("words")).where(F.col("words") > SAMPLE_WORDS).collect())
        found = grouped.where(~F.col("lang").isin(large)).collect()
        for lang in large:
            found += grouped.where(F.col("lang") == lang).orderBy(F.desc("n"), "w").limit(SAMPLE_WORDS).collect()
        for r in sorted(found, key=lambda r: (-r["n"], r["lang"], r["w"])):
            counts[r["lang"]][r["w"]] = r["n"]
    return fit(counts, byte_pieces(vocabulary))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep_<c> of every kept column c, lang_pred, lang_score, lang_words for every row of docs."""
    kept = [c for c in keep or [] if c != "text"]
    df = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in kept])
    out = df if "text" in (keep or []) else df.drop("text")
    names = out.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x pieces: fixed by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # its table lives as long as the task, so that idle workers hold little
        for batch in batches:
            got = scorer.score(batch.column("text").to_pylist())
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], names=[*names, "lang_pred", "lang_score", "lang_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return map_arrow(df, run, f"{fields}{', ' * bool(fields)}lang_pred string, lang_score double, lang_words long")


def accepted(min_score: float):
    """The pipeline's rule: a language was found, and its posterior reaches min_score."""
    return (F.col("lang_pred") != "und") & (F.col("lang_score") >= min_score)
