"""Token-id output: documents are tokenised, ordered by doc_id and written as rANS segments.

Documents are range-partitioned by doc_id and a hash of the text; each partition writes its segments (about SEGMENT_IDS ids of whole documents each,
with a frequency table of all of its ids) as rows of a Parquet table in the shared folder, which any executor can read back
and decode in parallel. A long text's tokens are found piecewise: a byte-level BPE never merges across a single blank that
follows a non-blank, so pieces between such blanks are tokenised once each and kept in a bounded table.

Defined results: a null or empty text has just the end id; rows with equal doc_id are ordered by the XXH64 of the text (seed 42;
42 for null), then by text; null doc_ids come first; a segment ends before it would hold more than SEGMENT_IDS ids, but a document is
never cut, so a very long one is a segment by itself, whose table has room for the ids of any vocabulary of up to 65,536 pieces (more
distinct ids than that raise ValueError); an empty table gives an empty file; further columns may have any name.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import rans
from gridloom.llm.common import map_arrow, shared_dir

SEGMENT_IDS = 1 << 20
#: Bound of a worker's table of pieces, in two generations.
KNOWN_PIECES = 500_000
#: Bytes of text whose words are looked up together (a longer text by itself), where workers hold their tables or not, and words
#: whose ids are laid out together.
BYTES_HELD, BYTES_AT_ONCE = 16 << 20, 1 << 20
WORDS_AT_ONCE = 1 << 19
END_ID = 0

#: White space other than blank and line feed (the last of it is U+3000).
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
_CUT = re.compile(r"(?<=\S)(?=\s)")
#: A line feed or nothing, letters, then nothing or an ASCII mark or digit and no more white space.
_SIMPLE = re.compile(r"(\n?)([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([!-@\[-`{-~]\S*)?\Z")
_RAW = "\x01"
#: Texts that do not simply fall into words at single blanks and line feeds.
_ODD = r"\A[ \n]|  |\n\n| \n|\n |[\x01" + "".join(f"\\x{{{ord(c):X}}}" for c in _OTHER_SPACE) + "]"


def keys_of(text: str) -> tuple[str, list[str]]:
    """The first piece, and a key for each further one; a piece begins where white space follows other text.

    A key stands for itself after a blank, for itself alone if it begins with a line feed, and without its first character if
    that is _RAW.
    """
    if text[:1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RAW in text or any(c in text for c in _OTHER_SPACE):
        raw = _CUT.split(text)
        return raw[0], [_key(r) for r in raw[1:]]
    parts = text.replace("\n", " \n").split(" ")
    return parts[0], parts[1:]


def _key(raw: str) -> str:
    alone = not raw[1:2].isspace() and raw[1:2] != _RAW
    return raw[1:] if alone and raw[0] == " " else raw if alone and raw[0] == "\n" else _RAW + raw


def _raw(key: str) -> str:
    return key[1:] if key[:1] == _RAW else key if key[:1] == "\n" else " " + key


class Tokens:
    """Ids of texts, by pieces; the ids of known pieces are kept.

    A piece of letters is one word to a byte-level vocabulary, so new words are given to the vocabulary's model directly, many in
    one string that is split at line feeds only. Where letters meet an ASCII mark or digit its rules always part words, so a piece's
    word and tail are looked up apart.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.kind).tobytes()
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.byte = {b: b if b in visible else 256 + hidden.index(b) for b in range(256)}
        self.line, self.blank = chr(self.byte[10]), chr(self.byte[32])
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Split(self.line, "isolated")
        self.forget()
        probe = ["word", "\nWord", "été", "\nñandú", "a"]
        wanted = self._ids([_raw(p) for p in probe])
        self.direct = True
        try:
            self._learn_words(probe)
            self.direct = all(self.known[p] == w.tobytes() for p, w in zip(probe, wanted, strict=True))
        except ValueError:
            self.direct = False
        self.forget()

    def forget(self) -> None:
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, keys: list[str]) -> None:
        size, feed = self.kind.itemsize, self._ids(["\n"])[0]
        for lo in range(0, len(keys), 512):
            part = keys[lo : lo + 512]
            plain = "\n".join([k[1:] if k[0] == "\n" else " " + k for k in part]) + "\n"
            mapped = plain.encode().decode("latin-1").translate(self.byte)
            ids = np.array(self.words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == feed[0])
            if len(feed) != 1 or len(ends) != len(part):
                raise ValueError("words cannot be told apart")
            raw, at, first = ids.tobytes(), 0, feed.tobytes()
            for k, e in zip(part, ends.tolist(), strict=True):
                self.known[k] = (first if k[0] == "\n" else b"") + raw[at * size : e * size]
                at = e + 1

    def _learn(self, keys: set[str]) -> None:
        words, tails, parted, rest = set(), set(), [], []
        known, match = self.known, _SIMPLE.match
        for k in keys:
            m = match(k) if self.direct else None
            if m is None:
                rest.append(k)
            elif m[3] is None:
                words.add(k)
            else:
                w = k[: m.end(2)]
                if w not in known:
                    if (v := self.old.get(w)) is None:
                        words.add(w)
                    else:
                        known[w] = v
                if m[3] not in self.tails:
                    tails.add(m[3])
                parted.append((k, w, m[3]))
        self._learn_words(list(words))
        self._learn_texts(list(tails), list(tails), self.tails)
        for k, w, t in parted:
            known[k] = known[w] + self.tails[t]
        self._learn_texts(rest, [_raw(k) for k in rest], known)

    def _learn_texts(self, keys: list[str], texts: list[str], table: dict[str, bytes]) -> None:
        for k, ids in zip(keys, self._ids(texts), strict=True):
            table[k] = ids.tobytes()

    def _look_up(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct keys; new ones are learned."""
        if len(self.known) + len(self.tails) > KNOWN_PIECES // 2:  # pieces met again move on to the new generation
            self.old, self.known, self.tails = self.known, {}, {"": b""}
        found = list(map(self.known.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            missing = [keys[i] for i in gaps]
            old = list(map(self.old.get, missing))
            self.known.update((k, v) for k, v in zip(missing, old, strict=True) if v is not None)
            self._learn({k for k, v in zip(missing, old, strict=True) if v is None})
            for i, k in zip(gaps, missing, strict=True):
                found[i] = self.known[k]
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        parted = [keys_of(text or "") for text in texts]
        distinct = list(dict.fromkeys(k for _, keys in parted for k in keys))
        get = dict(zip(distinct, self._look_up(distinct), strict=True)).__getitem__
        heads = self._ids([head for head, _ in parted])
        return [np.frombuffer(a.tobytes() + b"".join(map(get, keys)) + self.end, self.kind) for a, (_, keys) in zip(heads, parted, strict=True)]

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """As `encode`, for an Arrow column: words are cut and told apart by Arrow, looked up once each, and their ids laid out by numpy."""
        text = column.fill_null("")
        odd = pc.match_substring_regex(text, _ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(text)
        if odd.any():
            at = np.flatnonzero(odd)
            for i, ids in zip(at.tolist(), self.encode(text.take(pa.array(at)).to_pylist()), strict=True):
                out[i] = ids
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        parts = pc.split_pattern(pc.replace_substring(text.take(pa.array(plain)), "\n", " \n"), " ")
        offsets, flat = parts.offsets.to_numpy(), parts.flatten()
        offsets = offsets - offsets[0]
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        heads = self._ids(flat.filter(pa.array(first)).to_pylist())
        words = flat.filter(pa.array(~first)).dictionary_encode()
        values = self._look_up(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        begins = np.cumsum(sizes) - sizes
        table, index = np.frombuffer(b"".join(values), self.kind), words.indices.to_numpy()
        laid = []
        for lo in range(0, len(index), WORDS_AT_ONCE):
            w = index[lo : lo + WORDS_AT_ONCE]
            n = sizes[w]
            ends = np.cumsum(n)
            laid.append(table[np.repeat(begins[w] - ends + n, n) + np.arange(ends[-1])])
        ids = np.concatenate(laid) if laid else np.zeros(0, self.kind)
        upto = np.concatenate([[0], np.cumsum(sizes[index])])[offsets - np.arange(len(offsets))]
        end = np.frombuffer(self.end, self.kind)
        for k, (i, head) in enumerate(zip(plain.tolist(), heads, strict=True)):
            out[i] = np.concatenate([head, ids[upto[k] : upto[k + 1]], end])
        return out


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // most)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(lo, hi - lo)


_LAST: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker's tokeniser, kept between tasks."""
    if path not in _LAST:
        _LAST.clear()
        _LAST[path] = Tokens(path)
    return _LAST[path]


def segments(docs: DataFrame, vocabulary: str, partitions: int, hold: bool = False) -> DataFrame:
    """file, segment, first_id (ids before it in its file), n_ids, n_docs and data (a segment) for all documents in doc_id order.

    hold: workers keep their table of pieces for the next task, and look up more words at a time, for less work and about 300 MB of a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, file = tokens_of(vocabulary), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = first = segment = 0

        def flush() -> pa.RecordBatch:
            data = rans.encode_segment(doc_ids, ids)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((file, pa.int32()), (segment, pa.int32()), (first, pa.int64()), (held, pa.int64()), (len(ids), pa.int64()), (data, pa.binary()))], names=["file", "segment", "first_id", "n_ids", "n_docs", "data"])

        for batch in batches:
            for part in _slices(batch, BYTES_HELD if hold else BYTES_AT_ONCE):
                for doc_id, x in zip(part.column("doc_id").to_pylist(), tokens.encode_column(part.column("text")), strict=True):
                    if ids and held + len(x) > SEGMENT_IDS:
                        yield flush()
                        first, segment, held, doc_ids, ids = first + held, segment + 1, 0, [], []
                    doc_ids.append(doc_id)
                    ids.append(x)
                    held += len(x)
        if ids:
            yield flush()
        if not hold:
            tokens.forget()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # the hash deals rows of one doc_id, or of none, to many tasks
    ordered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return map_arrow(ordered, run, "file int, segment int, first_id long, n_ids long, n_docs long, data binary")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, partitions: int | None = None, hold: bool = False) -> str:
    """Write all documents to a folder of segments; returns the folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments(docs, vocabulary, n, hold).write.option("compression", "none").parquet(path)
    return path


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            seg = rans.Segment(batch.column("data")[k].as_py())
            at, rows = batch.column("first_id")[k].as_py(), []
            for doc_id, ids in seg.documents():
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("file")[k].as_py()] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in cols]], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    stored = spark.read.schema("file int, segment int, first_id long, n_ids long, n_docs long, data binary").parquet(path)
    files = stored.groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = map_arrow(stored.select("file", "first_id", "data"), _decode, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(files, docs["file"] == files["of"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
