"""A static range asymmetric numeral system (rANS) coder for token ids, vectorised over lanes.

A segment holds whole documents in order: a frequency table shared by its blocks, a document index, and blocks that can be
decoded independently. A block interleaves LANES coder states, so that each step encodes or decodes one id per lane; its
directory entry is a checkpoint: byte offset, first id, number of ids, lanes, and a CRC-32 of the ids. Layout, little-endian:

    magic 8 bytes | version u32 | ids u64 | docs u32 | symbols u32 | blocks u32 | CRC-32 of the rest of the header u32
    symbols: id u32 x symbols | frequency u16 (minus 1) x symbols
    docs: doc_id i64 x docs | null mark u8 x docs | ids u32 x docs
    blocks: offset u64 | first id u64 | ids u32 | lanes u32 | words u32 | CRC-32 u32, each as an array
    payload: for each block, lane states u32 x lanes | stream of u16 words

States live in [2^16, 2^32) and renormalise by 16-bit words; frequencies sum to 2^16.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"GLRANS01"
SCALE = 16
TOTAL = 1 << SCALE
LANES = 2048
BLOCK_IDS = 1 << 19
_HEAD = struct.Struct("<8sIQIIII")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and their frequencies scaled to sum to TOTAL, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > TOTAL:
        raise ValueError("more distinct ids than the table can hold")
    if not len(symbols):
        return symbols.astype(np.uint32), np.zeros(0, np.int64)
    n = counts[symbols].astype(np.float64)
    spare = TOTAL - len(symbols)
    exact = n * spare / n.sum()
    freq = np.floor(exact).astype(np.int64)
    rest = spare - int(freq.sum())
    freq[np.argsort(freq - exact, kind="stable")[:rest]] += 1
    return symbols.astype(np.uint32), freq + 1


def encode_block(codes: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, int]:
    """Encode symbol indices; returns states and words as bytes, and the number of lanes."""
    n = len(codes)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, 1 << 16, np.uint32)
    f_all, s_all = freq[codes].astype(np.uint32), start[codes].astype(np.uint32)
    chunks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        f, s = f_all[t * lanes : (t + 1) * lanes], s_all[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        high = y >> 16
        over = high >= f  # the state would leave its range
        if over.any():
            chunks.append(y[over].astype("<u2"))  # the low 16 bits
            y = np.where(over, high, y)
        q = y // f
        x[: len(f)] = (q << SCALE) + (y - q * f) + s
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u2")
    return x.astype("<u4").tobytes() + words.tobytes(), lanes


def decode_block(data: bytes, n: int, lanes: int, words: int, slot: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The n symbol indices of a block."""
    x = np.frombuffer(data, "<u4", lanes).astype(np.uint32)
    stream = np.frombuffer(data, "<u2", words, 4 * lanes).astype(np.uint32)
    out, at = np.empty(n, slot.dtype), 0
    f32, s32 = freq.astype(np.uint32), start.astype(np.uint32)
    for t in range(0, n, lanes):
        y = x[: min(lanes, n - t)]
        low = y & (TOTAL - 1)
        c = slot[low]
        out[t : t + len(y)] = c
        y = f32[c] * (y >> SCALE) + (low - s32[c])
        need = np.flatnonzero(y < (1 << 16))
        if len(need):
            y[need] = (y[need] << 16) | stream[at : at + len(need)]
            at += len(need)
        x[: len(y)] = y
    if at != words or (x != 1 << 16).any():
        raise ValueError("block does not end in its initial states")
    return out


def encode_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One segment of whole documents."""
    sizes = np.array([len(d) for d in docs], "<u4")
    ids = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    symbols, freq = frequencies(ids)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]) if len(freq) else freq
    codes = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int32)
    codes[symbols] = np.arange(len(symbols))
    blocks, entries, offset = [], [], 0
    for first in range(0, len(ids), BLOCK_IDS):
        part = ids[first : first + BLOCK_IDS]
        data, lanes = encode_block(codes[part], freq, start)
        entries.append((offset, first, len(part), lanes, (len(data) - 4 * lanes) // 2, zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(data)
        offset += len(data)
    columns = list(zip(*entries, strict=True)) or [()] * 6
    rest = b"".join([
        symbols.astype("<u4").tobytes(), (freq - 1).astype("<u2").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), sizes.tobytes(),
        *(np.array(c, k).tobytes() for c, k in zip(columns, ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4"), strict=True)),
    ])
    return _HEAD.pack(MAGIC, 1, len(ids), len(docs), len(symbols), len(blocks), zlib.crc32(rest)) + rest + b"".join(blocks)


class Segment:
    """Reads a segment; blocks can be decoded in any order."""

    def __init__(self, data: bytes):
        magic, version, self.n_ids, n_docs, n_symbols, n_blocks, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of this format")
        at = begin = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.symbols, self.freq = take("<u4", n_symbols), take("<u2", n_symbols).astype(np.int64) + 1
        ids, null, self.sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.blocks = list(zip(*(take(k, n_blocks).tolist() for k in ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4")), strict=True))
        if zlib.crc32(data[begin:at]) != crc:
            raise ValueError("header checksum differs")
        self.data, self.payload = data, at
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]) if n_symbols else self.freq
        self.slot = np.repeat(np.arange(n_symbols, dtype=np.int32), self.freq)

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, checked."""
        offset, _, n, lanes, words, crc = self.blocks[k]
        lo = self.payload + offset
        ids = self.symbols[decode_block(self.data[lo : lo + 4 * lanes + 2 * words], n, lanes, words, self.slot, self.freq, self.start)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of block {k} differs")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order."""
        ids = np.concatenate([self.block(k) for k in range(len(self.blocks))]) if self.blocks else np.zeros(0, np.uint32)
        at = 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            yield doc_id, ids[at : at + n]
            at += n
