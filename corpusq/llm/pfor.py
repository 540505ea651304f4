"""Patched frame-of-reference blocks for token ids: encode, decode, file layout.

A file holds, little-endian throughout:

* header: magic ``PFR1``, block length (u32), then u64 counts of documents,
  ids, blocks, payload words and exceptions;
* payload: u32 words, block after block.  A block of 128 ids is the ids less
  their minimum, packed at the block's width in four interleaved lanes of 32;
* exceptions: the high bits (u32 each), then the place in the block (u8 each);
* block index: first payload word (u64), first exception (u64), minimum (u32)
  and width (u8), each as one array with a closing entry for the two starts;
* documents: id (i64), null flag (u8) and number of ids (u64), as arrays.

The width is the bit length of the chosen percentile of a block's offsets;
larger offsets keep their low bits in place and their high bits in the
exception list.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
LANES = 4
DEEP = BLOCK // LANES
PERCENTILE = 90
_HEAD = struct.Struct("<4sIQQQQQ")


@dataclass
class Blocks:
    payload: np.ndarray  # u32
    sizes: np.ndarray  # words of each block
    minima: np.ndarray  # u32
    widths: np.ndarray  # u8
    exc_counts: np.ndarray  # of each block
    exc_high: np.ndarray  # u32
    exc_place: np.ndarray  # u8


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> Blocks:
    """Encode u32 ids; a short last block is filled up with its own last id."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids):] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    minima = full.min(axis=1) if n else np.empty(0, np.uint32)
    offsets = full - minima[:, None]
    place = min(BLOCK - 1, BLOCK * percentile // 100)
    widths = _bit_length(np.partition(offsets, place, axis=1)[:, place]) if n else np.empty(0, np.uint8)
    sizes = widths.astype(np.int64) * LANES
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(starts[-1], np.uint32)
    high = offsets >> np.minimum(widths, 31)[:, None].astype(np.uint32)
    high[widths >= 32] = 0
    at_block, at_place = np.nonzero(high)
    for width in np.unique(widths):
        w = int(width)
        if not w:
            continue
        rows = np.nonzero(widths == width)[0]
        low = offsets[rows] & np.uint32((1 << w) - 1)
        lanes = low.reshape(len(rows), DEEP, LANES)
        out = np.zeros((len(rows), w, LANES), np.uint32)
        for i in range(DEEP):
            word, shift = divmod(i * w, 32)
            out[:, word] |= lanes[:, i] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
        payload[(starts[rows][:, None] + np.arange(w * LANES)).ravel()] = out.ravel()
    return Blocks(payload, sizes, minima, widths, np.bincount(at_block, minlength=n).astype(np.int64), high[at_block, at_place], at_place.astype(np.uint8))


def decode_blocks(payload, starts, exc_starts, minima, widths, exc_high, exc_place, first: int, last: int) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (exclusive), by their index entries."""
    widths = widths[first:last]
    begins = starts[first:last].astype(np.int64)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for width in np.unique(widths):
        w = int(width)
        if not w:
            continue
        rows = np.nonzero(widths == width)[0]
        packed = payload[(begins[rows][:, None] + np.arange(w * LANES)).ravel()].reshape(len(rows), w, LANES)
        lanes = np.empty((len(rows), DEEP, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for i in range(DEEP):
            word, shift = divmod(i * w, 32)
            got = packed[:, word] >> np.uint32(shift)
            if shift + w > 32:
                got = got | (packed[:, word + 1] << np.uint32(32 - shift))
            lanes[:, i] = got & mask
        out[rows] = lanes.reshape(len(rows), BLOCK)
    lo, hi = int(exc_starts[first]), int(exc_starts[last])
    if hi > lo:
        of = np.repeat(np.arange(last - first), np.diff(exc_starts[first:last + 1]).astype(np.int64))
        out[of, exc_place[lo:hi]] |= exc_high[lo:hi] << widths[of].astype(np.uint32)
    return (out + minima[first:last, None]).ravel()


class Writer:
    """Takes ids document by document, encodes them as they come, keeps only encoded blocks."""

    def __init__(self, percentile: int = PERCENTILE, hold: int = 1 << 20):
        self.percentile, self.hold = percentile, hold - hold % BLOCK
        self.parts: list[Blocks] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order; ``ids`` are all their ids, one document after the other."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.lengths.append(lengths.astype("<u8"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.hold:
            self._encode(self.n_held - self.n_held % BLOCK)

    def _encode(self, n: int) -> None:
        if n:
            every = np.concatenate(self.held)
            self.parts.append(encode_blocks(every[:n], self.percentile))
            self.held, self.n_held = [every[n:].copy()], len(every) - n

    def chunks(self):
        """The file's bytes, piece by piece."""
        self._encode(self.n_held)
        p = self.parts
        starts = np.concatenate([[0], *[x.sizes for x in p]]).cumsum().astype("<u8")
        exc_starts = np.concatenate([[0], *[x.exc_counts for x in p]]).cumsum().astype("<u8")
        n_docs = sum(map(len, self.doc_ids))
        yield _HEAD.pack(MAGIC, BLOCK, n_docs, self.n_ids, len(starts) - 1, int(starts[-1]), int(exc_starts[-1]))
        for name, kind in (("payload", "<u4"), ("exc_high", "<u4"), ("exc_place", "u1")):
            for x in p:
                yield getattr(x, name).astype(kind).tobytes()
        yield starts.tobytes()
        yield exc_starts.tobytes()
        for name, kind in (("minima", "<u4"), ("widths", "u1")):
            for x in p:
                yield getattr(x, name).astype(kind).tobytes()
        for parts in (self.doc_ids, self.nulls, self.lengths):
            for x in parts:
                yield x.tobytes()


class Reader:
    """Opens a file's bytes; decodes any range of ids through the block index."""

    def __init__(self, data: bytes):
        magic, block, n_docs, self.n_ids, n_blocks, n_words, n_exc = _HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token file of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.payload, self.exc_high, self.exc_place = take("<u4", n_words), take("<u4", n_exc), take("u1", n_exc)
        self.starts, self.exc_starts = take("<u8", n_blocks + 1), take("<u8", n_blocks + 1)
        self.minima, self.widths = take("<u4", n_blocks), take("u1", n_blocks)
        self.doc_ids, self.nulls, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        got = decode_blocks(self.payload, self.starts, self.exc_starts, self.minima, self.widths, self.exc_high, self.exc_place, first, last)
        return got[start - first * BLOCK: stop - first * BLOCK]
