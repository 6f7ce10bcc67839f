"""Range asymmetric numeral system with one static table, in numpy, over interleaved lanes.

Token t of a block is step t // lanes of lane t % lanes. All lanes advance together, so each step is a few
numpy operations. A lane's state stays in [2**31, 2**63); it gives or takes one 32-bit word at a time.

A block is bytes, little-endian:
    magic 'QTB2', documents u32, tokens u64, lanes u32, steps between checkpoints u32, checkpoints u32,
    words u32, crc32 of the ids u32, crc32 of all that follows u32,
    null marks u8 a document, doc_ids i64 a document, lengths u32 a document,
    checkpoints: word position u64, crc32 of the ids up to the next one u32, and lane states u64 (the first is the
    block's start),
    words u32.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"QTB2"
_HEAD, _POINT = struct.Struct("<4sIQIIIIII"), struct.Struct("<QI")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Table:
    """Slots of 2**bits dealt to symbols: symbol s has freq[s] slots from start[s]."""

    bits: int
    freq: np.ndarray
    start: np.ndarray

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def table(counts: np.ndarray, bits: int = 20) -> Table:
    """Slots in proportion to the counts, one at least for each symbol that occurs."""
    counts = np.asarray(counts, np.float64)
    seen, slots = np.flatnonzero(counts > 0), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if len(seen):
        if len(seen) > slots:
            raise ValueError(f"{len(seen)} symbols need more than 2**{bits} slots")
        share = counts[seen] / counts[seen].sum() * (slots - len(seen))
        freq[seen] = 1 + np.floor(share).astype(np.int64)
        left = slots - int(freq.sum())
        freq[seen[np.argsort(-(share - np.floor(share)), kind="stable")[:left]]] += 1
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]) if len(freq) else freq
    return Table(bits, freq.astype(np.uint64), start.astype(np.uint64))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _lanes(tokens: int) -> int:
    return max(1, min(1024, tokens // 64))


def encode_block(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], t: Table, every: int = 256) -> bytes:
    """ids: the documents' tokens one after another; lengths add up to len(ids)."""
    n, lanes = len(ids), _lanes(len(ids))
    steps, bits = -(-n // lanes), np.uint64(t.bits)
    state = np.full(lanes, _LOW, np.uint64)
    shift = np.uint64(63 - t.bits)
    words, given = [], np.zeros(steps + 1, np.int64)  # given[s]: words that step s gives
    saved = []
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        x, f = state[: len(sym)], t.freq[sym]
        full = x >= (f << shift)
        if full.any():
            words.append((x[full] & _MASK32).astype("<u4"))
            given[s] = len(words[-1])
            x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(sym)] = (q << bits) + (x - q * f) + t.start[sym]
        if s % every == 0:
            saved.append((s, state.copy()))
    # a decoder reads in the other order
    stream = b"".join(w.tobytes() for w in reversed(words))
    before = np.concatenate([[0], np.cumsum(given[:steps])]) if steps else np.zeros(1, np.int64)
    if not saved:
        saved = [(0, state)]
    body = b"".join(
        [
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            *(_POINT.pack(int(before[s]), _crc(ids[s * lanes : (s + every) * lanes])) + x.astype("<u8").tobytes() for s, x in reversed(saved)),
            stream,
        ]
    )
    head = _HEAD.pack(
        MAGIC, len(doc_ids), n, lanes, every, len(saved), len(stream) // 4,
        _crc(ids), zlib.crc32(body),
    )
    return head + body


class Block:
    """A block read back; checks the checksum of its bytes."""

    def __init__(self, raw: bytes):
        magic, docs, self.tokens, self.lanes, self.every, points, words, self.ids_crc, crc = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if zlib.crc32(memoryview(raw)[_HEAD.size :]) != crc:
            raise ValueError("a block of token ids is damaged: its checksum differs")
        at = _HEAD.size
        nulls = np.frombuffer(raw, np.uint8, docs, at)
        at += docs
        ids = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        self.doc_ids = [None if z else int(d) for z, d in zip(nulls, ids)]
        self.lengths = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self._points = []
        for _ in range(points):
            at_word, own = _POINT.unpack_from(raw, at)
            self._points.append((at_word, np.frombuffer(raw, "<u8", self.lanes, at + _POINT.size), own))
            at += _POINT.size + 8 * self.lanes
        self._stream = np.frombuffer(raw, "<u4", words, at)

    def decode(self, t: Table, symbols: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of steps from `first` up to `last`; begins at the checkpoint before `first`.

        Parts of a block can be decoded apart from each other. Each whole stretch between checkpoints is held against
        its checksum, and a whole block against its own.
        """
        steps = -(-self.tokens // self.lanes)
        last = steps if last is None else min(last, steps)
        if first >= last:
            return np.zeros(0, np.uint32)
        k = first // self.every
        pos, state = self._points[k][0], self._points[k][1].astype(np.uint64)
        out, bits, mask = [], np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
        stretch = []
        for s in range(k * self.every, last):
            width = min(self.lanes, self.tokens - s * self.lanes)
            x = state[:width]
            slot = x & mask
            sym = symbols[slot]
            x = t.freq[sym] * (x >> bits) + slot - t.start[sym]
            short = x < _LOW
            m = int(np.count_nonzero(short))
            if m:
                x[short] = (x[short] << _WORD) | self._stream[pos : pos + m].astype(np.uint64)
                pos += m
            state[:width] = x
            stretch.append(sym)
            if s >= first:
                out.append(sym)
            if (s + 1) % self.every == 0 or s + 1 == steps:
                self._hold(np.concatenate(stretch), self._points[s // self.every][2])
                stretch = []
        ids = np.concatenate(out)
        if first == 0 and last == steps:
            self._hold(ids, self.ids_crc)
        return ids

    def _hold(self, ids: np.ndarray, crc: int) -> None:
        if _crc(ids) != crc:
            raise ValueError("a block of token ids decodes to other ids than were encoded")

    def documents(self, t: Table, symbols: np.ndarray, part: int = 0, parts: int = 1) -> tuple[int, int, np.ndarray]:
        """Documents i up to j that begin in one of `parts` equal shares of the block's checkpoints, and their ids.

        Shares can be decoded in different tasks, each from its own checkpoint; together they are all documents.
        """
        step = self.every * self.lanes * -(-len(self._points) // parts)
        starts = np.cumsum(self.lengths) - self.lengths
        i, j = np.searchsorted(starts, [part * step, (part + 1) * step])
        if i == j:
            return int(i), int(j), np.zeros(0, np.uint32)
        begin, stop = int(starts[i]), int(starts[j - 1] + self.lengths[j - 1])
        first = begin // self.lanes
        ids = self.decode(t, symbols, first, -(-stop // self.lanes))
        return int(i), int(j), ids[begin - first * self.lanes : stop - first * self.lanes]
