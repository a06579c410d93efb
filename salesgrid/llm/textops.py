"""Vectorised word hashing over Arrow text batches.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Those separators are ASCII,
so words can be found in the UTF-8 bytes without decoding. Each word gets a
64-bit hash: the sum of ``T[byte] * B**position`` (mod 2**64, read off one
prefix sum) and a final mixing step. Equal words always have equal hashes;
different ones collide with a probability of about 2**-64 a pair.

Memory is bounded by ``CHUNK_BYTES`` plus the words of one slice of rows
(``slices``); a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
SLICE_BYTES = 1 << 22

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n (mod 2**64); kept, since they never change."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """The words of some rows: one entry a word, rows in order."""

    data: np.ndarray      # the UTF-8 bytes of all rows
    row_start: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray     # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray     # index of each row's first word, and the number of words

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def text(self, i: int, j: int) -> str:
        """The words i..j-1 joined by one space."""
        return " ".join(bytes(self.data[self.start[k]:self.end[k]]).decode() for k in range(i, j))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most ``limit`` bytes of text (one row at least)."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words and word hashes of a text column (``lower``: A-Z count as a-z)."""
    data, rows = buffers(texts)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = space[1:] != space[:-1]
        edge[0], edge[-1] = not space[0], not space[-1]
    else:
        edge[:] = False
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[~space[inner - 1] & ~space[inner]]  # a word ends and another begins where rows meet
    marks = np.flatnonzero(edge)
    if len(both):
        marks = np.sort(np.concatenate([marks, np.repeat(np.unique(both), 2)]), kind="stable")
    start, end = marks[0::2].astype(np.int64), marks[1::2].astype(np.int64)
    out = span_hashes(data, start, end, lower)
    first = np.searchsorted(start, rows, side="left")
    first[-1] = len(start)
    return Words(data, rows, start, end, out, first.astype(np.int64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of byte spans that are in order and do not overlap."""
    table = _LOWER if lower else _BYTE
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, side="right")))
        base, stop = start[at], end[upto - 1]
        up, down = _powers(int(stop - base) + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(table[data[base:stop]] * up[:stop - base], out=sums[1:])
        s = start[at:upto] - base
        out[at:upto] = (sums[end[at:upto] - base] - sums[s]) * down[s]
        at = upto
    return mix(out)


def by_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values told apart by row too: equal only for equal values of one row."""
    return mix(values + mix(row.astype(np.uint64) + np.uint64(1)))


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``bounds``."""
    out = np.zeros(len(bounds) - 1, np.int64)
    filled = bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(flags[:bounds[-1]], bounds[:-1][filled], dtype=np.int64)
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (regardless of row ends)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j:n + j]
    return mix(out)


def sequence(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole run of word hashes, which also depends on its length."""
    h = grams(hashes, len(hashes))[0]
    return mix(np.array([h ^ np.uint64(len(hashes))], np.uint64))[0]
