"""Words of many texts at once, as numpy arrays over an Arrow column's own bytes.

All word patterns here are classes of bytes: ASCII characters in or out, and every byte of a longer
character in. Words get a 64-bit hash of their bytes with A-Z folded to a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding: digits, letters and all that isn't ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: [^\x20\x09-\x0D]+
NONSPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64)[_FOLD] | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) <= n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(512, 2 * n), _STEP, np.uint64))])
    return _POWERS


@dataclass
class Words:
    """data: all texts' bytes; doc, start, end, hash: of each word in turn; first: each text's first word, and the end."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def equal(self, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> bool:
        """Whether words a and b, pair by pair, are the same but for case."""
        pairs = np.unique(a.astype(np.int64) * len(self.start) + b)
        for some in (pairs[i : i + step] for i in range(0, len(pairs), step)):
            x, y = some // len(self.start), some % len(self.start)
            size = self.end[x] - self.start[x]
            if (size != self.end[y] - self.start[y]).any():
                return False
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if (_FOLD[self.data[np.repeat(self.start[x], size) + within]] != _FOLD[self.data[np.repeat(self.start[y], size) + within]]).any():
                return False
        return True

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, exclusive, folded and joined by one space."""
        return b" ".join(_FOLD[self.data[a:b]].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def scan(column: pa.Array, kind: np.ndarray) -> Words:
    data, at = column_bytes(column)
    n = len(column)
    none = np.zeros(0, np.int64)
    inside = kind[data]
    if not inside.any():
        return Words(data, none, none, none, none.astype(np.uint64), np.zeros(n + 1, np.int64))
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    end = np.flatnonzero(ends) + 1
    size = end - start
    where = np.flatnonzero(inside)
    heads = np.cumsum(size) - size
    within = np.arange(len(where)) - np.repeat(heads, size)
    powers = _powers(int(size.max()))
    h = np.add.reduceat(_BYTES[data[where]] * powers[within], heads)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, doc, start, end, mix(h + size.astype(np.uint64) * _STEP), first)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, by the first one's place (texts aren't told apart)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out)
