"""Words and hashes of many texts at once, as numpy arrays.

Used inside ``mapInArrow`` tasks. Texts arrive as an Arrow column; they are
handled in pieces of about ``PIECE`` bytes, so a task holds a bounded part of
its batch (or one text, if that is longer) in arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base (or of its inverse) modulo 2**64."""
    have = _powers[inverse]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), _INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        have = _powers[inverse] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of some consecutive texts: where they lie, whose they are, their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        """``data``: UTF-8 bytes; text t is ``data[offsets[t]:offsets[t + 1]]``."""
        self.data = _LOWER[data] if lower else data
        n = len(data)
        space = _SPACE[data]
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        #: The words of text t are those from first[t] to first[t + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.space = space

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.repeat(self.starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        at += np.arange(len(at))
        place = at - np.repeat(self.starts, lengths)
        value = (self.data[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(value, np.concatenate(([0], np.cumsum(lengths)[:-1]))))

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words (those that ``keep`` marks) joined by one space: bytes and each text's (start, end)."""
        starts, ends, counts = self.starts, self.ends, np.diff(self.first)
        if keep is not None:
            total = np.concatenate(([0], np.cumsum(keep)))
            counts = total[self.first[1:]] - total[self.first[:-1]]
            starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return np.zeros(0, np.uint8), np.zeros((len(counts), 2), np.int64)
        room = ends - starts + 1
        stop = np.cumsum(room)
        at = np.repeat(starts - (stop - room), room)
        at += np.arange(len(at))
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[stop - 1] = 32
        bounds = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(counts)))]
        first, last = bounds[:-1], bounds[1:]
        return out, np.stack((first, np.where(counts > 0, last - 1, first)), 1)

    def digests(self, keep: np.ndarray | None = None) -> list[str]:
        """SHA-256 of each text's words joined by one space."""
        data, at = self.joined(keep)
        view = memoryview(data)
        return [hashlib.sha256(view[s:e]).hexdigest() for s, e in at.tolist()]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive values (``len - k + 1`` of them)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(n), dtype=np.uint64)))
    return mix((total[k:] - total[: n - k + 1]) * powers(n - k + 1, inverse=True))


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, at


def pieces(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for consecutive rows of a text column; null: no words."""
    if not len(column):
        return
    data, at = _utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower)
        lo = hi
