"""Words of many texts at once: an Arrow batch is split and hashed by whole-array steps, whatever its texts' lengths.

Words are what stands between ASCII white space, A-Z in lower case. A word's hash is the sum of its bytes times powers of an
odd number, as a difference of running sums, mixed with its length (64 bits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that one running sum goes over; a longer word is hashed alone.
_SLICE = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0 .. base ** (n - 1) and their inverses, modulo 2 ** 64."""
    each = (base, pow(base, -1, 1 << 64))
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), b, np.uint64)), dtype=np.uint64)[:n] for b in each)
    return up, down


_UP, _DOWN = powers(_SLICE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of text i are first[i] to first[i + 1]; starts and ends are places in data."""

    data: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def cut(self, i: int, start: int, end: int) -> bytes:
        """The text of words start to end (exclusive) of text i."""
        a, b = self.first[i] + start, min(self.first[i] + end, self.first[i + 1])
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes() if a < b else b""


def words(texts: pa.Array, hashed: bool = True) -> Words:
    """The words of a column of binary; null texts have none. Hashes are left out if they are not needed."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    wide = np.dtype(np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    buffers = texts.buffers()
    cuts = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[cuts[0] : cuts[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    inside = (raw != 32) & (raw - np.uint8(9) > 4)  # unsigned: 9 to 13 are white space
    border = np.zeros(len(raw) + 1, bool)
    border[cuts] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    lower, hashes = raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)), np.empty(len(starts), np.uint64)
    a = 0
    while hashed and a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLICE, "right")))
        low, high = starts[a], ends[b - 1]
        if high - low > _SLICE:
            hashes[a] = xxhash.xxh3_64_intdigest(lower[low:high].tobytes())
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(lower[low:high] * _UP[: high - low], out=sums[1:])
            at = starts[a:b] - low
            hashes[a:b] = mixed((sums[ends[a:b] - low] - sums[at]) * _DOWN[at] + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return Words(raw, hashes, np.searchsorted(starts, cuts), starts, ends)


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of `size` words, first): those of text i are first[i] to first[i + 1]."""
    counts = np.maximum(np.diff(w.first) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = max(len(w.hashes) - size + 1, 0)
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = (value ^ w.hashes[k : n + k]) * np.uint64(_BASE)
        value ^= value >> np.uint64(32)
    if first[-1] < n:  # without those that begin in one text and end in another
        value = value[np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)]
    return value, first
