"""Spans of many texts at once: bytes of an Arrow column and hashes of its spans, by whole-array steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .words import mixed, powers

#: Bytes that one running sum goes over; a longer span is hashed alone.
SLICE = 1 << 17
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS = [powers(SLICE, base) for base in BASES]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, cuts) of a column of binary: text i is bytes[cuts[i] : cuts[i + 1]]; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    wide = np.dtype(np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    buffers = texts.buffers()
    cuts = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[cuts[0] : cuts[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return raw, cuts - cuts[0]


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of true, none of which goes over a cut."""
    border = np.zeros(len(inside) + 1, bool)
    border[cuts] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of spans in order of their place: bytes times powers of an odd number, mixed with the length."""
    up, down = _POWERS[which]
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        low, high = starts[a], ends[b - 1]
        if high - low > SLICE:
            out[a] = xxhash.xxh3_64_intdigest(data[low:high].tobytes(), seed=which)
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(data[low:high] * up[: high - low], out=sums[1:])
            at = starts[a:b] - low
            out[a:b] = mixed((sums[ends[a:b] - low] - sums[at]) * down[at] + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out
