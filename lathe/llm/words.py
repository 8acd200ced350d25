"""Words of many texts as 64-bit hashes, without a Python step per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n positions at least."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of its rows' words, where each row's words begin, with the end) for runs of rows; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        off_type = np.int64
    else:
        off_type = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, off_type, count=n + 1, offset=texts.offset * off_type().itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1)
        yield row, *_hash(data[off[row] : off[end]], off[row : end + 1] - off[row])
        row = end


def _hash(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(raw)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[:-1][off[:-1] < size]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[1:][off[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(raw, starts, ends), np.searchsorted(starts, off).astype(np.int64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, in order and without overlap; A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        a, b = starts[at:end] - base, ends[at:end] - base
        power, inverse = _tables(int(b[-1]) + 1)
        sums = np.zeros(int(b[-1]) + 1, np.uint64)
        np.cumsum((_LOWER[raw[base : base + b[-1]]].astype(np.uint64) + np.uint64(1)) * power[: b[-1]], out=sums[1:])
        out[at:end] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = end
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k neighbouring words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return _folded(words.reshape(1, -1).T)
    return np.unique(_folded(np.stack([words[j : n - k + 1 + j] for j in range(k)])))


def _folded(parts: np.ndarray) -> np.ndarray:
    s = np.full(parts.shape[1], len(parts), np.uint64)
    for p in parts:
        s = mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + p)
    return s
