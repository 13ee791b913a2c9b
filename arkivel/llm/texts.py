"""Texts of an Arrow column as numpy arrays: words, word hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multipliers of the hash functions; fixed values.
BASE, MIX1, MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64 for all i below n."""
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, ends, data): the words of text i are first[i] to first[i + 1] - 1, at starts:ends in data."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    head[cuts] |= inside[cuts]
    tail[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return np.searchsorted(starts, offsets, "left"), starts, ends, data


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for every pair of starts and ends, by prefix sums of a polynomial."""
    out, i, n = np.empty(len(starts), _U), 0, len(starts)
    while i < n:  # in segments, so that a long text takes no more memory than its longest word asks for
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + GROUP_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, _U)
        np.cumsum((data[low:high].astype(_U) + _U(1)) * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * MIX1)
        i = j
    return out


def shingles(first: np.ndarray, h: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Of every text the sorted distinct hashes of its word n-grams; a text of fewer words has one, of all its words."""
    factors = np.multiply.accumulate(np.full(width, MIX2, _U))
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, _U)
    for k in range(width):
        rolled += h[k : k + n] * factors[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((h[a:b] * factors[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(arr: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every text of an Arrow column."""
    offsets, data = column(arr)
    for i, j in groups(offsets):
        first, starts, ends, low = words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        yield from enumerate(shingles(first, hashes(low, starts, ends), width), i)
