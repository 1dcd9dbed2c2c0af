"""Words of many texts at once, as 64-bit hashes, by whole-array NumPy operations.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; it never spans two texts. Its hash is a
polynomial over a random table of byte values modulo 2**64 (odd base, so prefix sums can be shifted by the inverse
power), passed through a finaliser with the length. Nothing is done per word in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20240501


def _byte_table() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _byte_table()[_LOWER]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), or the inverse's, modulo 2**64."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]. Null is empty."""
    col = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    n = int(bounds[-1] - bounds[0]) if len(col) else 0
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    space = _SPACE[data]
    solid = ~space
    first, last = solid.copy(), solid.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]  # of the texts that hold bytes
    first[begin] = solid[begin]
    end = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[end] = solid[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("up", n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds).astype(np.int64)
