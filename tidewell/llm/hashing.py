"""Vectorised hashes of byte strings, and packed columns for shuffles of many small entries."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@cache
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class Spans:
    """Hashes of any spans of one buffer: equal bytes, equal hash, wherever they stand."""

    def __init__(self, buffer: np.ndarray, values: np.ndarray = BYTES) -> None:
        n = 1 << max(16, int(len(buffer) + 1).bit_length())
        self.back = powers(INVERSE, n)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(values[buffer] * powers(BASE, n)[: len(buffer)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, width: int) -> np.ndarray:
        """The hash of every span of this width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n]) if n > 0 else self.sums[:0]


def pack(column: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, all first bytes first, so that zeros compress well."""
    raw = np.ascontiguousarray(column).astype("<i8" if column.dtype.kind == "i" else "<u8")
    return raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    """The values of several packed columns in a row, as unsigned numbers."""
    out = []
    for raw in packed:
        planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :width] = planes.T
        out.append(wide.view("<u8").ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def trim() -> None:
    """Free memory goes back to the system instead of waiting for this worker's next allocation."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def tidy() -> None:
    """Give memory back at a task's end: Python workers live on, beside the executor's heap."""
    powers.cache_clear()
    gc.collect()
    trim()


def tidied(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, with its working memory given back before the next group comes."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            trim()

    return run
