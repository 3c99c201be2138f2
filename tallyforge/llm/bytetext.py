"""Texts of an Arrow column as one numpy byte array: words, hashes, shingles and rolling hashes.

All functions are pure and run inside Spark tasks. Texts are handled whole; a batch is only walked in
pieces of some rows, so that the arrays made from it stay small.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

PIECE_BYTES = 1 << 18

# The finalizer of the public splitmix64 generator and two odd multipliers.
MIX_1, MIX_2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE, COMBINE = 0xD1342543DE82EF95, 0xAEF17502108EF2D9


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(seed)) * np.uint64(STEP))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def not_blank() -> np.ndarray:
    """Bytes of words: all but space and the five controls from tab to carriage return."""
    table = np.ones(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Bytes of words: a-z, A-Z, 0-9 and everything outside ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Walk a string column: (first row, row after the last, their bytes, bounds of each row in them).
    A null is an empty text; a text longer than ``piece_bytes`` is a piece of its own."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + piece_bytes, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of its first word (one more at the end)."""
    inside = is_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words in lower case (A-Z only); tables of powers grow with the longest piece seen."""

    def __init__(self, seed: int = 1):
        self.values = byte_values(seed)[lower_ascii()]
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.sums(data), starts, ends)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and for each text the number of its first run.
    A text with fewer words has one run, all its words; a text without words none."""
    n = len(words)
    if not n:
        return words, np.zeros(len(firsts), np.int64)
    counts = np.diff(firsts)
    end = np.repeat(firsts[1:], counts)
    at = np.arange(n)
    run = words.copy()
    for j in range(1, size):
        further = at + j < end
        longer = mix(run * np.uint64(COMBINE) + words[np.minimum(at + j, n - 1)])
        run = np.where(further, longer, run)
    keep = at + size <= end
    keep[firsts[:-1][(counts > 0) & (counts < size)]] = True
    return run[keep], np.concatenate([[0], np.cumsum(keep)])[firsts]


def distinct_runs(runs: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's runs once, ascending."""
    parts = [np.unique(runs[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    counts = [len(p) for p in parts]
    return np.concatenate(parts) if parts else runs, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_column(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values))
