"""Words and rolling hashes of Arrow text columns, computed on the raw UTF-8 bytes with numpy.

Texts are never decoded: a separator table of 256 bytes tells words from gaps, and hashes of words and of
runs of words come from prefix sums modulo 2**64. Work goes in slices of about a MB, cut between documents, so
memory follows the slice (or one very long document) and not the batch. Within a slice all sums run in chunks of
CHUNK bytes or words, whose powers are the only tables kept.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes or words summed at once.
CHUNK = 1 << 16

_MASK = (1 << 64) - 1
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def tidy() -> None:
    """Give free memory back to the system: Spark keeps its Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(batches: Callable) -> Callable:
    """A function of batches whose task begins and ends with tidy(): what the task before left in cycles (its model, its
    caches) goes before this one takes memory of its own."""

    @wraps(batches)
    def run(*args):
        tidy()
        yield from batches(*args)
        tidy()

    return run


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE = 1 << 13


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    for low in range(0, len(x), 1 << 18):
        part = x[low : low + (1 << 18)]
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(27)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base."""
    steps = np.full(n, base & _MASK, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_UP, _DOWN = _powers(_BYTE, CHUNK), _powers(pow(_BYTE, -1, 1 << 64), CHUNK)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(data: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row (and the end) the index of its first word."""
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    edges = np.unique(at[(at > 0) & (at < len(data))])
    starts, ends = [], []
    for low in range(0, len(data), 16 * CHUNK):
        high = min(low + 16 * CHUNK, len(data))
        inside = ~gaps[data[low : high + 1]]  # and one byte of the next chunk
        n = high - low
        before = low > 0 and not gaps[data[low - 1]]
        start = inside[:n].copy()
        start[1:] &= ~inside[: n - 1]
        if before:
            start[0] = False
        end = inside[:n].copy()
        end[: len(inside) - 1] &= ~inside[1:]
        own = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
        start[own] = inside[own]
        own = edges[np.searchsorted(edges, low, side="right") : np.searchsorted(edges, high, side="right")] - 1 - low
        end[own] = inside[own]
        starts.append((np.flatnonzero(start) + low).astype(kind))
        ends.append((np.flatnonzero(end) + low + 1).astype(kind))
    starts = np.concatenate(starts) if starts else np.zeros(0, dtype=kind)
    return starts, np.concatenate(ends) if ends else starts, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of them, summed over the chunks that the word lies in."""
    out = np.zeros(len(starts), dtype=np.uint64)
    sums = np.zeros(CHUNK + 1, dtype=np.uint64)
    for low in range(0, len(data), CHUNK):
        high = min(low + CHUNK, len(data))
        i, j = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high))
        if i == j:
            continue
        np.cumsum(_VALUES[data[low:high]] * _UP[: high - low], out=sums[1 : high - low + 1])
        begin = np.maximum(starts[i:j], low) - low
        part = (sums[np.minimum(ends[i:j], high) - low] - sums[begin]) * _DOWN[begin]
        if starts[i] < low:  # the rest of a word that began before
            part[:1] *= np.uint64(pow(_BYTE, low - int(starts[i]), 1 << 64))
        out[i:j] += part
    out += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(out)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of k words inside a row: (hash, index of the first word, row).

    short: a row of fewer than k words, but not none, counts as one run.
    """
    rows = len(first) - 1
    count = np.diff(first)
    runs = np.maximum(count - k + 1, (count > 0) if short else 0)
    kind = np.int32 if len(hashes) < 1 << 31 else np.int64
    row = np.repeat(np.arange(rows, dtype=kind), runs)
    begin = np.cumsum(runs) - runs
    word = np.arange(len(row), dtype=kind)
    word += np.repeat((first[:-1] - begin).astype(kind), runs)
    out = np.empty(len(row), dtype=np.uint64)
    up, down = _powers(_WORD, CHUNK + k), _powers(pow(_WORD, -1, 1 << 64), CHUNK + k)
    sums = np.zeros(CHUNK + k + 1, dtype=np.uint64)
    for low in range(0, len(hashes), CHUNK):
        i, j = int(np.searchsorted(word, low)), int(np.searchsorted(word, low + CHUNK))
        if i == j:
            continue
        high = min(low + CHUNK + k, len(hashes))
        np.cumsum(hashes[low:high] * up[: high - low], out=sums[1 : high - low + 1])
        at, long = word[i:j] - low, np.minimum(count[row[i:j]], k)
        out[i:j] = (sums[at + long] - sums[at]) * down[at] + long.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(out), word, row


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, high: int, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Words low to high without those of the intervals (counted from low), joined by one space. Lists of
    words are made of _PIECE words at most."""
    edges = [low, *(low + np.stack([begin, end], axis=1).reshape(-1)).tolist(), high]
    pieces = ((k, min(k + _PIECE, b)) for a, b in zip(edges[::2], edges[1::2], strict=True) for k in range(a, b, _PIECE))
    return b" ".join(b" ".join(data[starts[a] : ends[b - 1]].tobytes().split()) for a, b in pieces)


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as bytes, one Arrow binary value each, without a copy for each row."""
    values = np.ascontiguousarray(values)
    offsets = np.ascontiguousarray((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8) if len(values) else b"")])


def heads(*columns: np.ndarray) -> np.ndarray:
    """True where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new
