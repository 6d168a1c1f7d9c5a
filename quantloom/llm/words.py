"""Words of Arrow string columns as 64-bit hashes, by array operations over the UTF-8 bytes.

A word's hash is a polynomial over its bytes (A-Z as a-z), taken from running sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK, SLICE = 1 << 20, 1 << 21
_A = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_A), -1, 1 << 64))


def _lower() -> np.ndarray:
    t = np.arange(256)
    t[65:91] += 32
    return t


LOWER = _lower().astype(np.uint8)
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_LOWER = BYTE[LOWER]
#: Bytes outside words: white space alone, or all of ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(BLOCK + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


POW, INV = _powers(_A), _powers(_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets into them; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=kind, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with at most SLICE bytes of text (or one row), with their buffers."""
    for b in batches:
        _, offsets = buffers(b.column(text))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            part = b.slice(i, j - i)
            yield part, *buffers(part.column(text))
            i = j


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and each row's first word (one more entry at the end)."""
    inside = ~outside[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """64-bit hashes of the words, never 0."""
    out, i, n = np.empty(len(starts), dtype=np.uint64), 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:  # a word of more than a block
            low = LOWER[data[base : ends[i]]] if table is BYTE_LOWER else data[base : ends[i]]
            out[i] = np.frombuffer(hashlib.blake2b(low.tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
            i += 1
            continue
        run = np.zeros(ends[j - 1] - base + 1, dtype=np.uint64)
        np.cumsum(table[data[base : ends[j - 1]]] * POW[: len(run) - 1], out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * INV[s]
        i = j
    return np.maximum(mix(out), np.uint64(1))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, by their first; the caller leaves out those that cross rows."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out + np.uint64(k))
