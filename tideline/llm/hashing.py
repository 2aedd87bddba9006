"""Vectorised hashing of bytes and words over whole slices of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random-looking 64-bit value for every byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


class Powers:
    """BASE**i and its inverses, grown as needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length() if n > 1 else 1
            up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up, cls.down


def sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of values[i:j] times BASE**i."""
    up, _ = Powers.get(len(values) + 1)
    p = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=p[1:])
    return p


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``sums`` of the bytes' values."""
    return sums(BYTE_VALUE[data])


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds; depends on the bytes and nothing else."""
    _, down = Powers.get(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U))


def buffers(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and n + 1 bounds of the texts in them.

    Words are stretches without the bytes 20 and 09 to 0D (hex), cut at text bounds; with
    ``lower``, A-Z count as a-z.
    """
    data = raw
    if lower:
        data = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    start, end, bounds = word_bounds(data, offsets)
    return span_hashes(prefix_sums(data), start, end), bounds


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in order, and n + 1 bounds of the texts in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = solid[inner]
    finish[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


_ORDER = np.array([0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F], U)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none an empty set."""
    n = len(words)
    full = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        full += words[j : j + len(full)] * _ORDER[j]
    full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _ORDER[: b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
