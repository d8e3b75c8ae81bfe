"""Vectorised word, window and set hashing over Arrow text columns."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the two polynomial hashes, over bytes and over words.
BYTE_BASE, WORD_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_power: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _power.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=U)
        step[0] = 1
        have = _power[base] = np.multiply.accumulate(step)
    return have[:n]


@functools.lru_cache(None)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many spans, the same for the same values anywhere."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(inverse(base), len(values) + 1)[start] + (end - start).astype(U))


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts; nulls are empty."""
    if text.null_count:
        text = text.fill_null("")
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(text: pa.Array, lower: bool = False):
    """(bytes, word starts, word ends, first word of each text): words are runs of anything but 0x20 and 0x09-0x0D."""
    raw, at = utf8(text)
    if lower:
        raw = LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    starts = inside[1:-1] & ~inside[:-2]
    starts[at[:-1][at[:-1] < len(raw)]] |= inside[1:-1][at[:-1][at[:-1] < len(raw)]]
    ends = inside[1:-1] & ~inside[2:]
    ends[at[1:-1][at[1:-1] > 0] - 1] |= inside[1:-1][at[1:-1][at[1:-1] > 0] - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return raw, start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return spans(raw.astype(U) + U(1), BYTE_BASE[which], start, end)


def window_hashes(word: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` words; the caller masks the runs that cross texts."""
    n = max(0, len(word) - size + 1)
    i = np.arange(n)
    return spans(word, WORD_BASE[which], i, i + size)
