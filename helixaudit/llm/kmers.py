"""Vectorised hashing of letter windows, shared by the sequence operators.

All functions work on a *block*: the letters of many records in one ``uint8`` array plus the
offsets of the records in it. No function loops over letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers and a letter table for the hashes. Any odd 64-bit numbers would do.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Letters handled at once; bounds the memory of a block to some tens of MB.
BLOCK_LETTERS = 1_000_000


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and record offsets of an Arrow string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return letters[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(letters: np.ndarray, offsets: np.ndarray, size: int = BLOCK_LETTERS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole records of about ``size`` letters: (first record, letters, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, letters[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def owners(offsets: np.ndarray) -> np.ndarray:
    """Record index of each letter."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``k`` values, by joining runs of doubling length."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, length, whole, done = values, 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            # The new piece lies behind what is joined so far.
            whole = power if whole is None else whole[: len(power) - done] * np.uint64(pow(base, length, 1 << 64)) + power[done:]
            done += length
        rest >>= 1
        if rest:
            power = power[: len(power) - length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
    return whole[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise a polynomial hash so that all of its bits depend on all letters."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def window_hashes(letters: np.ndarray, owner: np.ndarray, k: int, base: int = BASE_A) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hash of the window starting at each letter, and whether that window lies in one record."""
    if len(letters) < k:
        return np.empty(0, np.uint64), np.empty(0, bool)
    return mixed(rolling(LETTERS[letters], k, base)), owner[: len(owner) - k + 1] == owner[k - 1 :]


def distinct_windows(letters: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, hash) of the distinct windows of each record, sorted by record and hash.

    The hash keeps 64 bits; two windows of the two records of a pair that differ collide with a
    probability of about 10^-14.
    """
    owner = owners(offsets)
    h, inside = window_hashes(letters, owner, k)
    rec, h = owner[: len(h)][inside], h[inside]
    order = np.lexsort((h, rec))
    rec, h = rec[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (h[1:] != h[:-1])
    return rec[new], h[new]


def distinct_counts(letters: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Number of distinct windows of each record."""
    return np.bincount(distinct_windows(letters, offsets, k)[0], minlength=len(offsets) - 1)


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``w`` consecutive values."""
    out, length = values, 1
    while length * 2 <= w:
        out = pick(out[: len(out) - length], out[length:])
        length *= 2
    if length < w:
        out = pick(out[: len(out) - (w - length)], out[w - length :])
    return out


def local_minima(h: np.ndarray, owner: np.ndarray, k: int, w: int) -> np.ndarray:
    """Starts of the ``k``-letter seeds that are smallest among some ``w`` consecutive seeds of their record.

    Two records that have ``k + w - 1`` letters in common select the same seed in them, wherever
    they lie, so selection resists shifts.
    """
    if len(h) < w:
        return np.empty(0, np.int64)
    low = sliding(h, w, np.minimum)
    low[owner[: len(low)] != owner[k + w - 2 : k + w - 2 + len(low)]] = 0
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero(sliding(padded, w, np.maximum) == h)
