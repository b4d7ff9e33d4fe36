"""Composition of sequences in one pass: lengths, shares of characters and pairs, and what stands at each position.

Whole Arrow batches are counted at once in arrays, so the work is linear in the letters, however long the sequences
are, and no letter becomes a row. Equal results are summed in the task before they leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters counted at once, and rows of results that are summed at a time; both bound the memory of a task.
BLOCK_LETTERS, HELD_ROWS = 2_000_000, 1_000_000


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of an Arrow string column without nulls, one after the other, and the offsets of the texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not (data & 128).any():
        return data, offsets
    # A code point begins at every byte that does not continue one.
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), begins[offsets]


def blocks(points: np.ndarray, offsets: np.ndarray):
    """(first text, code points, offsets) of runs of whole texts of about ``BLOCK_LETTERS``."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_LETTERS, "right")) - 1)
        yield first, points[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def counted(key: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``cells`` and how often each occurs."""
    if cells > 8 * len(key) + 1024:
        return np.unique(key, return_counts=True)
    n = np.bincount(key, minlength=cells)
    at = np.flatnonzero(n)
    return at, n[at]


class Tally:
    """Sums rows of equal keys. What it holds is summed at ``HELD_ROWS`` rows, and passed on if that leaves more than half of them."""

    def __init__(self, *keys: str):
        self.keys, self.parts, self.rows = list(keys), [], 0

    def add(self, n: np.ndarray, **columns):
        self.parts.append(pa.table({k: columns[k] for k in self.keys} | {"n": pa.array(n, pa.int64())}))
        self.rows += len(n)

    def summed(self) -> pa.Table:
        table = pa.concat_tables(self.parts).group_by(self.keys).aggregate([("n", "sum")])
        return table.rename_columns([*self.keys, "n"])

    def excess(self):
        if self.rows > HELD_ROWS:
            self.parts = [self.summed()]
            self.rows = self.parts[0].num_rows
            if self.rows > HELD_ROWS // 2:
                yield from self.flush()

    def flush(self):
        if self.parts:
            yield from self.summed().combine_chunks().to_batches(max_chunksize=50_000)
        self.parts, self.rows = [], 0


def texts_of(first: np.ndarray, second: np.ndarray | None = None) -> pa.Array:
    """Code points, or pairs of them, as strings."""
    both = [first] if second is None else [first, second]
    kinds, at = np.unique(np.stack(both, 1), axis=0, return_inverse=True)
    return pa.array(["".join(map(chr, k)) for k in kinds.tolist()], pa.string()).take(pa.array(at.reshape(-1)))


def shares(points: np.ndarray, offsets: np.ndarray, pairs: bool):
    """(text, first, second or None, share): shares of the characters (or pairs of neighbours) that each text has, from its own."""
    length = np.diff(offsets)
    owner = np.repeat(np.arange(len(length)), length)
    kinds, dense = np.unique(points, return_inverse=True)
    a = len(kinds)
    if not pairs:
        key, n = counted(owner * a + dense, len(length) * a)
        return key // a, kinds[key % a], None, n / length[key // a]
    inside = owner[1:] == owner[:-1]
    key, n = counted(((owner[:-1] * a + dense[:-1]) * a + dense[1:])[inside], len(length) * a * a)
    return key // (a * a), kinds[key // a % a], kinds[key % a], n / (length[key // (a * a)] - 1)


def composition(s: DataFrame, names: dict[str, str], tally: bool = True) -> DataFrame:
    """(check, label, feature, value, n): sequences of each class by value; ``names`` gives the check of each wanted kind among length, gc, base and pair.

    ``s`` is (label, seq) without null sequences. Sequences that lack a character or pair have no row for it; an empty one
    has a length and a GC content of 0. Without ``tally`` each sequence has rows of its own.
    """

    def run(batches):
        out = Tally("check", "label", "feature", "value")

        def put(check: str, label: pa.Array, feature: pa.Array | None, value: np.ndarray):
            feature = pa.array([""], pa.string()).take(pa.array(np.zeros(len(value), np.int64))) if feature is None else feature
            rows = {"check": pa.array([check], pa.string()).take(pa.array(np.zeros(len(value), np.int64))), "label": label, "feature": feature, "value": pa.array(value, pa.float64())}
            if tally:
                out.add(np.ones(len(value), np.int64), **rows)
                return []
            return pa.table(rows | {"n": pa.array(np.ones(len(value), np.int64))}).combine_chunks().to_batches()

        for batch in batches:
            labels = batch.column(0)
            for first, points, offsets in blocks(*code_points(batch.column(1))):
                own = labels.slice(first, len(offsets) - 1)
                length = np.diff(offsets)
                if "length" in names:
                    yield from put(names["length"], own, None, length.astype(float))
                if "gc" in names:
                    strong = np.concatenate([[0], np.cumsum((points == ord("G")) | (points == ord("C")))])
                    yield from put(names["gc"], own, None, np.diff(strong[offsets]) * 100.0 / np.maximum(length, 1))
                for kind in ("base", "pair"):
                    if kind in names and len(points):
                        text, one, two, value = shares(points, offsets, kind == "pair")
                        yield from put(names[kind], own.take(pa.array(text)), texts_of(one, two), value)
                yield from out.excess()
        yield from out.flush()

    return s.select("label", "seq").mapInArrow(run, "check string, label string, feature string, value double, n bigint")


def positions(s: DataFrame, directions: tuple[bool, ...]) -> DataFrame:
    """(label, reverse, pos, base, n), not summed over tasks: characters at each 1-based position from either end of (label, seq, last).

    Positions past ``last`` are left out; where it is null, none are.
    """

    def run(batches):
        out = Tally("label", "reverse", "pos", "base")
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            label_of, labels = coded.indices.to_numpy(), coded.dictionary
            last = batch.column(2).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
            for first, points, offsets in blocks(*code_points(batch.column(1))):
                length = np.diff(offsets)
                owner = np.repeat(np.arange(len(length)), length)
                kinds, dense = np.unique(points, return_inverse=True)
                ahead = np.arange(len(points)) - offsets[:-1][owner]
                for reverse in directions:
                    at = length[owner] - 1 - ahead if reverse else ahead
                    use = at < last[first + owner]
                    if not use.any():
                        continue
                    a, top = len(kinds), int(at[use].max()) + 1
                    key, n = counted(((label_of[first + owner][use] * a + dense[use]) * top + at[use]).astype(np.int64), len(labels) * a * top)
                    place = pa.array((key // top // a).astype(np.int64))
                    out.add(n, label=labels.take(place), reverse=pa.array(np.full(len(key), reverse)), pos=pa.array((key % top + 1).astype(np.int32)), base=texts_of(kinds[key // top % a]))
                yield from out.excess()
        yield from out.flush()

    return s.select("label", "seq", F.col("last").cast("bigint")).mapInArrow(run, "label string, reverse boolean, pos int, base string, n bigint")


def frames(numbered: DataFrame) -> DataFrame:
    """(no, label, length, gc, bases map, pairs map): the values of each sequence of (no, label, seq), characters and pairs it lacks left out."""

    def run(batches):
        for batch in batches:
            for first, points, offsets in blocks(*code_points(batch.column(2))):
                n = len(offsets) - 1
                own = batch.slice(first, n)
                length = np.diff(offsets)
                strong = np.concatenate([[0], np.cumsum((points == ord("G")) | (points == ord("C")))])
                maps = []
                for pairs in (False, True):
                    text, one, two, value = shares(points, offsets, pairs) if len(points) else (np.zeros(0, np.int64), np.zeros(0, np.uint8), None, np.zeros(0))
                    begins = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                    maps.append(pa.MapArray.from_arrays(pa.array(begins), texts_of(one, two), pa.array(value, pa.float64())))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(length, pa.int64()), pa.array(np.diff(strong[offsets]) * 100.0 / np.maximum(length, 1)), *maps], names=["no", "label", "length", "gc", "bases", "pairs"])

    return numbered.select("no", "label", "seq").mapInArrow(run, "no bigint, label string, length bigint, gc double, bases map<string,double>, pairs map<string,double>")


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the ``k`` code points from each place on, in k steps over the whole array."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        # Mixed at every step, so that each bit depends on all letters and their order.
        h = (h ^ (points[i : i + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)
