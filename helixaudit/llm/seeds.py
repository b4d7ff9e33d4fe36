"""Seed selection bounds and the compact exchange of (seed, record) postings between tasks.

A plain shuffle of one row per posting costs about 30 bytes and a few hundred nanoseconds each.
Here every map task sorts its postings, cuts them by seed range into buckets and ships each bucket
as one packed binary value (about 9 to 13 bytes a posting, no per-posting work in the JVM). All
postings of a seed meet in one bucket, so a bucket can be joined on its own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import parallelism
from . import kmers

#: Letters of a window, as the similarity is defined on.
WINDOW = 12
#: Letters of a seed, and bits of its hash that are exchanged. Selected seeds crowd at low hashes, so random
#: sequences share one about once in 4^SEED / 9 trials; with 16 letters and 32 bits, such false
#: candidates already outnumber the true ones in half a million records and grow with the square.
SEED, KEY_BITS = 18, 40
#: A changed, inserted or lost letter spoils 10 to 13 windows; this many are taken for granted.
#: The slack covers edits inside short tandem repeats, which spoil fewer.
LEAST_GAP = 8
#: Widths of selection windows in use; a record takes the largest that its bound allows.
WIDTHS = (1, 2, 3, 4, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32)


def longest_run(m: int, threshold: float) -> int:
    """Shared windows in a row that the smaller of two similar records has at least, if it has ``m``.

    Similarity ``t`` of sets of sizes m <= b means t/(1+t)*(m+b) >= 2t/(1+t)*m common windows, so at
    most (1-t)/(1+t)*m of the smaller set are lost, in at most lost/LEAST_GAP inner gaps.
    """
    lost = math.floor(m * (1 - threshold) / (1 + threshold) + 1e-9)
    return -(-(m - lost) // (lost // LEAST_GAP + 1))


@lru_cache(maxsize=8)
def _widths(threshold: float, seed: int) -> np.ndarray:
    top = 4096
    spare = np.array([max(1, longest_run(m, threshold) + WINDOW - seed) if m else 1 for m in range(top + 1)])
    spare = np.minimum.accumulate(spare[::-1])[::-1]  # a bound for all records of at least m windows
    allowed = np.array(WIDTHS)
    return allowed[np.searchsorted(allowed, spare, "right") - 1]


def widths(sizes: np.ndarray, threshold: float, seed: int = SEED) -> np.ndarray:
    """Selection width for records of ``sizes`` distinct windows, safe as the smaller of a pair."""
    table = _widths(threshold, seed)
    return table[np.minimum(sizes, len(table) - 1)]


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Eight classes per doubling of the size."""
    return np.floor(8 * np.log2(np.maximum(sizes, 1))).astype(np.int64).clip(0, 255)


def class_bounds() -> tuple[np.ndarray, np.ndarray]:
    """Sizes that each class spans, a little wide of rounding."""
    edge = 2.0 ** (np.arange(257) / 8)
    return np.ceil(edge[:-1] - 1e-6), np.ceil(edge[1:] + 1e-6) - 1


def seed_bound(m: np.ndarray, b: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """Selected seeds that records of ``m`` and ``b`` >= ``m`` windows have in common at least if they are similar, and all windows of each are distinct.

    They have O >= t/(1+t)*(m+b) windows in common, in at most R = (m-O)/LEAST_GAP + 1 runs. A run of L windows holds
    L-6 seeds. If at least one of every ``w`` seeds in a row is selected, in both records alike, these are at least (L-6-(w-1))/w.
    """
    common = threshold / (1 + threshold) * (m + b)
    runs = np.maximum(m - common, 0) / LEAST_GAP + 1
    return np.ceil((common - runs * (w + SEED - WINDOW - 1)) / w - 1e-6).clip(1, 1 << 30).astype(np.int64)


@lru_cache(maxsize=8)
def shared_seeds(threshold: float) -> np.ndarray:
    """[class, class]: minima that similar records of these size classes have in common at least.

    The width in use is that of the larger record. :func:`seed_bound` is linear in both sizes, so it is least at the ends of
    the smaller one's class and the lower end of the other's.
    """
    low, high = class_bounds()
    width = widths(np.ceil(np.minimum(high, 1e6) * threshold).astype(np.int64), threshold).astype(float)
    out = np.minimum(*(seed_bound(m[:, None], np.maximum(low[None, :], m[:, None]), width[None, :], threshold) for m in (low, high)))
    # The row is the smaller one of the two classes.
    return np.triu(out) + np.triu(out, 1).T


def class_span(threshold: float) -> int:
    """Classes that the sizes of two similar records can lie apart."""
    return math.ceil(8 * math.log2(1 / threshold)) + 1


def set_sizes(letters: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct windows of each record (44 hash bits each: a clash only lowers a size by one)."""
    h, inside = kmers.window_hashes(letters, owner, WINDOW)
    keys = np.sort(owner[: len(h)][inside].astype(np.uint64) << np.uint64(44) | h[inside] >> np.uint64(20))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=len(offsets) - 1)


def keyed(h: np.ndarray) -> np.ndarray:
    """The leading KEY_BITS bits of hashes, as the exchange sorts and ships them."""
    return (h >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def scattered(seed: np.ndarray) -> np.ndarray:
    """Seeds renamed one to one, so that minima, which crowd at low hashes, spread evenly over the ranges of buckets."""
    return (seed.astype(np.uint64) * np.uint64(kmers.BASE_A) & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def in_range(seed: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Whether seeds lie in one of so many equal ranges."""
    return seed * parts >> KEY_BITS == part


def bitmap_place(seed: np.ndarray, bits: int, parts: int = 1) -> np.ndarray:
    """Bit of a seed in the bitmap of 2^bits bits of its range."""
    return (seed * parts & ((1 << KEY_BITS) - 1)) >> (KEY_BITS - bits)


def minimum_seeds(letters: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, seed of KEY_BITS bits, kind) of the seeds that are local minima; ``kind`` is twice the size class, and one more
    for a record whose windows are all distinct.

    A record uses the width that is safe for the smallest partner it can have. Minima of a wide
    window are minima of the narrower windows in it, so a pair meets in the seeds that the
    smaller record's own width selects.
    """
    owner = kmers.owners(offsets)
    h, inside = kmers.window_hashes(letters, owner, SEED)
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, none
    sizes = set_sizes(letters, offsets, owner)
    width = widths(np.ceil(sizes * threshold).astype(np.int64), threshold)
    kind = 2 * size_class(sizes) + (sizes == np.maximum(np.diff(offsets) - WINDOW + 1, 0))
    parts = []
    for w in np.unique(width):
        # Each width works on the letters of its own records.
        own = np.flatnonzero((width == w)[owner]) if len(width) > 1 else np.arange(len(letters))
        # No seed begins in the last letters of the last record.
        begin = own[: max(0, len(own) - SEED + 1)]
        own_h, own_inside, own_owner = h[begin], inside[begin], owner[own]
        at = np.flatnonzero(own_inside) if w == 1 else kmers.local_minima(own_h, own_owner, SEED, int(w))
        at = at[own_inside[at]]
        parts.append((own_owner[at].astype(np.int64), own_h[at]))
    rec, h = (np.concatenate(x) for x in zip(*parts))
    return rec, scattered(keyed(h)), kind[rec]


def packed(values: np.ndarray) -> bytes:
    """Integers as an offset and the fewest bytes each that hold them."""
    values = values.astype(np.int64)
    low = int(values.min()) if len(values) else 0
    span = int(values.max()) - low if len(values) else 0
    width = max(1, (span.bit_length() + 7) // 8)
    head = np.array([width, low, len(values)], np.int64).tobytes()
    return head + np.ascontiguousarray((values - low).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: memoryview) -> tuple[np.ndarray, memoryview]:
    """The first packed array of ``data`` and what follows it."""
    width, low, n = (int(x) for x in np.frombuffer(data[:24], np.int64))
    end = 24 + n * width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data[24:end], np.uint8).reshape(n, width)
    return wide.view(np.int64).reshape(-1) + low, data[end:]


class Exchange:
    """Collects postings of a map task and turns them into one packed row per bucket.

    With ``longest``, only so many postings of a seed and one more are sent from each flush (the seed is longer than that for
    all tasks then), and the numbers in the first column of the others are sent once, in buckets below zero, so that
    no seed, however frequent, fills a bucket.
    """

    schema = pa.schema([("bucket", pa.int64()), ("postings", pa.binary())])
    ddl = "bucket bigint, postings binary"

    def __init__(self, buckets: int, most: int = 3_000_000, longest: int | None = None):
        self.buckets, self.most, self.longest, self.held, self.n = buckets, most, longest, [], 0

    def add(self, seed: np.ndarray, *columns: np.ndarray, bucket: np.ndarray | None = None):
        """Take postings; yields packed rows when enough are held. Without ``bucket`` it is the seed's range."""
        self.held.append((seed, seed * self.buckets >> KEY_BITS if bucket is None else bucket, *columns))
        self.n += len(seed)
        if self.n >= self.most:
            yield from self.flush()

    def rows(self, bucket: np.ndarray, blobs: list[bytes]):
        # Rows go out in small batches: a blob column of a wide batch would be hundreds of MB.
        for i in range(0, len(blobs), 64):
            yield pa.record_batch([pa.array(bucket[i : i + 64], pa.int64()), pa.array(blobs[i : i + 64], pa.binary())], schema=self.schema)

    def flush(self):
        if not self.n:
            return
        seed, bucket, *columns = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        order = np.argsort(seed)
        if (np.diff(bucket[order]) < 0).any():
            order = np.lexsort((seed, bucket))
        seed, bucket, columns = seed[order], bucket[order], [c[order] for c in columns]
        if self.longest is not None:
            drop = surplus(seed, columns[0], self.longest)
            if drop.any():
                alone = np.unique(columns[0][drop])
                at = alone % self.buckets
                order = np.argsort(at)
                alone, at = alone[order], at[order]
                cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
                yield from self.rows(-1 - at[cuts[:-1]], [packed(alone[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
                seed, bucket, columns = seed[~drop], bucket[~drop], [c[~drop] for c in columns]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(seed)]])
        yield from self.rows(bucket[starts], [packed(np.diff(seed[a:b], prepend=0)) + b"".join(packed(c[a:b]) for c in columns) for a, b in zip(starts, ends)])


def surplus(seed: np.ndarray, number: np.ndarray, longest: int) -> np.ndarray:
    """Marks the postings of sorted ``seed`` beyond ``longest`` + 1 different numbers of a seed, and their repetitions."""
    start = np.flatnonzero(np.diff(seed, prepend=-1))
    length = np.diff(np.append(start, len(seed)))
    drop = np.zeros(len(seed), bool)
    for at, n in zip(start[length > longest], length[length > longest]):
        _, once = np.unique(number[at : at + n], return_index=True)
        if len(once) > longest:
            drop[at : at + n] = True
            drop[at + once[: longest + 1]] = False
    return drop


def by_bucket(rows, buckets: int):
    """Rows grouped by bucket, with the buckets dealt out evenly to the tasks. The number of tasks is set, as a bucket costs far more work than its bytes suggest."""
    tasks = max(parallelism(rows.sparkSession), min(buckets, buckets // 8))
    dealt = rows.withColumn("task", F.pmod("bucket", F.lit(tasks).cast("bigint")).cast("int"))
    return dealt.repartitionById(tasks, "task").groupBy("task", "bucket")


def gathered(blobs) -> list[np.ndarray]:
    """Columns of all packed rows of a bucket; the first is the seed."""
    parts = []
    for blob in blobs:
        rest, columns = memoryview(blob), []
        while len(rest):
            values, rest = unpacked(rest)
            columns.append(values)
        columns[0] = np.cumsum(columns[0])
        parts.append(columns)
    return [np.concatenate(x) for x in zip(*parts)]


def common_windows(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of each left text, of each right text, and those they have in common.

    Works on at most 4,096 pairs, whose windows are told apart by 52 hash bits within a pair.
    """
    keys = []
    for column in (left, right):
        letters, offsets = kmers.letters_of(column)
        owner = kmers.owners(offsets)
        h, inside = kmers.window_hashes(letters, owner, WINDOW)
        key = np.sort(owner[: len(h)][inside].astype(np.uint64) << np.uint64(52) | h[inside] >> np.uint64(12))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        keys.append(key[new])
    both = np.sort(np.concatenate(keys))
    common = both[1:][both[1:] == both[:-1]]
    return tuple(np.bincount((k >> np.uint64(52)).astype(np.int64), minlength=len(left)) for k in (*keys, common))
