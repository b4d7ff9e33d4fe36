"""Second look at records that meet in seeds of very many records, such as an adapter or a motif.

Joining such a seed's postings would give candidates by the square of its frequency though hardly any of them
are similar. The records that hold one are looked at again with *all* their seeds, where a strong
prefix filter holds: two similar records of ``m`` windows have ``least_common(m)`` seeds in common, so
each may drop that many less one, the last in an order that both share. Frequent seeds come last in
it, so they are dropped unless a record consists of them mostly; then its frequent partners are
indeed similar for the most part.

"Frequent" is read from a bitmap of bounded size. A false positive makes a seed frequent for all records
alike, so the order is still shared and the filter still exact.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from . import kmers
from .seeds import KEY_BITS, LEAST_GAP, SEED, WINDOW, Exchange, bitmap_place, by_bucket, gathered, keyed, set_sizes, size_class

#: Records that make a seed frequent.
FREQUENT = 48
#: Members of one block of a frequent seed in the second index.
BLOCK_MEMBERS = 1_000_000
#: Bits of the bitmap, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 20, 28


@lru_cache(maxsize=8)
def _least_common(threshold: float) -> np.ndarray:
    top = 4096
    lost = np.floor(np.arange(top + 1) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)
    spoiled = (lost // LEAST_GAP + 1) * (SEED - WINDOW)
    out = np.ones(top + 1, np.int64)
    for m in range(1, top + 1):
        s = np.arange(int(np.ceil(m * threshold)), m + 1)
        out[m] = max(1, int((np.ceil(threshold * (s + m) / (1 + threshold) - 1e-9) - spoiled[s]).min()))
    return out


def least_common(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Seeds that a record of ``sizes`` windows has in common with any similar one, at least.

    Each run of common windows has SEED - WINDOW seeds less than windows. Beyond the table's end the last
    value is a safe bound.
    """
    return _least_common(threshold)[np.minimum(sizes, 4096)]


def all_seeds(letters: np.ndarray, offsets: np.ndarray):
    """(record, seed) of the distinct seeds of each record, sorted; and its windows and places of seeds."""
    owner = kmers.owners(offsets)
    h, inside = kmers.window_hashes(letters, owner, SEED)
    sizes = set_sizes(letters, offsets, owner)
    rec = owner[: len(h)][inside].astype(np.int64)
    pair = np.unique(rec << KEY_BITS | keyed(h[inside]))
    return pair >> KEY_BITS, pair & ((1 << KEY_BITS) - 1), sizes, np.bincount(rec, minlength=len(sizes))


def blocks_for(texts: DataFrame) -> int:
    """Blocks into which the members of frequent seeds are split: as many as hold ``BLOCK_MEMBERS`` of all the texts."""
    return -(-texts.count() // BLOCK_MEMBERS) or 1


def blocks_of(pair: int, salts: int) -> tuple[int, int]:
    """The two blocks of a pair number: (0, 0), (0, 1), ..., (1, 1), ..."""
    return next((one, one + pair - before) for one in range(salts - 1, -1, -1) if (before := one * salts - one * (one - 1) // 2) <= pair)


def split_postings(number: np.ndarray, seed: np.ndarray, often: np.ndarray, buckets: int, salts: int, side: int | None = None):
    """(row, bucket) of each posting to send: those of frequent seeds go to all pairs of blocks with theirs, others to their bucket.

    Where two tables are joined, ``side`` is 0 or 1 and pairs of blocks are ordered; else the table is joined with itself.
    """
    bucket = seed * buckets >> KEY_BITS
    if salts == 1:
        return np.arange(len(seed)), bucket
    plain, hot = np.flatnonzero(~often), np.repeat(np.flatnonzero(often), salts)
    own, other = number[hot] % salts, np.tile(np.arange(salts), int(often.sum()))
    if side is None:
        one, two = np.minimum(own, other), np.maximum(own, other)
        pair = one * salts - one * (one - 1) // 2 + two - one
    else:
        pair = other * salts + own if side else own * salts + other
    return np.concatenate([plain, hot]), np.concatenate([bucket[plain], bucket[hot] + buckets * (1 + pair)])


def seeds_once(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, postings) of all distinct seeds of each text, without the text."""

    def run(batches):
        out = Exchange(buckets)
        for batch in batches:
            for _, letters, offsets in kmers.blocks(*kmers.letters_of(batch.column(0))):
                yield from out.add(all_seeds(letters, offsets)[1])
        yield from out.flush()

    return spread(texts.select("text")).mapInArrow(run, Exchange.ddl)


def bitmap(rows: DataFrame, buckets: int, bits: int, least: int, parts: int = 1) -> np.ndarray:
    """Bitmap of 2^bits bits (see :func:`seeds.bitmap_place`) of every seed that occurs in at least ``least`` postings; all lie in one range."""

    def run(table: pa.Table) -> pa.Table:
        seed = np.sort(gathered(x.as_py() for x in table.column("postings"))[0])
        # A bucket of fewer postings has none: its stop index would count from the end.
        at = np.unique(bitmap_place(seed[least - 1 :][seed[least - 1 :] == seed[: max(0, len(seed) - least + 1)]], bits, parts))
        if not len(at):
            return pa.table({"at": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        low = int(at[0]) >> 3 << 3
        marks = np.zeros((int(at[-1]) - low + 8) >> 3 << 3, np.uint8)
        marks[at - low] = 1
        return pa.table({"at": pa.array([low >> 3], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(1 << (bits - 3), np.uint8)
    for part in by_bucket(rows, buckets).applyInArrow(run, "at bigint, marks binary").toLocalIterator():
        piece = np.frombuffer(part["marks"], np.uint8)[: len(whole) - part["at"]]
        whole[part["at"] : part["at"] + len(piece)] |= piece
    return whole


def prefix_postings(texts: DataFrame, buckets: int, threshold: float, known, bits: int, salts: int = 1, side: int | None = None) -> DataFrame:
    """(bucket, postings) of (rep, text): seed, rep, kind (see :func:`seeds.minimum_seeds`; no record counts as one of distinct windows), for the seeds a text may not drop.

    With ``salts`` over 1 the members of a frequent seed are split into so many blocks, and each pair of blocks
    has a bucket of its own, so a seed that a third of all texts hold fills no task. Texts with many repeats inside, where seeds and windows don't run in parallel, drop nothing.
    """

    def run(batches):
        out, marks = Exchange(buckets), known.value
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for first, letters, offsets in kmers.blocks(*kmers.letters_of(batch.column(1))):
                rec, seed, sizes, places = all_seeds(letters, offsets)
                if not len(rec):
                    continue
                at = bitmap_place(seed, bits)
                often = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                order = np.lexsort((seed, often, rec))
                rec, seed = rec[order], seed[order]
                n = np.bincount(rec, minlength=len(sizes))
                plain = (n >= 0.95 * places) & (sizes >= 0.95 * (np.diff(offsets) - WINDOW + 1))
                keep = n - np.where(plain, least_common(sizes, threshold) - 1, 0)
                rank = np.arange(len(rec)) - (np.cumsum(n) - n)[rec]
                use = rank < keep[rec]
                rec, seed, often = rec[use], seed[use], often[order][use].astype(bool)
                row, bucket = split_postings(rep[first + rec], seed, often, buckets, salts, side)
                rec, seed = rec[row], seed[row]
                yield from out.add(seed, rep[first + rec], 2 * size_class(sizes)[rec], bucket=bucket)
        yield from out.flush()

    return spread(texts.select("rep", "text")).mapInArrow(run, Exchange.ddl)


def frequent_seeds(texts: DataFrame, buckets: int):
    """Bitmap of the seeds that ``FREQUENT`` texts or more have, and its bits: about 12 for each that there can be."""
    bits = int(min(max(LEAST_BITS, (buckets << 18).bit_length()), MOST_BITS))
    return bitmap(seeds_once(texts, buckets), buckets, bits, FREQUENT), bits
