"""Long spans of letters that occur unchanged in more than one record.

Records are cut by content: a gear hash rolls over ``SEED`` letters, and the place of its minimum in
each run of ``span`` letters decides the chunk that the run belongs to. The cuts depend only on
the letters around them, so an insertion shifts chunks but does not change them, and a run of
``span`` letters lies in chunks of the same key in every record that has it.

1. Equal texts collapse to one.
2. Keys of all chunks are exchanged (about three bytes each) and those of two texts or more are
   marked in a bitmap of bounded size; most chunks of a large corpus are alone and go no further. Where the bitmap would
   be too large, the keys are taken in several ranges, one after the other.
3. The chunks that remain are deduplicated by digest: first in each map task, so that a chunk of very many texts is sent once
   by each, then in their bucket, where the runs of the distinct chunks are compared by 128 hash bits. A bucket
   only learns the smallest and largest text of a chunk.
4. The stretches found come back to all places of their chunk by a join on the digest (a chunk has few stretches, however many
   places it has), are joined to spans per text and expanded to all records with that text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import cleaned
from ..session import spread, write_once
from . import kmers
from .hot_seeds import bitmap as bitmap_of
from .near_duplicates import MOST_BUCKETS, bucket_count, distinct_texts, ranges
from .seeds import KEY_BITS, Exchange, bitmap_place, by_bucket, in_range, keyed, packed, unpacked

#: Letters the gear hash rolls over.
SEED = 24
#: Letters of chunks that one bucket should hold at most, if no chunk is left out; its work needs about 100 bytes a letter.
BUCKET_LETTERS = 2_000_000
#: Bits of the bitmap for each chunk key of a range (few are marked, as few are in two texts), and for all at least and at most (128 MB).
KEY_SPACE, LEAST_BITS, MOST_BITS = 16, 20, 30
CHUNK_DDL = "bucket bigint, chunks binary, letters binary, d bigint, d2 bigint, rep bigint, start bigint"
#: Letters of chunks that a map task deduplicates at once.
HELD_LETTERS = 20_000_000


def chunks(letters: np.ndarray, offsets: np.ndarray, span: int):
    """(record, start in the record, runs, key) of the chunks of a block.

    A chunk covers ``runs`` consecutive runs of ``span`` letters, so ``runs + span - 1`` letters; chunks
    of a record overlap by ``span - 1`` letters and every run lies in exactly one.
    """
    owner = kmers.owners(offsets)
    n = len(letters) - span + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    gear = kmers.mixed(kmers.rolling(kmers.LETTERS[letters], SEED, 2))
    bits = np.uint64(max(24, len(letters).bit_length()))
    # The place is part of the value, so the leftmost of equal minima wins.
    placed = gear >> bits << bits | np.arange(len(gear), dtype=np.uint64)
    low = kmers.sliding(placed, span - SEED + 1, np.minimum)
    inside = owner[:n] == owner[span - 1 :]
    place = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    place[~inside] = -1
    begins = np.ones(n, bool)
    begins[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(begins)
    runs = np.diff(np.append(first, n))
    real = place[first] >= 0
    first, runs = first[real], runs[real]
    rec = owner[first].astype(np.int64)
    return rec, first - offsets[rec], runs, keyed(gear[place[first]])


def keys(texts: DataFrame, buckets: int, span: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, postings): chunk keys of a range, each once per text."""

    def run(batches):
        out = Exchange(buckets)
        for batch in batches:
            for _, letters, offsets in kmers.blocks(*kmers.letters_of(batch.column(0))):
                rec, _, _, key = chunks(letters, offsets, span)
                one = np.unique(rec << KEY_BITS | key) & ((1 << KEY_BITS) - 1)
                yield from out.add(one[in_range(one, part, parts)])
        yield from out.flush()

    return spread(texts.select("text")).mapInArrow(run, Exchange.ddl)


def digests(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each chunk, from all its letters and their places."""
    begin = np.cumsum(lengths) - lengths
    place = (np.arange(len(letters)) - np.repeat(begin, lengths)).astype(np.uint64)
    return tuple(np.add.reduceat(kmers.mixed(kmers.LETTERS[letters] + (place + np.uint64(1)) * np.uint64(base)), begin).view(np.int64) for base in (kmers.BASE_A, kmers.BASE_B))


def first_of_each(d: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first chunk of each digest, and the digest's number for every chunk."""
    order = np.lexsort((d2, d))
    new = np.append(True, (np.diff(d[order]) != 0) | (np.diff(d2[order]) != 0))[: len(d)]
    kind = np.empty(len(d), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def lowest_and_highest(low: np.ndarray, high: np.ndarray, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(kinds, np.iinfo(np.int64).max), np.full(kinds, np.iinfo(np.int64).min)
    np.minimum.at(a, kind, low)
    np.maximum.at(b, kind, high)
    return a, b


def sent_chunks(texts: DataFrame, bitmap, bits: int, buckets: int, span: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Chunks of a range whose key the bitmap knows: (bucket, chunks, letters) of the distinct ones, packed, and (d, d2, rep, start) of all places."""
    names = [c.split()[0] for c in CHUNK_DDL.split(", ")]
    most = HELD_LETTERS
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(n, **columns):
        return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def rows(held):
        key, rep, start, runs, letters = (np.concatenate(x) for x in zip(*held))
        lengths = runs + span - 1
        begin = np.cumsum(lengths) - lengths
        d, d2 = digests(letters, lengths)
        for at in range(0, len(d), 100_000):
            own = slice(at, at + 100_000)
            yield batch(len(d[own]), d=d[own], d2=d2[own], rep=rep[own], start=start[own])
        lead, kind = first_of_each(d, d2)
        low, high = lowest_and_highest(rep, rep, kind, len(lead))
        bucket = key[lead] * buckets >> KEY_BITS
        order = np.argsort(bucket, kind="stable")
        lead, low, high, bucket = lead[order], low[order], high[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(lead))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = lead[a:b]
            blob = b"".join(packed(c) for c in (d[own], d2[own], runs[own], low[a:b], high[a:b]))
            yield batch(1, bucket=[int(bucket[a])], chunks=[blob], letters=[letters[ranges(begin[own], lengths[own])].tobytes()])

    def run(batches):
        held, size, known = [], 0, bitmap.value
        for whole in batches:
            numbers = whole.column(0).to_numpy()
            for first, letters, offsets in kmers.blocks(*kmers.letters_of(whole.column(1))):
                rec, start, runs, key = chunks(letters, offsets, span)
                at = bitmap_place(key, bits, parts)
                take = ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & in_range(key, part, parts)
                if take.any():
                    rec, start, runs, key = rec[take], start[take], runs[take], key[take]
                    held.append((key, numbers[first + rec], start, runs, letters[ranges(offsets[rec] + start, runs + span - 1)]))
                    size += len(held[-1][4])
                if size > most:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return spread(texts.select("rep", "text")).mapInArrow(run, CHUNK_DDL)


def shared_runs(d: np.ndarray, d2: np.ndarray, runs: np.ndarray, low: np.ndarray, high: np.ndarray, letters: np.ndarray, span: int):
    """(chunk, first, last): stretches of the chunks of a bucket that several texts have, from 0, both ends included.

    Each chunk stands for the texts from ``low`` to ``high``.
    """
    lengths = runs + span - 1
    lead, kind = first_of_each(d, d2)
    low, high = lowest_and_highest(low, high, kind, len(lead))
    letters = letters[ranges((np.cumsum(lengths) - lengths)[lead], lengths[lead])]
    runs, lengths = runs[lead], lengths[lead]
    owner = np.repeat(np.arange(len(runs)), lengths)
    h, inside = kmers.window_hashes(letters, owner, span)
    h2, _ = kmers.window_hashes(letters, owner, span, kmers.BASE_B)
    h, h2, of = h[inside], h2[inside], owner[: len(h)][inside]
    order = np.lexsort((h2, h))
    a, b = h[order], h2[order]
    group = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    several = np.minimum.reduceat(low[of[order]], group) != np.maximum.reduceat(high[of[order]], group)
    flags = np.empty(len(order), bool)
    flags[order] = np.repeat(several, np.diff(np.append(group, len(order))))
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~(flags[:-1] & (of[1:] == of[:-1]))
    closes[:-1] &= ~(flags[1:] & (of[1:] == of[:-1]))
    i, j = np.flatnonzero(opens), np.flatnonzero(closes)
    begin = np.cumsum(runs) - runs
    c = of[i]
    return lead[c], i - begin[c], j - begin[c] + span - 1


def covered(rows: DataFrame, buckets: int, span: int) -> DataFrame:
    """(rep, first, last): stretches of the written :func:`sent_chunks` at all their places, 1-based, not joined yet."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("chunks"):
            rest, columns = memoryview(blob.as_py()), []
            while len(rest):
                values, rest = unpacked(rest)
                columns.append(values)
            parts.append(columns)
        d, d2, runs, low, high = (np.concatenate(x) for x in zip(*parts))
        letters = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("letters")])
        chunk, first, last = shared_runs(d, d2, runs, low, high, letters, span)
        return pa.table(dict(zip(("d", "d2", "first", "last"), (pa.array(x, pa.int64()) for x in (d[chunk], d2[chunk], first, last)))))

    found = by_bucket(rows.where("bucket is not null").select("bucket", "chunks", "letters"), buckets).applyInArrow(run, "d bigint, d2 bigint, first bigint, last bigint")
    # A chunk of very many texts is the skewed side of a join whose other side has it a few times, so it can be split.
    places = rows.where("bucket is null").select("d", "d2", "rep", "start")
    return places.join(found, ["d", "d2"]).select("rep", (F.col("start") + F.col("first") + 1).alias("first"), (F.col("start") + F.col("last") + 1).alias("last"))


def joined(stretches: DataFrame) -> DataFrame:
    """(rep, span_start, span_end): stretches joined wherever they overlap or touch."""
    before = Window.partitionBy("rep").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rep").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    rows = stretches.withColumn("opens", F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("opens").over(upto))
    return rows.groupBy("rep", "span").agg(F.min("first").alias("span_start"), F.max("last").alias("span_end")).drop("span")


def shared_spans(df: DataFrame, span: int = 60, text: str = "sequence", number: str = "seq_no") -> DataFrame:
    """(seq_no, span_start, span_end), 1-based with both ends: places covered by runs of ``span`` letters that another record has too.

    A run repeated inside one record alone does not count; records that are exact copies share all
    of their text. Null, blank and shorter texts give no rows, rows delivered again change nothing,
    an empty table gives no rows, extra columns are not read.
    """
    spark = df.sparkSession
    texts = write_once(distinct_texts(df, span, text, number), "texts")
    buckets = bucket_count(texts, (span - SEED) / 2)
    letters = texts.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    wanted = KEY_SPACE * (letters // 20 + 1)
    parts = -(-wanted // (1 << MOST_BITS))
    bits = int(min(max(LEAST_BITS, wanted.bit_length()), MOST_BITS))
    # Chunks overlap: their letters are about 4 times those of the texts.
    chunk_buckets = int(min(max(buckets, 4 * letters / BUCKET_LETTERS), MOST_BUCKETS))
    stretches = None
    for part in range(parts):
        known = spark.sparkContext.broadcast(bitmap_of(keys(texts, buckets, span, part, parts), buckets, bits, 2, parts))
        sent = write_once(sent_chunks(texts, known, bits, chunk_buckets, span, part, parts), "chunks")
        known.destroy()
        own = covered(sent, chunk_buckets, span)
        stretches = own if stretches is None else stretches.unionAll(own)
    alone = joined(stretches)
    copied = texts.where(F.col("rep") != F.col("last"))
    # A text of several records is shared whole; the spans found above count for the others.
    single = alone.join(copied.select("rep"), "rep", "left_anti").select(F.col("rep").alias("seq_no"), "span_start", "span_end")
    digest = lambda c: [F.xxhash64(c).alias("d"), F.xxhash64(F.reverse(c)).alias("d2")]
    rows = df.select(F.col(number).cast("bigint").alias("seq_no"), cleaned(F.col(text)).alias("text")).where(F.col("seq_no").isNotNull() & (F.length("text") >= span))
    rows = rows.select("seq_no", *digest(F.col("text"))).distinct()
    whole = rows.join(copied.select(*digest(F.col("text")), "n"), ["d", "d2"]).select("seq_no", F.lit(1).cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_end"))
    return single.unionByName(whole)


def shared_letters(df: DataFrame, span: int = 60, text: str = "sequence", number: str = "seq_no", every: bool = False) -> DataFrame:
    """(seq_no, letters, spans, shared): for each record with a shared span, its letters, and how many of them are shared.

    With ``every``, records that share nothing have a row too, with no spans and 0 letters shared.
    """
    rows = df.select(F.col(number).cast("bigint").alias("seq_no"), F.length(cleaned(F.col(text))).alias("letters")).dropna().distinct()
    found = shared_spans(df, span, text, number).groupBy("seq_no").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared"))
    rows = rows.join(found, "seq_no", "left" if every else "inner")
    return rows.select("seq_no", "letters", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("spans", "shared")])
