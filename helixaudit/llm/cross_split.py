"""Records of evaluation splits that occur, exactly or nearly, among the training records.

Plan
----
A prefix-filter join on rare shingles. The evaluation side is the small one and is indexed; the training side only probes. Both are cleaned once
and written.

1. Shingles. Of every evaluation record, seeds of 18 letters at a stride are taken; a training record holds all of its own, so
   any similar one has at least ``needed`` of them, at whatever offset. Single 12-letter windows can't serve as
   shingles: there are only 4^12 of them, so in a large corpus none is rare and the candidates would grow with the square of the input.
2. A bitmap of these shingles (at most 2^``MOST_BITS`` bits, whatever the input) goes to the
   training tasks. It only filters: a false positive costs a posting, never a result. Where there are more shingles, the
   seeds are taken in so many ranges, one after the other, that each range's bitmap is small enough.
3. Frequencies. All training records are read for how often each shingle occurs among them, into a table of fixed size. Only the order
   of shingles depends on it, so it need not be exact.
4. Index. Each evaluation record orders its shingles from the rarest on; the prefix leaves out as many of the most frequent as it can spare
   (``spared``). Postings carry the place of the shingle in this order, counted from the end. What is spared only meets
   training records with repeats inside, for which the count of common shingles does not hold.
5. Training records probe with the seeds at all positions; postings that pass the bitmap are exchanged by
   seed bucket and joined with the index there, under the length filter. A pair must have met in a shingle behind which enough
   others follow (the position filter), and in as many of the prefix as similar records of their sizes must.
6. Texts that meet in a seed of very many texts all the same are indexed again with all their seeds under a prefix filter
   that leaves frequent ones out (:mod:`hot_seeds`).
7. Candidates are verified on their full sets of windows and expanded to all copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import cleaned
from ..session import parallelism, spread, write_once
from ..sources.hits import complete_hits, id_number
from . import hot_seeds, kmers
from .near_duplicates import BUCKET_POSTINGS, MOST_BUCKETS, PAIRS_A_TASK, bucket_count, checked
from .seeds import KEY_BITS, SEED, WINDOW, Exchange, bitmap_place, by_bucket, class_bounds, class_span, gathered, in_range, keyed, longest_run, packed, seed_bound, set_sizes, size_class, unpacked

#: Leading bits of a seed by which its frequency is looked up (a table of 4 MB).
RANK_BITS = 22
#: Bits of the seed bitmap: so many for each shingle of a range, and for all within these bounds (at most 128 MB).
SHINGLE_BITS, LEAST_BITS, MOST_BITS = 16, 20, 30
#: Bits of the digest by which postings and candidates name a text; texts that share them are all verified.
SHORT = (1 << 40) - 1
#: Bits of the kind of a text.
KIND_BITS = 10
#: Candidate pairs generated at once inside a bucket.
PAIR_BLOCK = 1_000_000


def records(df: DataFrame, least: int, text: str = "sequence", number: str = "seq_no") -> DataFrame:
    """(no, text, d, d2) of the rows with ``least`` letters or more; d and d2 are 128 bits of the text's digest."""
    rows = df.select(F.col(number).cast("bigint").alias("no"), cleaned(F.col(text)).alias("text"))
    rows = rows.where(F.col("no").isNotNull() & (F.length("text") >= least))
    return rows.select("no", "text", F.xxhash64("text").alias("d"), F.xxhash64(F.reverse("text")).alias("d2"))


def strides(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Stride at which shingles of records of these sizes are taken: two thirds of what would leave one in common with similar records, so that some can be spared."""
    top = 4096
    run = np.array([max(1, longest_run(m, threshold) + WINDOW - SEED) if m else 1 for m in range(top + 1)])
    run = np.minimum.accumulate(run[::-1])[::-1]
    return np.maximum(run[np.minimum(np.ceil(sizes * threshold).astype(np.int64), top)] * 2 // 3, 1)


@lru_cache(maxsize=8)
def needed_seeds(threshold: float) -> np.ndarray:
    """[evaluation class, training class]: shingles that similar records of these size classes have in common at least (``seeds.seed_bound``)."""
    low, high = class_bounds()
    step = strides(np.minimum(high, 1e6), threshold).astype(float)
    smaller, larger = (
        np.minimum(*(seed_bound(m[:, None], np.maximum(low[None, :], m[:, None]), w, threshold) for m in (low, high)))
        for w in (step[:, None], step[None, :])
    )
    # Rows of both are the smaller record: the evaluation record in the first, the training record in the second.
    return np.triu(smaller) + np.triu(larger, 1).T


@lru_cache(maxsize=8)
def spared(threshold: float) -> np.ndarray:
    """Shingles that an evaluation record of each size class leaves out of the index: two thirds of those it has in common with any similar record."""
    near = np.abs(np.arange(256)[:, None] - np.arange(256)[None, :]) <= class_span(threshold)
    least = np.where(near, needed_seeds(threshold), 1 << 30).min(1)
    return least - (least + 2) // 3


def kinds(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice the size class, and one more for records whose windows are all distinct."""
    return 2 * size_class(sizes) + (sizes == np.maximum(np.diff(offsets) - WINDOW + 1, 0))


def fresh_blocks(batch: pa.RecordBatch, mask: int):
    """Blocks (digests under ``mask``, letters, offsets) of the texts of a batch of (d, d2, text), each text once."""
    d, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    order = np.lexsort((d2, d))
    once = np.append(True, (np.diff(d[order]) != 0) | (np.diff(d2[order]) != 0))[: len(d)]
    first = np.sort(order[once])
    texts = batch.column(2) if len(first) == batch.num_rows else batch.column(2).take(pa.array(first))
    short = d[first] & mask
    for at, letters, offsets in kmers.blocks(*kmers.letters_of(texts)):
        yield short[at : at + len(offsets) - 1], letters, offsets


def shingles(letters: np.ndarray, offsets: np.ndarray, threshold: float):
    """(record, seed) of the shingles of a block, each once per record, and kinds of the records."""
    owner = kmers.owners(offsets)
    h, inside = kmers.window_hashes(letters, owner, SEED)
    sizes = set_sizes(letters, offsets, owner)
    step = strides(sizes, threshold)
    rec = owner[: len(h)]
    take = np.flatnonzero(inside & ((np.arange(len(h)) - offsets[:-1][rec]) % step[rec] == 0))
    rec, seed = rec[take].astype(np.int64), keyed(h[take])
    order = np.lexsort((seed, rec))
    rec, seed = rec[order], seed[order]
    once = np.append(True, (np.diff(rec) != 0) | (np.diff(seed) != 0))[: len(rec)]
    return rec[once], seed[once], kinds(sizes, offsets)


def all_shingles(texts: DataFrame, buckets: int, threshold: float, part: int, parts: int) -> DataFrame:
    """(bucket, postings) of the evaluation side: the shingles of a range alone."""

    def run(batches):
        out = Exchange(buckets)
        for batch in batches:
            for _, letters, offsets in fresh_blocks(batch, SHORT):
                seed = shingles(letters, offsets, threshold)[1]
                yield from out.add(np.unique(seed[in_range(seed, part, parts)]))
        yield from out.flush()

    return spread(texts.select("d", "d2", "text")).mapInArrow(run, Exchange.ddl)


def seed_bitmap(rows: DataFrame, buckets: int, bits: int, parts: int = 1) -> np.ndarray:
    """Bitmap of 2^bits bits of the seeds of a range, by their leading bits within it; its size is bounded by MOST_BITS."""
    return hot_seeds.bitmap(rows, buckets, bits, 1, parts)


def known_seeds(batch: pa.RecordBatch, mask: int, known: np.ndarray, bits: int, part: int, parts: int):
    """(digests, letters, offsets, owners, places, seeds) by block: the seeds at all places of the texts that lie in the range and that the bitmap knows."""
    for d, letters, offsets in fresh_blocks(batch, mask):
        owner = kmers.owners(offsets)
        h, inside = kmers.window_hashes(letters, owner, SEED)
        seed = keyed(h)
        at = bitmap_place(seed, bits, parts)
        take = np.flatnonzero(inside & ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))
        take = take[in_range(seed[take], part, parts)]
        yield d, letters, offsets, owner, take, seed[take]


def frequencies(texts: DataFrame, bitmap, bits: int, buckets: int, part: int, parts: int, table: np.ndarray) -> None:
    """Enter into ``table`` how often the shingles of a range occur on the training side: four times the logarithm, the highest of those that share a place."""

    def counts(batches):
        out = Exchange(buckets)
        for batch in batches:
            found = [seed for *_, seed in known_seeds(batch, SHORT, bitmap.value, bits, part, parts) if len(seed)]
            if found:
                seed, n = np.unique(np.concatenate(found), return_counts=True)
                yield from out.add(seed, n)
        yield from out.flush()

    def run(rows: pa.Table) -> pa.Table:
        seed, n = gathered(x.as_py() for x in rows.column("postings"))
        seed, at = np.unique(seed, return_inverse=True)
        level = np.minimum(4 * np.log2(1 + np.bincount(at, n)), 255).astype(np.uint8)
        place = seed >> (KEY_BITS - RANK_BITS)
        start = np.flatnonzero(np.append(True, np.diff(place) > 0))
        # Most shingles that occur do so once or twice: only the others are worth a place.
        place, level = place[start], np.maximum.reduceat(level, start)
        use = level > 4
        return pa.table({"places": pa.array([packed(np.diff(place[use], prepend=0))], pa.binary()), "levels": pa.array([packed(level[use])], pa.binary())})

    rows = spread(texts.select("d", "d2", "text")).mapInArrow(counts, Exchange.ddl)
    for row in by_bucket(rows, buckets).applyInArrow(run, "places binary, levels binary").toLocalIterator():
        place, level = np.cumsum(unpacked(memoryview(row["places"]))[0]), unpacked(memoryview(row["levels"]))[0]
        table[place] = np.maximum(table[place], level.astype(np.uint8))


def index(texts: DataFrame, frequency, buckets: int, threshold: float, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, postings) of the evaluation side: seed, digest, kind, and place in the order of frequency, from the end, for the shingles of a range."""
    longest, mask = hot_seeds.FREQUENT**2, SHORT

    def run(batches):
        out, often = Exchange(buckets, longest=longest), frequency.value
        for batch in batches:
            for d, letters, offsets in fresh_blocks(batch, mask):
                rec, seed, kind = shingles(letters, offsets, threshold)
                order = np.lexsort((seed, often[seed >> (KEY_BITS - RANK_BITS)], rec))
                rec, seed = rec[order], seed[order]
                n = np.bincount(rec, minlength=len(offsets) - 1)
                behind = n[rec] - (np.arange(len(rec)) - (np.cumsum(n) - n)[rec])
                use = in_range(seed, part, parts)
                rec = rec[use]
                yield from out.add(seed[use], d[rec], kind[rec], behind[use])
        yield from out.flush()

    return spread(texts.select("d", "d2", "text")).mapInArrow(run, Exchange.ddl)


def probes(texts: DataFrame, bitmap, bits: int, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, postings) of the training side: seed, digest, kind of its seeds at all positions that lie in the range and that the bitmap knows."""
    longest, mask = hot_seeds.FREQUENT**2, SHORT

    def run(batches):
        out = Exchange(buckets, longest=longest)
        for batch in batches:
            for d, letters, offsets, owner, take, seed in known_seeds(batch, mask, bitmap.value, bits, part, parts):
                if len(take):
                    rec = owner[take]
                    yield from out.add(seed, d[rec], kinds(set_sizes(letters, offsets, owner), offsets)[rec])
        yield from out.flush()

    return spread(texts.select("d", "d2", "text")).mapInArrow(run, Exchange.ddl)


def pair_blocks(seed_a, d_a, kind_a, behind_a, seed_b, d_b, kind_b, threshold: float):
    """(a, b, common, needed, behind): evaluation and training digests that share shingles, sizes within the span; blocks may repeat a pair.

    Digests come with the kind of their text behind them, as texts of several kinds can share a short one.
    ``needed`` counts all shingles of the evaluation record; ``behind`` is the most that follow one in common, itself included.
    """
    span, need = class_span(threshold), needed_seeds(threshold)
    names_a, a = np.unique(d_a, return_inverse=True)
    names_b, b = np.unique(d_b, return_inverse=True)
    own_a, own_b = np.zeros(len(names_a), np.int64), np.zeros(len(names_b), np.int64)
    own_a[a], own_b[b] = kind_a, kind_b
    size_a, size_b = kind_a >> 1, kind_b >> 1
    order_a = np.argsort(seed_a << 9 | size_a)
    key_a, a, behind_a = (seed_a << 9 | size_a)[order_a], a[order_a], behind_a[order_a]
    low = np.searchsorted(key_a, seed_b << 9 | np.maximum(size_b - span, 0), "left")
    n = np.searchsorted(key_a, seed_b << 9 | (size_b + span), "right") - low
    done, at = np.concatenate([[0], np.cumsum(n)]), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIR_BLOCK, "right")) - 1)
        j = np.repeat(np.arange(at, to), n[at:to])
        i = np.arange(done[to] - done[at]) - np.repeat(done[at:to] - done[at], n[at:to]) + low[j]
        if len(i):
            key = a[i] * len(names_b) + b[j]
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(np.append(True, np.diff(key) > 0))
            common, behind = np.diff(np.append(start, len(key))), np.maximum.reduceat(behind_a[i][order], start)
            one, two = key[start] // len(names_b), key[start] % len(names_b)
            x, y = own_a[one], own_b[two]
            yield names_a[one] >> KIND_BITS, names_b[two] >> KIND_BITS, common, np.where(x & y & 1, need[x >> 1, y >> 1], 1), np.where(x & y & 1, spared(threshold)[x >> 1], 0), behind
        at = to


def distinct_postings(seed, d, *columns):
    """The postings of one side, each (seed, text) once, by seed."""
    order = np.lexsort((d, seed))
    seed, d = seed[order], d[order]
    once = np.append(True, (seed[1:] != seed[:-1]) | (d[1:] != d[:-1]))[: len(seed)]
    return seed[once], d[once], *(c[order][once] for c in columns)


FOUND = ("a", "b", "common", "needed", "spared", "behind", "alone")


def meet(left: DataFrame, right: DataFrame, buckets: int, threshold: float, most: int | None = None, counted: bool = True) -> DataFrame:
    """Digests a, b of evaluation and training texts with what they share in a bucket (see :func:`pair_blocks`), with ``alone`` 0.

    Where the lists of a seed would make more than ``most`` pairs, its texts come out alone, on the
    evaluation side with ``alone`` 1, on the training side with 2. Unless ``counted``, one common seed will do, and postings have no place.
    """

    def batch(*columns):
        return pa.record_batch([pa.array(np.asarray(x), pa.int64()) for x in columns], names=list(FOUND))

    def alone(d, side):
        none = np.zeros(len(d))
        return batch(d, d, none, none, none, none, none + side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = ([], []), 0
        for part in batches:
            number = part.column(part.schema.get_field_index("bucket"))[0].as_py()
            for side, blob in zip(part.column(part.schema.get_field_index("side")), part.column(part.schema.get_field_index("postings"))):
                held[side.as_py()].append(blob.as_py())
        if number < 0:
            for side in (0, 1):
                if held[side]:
                    yield alone(np.unique(np.concatenate([unpacked(memoryview(x))[0] for x in held[side]])), side + 1)
            return
        if not held[0] or not held[1]:
            return
        first = gathered(held[0])
        named = lambda seed, d, kind, *rest: (seed, d << KIND_BITS | kind, kind, *rest)
        seed_a, d_a, kind_a, behind_a = distinct_postings(*named(*first), *([] if counted else [np.ones(len(first[0]), np.int64)]))
        seed_b, d_b, kind_b = named(*gathered(held[1]))
        known = np.isin(seed_b, seed_a)
        seed_b, d_b, kind_b = distinct_postings(seed_b[known], d_b[known], kind_b[known])
        # Records of distinct windows on both sides meet in the prefix; others in all shingles.
        spare = (kind_a & 1).astype(bool) & (behind_a <= spared(threshold)[kind_a >> 1]) & counted
        plain = (kind_b & 1).astype(bool) & counted
        for use_a, use_b in ((~spare, slice(None)), (spare, ~plain)):
            one, two = [x[use_a] for x in (seed_a, d_a, kind_a, behind_a)], [x[use_b] for x in (seed_b, d_b, kind_b)]
            if not len(one[0]) or not len(two[0]):
                continue
            if most is not None:
                seeds, count_b = np.unique(two[0], return_counts=True)
                count_a = np.searchsorted(one[0], seeds, "right") - np.searchsorted(one[0], seeds, "left")
                hot = seeds[count_a * count_b > most]
                hot_a, hot_b = np.isin(one[0], hot), np.isin(two[0], hot)
                yield alone(np.unique(one[1][hot_a] >> KIND_BITS), 1)
                yield alone(np.unique(two[1][hot_b] >> KIND_BITS), 2)
                one, two = [x[~hot_a] for x in one], [x[~hot_b] for x in two]
            for a, b, common, needed, spares, behind in pair_blocks(*one, *two, threshold):
                if not counted:
                    needed, spares = np.ones(len(needed)), np.zeros(len(spares))
                yield batch(a, b, common, needed, spares, behind, np.zeros(len(a)))

    both = left.select("bucket", F.lit(0).alias("side"), "postings").unionAll(right.select("bucket", F.lit(1).alias("side"), "postings"))
    return by_bucket(both, buckets).applyInArrow(run, ", ".join(f"{c} bigint" for c in FOUND))


def enough(found: DataFrame) -> DataFrame:
    """(a, b): pairs that met in a shingle behind which as many follow as they need, and in as many of the prefix as they need less those spared."""
    pairs = found.where("alone = 0").groupBy("a", "b", "needed", "spared").agg(F.sum("common").alias("common"), F.max("behind").alias("behind"))
    return pairs.where("common >= greatest(needed - spared, 1) and behind >= needed").select("a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): distinct candidate pairs of the written (no, d, d2, text) of both sides, by the ``SHORT`` part of d.

    Texts that meet in frequent seeds are looked at again (:mod:`hot_seeds`).
    """
    spark = left.sparkSession
    letters = left.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    seeds = letters // 5 + 1
    parts = -(-SHINGLE_BITS * seeds // (1 << MOST_BITS))
    bits = int(min(max(LEAST_BITS, (SHINGLE_BITS * seeds - 1).bit_length()), MOST_BITS))
    buckets = int(min(max(parallelism(spark), 2 * seeds / BUCKET_POSTINGS), MOST_BUCKETS))
    table, bitmaps = np.zeros(1 << RANK_BITS, np.uint8), []
    for part in range(parts):
        # Held on the driver's disk by Spark, one for each range; a task loads that of its range only.
        bitmaps.append(spark.sparkContext.broadcast(seed_bitmap(all_shingles(left, buckets, threshold, part, parts), buckets, bits, parts)))
        frequencies(right, bitmaps[-1], bits, buckets, part, parts, table)
    frequency, found = spark.sparkContext.broadcast(table), None
    for part, known in enumerate(bitmaps):
        own = meet(index(left, frequency, buckets, threshold, part, parts), probes(right, known, bits, buckets, part, parts), buckets, threshold, hot_seeds.FREQUENT**2)
        own = write_once(own, "joined")
        known.destroy()
        found = own if found is None else found.unionAll(own)
    frequency.destroy()
    pairs = enough(found)
    if not (often := found.where("alone > 0")).isEmpty():
        texts = [write_once(wanted_texts(rows, often.where(F.col("alone") == k), "a").select(F.col("a").alias("rep"), "text", F.length("text").alias("n")), "frequent") for k, rows in ((1, left), (2, right))]
        every = texts[0].unionAll(texts[1])
        buckets, salts = bucket_count(every, 1.0), hot_seeds.blocks_for(every)
        marks, bits = hot_seeds.frequent_seeds(every, buckets)
        known = spark.sparkContext.broadcast(marks)
        sides = [hot_seeds.prefix_postings(t, buckets, threshold, known, bits, salts, side) for side, t in enumerate(texts)]
        pairs = pairs.unionAll(enough(meet(*sides, buckets, threshold, counted=False))).distinct()
    return pairs


def wanted_texts(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, d, d2, text) of the texts that ``pairs``' column ``key`` names by the ``SHORT`` part of their digest, each text once."""
    need = pairs.select(key).distinct()
    return rows.select(F.col("d").bitwiseAND(F.lit(SHORT)).alias(key), "d", "d2", "text").join(need, key, "left_semi").dropDuplicates(["d", "d2"])


def text_overlaps(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, a2, b, b2): both halves of the digests of all similar texts of the written (no, d, d2, text) of both sides."""
    pairs = write_once(candidates(left, right, threshold), "candidates")
    tasks = max(parallelism(left.sparkSession), pairs.count() // PAIRS_A_TASK)
    texts = [write_once(wanted_texts(rows, pairs, key).toDF(key, f"{key}1", f"{key}2", f"text_{key}"), "texts") for key, rows in (("a", left), ("b", right))]
    # Where a short digest stands for two texts the pair meets both, and each is verified.
    rows = pairs.repartition(tasks, "a").join(texts[0], "a").repartition(tasks, "b").join(texts[1], "b")
    return checked(rows.select("a1", "a2", "b1", "b2", "text_a", "text_b"), threshold).select(F.col("a1").alias("a"), "a2", F.col("b1").alias("b"), "b2")


def written(df: DataFrame, least: int, text: str = "sequence", number: str = "seq_no") -> DataFrame:
    """The :func:`records` of a side, written once: cleaning and digests are not computed again."""
    return write_once(records(df, least, text, number), "records")


def overlaps_by_text(evaluation: DataFrame, training: DataFrame, threshold: float = 0.5, text: str = "sequence", number: str = "seq_no", least: int = 40) -> DataFrame:
    """(test_no, train_no): all pairs of records with a window similarity of ``threshold`` or more.

    Equal texts of ``least`` letters or more are included, every record of either side counts on
    its own, and rows delivered again change nothing. A number with several texts overlaps by each of them. Null, blank and shorter
    texts give no rows; empty tables give none; extra columns are not read.
    """
    left, right = written(evaluation, least, text, number), written(training, least, text, number)
    same = write_once(text_overlaps(left, right, threshold), "similar")
    of = lambda rows, key, name: rows.select(F.col("d").alias(key), F.col("d2").alias(f"{key}2"), F.col("no").alias(name)).distinct()
    out = same.join(of(left, "a", "test_no"), ["a", "a2"]).join(of(right, "b", "train_no"), ["b", "b2"])
    return out.select("test_no", "train_no").distinct()


def overlap_classes(evaluation: DataFrame, training: DataFrame, threshold: float = 0.5, text: str = "sequence", number: str = "seq_no", least: int = 40) -> DataFrame:
    """(test_first, train_first, n_test, n_train): overlaps by text between classes of equal texts, each under its smallest number, with their records.

    One row for each pair of texts, however many copies either side has; :func:`class_members` names them.
    """
    left, right = written(evaluation, least, text, number), written(training, least, text, number)
    out = text_overlaps(left, right, threshold)
    for rows, key, side in ((left, "a", "test"), (right, "b", "train")):
        of = rows.select("no", "d", "d2").distinct().groupBy(F.col("d").alias(key), F.col("d2").alias(f"{key}2"))
        out = out.join(of.agg(F.min("no").alias(f"{side}_first"), F.count(F.lit(1)).alias(f"n_{side}")), [key, f"{key}2"])
    return out.select("test_first", "train_first", "n_test", "n_train")


def class_members(df: DataFrame, text: str = "sequence", number: str = "seq_no", least: int = 40) -> DataFrame:
    """(seq_no, first_no): the class of equal texts, under its smallest number, of each record of ``least`` letters or more."""
    rows = records(df, least, text, number).select("no", "d", "d2").distinct()
    first = rows.groupBy("d", "d2").agg(F.min("no").alias("first_no"))
    return rows.join(first, ["d", "d2"]).select(F.col("no").alias("seq_no"), "first_no")


def overlaps_by_hit(evaluation: DataFrame, training: DataFrame, hits: DataFrame, threshold: float = 90.0, number: str = "seq_no") -> DataFrame:
    """(test_no, train_no) of the complete hits with least(qcov, tcov) * pident >= ``threshold``.

    Ids that name no record of either table, as those of control probes, give no rows.
    """
    rows = complete_hits(hits).where(F.least("qcov", "tcov") * F.col("pident") >= threshold)
    rows = rows.select(id_number("query", "test").alias("test_no"), id_number("target", "train").alias("train_no")).dropna().distinct()
    rows = rows.join(evaluation.select(F.col(number).cast("bigint").alias("test_no")), "test_no", "left_semi")
    return rows.join(training.select(F.col(number).cast("bigint").alias("train_no")), "train_no", "left_semi").select("test_no", "train_no")


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, hits: DataFrame, threshold: float = 0.5, hit_threshold: float = 90.0) -> DataFrame:
    """(test_no, train_no): distinct pairs found by text or by hit."""
    return overlaps_by_text(evaluation, training, threshold).unionByName(overlaps_by_hit(evaluation, training, hits, hit_threshold)).distinct()


def overlap_report(pairs: DataFrame, evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(split, test_source, train_source, n_pairs, n_test, n_train): overlaps per split and source; null sources are a group."""
    test = evaluation.groupBy("seq_no").agg(F.min("split").alias("split"), F.min("source").alias("test_source")).withColumnRenamed("seq_no", "test_no")
    train = training.groupBy("seq_no").agg(F.min("source").alias("train_source")).withColumnRenamed("seq_no", "train_no")
    rows = pairs.join(test, "test_no").join(train, "train_no")
    return rows.groupBy("split", "test_source", "train_source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("test_no").alias("n_test"), F.countDistinct("train_no").alias("n_train"))
