"""Near-duplicate records with small edits: all pairs of texts above a window similarity.

Plan
----
1. Exact copies collapse to one text each (hash aggregate with map-side combine), written once.
2. Each text selects seeds that resist shifts (:mod:`seeds`); postings (seed, text, kind)
   are exchanged by seed bucket. A seed of very many texts is cut short before the exchange.
3. Each bucket is an inverted index joined with itself by set-relation skipping: posting lists
   are sorted by size class and a member only visits the block of the list whose sizes can
   still reach the threshold (the rest is skipped by position); equal lists are answered once, and the answers of a
   list that is much like the one before it are those of that list, less the pairs of members it lacks, plus the pairs of its
   new members (:func:`list_tables`). All this counts the seeds that each pair of texts has in common.
4. Lists longer than ``hot_seeds.FREQUENT`` are not joined: their texts are indexed again with all their seeds
   under a prefix filter that leaves frequent seeds out (:mod:`hot_seeds`).
5. Counts are summed; pairs with fewer common seeds than similar texts of their sizes must have (``seeds.shared_seeds``)
   are dropped. What is left is joined with both texts and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import cleaned
from ..session import parallelism, spread, write_once
from . import hot_seeds, kmers
from .components import components
from .seeds import Exchange, by_bucket, class_span, common_windows, gathered, minimum_seeds, shared_seeds, unpacked

#: Postings that one bucket should hold about.
BUCKET_POSTINGS = 1_000_000
#: Buckets at most; each still spans 2^18 of the 2^40 seeds.
MOST_BUCKETS = 1 << 22
#: Pairs generated at once inside a bucket, and pairs whose texts one task compares.
PAIR_BLOCK, PAIRS_A_TASK = 500_000, 100_000


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def distinct_texts(df: DataFrame, least: int, text: str = "sequence", number: str = "seq_no") -> DataFrame:
    """(rep bigint, last bigint, text string, n int): one row per distinct cleaned text of ``least`` letters or more.

    ``rep`` and ``last`` are the smallest and largest number carrying the text, so ``rep = last``
    tells a text that occurs in one record only, however often its row was delivered. Null numbers
    are left out.
    """
    rows = df.select(F.col(number).cast("bigint").alias("no"), cleaned(F.col(text)).alias("text"))
    rows = rows.where(F.col("no").isNotNull() & (F.length("text") >= least))
    return rows.groupBy("text").agg(F.min("no").alias("rep"), F.max("no").alias("last")).select("rep", "last", "text", F.length("text").alias("n"))


def bucket_count(df: DataFrame, per_posting: float) -> int:
    """Buckets for the letters in column ``n``: about ``BUCKET_POSTINGS`` postings each, and one for each task at least."""
    letters = df.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    return int(min(max(parallelism(df.sparkSession), letters / per_posting / BUCKET_POSTINGS), MOST_BUCKETS))


def postings(texts: DataFrame, buckets: int, threshold: float, longest: int | None = None) -> DataFrame:
    """(bucket, postings) rows with packed seed, text number and kind (see :func:`seeds.minimum_seeds`)."""

    def run(batches):
        out = Exchange(buckets, longest=longest)
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for first, letters, offsets in kmers.blocks(*kmers.letters_of(batch.column(1))):
                rec, seed, kind = minimum_seeds(letters, offsets, threshold)
                yield from out.add(seed, rep[first + rec], kind)
        yield from out.flush()

    return spread(texts.select("rep", "text")).mapInArrow(run, Exchange.ddl)


def posting_lists(seed: np.ndarray, rep: np.ndarray, kind: np.ndarray):
    """(rep, kind, list number, list lengths) of the lists of two texts or more, by kind and number in each list, without repetitions."""
    order = np.argsort(seed)
    seed, rep, kind = seed[order], rep[order], kind[order]
    twice = np.zeros(len(seed), bool)
    same = seed[1:] == seed[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    seed, rep, kind = seed[twice], rep[twice], kind[twice]
    order = np.lexsort((rep, kind, seed))
    seed, rep, kind = seed[order], rep[order], kind[order]
    fresh = np.ones(len(seed), bool)
    fresh[1:] = (seed[1:] != seed[:-1]) | (rep[1:] != rep[:-1])
    seed, rep, kind = seed[fresh], rep[fresh], kind[fresh]
    if not len(seed):
        return rep, kind, rep, rep
    start = np.append(True, seed[1:] != seed[:-1])
    length = np.diff(np.append(np.flatnonzero(start), len(seed)))
    group = np.cumsum(start) - 1
    use = length[group] > 1
    return rep[use], kind[use], np.cumsum(np.append(True, np.diff(group[use]) > 0))[: use.sum()] - 1, length[length > 1]


@dataclass
class Tables:
    """Lists one after the other. ``flag`` marks members whose pairs with all members of the list are wanted; a pair of the list counts ``weight``."""

    rep: np.ndarray
    kind: np.ndarray
    group: np.ndarray
    flag: np.ndarray
    weight: np.ndarray


def list_tables(rep: np.ndarray, kind: np.ndarray, group: np.ndarray, length: np.ndarray) -> Tables:
    """What must be joined so that each pair is counted once for each list that holds both.

    Lists are put in an order in which similar ones are neighbours. A list much like the one before derives its answers: the chain of lists
    L1, L2, L3 has 3 times the pairs of L1, 2 times the change from L1 to L2 and the change from L2 to L3, where
    a change is the pairs of new members in the later list less the pairs of lost members in the earlier one. Equal lists change nothing.
    """
    first = np.cumsum(length) - length
    member = kmers.mixed(rep.astype(np.uint64))
    whole = np.add.reduceat(member, first)
    # Lists that share their two members of lowest hash are likely to be similar; equal lists fall together.
    lowest = np.lexsort((member, group))
    low, second = member[lowest][first], member[lowest][first + 1]
    order = np.lexsort((whole, length, second, low))
    at = ranges(first[order], length[order])
    rep, kind, length = rep[at], kind[at], length[order]
    n = len(length)
    group = np.repeat(np.arange(n), length)
    first = np.cumsum(length) - length
    # A member is kept if the list before has it too; both lists of (list, member) are sorted for the search.
    _, dense = np.unique(rep, return_inverse=True)
    base = int(dense.max()) + 1
    key = group * base + dense
    by_key = np.argsort(key)
    found = np.searchsorted(key[by_key], key - base)
    hit = by_key[np.minimum(found, len(key) - 1)]
    kept = (group > 0) & (key[hit] == key - base)
    still = np.zeros(len(key), bool)
    still[hit[kept]] = True
    new = length - np.add.reduceat(kept, first)
    lost = np.append(0, (length - np.add.reduceat(still, first))[:-1])
    before = np.append(0, length[:-1])
    derived = (np.arange(n) > 0) & (2 * (new * length + lost * before) < length * (length - 1) / 2)
    head = np.maximum.accumulate(np.where(derived, 0, np.arange(n)))
    # Lists from here to the end of the chain, which all contain this change.
    tail = np.append(np.flatnonzero(~derived)[1:], n)[np.searchsorted(np.flatnonzero(~derived), head)]
    rest = tail - np.arange(n)
    plus = ~derived[group] | (new > 0)[group]
    minus_lists = np.flatnonzero(derived & (lost > 0)) - 1
    minus = ranges(first[minus_lists], length[minus_lists])
    parts = (
        (rep[plus], kind[plus], group[plus], (~kept | ~derived[group])[plus], rest[group[plus]]),
        (rep[minus], kind[minus], n + np.repeat(np.arange(len(minus_lists)), length[minus_lists]), ~still[minus], -np.repeat(rest[minus_lists + 1], length[minus_lists])),
    )
    return Tables(*(np.concatenate(x) for x in zip(*parts)))


def table_pairs(tables: Tables, span: int):
    """Index pairs (i, j) that the tables ask for, each once, whose size classes lie within ``span``, in blocks.

    Lists are contiguous and sorted by kind; the block that an entry visits is found by position in the combined
    (list, kind) order. A marked member visits those behind it, and of those before it the unmarked ones.
    """
    order = tables.group << 9 | tables.kind >> 1
    marked = np.flatnonzero(tables.flag)
    ends = np.searchsorted(order, order[marked] + span, "right")
    # The class of an entry is at least 0, so that no block reaches back into another list.
    begins = np.searchsorted(order, np.maximum(order[marked] - span, order[marked] >> 9 << 9), "left")
    for of, low, n in ((marked, marked + 1, ends - marked - 1), (marked, begins, marked - begins)):
        done, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIR_BLOCK, "right")) - 1)
            i = np.repeat(of[at:to], n[at:to])
            j = np.arange(done[to] - done[at]) - np.repeat(done[at:to] - done[at], n[at:to]) + np.repeat(low[at:to], n[at:to])
            if low is begins:
                i, j = i[~tables.flag[j]], j[~tables.flag[j]]
            if len(i):
                yield i, j
            at = to


def join_lists(rep: np.ndarray, kind: np.ndarray, group: np.ndarray, length: np.ndarray, threshold: float):
    """(a, b, common, needed): pairs of texts, smaller number first, with their common seeds in these lists and what they need in all; blocks may repeat a pair."""
    if not len(rep):
        return
    need = shared_seeds(threshold)
    tables = list_tables(rep, kind, group, length)
    names, dense = np.unique(tables.rep, return_inverse=True)
    own_kind = np.zeros(len(names), np.int64)
    own_kind[dense] = tables.kind
    for i, j in table_pairs(tables, class_span(threshold)):
        a, b = np.minimum(dense[i], dense[j]), np.maximum(dense[i], dense[j])
        key = a * len(names) + b
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.append(True, np.diff(key) > 0))
        common = np.add.reduceat(tables.weight[i][order], start)
        key, common = key[start][common != 0], common[common != 0]
        a, b = key // len(names), key % len(names)
        x, y = own_kind[a], own_kind[b]
        yield names[a], names[b], common, np.where(x & y & 1, need[x >> 1, y >> 1], 1)


PAIRS_DDL = "a bigint, b bigint, common bigint, needed bigint"


def join_buckets(rows: DataFrame, buckets: int, threshold: float, longest: int | None = None, salts: int = 1, needed: bool = True) -> DataFrame:
    """(a, b, common, needed): pairs by bucket with the seeds they have in common there and need in all (1 unless ``needed``).

    Texts of lists longer than ``longest`` come out alone, as ``a`` with ``needed`` 0. Buckets from ``buckets`` on belong to
    seeds whose members are split into ``salts`` blocks (see :func:`hot_seeds.prefix_postings`): each joins two blocks.
    """

    def batch(*columns):
        return pa.record_batch([pa.array(np.asarray(c), pa.int64()) for c in columns], names=["a", "b", "common", "needed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for part in batches:
            held += [x.as_py() for x in part.column(part.schema.get_field_index("postings"))]
            number = part.column(part.schema.get_field_index("bucket"))[0].as_py()
        if number < 0:
            alone = np.unique(np.concatenate([unpacked(memoryview(x))[0] for x in held]))
            yield batch(alone, alone, np.zeros(len(alone)), np.zeros(len(alone)))
            return
        rep, kind, group, length = posting_lists(*gathered(held))
        if longest is not None and len(rep):
            hot = length[group] > longest
            alone = np.unique(rep[hot])
            yield batch(alone, alone, np.zeros(len(alone)), np.zeros(len(alone)))
            rep, kind, group = rep[~hot], kind[~hot], np.cumsum(np.append(True, np.diff(group[~hot]) > 0))[: (~hot).sum()] - 1
            length = length[length <= longest]
        split = number // buckets and salts > 1
        for a, b, common, need in join_lists(rep, kind, group, length, threshold):
            if split:
                # Two members of one block meet in the bucket of that block with itself.
                one, two = hot_seeds.blocks_of(number // buckets - 1, salts)
                use = (a % salts != b % salts) if one != two else np.ones(len(a), bool)
                a, b, common, need = a[use], b[use], common[use], need[use]
            yield batch(a, b, common, need if needed else np.ones(len(need)))

    return by_bucket(rows, buckets).applyInArrow(run, PAIRS_DDL)


def enough(found: DataFrame) -> DataFrame:
    """(a, b): the pairs whose common seeds, over all buckets, are as many as they need."""
    pairs = found.where("needed > 0").groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("needed").alias("needed"))
    return pairs.where(F.col("common") >= F.col("needed")).select("a", "b")


def candidates(texts: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """(a, b): distinct pairs of texts that share as many seeds as similar texts must."""
    # A seed that some task cuts short is longer than FREQUENT in its bucket, too.
    found = write_once(join_buckets(postings(texts, buckets, threshold, hot_seeds.FREQUENT), buckets, threshold, hot_seeds.FREQUENT), "joined")
    pairs = enough(found)
    often = found.where("needed = 0").select(F.col("a").alias("rep")).distinct()
    if not often.isEmpty():
        # Two texts that share a frequent seed both come here; the others have all their common seeds counted above.
        again = write_once(texts.join(often, "rep", "left_semi").select("rep", "text", "n"), "frequent")
        buckets = bucket_count(again, 1.0)
        salts = hot_seeds.blocks_for(again)
        marks, bits = hot_seeds.frequent_seeds(again, buckets)
        known = texts.sparkSession.sparkContext.broadcast(marks)
        more = join_buckets(hot_seeds.prefix_postings(again, buckets, threshold, known, bits, salts), buckets, threshold, salts=salts, needed=False)
        pairs = pairs.unionAll(enough(more)).distinct()
    return pairs


def checked(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows whose ``text_a`` and ``text_b``, their last columns, have a similarity of ``threshold`` or more, with ``common`` and ``similarity`` in place of the texts."""
    kept = rows.schema[:-2]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n_a, n_b, common = common_windows(batch.column(len(kept)), batch.column(len(kept) + 1))
                similarity = common / np.maximum(n_a + n_b - common, 1)
                ok = similarity >= threshold
                columns = [batch.column(k).filter(pa.array(ok)) for k in range(len(kept))]
                yield pa.record_batch([*columns, pa.array(common[ok], pa.int64()), pa.array(similarity[ok], pa.float64())], names=[f.name for f in kept] + ["common", "similarity"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", common bigint, similarity double")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, similarity) of the written pairs with ``threshold`` or more; ``texts`` is (rep, text).

    Only texts of some pair are moved. They are joined by number, in as many tasks as the pairs need.
    """
    tasks = max(parallelism(pairs.sparkSession), pairs.count() // PAIRS_A_TASK)
    need = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = write_once(texts.join(need, "rep", "left_semi").select("rep", "text"), "wanted")
    rows = pairs.repartition(tasks, "a").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.repartition(tasks, "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return checked(rows.select("a", "b", "text_a", "text_b"), threshold)


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.5, text: str = "sequence", number: str = "seq_no", least: int = 40) -> DataFrame:
    """(seq_a, seq_b, common, similarity): all pairs of distinct cleaned texts of ``threshold`` or more.

    Similarity is the share of distinct 12-letter windows in common among those of both; it is
    defined for texts of ``least`` letters or more, so null, blank and short texts give no rows.
    Equal texts stand as one under their smallest number; ``seq_a < seq_b``. Rows delivered again
    change nothing. Other columns of ``df``, whatever their names, are not read. An empty table
    gives no rows.
    """
    return text_pairs(write_once(distinct_texts(df, least, text, number), "texts"), threshold)


def text_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of :func:`near_duplicate_pairs` for distinct texts that are written already."""
    pairs = verified(write_once(candidates(texts, bucket_count(texts, 4.0), threshold), "candidates"), texts, threshold)
    return pairs.select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"), "common", "similarity")


def families(df: DataFrame, threshold: float = 0.5, text: str = "sequence", number: str = "seq_no", least: int = 40) -> DataFrame:
    """(seq_no, first_no, family, links): each record of ``least`` letters or more, once.

    ``first_no`` is the smallest number with its text, which stands for the text in the pairs; ``family`` is the smallest
    number of its family, its own if it has neither a near duplicate nor a copy before it. ``links`` counts the pairs
    that name the record, so records with ``first_no`` < ``seq_no`` and those without near duplicates have none.
    """
    texts = write_once(distinct_texts(df, least, text, number), "texts")
    pairs = write_once(text_pairs(texts, threshold).select("seq_a", "seq_b"), "pairs")
    ends = pairs.select(F.col("seq_a").alias("rep")).unionAll(pairs.select(F.col("seq_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    # Numbers are padded so that the smallest string is the smallest number.
    padded = [F.lpad(F.col(c).cast("string"), 20, "0").alias(c) for c in ("seq_a", "seq_b")]
    group = components(pairs.select(*padded), "seq_a", "seq_b").select(F.col("record_id").cast("bigint").alias("rep"), F.col("group_id").cast("bigint").alias("family"))
    digest = lambda c: [F.xxhash64(c).alias("d"), F.xxhash64(F.reverse(c)).alias("d2")]
    known = texts.select("rep", *digest(F.col("text"))).join(links, "rep", "left").join(group, "rep", "left")
    known = known.select("d", "d2", F.col("rep").alias("first_no"), F.coalesce("family", "rep").alias("family"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = df.select(F.col(number).cast("bigint").alias("seq_no"), cleaned(F.col(text)).alias("text")).where(F.col("seq_no").isNotNull() & (F.length("text") >= least))
    # A text of many records is the skewed side of a join whose other side has it once.
    rows = rows.select("seq_no", *digest(F.col("text"))).distinct().join(known, ["d", "d2"])
    return rows.select("seq_no", "first_no", "family", F.when(F.col("seq_no") == F.col("first_no"), F.col("links")).otherwise(0).alias("links"))
