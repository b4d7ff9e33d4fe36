"""Repeated sequences inside a class and between classes. All counts are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import by_pair, class_pairs

#: Share of sequences left after deduplication below which a pair fails (fixed value).
REMAINING_FAIL = 0.98


def texts(s: DataFrame) -> DataFrame:
    """(label, seq, k): each distinct sequence of a class with its number of copies."""
    return s.groupBy("label", "seq").agg(F.count(F.lit(1)).alias("k"))


def levels(s: DataFrame) -> DataFrame:
    """(label, seq, extra): extra copies of every sequence that a class holds more than once."""
    return texts(s).select("label", "seq", (F.col("k") - 1).alias("extra")).where(F.col("extra") > 0)


def ranked_levels(numbered: DataFrame) -> DataFrame:
    """(label, place, seq, extra): the :func:`levels` of (no, label, seq), most copies first, ties by the first appearance.

    ``place`` counts from 1 in each class. Only sequences with copies are ordered.
    """
    rows = numbered.groupBy("label", "seq").agg((F.count(F.lit(1)) - 1).alias("extra"), F.min("no").alias("first")).where(F.col("extra") > 0)
    order = Window.partitionBy("label").orderBy(F.desc("extra"), "first", "seq")
    return rows.select("label", F.row_number().over(order).alias("place"), "seq", "extra")


def bin_of(extra):
    """Name of the bin of a number of extra copies: 1 to 10 on their own, then by what they exceed."""
    out = F.when(extra > 1000, ">1000").when(extra > 500, ">500").when(extra > 100, ">100").when(extra > 50, ">50").when(extra > 10, ">10")
    return out.otherwise(extra.cast("string"))


def bins(s: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, label, bin, extra, percent): extra copies by bin, and their share of all sequences of both classes."""
    pairs = class_pairs(s) if pairs is None else pairs
    own = levels(s).groupBy("label", bin_of(F.col("extra")).alias("bin")).agg(F.sum("extra").alias("extra"))
    rows = own.join(F.broadcast(pairs), (own["label"] == pairs["label_1"]) | (own["label"] == pairs["label_2"]))
    return rows.select("label_1", "label_2", "label", "bin", "extra", (F.col("extra") * 100.0 / (F.col("n_1") + F.col("n_2"))).alias("percent"))


def within_check(s: DataFrame, pairs: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, remaining, flag): share of the pair's sequences that are left when each class is deduplicated.

    ``held`` are the :func:`texts` of ``s``, if they are known.
    """
    pairs = class_pairs(s) if pairs is None else pairs
    sizes = (texts(s) if held is None else held).groupBy("label").agg(F.count(F.lit(1)).alias("distinct"), F.sum("k").alias("n"))
    rows = by_pair(sizes, pairs, "distinct", "n").groupBy("label_1", "label_2").agg((F.sum("distinct") / F.sum("n")).alias("remaining"))
    left = F.col("remaining")
    return rows.withColumn("flag", F.when(left < REMAINING_FAIL, "Fail").when(left < 1, "Warning").otherwise("Pass"))


def shared(s: DataFrame) -> DataFrame:
    """(label_1, label_2, seq): sequences that both classes of a pair hold.

    One row per distinct (label, seq) is shuffled by sequence; a group has at most one row per class,
    so its pairs are bounded by the number of classes, however often a sequence occurs.
    """
    held = s.groupBy("seq").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    ones = held.select("seq", "labels", F.posexplode("labels").alias("i", "label_1"))
    return ones.select("label_1", F.explode(F.slice("labels", F.col("i") + 2, F.size("labels"))).alias("label_2"), "seq")


def between_check(s: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, shared, flag): number of sequences that both classes hold; any is a failure."""
    pairs = class_pairs(s) if pairs is None else pairs
    found = shared(s).groupBy("label_1", "label_2").agg(F.count(F.lit(1)).alias("shared"))
    # The pairs may be in another order than the labels.
    either = found.unionAll(found.select(F.col("label_2").alias("label_1"), F.col("label_1").alias("label_2"), "shared"))
    rows = pairs.join(either, ["label_1", "label_2"], "left").select("label_1", "label_2", F.coalesce("shared", F.lit(0)).alias("shared"))
    return rows.withColumn("flag", F.when(F.col("shared") > 0, "Fail").otherwise("Pass"))


def alphabet_check(s: DataFrame, alphabet: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, bases_1, bases_2, flag): a failure unless both classes use the same characters."""
    pairs = class_pairs(s) if pairs is None else pairs
    text = alphabet.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("feature")), "").alias("bases"))
    rows = pairs
    for k in (1, 2):
        rows = rows.join(text.select(F.col("label").alias(f"label_{k}"), F.col("bases").alias(f"bases_{k}")), f"label_{k}", "left")
    rows = rows.select("label_1", "label_2", *[F.coalesce(f"bases_{k}", F.lit("")).alias(f"bases_{k}") for k in (1, 2)])
    return rows.withColumn("flag", F.when(F.col("bases_1") == F.col("bases_2"), "Pass").otherwise("Fail"))
