"""How well a single feature separates two classes: AU-ROC, average precision, best accuracy.

All scores come from histograms of distinct values (:func:`features.histograms`), so the ranking
window sees distinct values, never sequences, and all class pairs and features are scored in one
job. Class 1 of a pair, the one of lower order, is the positive class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .features import FEATURES, Feature, alphabets, histograms

#: Type of counts that are multiplied with one another.
COUNT = "decimal(15,0)"
#: Sequences that the smaller class needs to be scored (fixed value).
FLOOR = 250
#: AU-ROC above which a feature is a warning or a failure (fixed values).
WARNING, FAIL = 0.6, 0.7
KEYS = ("label_1", "label_2", "check", "feature")


def flag(auroc: Column) -> Column:
    """Fail, Warning, Pass, or Unknown for a missing score."""
    return F.when(auroc.isNull(), "Unknown").when(auroc > FAIL, "Fail").when(auroc > WARNING, "Warning").otherwise("Pass")


def class_pairs(s: DataFrame, order: dict[str, int] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, n_1, n_2): all pairs of classes, in the order of ``order`` or of the labels.

    ``sizes`` (label, n) saves the count if it is known. The table has one row per class (at most some
    dozens), so the pairs are few.
    """
    sizes = s.groupBy("label").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    place = F.col("label") if order is None else F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("label"))
    one = sizes.select(F.col("label").alias("label_1"), F.col("n").alias("n_1"), place.alias("o_1"), F.lit(0).alias("k"))
    two = sizes.select(F.col("label").alias("label_2"), F.col("n").alias("n_2"), place.alias("o_2"), F.lit(0).alias("k"))
    return one.join(two, (F.col("o_1") < F.col("o_2")) & (one["k"] == two["k"])).select("label_1", "label_2", "n_1", "n_2")


def by_pair(rows: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """Rows of either class of each pair, with ``side`` 1 or 2.

    ``pairs`` has one row per pair of classes, so its two sides are broadcast, and the rows are read once.
    """
    side = lambda k: F.struct(F.col(f"label_{k}").alias("label"), F.lit(k).alias("side"))
    sides = pairs.select("label_1", "label_2", F.inline(F.array(side(1), side(2))))
    return rows.join(F.broadcast(sides), "label").select("label_1", "label_2", "side", *columns)


def pair_histograms(hist: DataFrame, alphabet: DataFrame, pairs: DataFrame, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """(label_1, label_2, check, feature, value, a, b): sequences of both classes by value, zeros included.

    Each feature of a domain has a row of value 0 to begin with, to which the sequences are added that no other row counts. So
    there is one exchange by value and one by feature, which the windows behind it share.
    """
    rows = by_pair(hist, pairs, "check", "feature", "value", "n").withColumn("zero", F.lit(False))
    for f in features:
        if f.domain:
            own = by_pair(f.domain(alphabet).select(F.lit(f.check).alias("check"), "label", "feature"), pairs, "check", "feature")
            rows = rows.unionByName(own.select("*", F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("zero")))
    a, b = (F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "a"), (2, "b")))
    counts = rows.groupBy(*KEYS, "value").agg(a, b, F.max("zero").alias("zero"))
    whole = Window.partitionBy(*KEYS)
    counts = counts.select("*", F.sum("a").over(whole).alias("held_a"), F.sum("b").over(whole).alias("held_b")).join(F.broadcast(pairs), ["label_1", "label_2"])
    a, b = (F.when(F.col("zero"), F.col(c) + F.col(n) - F.col(f"held_{c}")).otherwise(F.col(c)).alias(c) for c, n in (("a", "n_1"), ("b", "n_2")))
    return counts.select(*KEYS, "value", a, b).where((F.col("a") > 0) | (F.col("b") > 0))


def tie_group_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc, aupr, accuracy) from (keys, value, a, b), one row per distinct value.

    The direction of a feature is ignored: a score that ranks the positive class lower is inverted
    for all three. Whether it does is decided on integers (twice the Mann-Whitney statistic),
    so no rounding can turn a feature at chance around.
    """
    order = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    rows = counts.select(*keys, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.sum("a").over(order).alias("ca"), F.sum("b").over(order).alias("cb"), F.sum("a").over(whole).alias("n1"), F.sum("b").over(whole).alias("n2"))
    a, b, ca, cb, n1, n2 = (F.col(c) for c in ("a", "b", "ca", "cb", "n1", "n2"))
    above_a, above_b = n1 - ca + a, n2 - cb + b
    share = a / n1
    out = rows.groupBy(*keys).agg(
        F.first("n1").alias("n1"),
        F.first("n2").alias("n2"),
        F.sum(a.cast(COUNT) * (2 * (cb - b) + b).cast(COUNT)).alias("u2"),
        F.sum(F.try_divide(share * above_a, above_a + above_b)).alias("ap_up"),
        F.sum(F.try_divide(share * ca, ca + cb)).alias("ap_down"),
        F.max(n1 - ca + cb).alias("cut_up"),
        F.max(ca + n2 - cb).alias("cut_down"),
    )
    both = n1.cast(COUNT) * n2.cast(COUNT)
    down = F.col("u2") < both
    best = F.greatest(n1, n2, F.when(down, F.col("cut_down")).otherwise(F.col("cut_up")))
    return out.select(
        *keys,
        F.try_divide(F.greatest(F.col("u2"), 2 * both - F.col("u2")).cast("double"), (2 * both).cast("double")).alias("auroc"),
        F.when(down, F.col("ap_down")).otherwise(F.col("ap_up")).alias("aupr"),
        F.try_divide(best.cast("double"), n1 + n2).alias("accuracy"),
    )


def two_by_two(m1: Column, c1: Column, m2: Column, c2: Column) -> tuple[Column, Column, Column]:
    """AU-ROC, average precision and best accuracy of a yes/no feature, in closed form.

    ``m`` of the ``c`` sequences of a class have it. The feature has two tie groups, with and without it, so these are the
    sums of :func:`tie_group_metrics` written out for both ways of ranking them: twice the Mann-Whitney statistic is
    m1 * (2 * (c2 - m2) + m2) + (c1 - m1) * (c2 - m2), and either way the group ranked last holds all sequences.
    """
    # Products of two counts pass 64 bits at some billions of sequences.
    m1, c1, m2, c2 = (c.cast(COUNT) for c in (m1, c1, m2, c2))
    twice = m1 * (2 * c2 - m2) + (c1 - m1) * (c2 - m2)
    without = twice < c1 * c2

    def ranked_first(a: Column, b: Column) -> tuple[Column, Column]:
        # The group of a and b sequences comes first; all c1 + c2 follow. An empty group adds nothing.
        head = F.coalesce(F.try_divide((a * a).cast("double"), (c1 * (a + b)).cast("double")), F.lit(0.0))
        return head + F.try_divide((c1 - a).cast("double"), (c1 + c2).cast("double")), F.greatest(a + c2 - b, c1, c2)

    (with_ap, with_hit), (other_ap, other_hit) = ranked_first(m1, m2), ranked_first(c1 - m1, c2 - m2)
    return (
        F.try_divide(F.greatest(twice, 2 * c1 * c2 - twice).cast("double"), (2 * c1 * c2).cast("double")),
        F.when(without, other_ap).otherwise(with_ap),
        F.try_divide(F.when(without, other_hit).otherwise(with_hit).cast("double"), (c1 + c2).cast("double")),
    )


def feature_metrics(s: DataFrame, features: tuple[Feature, ...] = FEATURES, floor: int = FLOOR, pairs: DataFrame | None = None, alphabet: DataFrame | None = None, hist: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, check, feature, auroc, aupr, accuracy, flag) for every pair of classes.

    Scalar checks have one row with an empty ``feature``. Below ``floor`` sequences in the smaller
    class the metrics are null and the flag is Unknown.
    """
    pairs = class_pairs(s) if pairs is None else pairs
    # The histograms are read for values and for zeros; written once, they cost one pass over the sequences.
    hist = write_once(histograms(s, features), "histograms") if hist is None else hist
    scored = tie_group_metrics(pair_histograms(hist, alphabets(s) if alphabet is None else alphabet, pairs, features), list(KEYS))
    rows = scored.join(F.broadcast(pairs), ["label_1", "label_2"])
    enough = F.least("n_1", "n_2") >= floor
    metrics = [F.when(enough, F.col(c)).alias(c) for c in ("auroc", "aupr", "accuracy")]
    return rows.select(*KEYS, *metrics).withColumn("flag", flag(F.col("auroc")))


def worst_case(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The headline of sub-checks: each metric's maximum on its own, missing scores ignored, and the flag of its AU-ROC."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("auroc", "aupr", "accuracy")]).withColumn("flag", flag(F.col("auroc")))
