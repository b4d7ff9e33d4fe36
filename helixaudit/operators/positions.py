"""What stands at each position of the sequences, read from either end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import composition
from .features import FORWARD, REVERSED, alphabets
from .metrics import FLOOR, by_pair, class_pairs, flag, two_by_two

#: Sequences that must reach a position for it to be reported (fixed value).
REPORTED = 50


def length_counts(s: DataFrame) -> DataFrame:
    """(label, len, n): sequences of each class by length."""
    return s.groupBy("label", F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def cohorts(lengths: DataFrame) -> DataFrame:
    """(label, pos, cohort, coverage): sequences that reach each 1-based position, and their share of the class.

    Works on the length histogram: a suffix sum, then each length stands for the positions down to the
    next shorter one.
    """
    by_len = Window.partitionBy("label").orderBy("len")
    rows = lengths.select(
        "label", "len",
        F.sum("n").over(by_len.rowsBetween(0, Window.unboundedFollowing)).alias("cohort"),
        F.coalesce(F.lag("len").over(by_len), F.lit(0)).alias("below"),
        F.sum("n").over(Window.partitionBy("label")).alias("total"),
    ).where(F.col("len") > F.col("below"))
    rows = rows.select("label", "cohort", "total", F.explode(F.sequence(F.col("below") + 1, F.col("len"))).alias("pos"))
    return rows.select("label", "pos", "cohort", (F.col("cohort") / F.col("total")).alias("coverage"))


def windows(lengths: DataFrame, end_position: int | None = None, min_coverage: float = 0.25, floor: int = FLOOR) -> DataFrame:
    """(label, sequences, end_position, scored_end_position) of each class.

    A position is reported as far as ``REPORTED`` sequences reach (all of it for smaller classes) and
    scored as far as max(``floor``, ``min_coverage`` of the class) reach; an explicit end is capped at
    the longest sequence and never widens what is scored.
    """
    down = Window.partitionBy("label").orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lengths.select("label", "len", "n", F.sum("n").over(down).alias("reach"), F.sum("n").over(Window.partitionBy("label")).alias("sequences"))
    required = F.greatest(F.lit(floor), F.ceil(F.lit(float(min_coverage)) * F.col("sequences")))
    rows = rows.withColumn("required", required)
    kth = lambda k: F.coalesce(F.max(F.when(F.col("reach") >= k, F.col("len"))), F.lit(0))
    out = rows.groupBy("label").agg(F.max("sequences").alias("sequences"), F.max("len").alias("longest"), kth(F.lit(REPORTED)).alias("kth"), kth(F.col("required")).alias("scored"))
    reported = F.when(F.col("sequences") < REPORTED, F.col("longest")).otherwise(F.col("kth"))
    end = F.greatest(reported, F.col("scored")) if end_position is None else F.least(F.lit(end_position), F.col("longest"))
    out = out.withColumn("end_position", end.cast("int"))
    return out.select("label", "sequences", "end_position", F.least("scored", "end_position").cast("int").alias("scored_end_position"))


def cohort_floor(sizes: DataFrame, pairs: DataFrame, min_coverage: float = 0.25, floor: int = FLOOR) -> DataFrame:
    """(label_1, label_2, cohort_floor): the share of a class that must reach a position for it to be scored.

    Each class asks for max(``floor``, ``min_coverage`` of it) of its ``n`` sequences; the larger share of the two binds.
    """
    share = F.greatest(F.lit(floor), F.ceil(F.lit(float(min_coverage)) * F.col("n"))) / F.col("n")
    rows = by_pair(sizes.where("n > 0").select("label", share.alias("share")), pairs, "share")
    return rows.groupBy("label_1", "label_2").agg(F.max("share").alias("cohort_floor"))


def pair_windows(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(label_1, label_2, end_position, scored_end_position): the windows both classes allow."""
    rows = by_pair(own, pairs, "end_position", "scored_end_position")
    return rows.groupBy("label_1", "label_2").agg(F.min("end_position").alias("end_position"), F.min("scored_end_position").alias("scored_end_position"))


def position_counts(s: DataFrame, reverse: bool = False, end: DataFrame | None = None) -> DataFrame:
    """(label, pos, base, n): how often each character stands at each 1-based position of a class.

    ``end`` (label, last) cuts the sequences before their letters are counted.
    """
    return both_counts(s, end, (reverse,)).drop("reverse")


def both_counts(s: DataFrame, end: DataFrame | None = None, directions: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(label, reverse, pos, base, n): the :func:`position_counts` of both directions, in one pass."""
    s = s.select("label", "seq", F.lit(None).alias("last")) if end is None else s.join(F.broadcast(end), "label")
    return composition.positions(s, directions).groupBy("label", "reverse", "pos", "base").agg(F.sum("n").alias("n"))


def position_metrics(s: DataFrame, reverse: bool = False, end_position: int | None = None, min_coverage: float = 0.25, floor: int = FLOOR) -> DataFrame:
    """(label_1, label_2, check, base, pos, auroc, aupr, accuracy, flag): every base of either class at every reported position.

    Positions past the scored window, or that fewer than ``floor`` sequences of either class reach, are
    Unknown with null metrics.
    """
    return both_metrics(s, class_pairs(s), alphabets(s), length_counts(s), end_position, min_coverage, floor, (reverse,))


def both_metrics(s: DataFrame, pairs: DataFrame, alphabet: DataFrame, lengths: DataFrame, end_position: int | None = None, min_coverage: float = 0.25, floor: int = FLOOR, directions: tuple[bool, ...] = (False, True)) -> DataFrame:
    """The :func:`position_metrics` of both directions, in one pass over the sequences."""
    own = windows(lengths, end_position, min_coverage, floor)
    both = pair_windows(own, pairs)
    counts = both_counts(s, own.select("label", F.col("scored_end_position").alias("last")), directions)
    bases = by_pair(alphabet, pairs, "feature").select("label_1", "label_2", F.col("feature").alias("base")).distinct()
    grid = bases.join(F.broadcast(both), ["label_1", "label_2"])
    # At most (bases x positions) rows per pair and direction; an empty window gives none.
    grid = grid.where(F.col("end_position") >= 1).withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("end_position")))).withColumn("reverse", F.explode(F.array(*map(F.lit, directions))))
    reach = by_pair(cohorts(lengths), pairs, "pos", "cohort")
    c = lambda k, v: F.coalesce(F.sum(F.when(F.col("side") == k, F.col(v))), F.lit(0))
    reach = reach.groupBy("label_1", "label_2", "pos").agg(c(1, "cohort").alias("c1"), c(2, "cohort").alias("c2"))
    held = by_pair(counts, pairs, "reverse", "pos", "base", "n").groupBy("label_1", "label_2", "reverse", "pos", "base").agg(c(1, "n").alias("m1"), c(2, "n").alias("m2"))
    rows = grid.join(reach, ["label_1", "label_2", "pos"], "left").join(held, ["label_1", "label_2", "reverse", "pos", "base"], "left").na.fill(0, ["m1", "m2", "c1", "c2"])
    scorable = (F.col("pos") <= F.col("scored_end_position")) & (F.least("c1", "c2") >= max(floor, 1))
    # Null counts keep the closed form from dividing by an empty cohort.
    own_of = lambda name: F.when(scorable, F.col(name))
    auroc, aupr, accuracy = two_by_two(own_of("m1"), own_of("c1"), own_of("m2"), own_of("c2"))
    check = F.when(F.col("reverse"), REVERSED).otherwise(FORWARD).alias("check")
    rows = rows.select("label_1", "label_2", check, "base", "pos", F.when(scorable, auroc).alias("auroc"), F.when(scorable, aupr).alias("aupr"), F.when(scorable, accuracy).alias("accuracy"))
    return rows.withColumn("flag", flag(F.col("auroc")))
