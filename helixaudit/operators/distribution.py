"""How the values of features are spread in a class: ranges, letter values and histograms, for drawing.

Everything comes from the histograms of distinct values, so no sequence is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES, Feature

#: Depths of the letter values: the median, then quarters, eighths, ... on either side.
DEPTHS = 5


def with_zeros(hist: DataFrame, alphabet: DataFrame, sizes: DataFrame, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """(label, check, feature, value, n): the histograms with the sequences that lack a feature of their class at value 0."""
    domains = [f.domain(alphabet).select("label", F.lit(f.check).alias("check"), "feature") for f in features if f.domain]
    rows = hist.select("label", "check", "feature", "value", "n")
    keys = ["label", "check", "feature"]
    for domain in domains:
        held = rows.groupBy(*keys).agg(F.sum("n").alias("held"))
        zero = domain.join(held, keys, "left").join(F.broadcast(sizes.select("label", F.col("n").alias("size"))), "label")
        zero = zero.select(*keys, F.lit(0.0).alias("value"), (F.col("size") - F.coalesce("held", F.lit(0))).alias("n"))
        rows = rows.unionByName(zero.where(F.col("n") > 0))
    return rows


def tails(depths: int = DEPTHS) -> list[float]:
    """Shares below the letter values: 1/2, then 1/4 and 3/4, 1/8 and 7/8, ..."""
    return [0.5] + [q for k in range(2, depths + 1) for q in (0.5**k, 1 - 0.5**k)]


def letter_values(rows: DataFrame, depths: int = DEPTHS) -> DataFrame:
    """(label, check, feature, n, low, high, letters array): exact, interpolated between neighbours; ``letters`` follows :func:`tails`."""
    cut = F.percentile("value", F.array(*map(F.lit, tails(depths))), F.col("n"))
    return rows.groupBy("label", "check", "feature").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), cut.alias("letters"))


def grid(rows: DataFrame, cells: int = 50) -> DataFrame:
    """(label, check, feature, cell, n): sequences by cell of an even grid over the range that all classes of a feature span together."""
    span = rows.groupBy("check", "feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("low")) * cells, F.col("high") - F.col("low")), F.lit(0.0))), F.lit(cells - 1)).cast("int")
    return rows.join(span, ["check", "feature"]).groupBy("label", "check", "feature", at.alias("cell")).agg(F.sum("n").alias("n"))
