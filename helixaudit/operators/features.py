"""Features of labelled sequences, one row per value that is not zero.

Input everywhere: ``(label string, seq string)``, one row per sequence; see ``sources.tables.labelled``.
The built-in features are counted in one pass over the letters (:mod:`composition`), so nothing is shuffled
before the values are aggregated to histograms, whose size depends on distinct values only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .composition import composition

#: Check names, in report order (fixed values).
BASES = "Unique bases"
WITHIN = "Sequence Duplications within Labels"
BETWEEN = "Duplicate Sequences between Labels"
LENGTHS = "Sequence lengths"
GC = "Per sequence GC content"
NUCLEOTIDES = "Per sequence nucleotide content"
DINUCLEOTIDES = "Per sequence dinucleotide content"
FORWARD = "Per position nucleotide content"
REVERSED = "Per position reversed nucleotide content"
CHECKS = (BASES, WITHIN, BETWEEN, LENGTHS, GC, NUCLEOTIDES, DINUCLEOTIDES, FORWARD, REVERSED)


def letters(seq: Column) -> Column:
    """Distinct characters of a sequence; an empty one has none."""
    return F.filter(F.array_distinct(F.split(seq, "")), lambda c: c != "")


@dataclass(frozen=True)
class Feature:
    """A named family of values of a sequence.

    ``values`` turns (label, seq) into (label, feature, value) rows, at most one per sequence and
    feature; a sequence without a row for a feature has the value 0. ``domain`` gives the
    features of a class as (label, feature) from its letters, for families whose features are
    compared even where no sequence has them; the two classes' domains are united.
    """

    check: str
    values: Callable[[DataFrame], DataFrame]
    domain: Callable[[DataFrame], DataFrame] | None = None
    #: What :mod:`composition` calls a built-in family.
    kind: str = ""


def _built_in(check: str, kind: str, domain: Callable[[DataFrame], DataFrame] | None = None) -> Feature:
    return Feature(check, lambda s: composition(s, {kind: check}, tally=False).select("label", "feature", "value"), domain, kind)


def _pair_domain(alphabet: DataFrame) -> DataFrame:
    other = alphabet.select("label", F.col("feature").alias("second"))
    return alphabet.join(other, "label").select("label", F.concat("feature", "second").alias("feature"))


FEATURES = (
    _built_in(LENGTHS, "length"),
    _built_in(GC, "gc"),
    _built_in(NUCLEOTIDES, "base", lambda alphabet: alphabet),
    _built_in(DINUCLEOTIDES, "pair", _pair_domain),
)


def scalar_feature(check: str, value: Column) -> Feature:
    """A user's feature: one number per sequence, as a column expression over ``seq`` (or a pandas UDF); null counts as 0."""
    return Feature(check, lambda s: s.select("label", F.lit("").alias("feature"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")))


def column_features(check: str, values: dict[str, Column]) -> Feature:
    """A user's family of features: several numbers per sequence, by name, each a column expression over ``seq``.

    Each has a row of its own in reports, and the check is as bad as the worst of them. A null counts as 0.
    """
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("feature"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")) for name, value in values.items()]))
    return Feature(check, lambda s: s.select("label", rows))


def alphabets(s: DataFrame) -> DataFrame:
    """(label, feature): the distinct characters of each class."""
    return s.select("label", F.explode(letters(F.col("seq"))).alias("feature")).distinct()


def histograms(s: DataFrame, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """(check, label, feature, value, n): sequences of each class by value of each feature, zeros left out of families with a domain."""
    kinds = {f.kind: f.check for f in features if f.kind}
    parts = [composition(s, kinds)] if kinds else []
    parts += [f.values(s).select(F.lit(f.check).alias("check"), "label", "feature", "value", F.lit(1).cast("bigint").alias("n")) for f in features if not f.kind]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("check", "label", "feature", "value").agg(F.sum("n").alias("n"))


def class_summary(s: DataFrame) -> DataFrame:
    """(label, sequences, bases, unique_bases, gc, distinct_sequences, empty_sequences, min_length, mean_length, max_length).

    Exact; empty sequences are members of their class; a class without bases has a GC share of 0.
    """
    n = F.length("seq")
    # Counted by text first, so that the distinct count needs no second pass over the rows.
    texts = s.groupBy("label", "seq").agg(F.count(F.lit(1)).alias("k"))
    of = texts.groupBy("label").agg(
        F.sum("k").alias("sequences"),
        F.sum(n * F.col("k")).alias("bases"),
        F.sum((n - F.length(F.translate("seq", "GC", ""))) * F.col("k")).alias("strong"),
        F.count(F.lit(1)).alias("distinct_sequences"),
        F.sum(F.when(n == 0, F.col("k")).otherwise(0)).alias("empty_sequences"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
    )
    bases = alphabets(s).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("feature")), "").alias("unique_bases"))
    return of.join(bases, "label", "left").select(
        "label", "sequences", "bases", F.coalesce("unique_bases", F.lit("")).alias("unique_bases"),
        F.coalesce(F.try_divide(F.col("strong").cast("double"), F.col("bases")), F.lit(0.0)).alias("gc"),
        "distinct_sequences", "empty_sequences", "min_length", (F.col("bases") / F.col("sequences")).alias("mean_length"), "max_length",
    )
