"""The report on classes: all checks on all class pairs as one ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import duplicates
from ..operators.features import BASES, BETWEEN, CHECKS, FEATURES, FORWARD, LENGTHS, NUCLEOTIDES, REVERSED, WITHIN, Feature, alphabets, histograms
from ..operators.metrics import FLOOR, class_pairs, feature_metrics, worst_case
from ..operators.positions import both_metrics, length_counts
from ..session import write_once

METRICS = ("auroc", "aupr", "accuracy")


def _rows(df: DataFrame, check: Column, name: Column, headline: bool, order: list[Column]) -> DataFrame:
    metrics = [(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in METRICS]
    key = F.concat_ws(" ", *order) if order else F.lit("")
    return df.select("label_1", "label_2", check.alias("group"), name.alias("check"), F.lit(headline).alias("headline"), key.alias("key"), *metrics, "flag")


def class_report(s: DataFrame, end_position: int | None = None, min_coverage: float = 0.25, floor: int = FLOOR, features: tuple[Feature, ...] = FEATURES, order: dict[str, int] | None = None, hist: DataFrame | None = None) -> DataFrame:
    """(label_1, label_2, row, check, flag, auroc, aupr, accuracy), ``row`` counting from 1 in each pair.

    Headlines come first, in check order; then the sub-checks of each check: features by name, positions
    base by base, each base followed by its own headline. Rule checks have no metrics. A check
    without any sub-check has no headline. ``hist`` are the histograms of ``s``, if they are written already.
    """
    # Three passes over the sequences: values of all features, distinct texts, positions. All else is read from what these wrote.
    hist = write_once(histograms(s, features), "histograms") if hist is None else hist
    checks = {f.check for f in features if f.kind}
    lengths = hist.where(F.col("check") == LENGTHS).select("label", F.col("value").cast("int").alias("len"), "n") if LENGTHS in checks else write_once(length_counts(s), "lengths")
    pairs = write_once(class_pairs(s, order, lengths.groupBy("label").agg(F.sum("n").alias("n"))), "pairs")
    alphabet = write_once(hist.where(F.col("check") == NUCLEOTIDES).select("label", "feature").distinct() if NUCLEOTIDES in checks else alphabets(s), "alphabets")
    held = write_once(duplicates.texts(s), "texts")
    lit = F.lit
    parts = [
        _rows(duplicates.alphabet_check(s, alphabet, pairs), lit(BASES), lit(BASES), True, []),
        _rows(duplicates.within_check(s, pairs, held), lit(WITHIN), lit(WITHIN), True, []),
        _rows(duplicates.between_check(held, pairs), lit(BETWEEN), lit(BETWEEN), True, []),
    ]
    single = write_once(feature_metrics(s, features, floor, pairs, alphabet, hist), "features")
    check, feature = F.col("check"), F.col("feature")
    parts.append(_rows(single.where(feature == ""), check, check, True, []))
    many = single.where(feature != "")
    parts.append(_rows(many, check, F.concat(check, lit(" - "), feature), False, [feature]))
    parts.append(_rows(worst_case(many, ["label_1", "label_2", "check"]), check, check, True, []))
    places = write_once(both_metrics(s, pairs, alphabet, lengths, end_position, min_coverage, floor), "positions")
    base = F.col("base")
    # Code points keep the order of bases where the names would not.
    by_base = F.lpad(F.ascii("base").cast("string"), 8, "0")
    parts.append(_rows(places, check, F.concat(check, lit(" - "), base, lit(" position "), F.col("pos").cast("string")), False, [by_base, F.lpad(F.col("pos").cast("string"), 12, "0")]))
    per_base = worst_case(places, ["label_1", "label_2", "check", "base"])
    parts.append(_rows(per_base, check, F.concat(check, lit(" - "), base), False, [by_base, lit("~")]))
    parts.append(_rows(worst_case(places, ["label_1", "label_2", "check"]), check, check, True, []))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = [c for c in CHECKS if c not in (FORWARD, REVERSED)] + [f.check for f in features if f.check not in CHECKS] + [FORWARD, REVERSED]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("group"))
    # A pair's rows are its features and positions (some tens of thousands), never sequences.
    row = F.row_number().over(Window.partitionBy("label_1", "label_2").orderBy(F.desc("headline"), place, "key", "check"))
    return rows.select("label_1", "label_2", row.alias("row"), "check", "headline", "flag", *METRICS)


def verdict(report: DataFrame) -> DataFrame:
    """(label_1, label_2, flag, checks): headline flags of each pair."""
    return report.where("headline").groupBy("label_1", "label_2", "flag").agg(F.count(F.lit(1)).alias("checks"))


def simple_report(report: DataFrame) -> DataFrame:
    """The columns of the CSV report of one pair: Check, Flag, AU-ROC, AU-PR, Accuracy, in row order."""
    return report.orderBy("row").select(F.col("check").alias("Check"), F.col("flag").alias("Flag"), F.col("auroc").alias("AU-ROC"), F.col("aupr").alias("AU-PR"), F.col("accuracy").alias("Accuracy"))
