"""What a table of hits says about leakage of test sequences into training."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.hits import HIT_SCHEMA, complete_hits, id_number

#: Share of leaked queries, in percent, from which a split fails (fixed value); any leak is a warning.
FAIL_SHARE = 2.0
#: Hits shown in a report (fixed value).
LISTED = 100


def with_similarity(hits: DataFrame) -> DataFrame:
    """Complete hits with ``min_cov``, ``similarity`` (0 to 100) and the numbers of both ids.

    The smaller coverage counts, so a short sequence inside a long one is no leak.
    """
    rows = complete_hits(hits).withColumn("min_cov", F.least("qcov", "tcov"))
    return rows.select("*", (F.col("min_cov") * F.col("pident")).alias("similarity"), id_number("query", "test").alias("query_no"), id_number("target", "train").alias("target_no"))


def checked_ids(rows: DataFrame, n_queries: int, n_targets: int) -> DataFrame:
    """The rows; fails when the job runs if an id is none of ``seq_<n>_test`` / ``seq_<n>_train`` below the given numbers."""
    ok = F.coalesce((F.col("query_no") < n_queries) & (F.col("target_no") < n_targets), F.lit(False))
    return rows.where(F.assert_true(ok, F.concat_ws(" ", F.lit("hit of an unknown sequence:"), "query", "target")).isNull())


def known_hits(hits: DataFrame, n_queries: int, n_targets: int, source: str = "hits") -> DataFrame:
    """The complete hits, kept; raises if one names a sequence that is none of the given numbers. The caller unpersists them."""
    rows = checked_ids(with_similarity(hits), n_queries, n_targets).select(*[f.name for f in HIT_SCHEMA]).persist()
    try:
        rows.count()
    except Exception as error:
        rows.unpersist()
        if found := re.search(r"hit of an unknown sequence: [^\n]*", str(error)):
            raise ValueError(f"{source}: {found[0]}") from None
        raise
    return rows


def reverse_strand() -> Column:
    """Whether a hit has descending coordinates. Such hits are counted, never dropped."""
    return (F.col("qstart") > F.col("qend")) | (F.col("tstart") > F.col("tend"))


def best_similarity(hits: DataFrame, side: str = "query") -> DataFrame:
    """(id, similarity float): the best hit of each query or target that has one."""
    return with_similarity(hits).groupBy(F.col(side).alias("id")).agg(F.max("similarity").cast("float").alias("similarity"))


def summary(hits: DataFrame, threshold: float = 90.0) -> DataFrame:
    """One row: hits, leaked hits, leaked and hit queries and targets, hits with descending coordinates (all, leaked)."""
    rows = with_similarity(hits)
    leaked = F.col("similarity") >= threshold
    # Per id first, so that the distinct counts are plain counts of small rows.
    sides = [rows.groupBy(side).agg(F.max(leaked).alias("leaked")).agg(F.count(F.lit(1)).alias(f"{name}_hit"), F.count_if("leaked").alias(f"{name}_leaked")) for side, name in (("query", "queries"), ("target", "targets"))]
    every = rows.agg(F.count(F.lit(1)).alias("hits"), F.count_if(leaked).alias("hits_leaked"), F.count_if(reverse_strand()).alias("hits_reversed"), F.count_if(reverse_strand() & leaked).alias("leaked_reversed"))
    one = every.withColumn("k", F.lit(1))
    for side in sides:
        one = one.join(side.withColumn("k", F.lit(1)), "k")
    return one.drop("k")


def leak_flag(percent: Column) -> Column:
    return F.when(percent >= FAIL_SHARE, "Fail").when(percent > 0, "Warning").otherwise("Pass")


def threshold_stats(hits: DataFrame, n_queries: int, n_targets: int, threshold: float = 90.0) -> DataFrame:
    """The summary with percentages of all queries and targets, those without hits, and the flag."""
    rows = summary(hits, threshold)
    for name, n in (("queries", n_queries), ("targets", n_targets)):
        rows = rows.withColumn(f"{name}_total", F.lit(n).cast("bigint"))
        rows = rows.withColumn(f"{name}_without_hits", F.greatest(F.lit(n) - F.col(f"{name}_hit"), F.lit(0)).cast("bigint"))
        rows = rows.withColumn(f"{name}_leaked_percent", F.coalesce(F.try_divide(F.col(f"{name}_leaked") * 100.0, F.lit(float(n))), F.lit(0.0)))
    return rows.withColumn("flag", leak_flag(F.col("queries_leaked_percent")))


def split_check(stats: DataFrame) -> DataFrame:
    """The one row of the split report, as its CSV writes it."""
    percent = lambda c: F.format_string("%.2f%%", c)
    return stats.select(F.lit("Data Leakage").alias("Check"), F.col("flag").alias("Flag"), percent(F.col("queries_leaked_percent")).alias("Percentage of leaked queries"), percent(F.col("targets_leaked_percent")).alias("Percentage of leaked targets"))


#: Total order of listed hits: most similar first, then by place, then by everything else.
def listing_order() -> list[Column]:
    return [F.desc("similarity"), *[F.asc(c) for c in ("query_no", "target_no", "qstart", "qend", "tstart", "tend", "qcov", "tcov", "pident", "evalue", "alnlen", "qaln", "taln", "query", "target")]]


def leaked_hits(hits: DataFrame, threshold: float = 90.0) -> DataFrame:
    """All leaked hits, in no order."""
    return with_similarity(hits).where(F.col("similarity") >= threshold)


def listing(hits: DataFrame, threshold: float = 90.0, most: int = LISTED) -> DataFrame:
    """The first leaked hits in the total order (a top-k, never a sort of all hits)."""
    return leaked_hits(hits, threshold).orderBy(*listing_order()).limit(most)


def histogram(hits: DataFrame, ids: DataFrame, side: str = "query") -> DataFrame:
    """(bin, sequences): sequences of ``ids`` (column id) by best similarity, in ten bins of 10; the last is closed, no hit counts in the first."""
    best = ids.select("id").distinct().join(best_similarity(hits, side), "id", "left")
    at = F.least(F.floor(F.coalesce("similarity", F.lit(0.0)) / 10), F.lit(9)).cast("int")
    return best.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("sequences"))


def export(hits: DataFrame, path: str, threshold: float = 90.0) -> None:
    """All leaked hits in the total order, tab-separated with a header, also when there are none.

    ``path`` becomes a folder of part files, each a range of the order, whose names follow it; few hits make one file.
    """
    columns = [f.name for f in HIT_SCHEMA] + ["min_cov", F.col("similarity").alias("min_cov*pident")]
    leaked_hits(hits, threshold).orderBy(*listing_order()).select(*columns).write.csv(path, sep="\t", header=True)
