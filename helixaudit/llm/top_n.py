"""The best N items of every group, band by band from the highest scores down.

Groups, items and scores are written once, sorted by score in each file. Each band reads only rows whose score lies in it (a filter that
reaches the scan and skips pages), leaves out
groups that bands above have filled, and adds what is carried of groups not filled yet. Rows of
filled groups in lower bands are never shuffled or ranked, and once all groups are filled no band is read any more. Ties never straddle bands, as a band
is a range of scores; inside the band that completes a group they are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from ..sources.hits import complete_hits, id_number

#: Shares of the rows that lie above the lower edge of each band but the last.
BANDS = (0.1, 0.4)


def top_n_by_bands(rows: DataFrame, n: int, group: str, item: str, score: str, ties: list[Column], bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(group, item, score, rank): the ``n`` best distinct items of each group, an item counting with its best score.

    ``rows`` must hold no null group, item or score; ``ties`` orders equal scores and should end in
    the item, so that the result is the same on every run. Groups with fewer items come out whole.
    The edges of the bands only steer the work: any edges give the same result.
    """
    rows = write_once(rows.select(group, item, score).sortWithinPartitions(F.desc(score)), "scores")
    groups = rows.select(group).distinct().count()
    edges = rows.agg(F.percentile_approx(score, F.array(*[F.lit(1 - b) for b in bands]), F.lit(1000))).first()[0] or []
    edges = sorted({float(x) for x in edges}, reverse=True)
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    finished, carried, above = None, None, None
    for low in [*edges, None]:
        band = rows if low is None else rows.where(F.col(score) >= low)
        band = band if above is None else band.where(F.col(score) < above)
        if finished is not None:
            band = band.join(finished.select(group).distinct(), group, "left_anti")
        best = band.groupBy(group, item).agg(F.max(score).alias(score))
        if carried is not None:
            best = best.unionByName(carried.select(group, item, score)).groupBy(group, item).agg(F.max(score).alias(score))
        # The rank filter lets Spark cut each group to n rows on the map side, so a hot group costs no more than others.
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        ranked = write_once(ranked.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(group))), "band")
        full = ranked.where(F.col("held") >= n)
        finished = full if finished is None else finished.unionByName(full)
        carried, above = ranked.where(F.col("held") < n), low
        if low is not None and finished.select(group).distinct().count() == groups:
            break
    return finished.unionByName(carried).select(group, item, score, "rank")


def top_targets(hits: DataFrame, n: int = 5) -> DataFrame:
    """(query, target, pident, rank) of the ``n`` best targets of each query among the complete hits.

    Higher ``pident`` first, ties by the smaller number in the target id (ids without a number
    last, by text). Incomplete hits (null or NaN in any column) are ignored; repeated rows count
    once; an empty table gives no rows; extra columns are not read.
    """
    return top_n_by_bands(complete_hits(hits), n, "query", "target", "pident", [id_number("target", "train").asc_nulls_last(), F.col("target")])
