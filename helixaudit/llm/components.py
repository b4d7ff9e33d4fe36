"""Groups of records linked directly or through others: randomised contraction of the match graph.

Every round each vertex hooks to the vertex of the lowest fresh hash among itself and its
neighbours; edges are relabelled, loops and repetitions dropped. A constant share of the vertices
is expected to vanish each round, on any graph, so a chain of n links takes O(log n) rounds. The
mappings of all rounds (of geometrically falling size) are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from ..sources.hits import complete_hits


def components(pairs: DataFrame, left: str, right: str, seed: int = 1) -> DataFrame:
    """(record_id, group_id) of every id in ``pairs``; ``group_id`` is the smallest id of the group.

    Rows with a null id are ignored; a row that links an id to itself only makes it a member of
    its own group; repeated rows change nothing; an empty table gives no rows. Ids compare as
    binary strings.
    """
    links = pairs.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v")).dropna()
    edges = write_once(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    ids = edges.select("u").union(edges.select("v")).distinct()
    edges = edges.where(F.col("u") != F.col("v"))
    hooks = []
    while not edges.isEmpty():
        salt = F.lit(seed * 1_000_003 + len(hooks))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hashed = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("u").agg(F.min(hashed("v")).alias("near"))
        hook = write_once(best.select("u", F.least("near", hashed("u"))["id"].alias("to")), "hooks")
        hooks.append(hook)
        moved = edges.join(hook, "u").select(F.col("to").alias("a"), "v")
        moved = moved.join(hook.withColumnRenamed("u", "v"), "v").select("a", F.col("to").alias("b")).where(F.col("a") != F.col("b"))
        edges = write_once(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    label = None
    for hook in reversed(hooks):
        if label is None:
            label = hook
        else:
            later = label.select(F.col("u").alias("to"), F.col("to").alias("last"))
            label = hook.join(later, "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    if label is None:
        return ids.select(F.col("u").alias("record_id"), F.col("u").alias("group_id"))
    label = write_once(ids.join(label, "u", "left").select("u", F.coalesce("to", "u").alias("to")), "labels")
    smallest = label.groupBy("to").agg(F.min("u").alias("group_id"))
    return label.join(smallest, "to").select(F.col("u").alias("record_id"), "group_id")


def hit_groups(hits: DataFrame) -> DataFrame:
    """(record_id, group_id) of every id of the complete hits, linked by any complete hit."""
    return components(complete_hits(hits), "query", "target")
