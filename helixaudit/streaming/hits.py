"""Hits that arrive while a search still runs: the leak summary kept up to date.

The batch operators need no stream; this is the same aggregation as a stateful query. State is one
row per query that has a hit. A maximum does not depend on the order of arrival, so late hits
need no watermark and hits delivered twice change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.leakage import with_similarity
from ..sources.hits import HIT_SCHEMA


def hit_stream(spark, folder: str) -> DataFrame:
    """A stream of the hit files that appear in a folder."""
    return spark.readStream.schema(HIT_SCHEMA).option("sep", "\t").option("header", True).csv(folder)


def best_so_far(hits: DataFrame) -> DataFrame:
    """(id, similarity float): the best hit of each query so far; for the output modes update and complete."""
    return with_similarity(hits).groupBy(F.col("query").alias("id")).agg(F.max("similarity").cast("float").alias("similarity"))


def keep_leaks(hits: DataFrame, path: str, checkpoint: str, threshold: float = 90.0, **trigger) -> StreamingQuery:
    """Append every leaked hit of the stream to parquet files, exactly once."""
    rows = with_similarity(hits).where(F.col("similarity") >= threshold)
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
