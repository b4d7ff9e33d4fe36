"""FASTA files: scan, selection by id, numbered staging, writing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_once


def read_fasta(spark: SparkSession, paths: list[str] | str, placed: bool = False) -> DataFrame:
    """(file, id, seq) of each record: lines joined, upper case; ``id`` is the first word of the header.

    Records are split by the reader, so a file is read in parallel and a long record spans no task
    border. Text before the first header is ignored; ``.gz`` files are read by one task each. ``placed`` adds the columns
    that :func:`in_input_order` reads.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # Only the first record of a file keeps its mark; what has none there is no record.
    text = F.regexp_replace("value", "^\\s*>", "")
    header = F.regexp_extract(text, "^([^\\r\\n]*)", 1)
    body = F.regexp_replace(F.substr(text, F.length(header) + 1), "\\s", "")
    rows = rows.where(F.trim("value") != "").select("file", "start", F.regexp_extract(header, "^(\\S*)", 1).alias("id"), F.upper(body).alias("seq"))
    return rows.withColumn("at", F.monotonically_increasing_id()) if placed else rows.drop("start")


def select_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is among ``ids`` (one column ``id``)."""
    return records.join(ids.select("id").distinct(), "id", "left_semi").select(*[c for c in ("no", "file", "id", "seq") if c in records.columns])


def in_input_order(s: DataFrame, half: str, paths: list[str]) -> DataFrame:
    """(no, id, seq) of (file, start, at, seq): sequences numbered from 0 as they stand in the files, in the order in which these are given.

    ``file`` and ``start`` name the block of a file that a row was read from, ``at`` is its ``monotonically_increasing_id``, which runs on
    by one within a block. Numbers come from the sizes of the blocks before, so no task sees all rows. A hit table
    that some other search made for the same files names the same sequences.
    """
    jvm, conf = s.sparkSession._jvm, s.sparkSession.sparkContext._jsc.hadoopConfiguration()

    def address(path: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^([a-z0-9]+):/+", r"\1:/", at.getFileSystem(conf).makeQualified(at).toUri().toString())

    given = F.create_map(*[F.lit(x) for i, path in enumerate(dict.fromkeys(map(address, paths))) for x in (path, i)])
    # Written once, as places must not change between the two uses.
    rows = write_once(s.select("file", "start", "at", "seq"), "staged")
    blocks = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # One row per block of a file.
    # A scheme is followed by one slash or three, as the writer likes.
    plain = F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")
    order = Window.orderBy(F.try_element_at(given, plain).asc_nulls_last(), "file", "start")
    offsets = blocks.select("file", "start", "first", (F.sum("n").over(order) - F.col("n")).alias("before"))
    rows = rows.join(offsets, ["file", "start"]).withColumn("no", F.col("before") + F.col("at") - F.col("first"))
    return rows.select("no", F.concat(F.lit("seq_"), F.col("no").cast("string"), F.lit(f"_{half}")).alias("id"), "seq")


def staged(s: DataFrame, half: str, order: list[str]) -> DataFrame:
    """(no, id, seq): sequences numbered from 0 in a total order, with their public ids ``seq_<n>_<half>``.

    ``order`` must name columns that make the order total; numbers come from per-partition offsets, so
    no task sees all rows.
    """
    ranked = s.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id() % (1 << 33))
    # Written once: range borders are sampled, so a second run of this plan could place rows elsewhere.
    ranked = write_once(ranked.select("seq", "part", "in_part"), "staged")
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    rows = ranked.join(F.broadcast(offsets), "part").withColumn("no", F.col("offset") + F.col("in_part"))
    return rows.select("no", F.concat(F.lit("seq_"), F.col("no").cast("string"), F.lit(f"_{half}")).alias("id"), "seq")


def write_fasta(records: DataFrame, path: str) -> None:
    """Write (id, seq) as records of two lines, one file per partition."""
    records.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def length_summary(s: DataFrame) -> DataFrame:
    """(count, min_length, mean_length, max_length) of a set of sequences; zeros for an empty one."""
    n = F.length("seq")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return s.agg(F.count(F.lit(1)).alias("count"), zero(F.min(n), "min_length"), zero(F.avg(n), "mean_length"), zero(F.max(n), "max_length"))
