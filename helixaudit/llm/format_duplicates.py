"""Records that are the same but for blanks, letter case, punctuation or the order of their parts.

Byte-identical raw texts collapse first (a hash aggregate with map-side combine), so the
canonical form is computed once for each distinct raw text and a hot text is one row from then
on. The survivors are written with their canonical text; only its 128-bit digest is shuffled to find the
groups of several survivors, and these are grouped again on their whole canonical text. Counts of raw texts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once

#: Characters that part a record (fixed values).
SEPARATORS = "[|;/]"


def canonical(sequence: Column) -> Column:
    """The cleaned parts of a sequence in sorted order, joined by ``|``; empty parts are dropped."""
    parts = F.transform(F.split(F.upper(sequence), SEPARATORS), lambda p: F.regexp_replace(p, "[^A-Z]", ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "|")


def digest(text: str, *names: str) -> list[Column]:
    """128 bits of a text, in two columns."""
    return [F.xxhash64(F.col(text)).alias(names[0]), F.xxhash64(F.reverse(F.col(text))).alias(names[1])]


def collapsed(df: DataFrame, least: int, text: str, number: str) -> DataFrame:
    """(d, d2, first_no, last_no, canon, c, c2) of each distinct raw text: its digest, smallest and largest number, canonical text and its digest.

    Left out are texts whose parts have fewer than ``least`` letters in all. It is written once.
    """
    rows = df.select(F.col(number).cast("bigint").alias("no"), F.col(text).alias("text")).dropna()
    raw = rows.groupBy("text").agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"))
    raw = raw.select(*digest("text", "d", "d2"), "first_no", "last_no", canonical(F.col("text")).alias("canon"))
    return write_once(raw.where(F.length(F.translate("canon", "|", "")) >= least).select("*", *digest("canon", "c", "c2")), "raw")


def grouped(raw: DataFrame) -> DataFrame:
    """(d, d2, first_no, last_no, kept_no): each collapsed text of a group of several records, with the record kept for the group. Written once.

    Digests find the texts with company; these are grouped on their canonical texts in full, so a clash of digests joins nothing.
    """
    columns = ["d", "d2", "first_no", "last_no"]
    # Written, so that its size is known before the texts are moved: a small one is broadcast and they stay.
    forms = write_once(raw.groupBy("c", "c2").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("c", "c2"), "forms")
    several = raw.join(forms, ["c", "c2"], "left_semi")
    kept = several.groupBy("canon").agg(F.min("first_no").alias("kept_no"))
    alone = raw.where("first_no < last_no").join(forms, ["c", "c2"], "left_anti")
    return write_once(several.join(kept, "canon").select(*columns, "kept_no").unionByName(alone.select(*columns, F.col("first_no").alias("kept_no"))), "grouped")


def members(df: DataFrame, groups: DataFrame, text: str, number: str) -> DataFrame:
    """(kept_no, no): every record of the groups, once.

    Texts of one record are in the groups' own rows. A text of many records
    is the skewed side of a join whose other side has it once, so it can be split.
    """
    one = groups.where("first_no = last_no").select("kept_no", F.col("first_no").alias("no"))
    many = groups.where("first_no < last_no").select("d", "d2", "kept_no")
    rows = df.select(F.col(number).cast("bigint").alias("no"), F.col(text).alias("text")).dropna().select("no", *digest("text", "d", "d2"))
    return one.unionByName(rows.join(many, ["d", "d2"]).select("kept_no", "no")).distinct()


def format_copies(df: DataFrame, least: int = 20, text: str = "sequence", number: str = "seq_no") -> DataFrame:
    """(kept_no, copy_no): one row for each record beyond the one kept of its group (the smallest number).

    Records (not deliveries) count, so rows delivered again change nothing. Null texts and numbers, and texts whose parts have
    fewer than ``least`` letters in all, are in no group. An empty table gives no rows; extra columns are not read.
    """
    rows = members(df, grouped(collapsed(df, least, text, number)), text, number)
    return rows.where(F.col("kept_no") != F.col("no")).select("kept_no", F.col("no").alias("copy_no"))


def format_groups(df: DataFrame, least: int = 20, text: str = "sequence", number: str = "seq_no", fewest: int = 2) -> DataFrame:
    """(kept_no, copies): one row for each group of ``fewest`` records or more; all groups from 1 are the collapsed collection."""
    raw = collapsed(df, least, text, number)
    groups = grouped(raw)
    counts = members(df, groups, text, number).groupBy("kept_no").agg(F.count(F.lit(1)).alias("copies"))
    if fewest < 2:
        counts = counts.unionByName(raw.join(groups.select("d", "d2"), ["d", "d2"], "left_anti").select(F.col("first_no").alias("kept_no"), F.lit(1).cast("bigint").alias("copies")))
    return counts.where(F.col("copies") >= fewest)
