"""The table of similarity hits: its fixed schema and what counts as a usable row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a hit, in file order (fixed values).
HIT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query", "target")]
    + [T.StructField(n, T.DoubleType()) for n in ("qcov", "tcov", "pident", "evalue")]
    + [T.StructField(n, T.IntegerType()) for n in ("qstart", "qend", "tstart", "tend", "alnlen")]
    + [T.StructField(n, T.StringType()) for n in ("qaln", "taln")]
)


def read_hits(spark, path: str) -> DataFrame:
    """Hits of a tab-separated file with a header; an empty file gives no rows."""
    return spark.read.csv(path, sep="\t", header=True, schema=HIT_SCHEMA, enforceSchema=False)


def complete_hits(hits: DataFrame) -> DataFrame:
    """Rows without null or NaN in any of the 13 columns, ids trimmed and in lower case.

    Columns beyond the 13 are dropped. Both ids stay strings.
    """
    present = [F.col(f.name).isNotNull() & (~F.isnan(f.name) if isinstance(hits.schema[f.name].dataType, (T.DoubleType, T.FloatType)) else F.lit(True)) for f in HIT_SCHEMA]
    ids = [F.lower(F.trim(c)).alias(c) for c in ("query", "target")]
    return hits.where(reduce(lambda a, b: a & b, present)).select(*ids, *[f.name for f in HIT_SCHEMA][2:])


def id_number(column: str, half: str) -> Column:
    """Number in a public id ``seq_<n>_<half>``; null for any other text."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^seq_([0-9]+)_{half}$', 1), '') as bigint)")
