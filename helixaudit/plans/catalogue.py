"""The core's queries by name, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.raw_rows import rejected_rows, valid_rows
from . import class_queries


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_rows(table(spark, folder, "raw_enhancer_rows")).select("line_no", "reason")


def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    return valid_rows(table(spark, folder, "raw_enhancer_rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return class_queries.queries() | {f.__name__: f for f in (p7_found, p7_valid)}


_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_ROW = "regexp_replace(coalesce(line, ''), '\\r\\z', '')"
_SCORE = r"(0+\.?[0-9]*|0*\.[0-9]+|0*1\.?0*)?"


def _unquoted(k: int) -> str:
    part = f"regexp_extract(l, '(?s)^{','.join([_FIELD] * 4)}$', {k})"
    return f"CASE WHEN {part} LIKE '\"%' THEN replace(substr({part}, 2, length({part}) - 2), '\"\"', '\"') ELSE {part} END"


_PARSED = f"""SELECT line_no, file_name, CASE
  WHEN NOT regexp_full_match(l, '(?s){_FIELD}(?:,{_FIELD})*') THEN 'broken_quoting'
  WHEN NOT regexp_full_match(l, '(?s){",".join([_FIELD] * 4)}') THEN 'column_count'
  WHEN NOT (regexp_full_match({_unquoted(1)}, '[ACGTNacgtn]+') AND {_unquoted(2)} IN ('0', '1') AND regexp_full_match({_unquoted(4)}, '{_SCORE}')) THEN 'invalid_value' END AS reason, l
FROM (SELECT line_no, file_name, {_ROW} AS l FROM raw_enhancer_rows)"""


def oracle_sql() -> dict[str, str]:
    return class_queries.oracle_sql() | {
        "p7_found": f"SELECT line_no, reason FROM ({_PARSED}) WHERE reason IS NOT NULL",
        "p7_valid": f"SELECT line_no, file_name, upper({_unquoted(1)}) AS sequence, {_unquoted(2)} AS label, {_unquoted(3)} AS source, try_cast({_unquoted(4)} AS double) AS score FROM ({_PARSED}) WHERE reason IS NULL",
    }
