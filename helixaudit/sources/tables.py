"""Readers of labelled tables: every column as text, missing cells by a fixed set of spellings."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of a missing cell in a delimited file (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: File extensions and the format they stand for (fixed values).
FORMATS = {".csv": "csv", ".tsv": "tsv", ".fasta": "fasta", ".fa": "fasta"}
COMPRESSED = (".gz",)
SEPARATORS = {"csv": ",", "tsv": "\t"}
#: Labels that may be inferred from a column at most (fixed value).
MOST_LABELS = 50


def infer_format(paths: list[str]) -> str:
    """Format of input files by their extensions; a compression suffix is ignored and all files must agree."""
    found = {}
    for path in paths:
        name = PurePath(path).name.lower()
        for suffix in COMPRESSED:
            name = name.removesuffix(suffix)
        kind = next((v for k, v in FORMATS.items() if name.endswith(k)), None)
        if kind is None:
            raise ValueError(f"{path}: unknown format, known are {', '.join(FORMATS)}, each also with {', '.join(COMPRESSED)}")
        found.setdefault(kind, path)
    if len(found) > 1:
        raise ValueError("input files differ in format: " + ", ".join(f"{p} is {k}" for k, p in found.items()))
    if not found:
        raise ValueError("no input files")
    return next(iter(found))


def present(cell: Column) -> Column:
    """The cell, or null if it is spelled as missing."""
    return F.when(~cell.isin(*MISSING), cell)


def require_columns(df: DataFrame, wanted: dict[str, str], source: str) -> None:
    """Raise if a column is missing, naming file, option, column and what there is. ``wanted`` maps columns to options."""
    absent = {c: option for c, option in wanted.items() if c not in df.columns}
    if absent:
        raise ValueError(f"{source}: " + "; ".join(f"column '{c}' ({option}) is missing" for c, option in absent.items()) + f"; available: {', '.join(df.columns)}")


def breaks_inside(spark: SparkSession, paths: list[str]) -> bool:
    """Whether some field of the files may hold a line break: a line with an odd number of quotes."""
    lines = spark.read.text(paths)
    return not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_table(spark: SparkSession, paths: list[str], kind: str | None = None, placed: bool = False) -> DataFrame:
    """All columns of delimited files with a header, as text, with missing cells as null.

    Files are pooled, and read in parallel within a file unless fields hold line breaks, which a first look at the lines finds. ``.gz``
    files are read whole by one task each, so they are spread again afterwards. ``placed`` adds the columns ``file``, ``start`` and ``at`` that
    ``fasta.in_input_order`` reads (in place of columns of the files with these names).
    """
    kind = kind or infer_format(paths)
    df = spark.read.csv(paths, sep=SEPARATORS[kind], header=True, inferSchema=False, enforceSchema=False, multiLine=breaks_inside(spark, paths), escape='"', nullValue="", emptyValue="")
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")] if placed else []
    df = df.select(*[present(F.col(f"`{c}`")).alias(c) for c in df.columns if not placed or c not in ("file", "start", "at")], *places)
    if any(p.lower().endswith(COMPRESSED) for p in paths):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def sequence(columns: list[str]) -> Column:
    """The sequence of a row: its columns in upper case one after the other, missing ones as empty."""
    parts = [F.upper(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]
    return reduce(lambda a, b: F.concat(a, b), parts)


def labelled(df: DataFrame, columns: list[str], label: str, source: str = "input") -> DataFrame:
    """(label, seq) of a table: rows without a label are dropped, missing sequences are empty ones."""
    require_columns(df, {c: "sequence column" for c in columns} | {label: "label column"}, source)
    return df.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("label"), sequence(columns).alias("seq"))


def column_sets(columns: list[str]) -> list[list[str]]:
    """The analyses of several sequence columns: each alone, then all of them joined."""
    return [[c] for c in columns] + ([list(columns)] if len(columns) > 1 else [])


def resolve_labels(s: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """The classes to compare: those given (each once), or all labels in sorted order, at most ``MOST_LABELS``."""
    if wanted:
        out = list(dict.fromkeys(map(str, wanted)))
        held = {r[0] for r in s.where(F.col("label").isin(*out)).select("label").distinct().collect()}
        if gone := [x for x in out if x not in held]:
            raise ValueError(f"no rows with label {', '.join(gone)}")
        return out
    found = sorted(r[0] for r in s.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if not found:
        raise ValueError("no labelled rows")
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels; name those to compare")
    return found


#: A number as delimited files write it.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def median_split(df: DataFrame, columns: list[str], target: str, source: str = "input") -> DataFrame:
    """(label, seq) with label ``high`` for targets at or above the median, else ``low``; rows without a number are dropped.

    The median is exact. Raises if no row has a number or one side is empty.
    """
    require_columns(df, {c: "sequence column" for c in columns} | {target: "label column"}, source)
    text = F.col(f"`{target}`").cast("string")
    value = F.when(text.rlike(NUMBER), F.expr(f"try_cast(trim(cast(`{target}` as string)) as double)"))
    rows = df.select(value.alias("value"), sequence(columns).alias("seq")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    middle = rows.agg(F.median("value")).first()[0]
    if middle is None:
        raise ValueError(f"{source}: no number in column '{target}'")
    out = rows.select(F.when(F.col("value") >= middle, "high").otherwise("low").alias("label"), "seq")
    if out.where(F.col("label") == "low").isEmpty():
        raise ValueError(f"{source}: all values of '{target}' are at or above the median, so there is nothing to compare")
    return out
