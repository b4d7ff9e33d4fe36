"""Loading delimited rows of which some do not parse: valid rows and rejects with a reason.

A structural index is built for a whole batch at once: a mask of quotes, its prefix parity (odd
inside a quoted field), and from both the delimiters and field ends of every row. Counts and
type checks then run on arrays of fields. No Python code runs per row or per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA, RETURN = 34, 44, 13
#: Fields of a row, in order (fixed values).
FIELDS = ("sequence", "label", "source", "score")
#: Reasons, in the order in which they are tried (fixed values).
REASONS = ("broken_quoting", "column_count", "invalid_value")
#: A plain decimal from 0 to 1: no sign, no exponent, at least one digit.
SCORE = r"^(?:0+\.?[0-9]*|0*\.[0-9]+|0*1\.?0*)$"
DDL = "line_no bigint, file_name string, reason string, sequence string, label string, source string, score double"


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the rows of a string column, without one carriage return at the end; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    if column.null_count:
        ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
    some = ends > starts
    ends = ends.copy()
    ends[some] -= data[ends[some] - 1] == RETURN
    return data, starts, ends


def structure(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row, first, last) of every field, and which rows have broken quoting. A field is data[first:last]."""
    n = len(starts)
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
    quotes = np.cumsum(data == QUOTE)
    before = np.concatenate([[0], quotes])
    # Parity counts from the start of the row.
    inside = ((quotes - before[starts][row]) & 1).astype(bool) if len(data) else np.empty(0, bool)
    comma = np.flatnonzero((data == COMMA) & ~inside)
    comma = comma[comma < ends[row[comma]]]
    fields = np.bincount(row[comma], minlength=n) + 1
    first = np.empty(fields.sum(), np.int64)
    lead = np.cumsum(fields) - fields
    is_lead = np.zeros(len(first), bool)
    is_lead[lead] = True
    first[lead] = starts
    first[~is_lead] = comma + 1
    last = np.empty_like(first)
    is_last = np.zeros(len(first), bool)
    is_last[lead + fields - 1] = True
    last[is_last] = ends
    last[~is_last] = comma
    of = np.repeat(np.arange(n), fields)
    count = before[last] - before[first]
    opened = np.zeros(len(first), bool)
    some = last > first
    opened[some] = data[first[some]] == QUOTE
    closed = np.zeros(len(first), bool)
    long = last - first >= 2
    closed[long] = data[last[long] - 1] == QUOTE
    bad = np.where(opened, ~closed | (count & 1).astype(bool), count > 0)
    # Between the outer quotes, quotes must come in pairs: every stretch of them has even length.
    at = np.flatnonzero(data == QUOTE)
    owner = np.searchsorted(first, at, "right") - 1
    inner = opened[owner] & closed[owner] & (at > first[owner]) & (at < last[owner] - 1)
    at, owner = at[inner], owner[inner]
    if len(at):
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(head)
        odd = np.diff(np.append(begin, len(at))) & 1 == 1
        bad[owner[begin[odd]]] = True
    broken = np.zeros(n, bool)
    broken[of[bad]] = True
    return of, first, last, fields, opened, broken


def texts(data: np.ndarray, first: np.ndarray, last: np.ndarray, opened: np.ndarray) -> pa.Array:
    """Field values with quotes removed and doubled quotes made single."""
    first, last = first + opened, last - opened
    lengths = last - first
    ends = np.cumsum(lengths)
    own = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(first, lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[own])))
    if opened.any():
        values = pc.if_else(pa.array(opened), pc.replace_substring(values, '""', '"'), values)
    return values


def parsed(line_no: pa.Array, file_name: pa.Array, line: pa.Array) -> pa.RecordBatch:
    """Every row of a batch with its reason (null for valid rows) or its values (null for rejects)."""
    data, starts, ends = buffers(line)
    of, first, last, fields, opened, broken = structure(data, starts, ends)
    n = len(starts)
    well = ~broken & (fields == len(FIELDS))
    own = np.flatnonzero(well[of]).reshape(-1, len(FIELDS))
    columns = [texts(data, first[own[:, k]], last[own[:, k]], opened[own[:, k]]) for k in range(len(FIELDS))]
    ok = pc.match_substring_regex(columns[0], "^[ACGTNacgtn]+$")
    ok = pc.and_(ok, pc.is_in(columns[1], value_set=pa.array(["0", "1"], pa.large_string())))
    empty = pc.equal(columns[3], "")
    ok = pc.and_(ok, pc.or_(empty, pc.match_substring_regex(columns[3], SCORE)))
    # RE2's $ is the end of the text here, never before a last line break.
    good = np.flatnonzero(well)[ok.to_numpy(zero_copy_only=False)]
    valid = np.zeros(n, bool)
    valid[good] = True
    reason = np.where(broken, REASONS[0], np.where(fields != len(FIELDS), REASONS[1], REASONS[2])).astype(object)
    reason[valid] = None
    spread = np.full(n, -1, np.int64)
    spread[good] = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    index = pa.array(spread, pa.int64(), mask=~valid)
    score = pc.if_else(empty, pa.scalar(None, pa.large_string()), columns[3])
    score = pc.if_else(pa.array(ok), score, pa.scalar(None, pa.large_string())).cast(pa.float64())
    values = [c.take(index).cast(pa.string()) for c in columns[:3]] + [score.take(index)]
    return pa.record_batch([line_no, file_name, pa.array(reason, pa.string()), *values], names=[c.split()[0] for c in DDL.split(", ")])


def parse_rows(raw: DataFrame, number: str = "line_no", file_name: str = "file_name", line: str = "line") -> DataFrame:
    """(line_no, file_name, reason, sequence, label, source, score): each raw row once, valid or rejected.

    The first reason that holds of ``REASONS`` is given; valid rows have none and carry their values,
    an empty score as null. A null ``line`` counts as an empty row, which has one field. An empty
    table gives no rows; extra columns are not read.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield parsed(batch.column(0), batch.column(1), batch.column(2))

    return raw.select(F.col(number).cast("bigint"), F.col(file_name).cast("string"), F.col(line).cast("string")).mapInArrow(run, DDL)


def rejected_rows(raw: DataFrame) -> DataFrame:
    """(line_no, file_name, reason) of the rows that are not valid."""
    return parse_rows(raw).where(F.col("reason").isNotNull()).select("line_no", "file_name", "reason")


def valid_rows(raw: DataFrame) -> DataFrame:
    """(line_no, file_name, sequence, label, source, score) of the valid rows; sequences in upper case as all readers give them."""
    return parse_rows(raw).where(F.col("reason").isNull()).select("line_no", "file_name", F.upper("sequence").alias("sequence"), "label", "source", "score")
