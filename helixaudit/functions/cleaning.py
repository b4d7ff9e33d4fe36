"""Column expressions that normalise sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(sequence: Column) -> Column:
    """Upper case with every character outside A-Z removed; null gives an empty string."""
    return F.regexp_replace(F.upper(F.coalesce(sequence, F.lit(""))), "[^A-Z]", "")
