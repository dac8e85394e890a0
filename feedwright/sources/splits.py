"""Bounds for reading a table in even parts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def _literal(value: object) -> str:
    if isinstance(value, datetime):
        return f"timestamp '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"date '{value.isoformat()}'"
    return str(value)


def even_splits(keys: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a table into at most ``parts`` parts of about the same number of rows, by one column.

    ``keys`` is a narrow read of the table. The bounds are approximate percentiles of the column, so a skewed column gives
    narrow ranges where its values are dense; equal steps between smallest and largest value would not. Each row meets
    exactly one condition, rows without a value the first. A value with more than a part's share of the rows has a part of
    its own. The bounds, fewer than ``parts``, are all that reaches the driver; ``accuracy`` is that of the percentiles.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    kind = keys.schema[column].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"a table is split by a number, a date or a time, not by {kind.simpleString()}")
    at = [i / parts for i in range(1, parts)]
    if not at:
        return ["1 = 1"]
    # A whole-table aggregate of bounded sketches, merged from one per task.
    row = keys.agg(F.percentile_approx(column, F.array(*map(F.lit, at)), F.lit(accuracy)).alias("bounds")).first()
    bounds = [_literal(b) for b in dict.fromkeys(row["bounds"] or [])]
    if not bounds:
        return ["1 = 1"]
    first = f"({column} < {bounds[0]} or {column} is null)"
    middle = [f"({column} >= {low} and {column} < {high})" for low, high in zip(bounds, bounds[1:])]
    return [first, *middle, f"{column} >= {bounds[-1]}"]
