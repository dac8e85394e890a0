"""Calendar and time-zone expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LOCAL_ZONE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(c: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall-clock time as local wall-clock time, daylight saving included; independent of the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(c).cast("timestamp_ntz"))


def period_bounds(period: str) -> tuple[datetime, datetime]:
    """Half-open bounds of '2025', '2025-02' or '2025-02-14'."""
    parts = [int(p) for p in period.split("-")]
    if len(parts) == 1:
        return datetime(parts[0], 1, 1), datetime(parts[0] + 1, 1, 1)
    if len(parts) == 2:
        year, month = parts
        return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)
    start = datetime(*parts)
    return start, datetime.fromordinal(start.toordinal() + 1)


def in_period(c: Column | str, period: str) -> Column:
    """A typed range instead of a text match, so parquet can skip row groups and partitions."""
    start, end = period_bounds(period)
    c = _col(c)
    low = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    high = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    return (c >= low) & (c < high)


def month_text(c: Column | str) -> Column:
    """Year and month, taken from the value itself: no session zone is involved."""
    return F.concat_ws("-", F.lpad(F.year(_col(c)).cast("string"), 4, "0"), F.lpad(F.month(_col(c)).cast("string"), 2, "0"))


def is_weekday(c: Column | str, closed: str = "Sunday") -> Column:
    """Days other than the closed one."""
    return F.date_format(_col(c), "EEEE") != F.lit(closed)
