"""Visitor counts by local time, calendar and system."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LOCAL_ZONE
from ..functions import in_period, is_weekday, local_time, month_text, period_bounds


def with_location(history: DataFrame, sensor_site: DataFrame, site_location: DataFrame, location: DataFrame) -> DataFrame:
    """Rows with a sensor with their location through the sensor and site tables.

    The three small tables are joined to each other first. Give it rows that are already summed per sensor: then a busy
    sensor is folded before the shuffle, and the history itself never meets the join.
    """
    chain = (
        sensor_site.select("sensorid", "site_id")
        .join(site_location.select("site_id", "location_id"), "site_id")
        .join(location.select("location_id", "location_name"), "location_id")
        .select("sensorid", "location_name")
    )
    return history.join(chain, "sensorid")


def total_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """In and out counts of finer groups added up."""
    return counts.groupBy(*by).agg(F.sum("incount").alias("incount"), F.sum("outcount").alias("outcount"))


def yearly_counts(rows: DataFrame, key: str, at: str, years: Sequence[str]) -> DataFrame:
    """In and out counts per key and year, for the named years; ``at`` becomes the first day of the year."""
    wanted = reduce(Column.__or__, [in_period(at, year) for year in years])
    first = F.make_date(F.year(at), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return total_counts(rows.filter(wanted).withColumn(at, first), [key, at])


def local_time_counts(
    history: DataFrame, by: Sequence[str], period: str | None, at: str = "timestamputc", zone: str | None = LOCAL_ZONE
) -> DataFrame:
    """In and out counts per group for a period in local time (zone=None: in UTC).

    With a zone the rows are first cut to the period widened by a day in UTC, which the parquet reader can use to skip
    data; the exact local bounds are applied after it.
    """
    local = F.col(at) if zone is None else local_time(at, zone)
    rows = history.withColumn("_local", local)
    if period is not None:
        if zone is not None:
            rows = rows.filter(_around(at, period))
        rows = rows.filter(in_period("_local", period))
    return rows.groupBy(*by).agg(
        F.sum("incount").cast("bigint").alias("incount"), F.sum("outcount").cast("bigint").alias("outcount")
    )


def _around(at: str, period: str) -> Column:
    start, end = period_bounds(period)
    low, high = start - timedelta(days=1), end + timedelta(days=1)
    stamp = [F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (low, high)]
    return (F.col(at) >= stamp[0]) & (F.col(at) < stamp[1])


def monthly_counts(history: DataFrame, by: Sequence[str], at: str = "timestamputc") -> DataFrame:
    """All months in one pass."""
    return (
        history.withColumn("month", month_text(at))
        .groupBy(*by, "month")
        .agg(F.sum("incount").cast("bigint").alias("incount"), F.sum("outcount").cast("bigint").alias("outcount"))
    )


def calendar_totals(
    traffic: DataFrame, date: str, value: str, start: str, grain: str = "day", closed: str = "Sunday"
) -> DataFrame:
    """Daily or monthly totals from a start day (or month) on, without the closed weekday."""
    if grain not in ("day", "month"):
        raise ValueError("grain must be 'day' or 'month'")
    first = start if grain == "day" else f"{start}-01"
    day = F.col(date).cast("date")
    bucket = day.alias("day") if grain == "day" else month_text(day).alias("month")
    kept = traffic.filter((F.col(date) >= F.lit(first).cast("date")) & is_weekday(day, closed))
    return kept.groupBy(bucket).agg(F.sum(value).alias("total"))


def period_cross_system(systems: dict[str, tuple[DataFrame, str]], key: str, years: Sequence[str]) -> DataFrame:
    """Per key, in and out counts of every system and year side by side; keys need rows in all of them.

    ``systems`` is {name: (frame(key, incount, outcount, ...), local timestamp column)}. The systems are stacked with
    one column per figure and grouped once.
    """
    cells = [(year, name, m) for year in years for name in systems for m in ("incount", "outcount")]
    stacked = []
    for name, (df, at) in systems.items():
        tests = {year: in_period(at, year) for year in years}
        wanted = reduce(Column.__or__, tests.values())
        columns = [
            (F.when(tests[year], F.col(m)) if name == n else F.lit(None)).cast("bigint").alias(f"{m}_{year}_{n}")
            for year, n, m in cells
        ]
        seen = [
            (F.when(tests[year], F.lit(1)) if name == n else F.lit(None)).cast("int").alias(f"_{year}_{n}")
            for year in years
            for n in systems
        ]
        stacked.append(df.filter(wanted).select(key, *columns, *seen))
    figures = [f"{m}_{year}_{n}" for year, n, m in cells]
    marks = [f"_{year}_{n}" for year in years for n in systems]
    grouped = (
        reduce(DataFrame.union, stacked)
        .groupBy(key)
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in figures], *[F.max(c).alias(c) for c in marks])
    )
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in marks])
    return grouped.filter(complete).select(key, *figures)


def threshold_days(
    readings: DataFrame, traffic: DataFrame, limit: float, by: str, reading: str = "value", count: str = "incount"
) -> DataFrame:
    """Total traffic per location on the days with a reading at or over the limit.

    ``readings`` (day, value), ``traffic`` (by, day, count). The days are few and distinct; traffic is summed per
    location and day before it meets them. Equal daily totals of different days count separately.
    """
    days = readings.filter(F.col(reading) >= F.lit(limit)).select("day").distinct()
    daily = traffic.groupBy(by, "day").agg(F.sum(count).alias(count))
    return daily.join(days, "day", "left_semi").groupBy(by).agg(F.sum(count).cast("bigint").alias(count))
