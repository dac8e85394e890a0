"""Visitor counters and weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .check import check


def _located(s: Sources, counts: DataFrame) -> DataFrame:
    return op.with_location(counts, s["sensor_site"], s["site_location"], s["location"])


@check("traffic_by_utc_month", "traffic", "PC01", "listing")
def traffic_by_utc_month(s: Sources, months: Sequence[str] | None = None) -> DataFrame:
    """In and out counts per location and UTC month, all months in one pass."""
    rows = s["traffic_history"]
    if months:
        kept = fn.in_period("timestamputc", months[0])
        for m in months[1:]:
            kept = kept | fn.in_period("timestamputc", m)
        rows = rows.filter(kept)
    return op.total_counts(_located(s, op.monthly_counts(rows, ["sensorid"])), ["location_name", "month"])


@check("traffic_by_local_month", "traffic", "PC02", "listing")
def traffic_by_local_month(s: Sources, month: str = "2025-02") -> DataFrame:
    """In and out counts per location for a month of local time."""
    counts = op.local_time_counts(s["traffic_history"], ["sensorid"], month)
    return op.total_counts(_located(s, counts), ["location_name"])


@check("store_traffic_daily", "traffic", "PC03", "listing")
def store_traffic_daily(s: Sources, start: str = "2026-04-01") -> DataFrame:
    """Daily totals without Sundays."""
    return op.calendar_totals(s["store_traffic"], "trafficdate", "trafficvalue", start)


@check("store_traffic_monthly", "traffic", "PC03", "listing")
def store_traffic_monthly(s: Sources, start: str = "2026-01") -> DataFrame:
    """Monthly totals without Sundays."""
    return op.calendar_totals(s["store_traffic"], "trafficdate", "trafficvalue", start, grain="month")


@check("sensor_traffic", "traffic", "PC04", "listing")
def sensor_traffic(s: Sources, location: str, month: str = "2025-12") -> DataFrame:
    """In and out counts per sensor of one location for a month of local time.

    The local time is an expression on the history row itself; no second read of the history is joined to it.
    """
    sensors = s["sensor"].select("sensorid", F.col("sensorname").alias("sensor"))
    counts = op.local_time_counts(s["traffic_history"], ["sensorid"], month)
    rows = _located(s, counts).filter(fn.one_of("location_name", [location])).join(sensors, "sensorid")
    return op.total_counts(rows, ["sensor"])


@check("traffic_systems", "traffic", "PC05", "listing")
def traffic_systems(s: Sources, years: Sequence[str] = ("2025", "2026")) -> DataFrame:
    """Two years of two systems side by side per location."""
    history = s["traffic_history"].withColumn("local", fn.local_time("timestamputc"))
    own = _located(s, op.yearly_counts(history, "sensorid", "local", years))
    facts = op.yearly_counts(s["fact_sensor_traffic"], "location_key", "timestampest", years).join(s["dim_location"], "location_key")
    return op.period_cross_system({"history": (own, "local"), "fact": (facts, "timestampest")}, "location_name", list(years))


@check("hot_day_traffic", "traffic", "WD01", "listing")
def hot_day_traffic(s: Sources, year: str = "2025", limit: float = fv.HOT_DAY_LIMIT, station: str = "1") -> DataFrame:
    """Visitors per location on the days at least as hot as the limit."""
    hot = s["weather_history"].filter(
        fn.one_of("datatype", ["tmax"]) & (F.col("store_location_id") == station) & fn.in_period("observationdate", year)
    )
    readings = hot.select(F.col("observationdate").cast("date").alias("day"), "value")
    facts = s["fact_sensor_traffic"].filter(fn.in_period("timestampest", year))
    daily = facts.groupBy("location_key", F.col("timestampest").cast("date").alias("day")).agg(F.sum("incount").alias("incount"))
    traffic = daily.join(s["dim_location"], "location_key").select("location_name", "day", "incount")
    return op.threshold_days(readings, traffic, limit, "location_name")


@check("weather_day", "traffic", "WD01", "listing")
def weather_day(s: Sources, day: str = "2025-04-02") -> DataFrame:
    """All readings of a day."""
    return s["weather_history"].filter(fn.in_period("observationdate", day))


@check("hot_days", "traffic", "WD01", "listing")
def hot_days(s: Sources, year: str = "2025", limit: float = fv.HOT_DAY_LIMIT, station: str = "1") -> DataFrame:
    """The readings at or over the limit."""
    rows = s["weather_history"].filter(
        fn.one_of("datatype", ["tmax"])
        & (F.col("value") >= limit)
        & (F.col("store_location_id") == station)
        & fn.in_period("observationdate", year)
    )
    return rows.select(F.col("observationdate").cast("date").alias("day"), "datatype", "value")
