"""Read queries on station-hour demand: coverage, calendar profiles, rankings, series."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks, measures



def network_hours(demand: DataFrame) -> DataFrame:
    return demand.groupBy("time").agg(
        F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals")
    )


def covered_hours(demand: DataFrame) -> DataFrame:
    """Hours in which the network recorded at least one departure."""
    return network_hours(demand).where(F.col("departures") > 0)


def coverage_summary(demand: DataFrame) -> DataFrame:
    """Rows, distinct stations and hours, first and last hour, and totals (one row)."""
    return demand.agg(
        F.count(F.lit(1)).alias("station_hours"),
        F.count_distinct("station").alias("stations"),
        F.count_distinct("time").alias("hours"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.sum("departures").alias("departures"),
        F.sum("arrivals").alias("arrivals"),
        F.sum(F.col("departures") + F.col("arrivals")).alias("total_activity"),
        F.sum(F.col("arrivals") - F.col("departures")).alias("net_flow"),
    )


def utc_bucket(dimension: str, time: Column) -> Column:
    """UTC hour, weekday with Sunday = 0, ISO week or month."""
    if dimension == "hour":
        return F.hour(time)
    if dimension == "weekday":
        return F.dayofweek(time) - 1
    if dimension == "week":
        return F.weekofyear(time)
    if dimension == "month":
        return F.month(time)
    raise ValueError("dimension must be hour, weekday, week or month")


def calendar_profile(demand: DataFrame, dimension: str, station: str | None = None) -> DataFrame:
    """Observed rows only: absent station-hours are unknown and never count as zero."""
    if station is not None:
        demand = demand.where(F.col("station") == station)
    return demand.groupBy(utc_bucket(dimension, F.col("time")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("observed_rows"),
        F.avg("departures").alias("mean_departures"),
        F.sum("departures").alias("total_departures"),
        F.avg("arrivals").alias("mean_arrivals"),
    )


def local_profile(demand: DataFrame, dimension: str, tz: str) -> DataFrame:
    """Local hour, weekday (Monday = 0) or `YYYY-MM`: sums, rows and mean departures."""
    local = clocks.local_time(F.col("time"), tz)
    bucket = {
        "hour": F.hour(local),
        "weekday": F.weekday(local),
        "month": F.date_format(local, "yyyy-MM"),
    }[dimension]
    return demand.groupBy(bucket.cast("string").alias("bucket")).agg(
        F.sum("departures").alias("departures"),
        F.sum("arrivals").alias("arrivals"),
        F.count(F.lit(1)).alias("rows"),
        (F.sum("departures") / F.count(F.lit(1))).alias("mean_departures"),
    )


def station_ranking(demand: DataFrame, metric: str = "departures", limit: int = 20) -> DataFrame:
    """The k busiest stations; equal values are ordered by station."""
    value = {
        "departures": F.col("departures"),
        "arrivals": F.col("arrivals"),
        "activity": F.col("departures") + F.col("arrivals"),
    }[metric]
    return (
        demand.groupBy("station")
        .agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("observed_rows"))
        .orderBy(F.desc("value"), "station")
        .limit(limit)
    )


def checked_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """UTC bounds of a read query; naive and empty ranges are refused."""
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("start and end must include a time zone offset")
    start, end = start.astimezone(timezone.utc), end.astimezone(timezone.utc)
    if end <= start:
        raise ValueError("end must be later than start")
    return start, end


def in_range(demand: DataFrame, start: datetime, end: datetime) -> DataFrame:
    start, end = checked_range(start, end)
    bounds = [F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for t in (start, end)]
    return demand.where((F.col("time") >= bounds[0]) & (F.col("time") < bounds[1]))


def hourly_series(
    demand: DataFrame, start: datetime, end: datetime, station: str | None = None, limit: int | None = None
) -> DataFrame:
    """Per observed hour: sums and the number of observed station-hours, oldest first.

    All hours of the range, or the oldest `limit` where one is asked for.
    """
    rows = in_range(demand, start, end)
    if station is not None:
        rows = rows.where(F.col("station") == station)
    hours = (
        rows.groupBy("time")
        .agg(
            F.sum("departures").alias("departures"),
            F.sum("arrivals").alias("arrivals"),
            F.count(F.lit(1)).alias("observed_station_hours"),
        )
        .orderBy("time")
    )
    return hours if limit is None else hours.limit(limit)


def latest_history(demand: DataFrame, station: str | None = None, limit: int = 100) -> DataFrame:
    """The newest `limit` observations, ties by station."""
    if station is not None:
        demand = demand.where(F.col("station") == station)
    return demand.orderBy(F.desc("time"), "station").limit(limit)


def rectangle_coverage(demand: DataFrame) -> DataFrame:
    """How much of the calendar-hours x stations rectangle is observed (one row)."""
    totals = demand.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station").alias("stations"),
        F.count_distinct("time").alias("unique_hours"),
        F.count_if(F.col("departures") == 0).alias("zero_departure_rows"),
        F.min("time").alias("_first"),
        F.max("time").alias("_last"),
    )
    hours = (F.unix_timestamp("_last") - F.unix_timestamp("_first")) / 3600
    return totals.select(
        "rows",
        "stations",
        "unique_hours",
        "zero_departure_rows",
        (F.floor(hours) + 1).alias("calendar_hours"),
    ).withColumns(
        {
            "missing_global_hours": F.col("calendar_hours") - F.col("unique_hours"),
            "full_rectangle_coverage": F.col("rows") / (F.col("calendar_hours") * F.col("stations")),
        }
    )


def outlook(profile: DataFrame, start_hour: int) -> DataFrame:
    """24 rows from `start_hour` on: the hour-of-day profile rotated to that hour.

    `profile` is `calendar_profile(.., "hour")`, at most 24 rows.
    """
    hours = profile.sparkSession.range(24).select(
        F.col("id").cast("int").alias("position"),
        ((F.col("id") + start_hour) % 24).cast("int").alias("bucket"),
    )
    return hours.join(profile, "bucket", "left").select(
        "position",
        F.col("bucket").alias("hour"),
        F.col("mean_departures").alias("departures"),
        F.col("mean_arrivals").alias("arrivals"),
        F.coalesce("observed_rows", F.lit(0)).alias("rows"),
    )


def outlook_summary(rows: DataFrame) -> DataFrame:
    """Total expected departures and the earliest peak hour (one row)."""
    known = F.coalesce("departures", F.lit(-1.0))
    return rows.agg(
        F.sum(F.coalesce("departures", F.lit(0.0))).alias("total_departures"),
        F.max_by("hour", F.struct(known, -F.col("position"))).alias("peak_hour"),
    )


def stations_with_observations(stations: DataFrame, demand: DataFrame) -> DataFrame:
    return stations.join(demand.select("station"), "station", "left_semi")


def validity_intervals(demand: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(station, valid_from, valid_to): first hour and last hour + 1 h, widened by known rows."""
    seen = demand.groupBy("station").agg(
        F.min("time").alias("valid_from"),
        clocks.shift_hours(F.max("time"), 1).alias("valid_to"),
    )
    if known is None:
        return seen
    both = seen.unionByName(known.select("station", "valid_from", "valid_to"))
    return both.groupBy("station").agg(
        F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")
    )


def with_measures(demand: DataFrame) -> DataFrame:
    return demand.withColumns(measures.demand_measures(F.col("departures"), F.col("arrivals")))
