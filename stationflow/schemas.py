"""Declared schemas (as DDL) and the column check used at every stage boundary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

RAW_TRIP = (
    "started_at string, ended_at string, origin_station string, destination_station string,"
    " latitude string, longitude string, name string"
)
STATION_HOUR = "time timestamp, station string, departures bigint, arrivals bigint"
CANONICAL = (
    "provider string, station_id string, observed_at timestamp, departures bigint, arrivals bigint,"
    " total_activity bigint, net_flow bigint, demand bigint, source_year int"
)
SNAPSHOT_DOCUMENT = (
    "_id string, stations array<struct<id: string, number: string, name: string, address: string,"
    " dock_bikes: string, total_bases: string, free_bases: string, activate: string,"
    " no_available: string, latitude: string, longitude: string>>"
)
INVENTORY = (
    "station string, time timestamp_ntz, bikes double, capacity double, free double, active double,"
    " unavailable double, name string, station_number string, address string, latitude double,"
    " longitude double"
)
WEATHER = (
    "time timestamp, temperature_2m double, precipitation double, rain double, wind_speed_10m double"
)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """Fail closed when a stage does not receive the columns of its contract."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df
