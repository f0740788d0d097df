"""How the generic operators meet the test tables, in Spark and as SQL fragments.

Each binding reads whole tables and exists twice: a DataFrame method and a CTE of the same name.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.session import spread

ZONE = "Europe/Paris"


class Tables:
    """Lazy access to the tables of a folder and the bindings derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def lineitem(self) -> DataFrame:
        return spread(self.table("lineitem"), "l_orderkey", "l_linenumber")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    def _event_counts(self, station) -> DataFrame:
        return self.events.groupBy(
            F.date_trunc("hour", "ts").alias("time"), station.alias("station")
        ).agg(
            F.count_if(F.col("event_id") % 2 == 0).alias("departures"),
            F.count_if(F.col("event_id") % 2 == 1).alias("arrivals"),
        )

    @property
    def demand(self) -> DataFrame:
        """Station-hours of few, dense stations (event types)."""
        return self._event_counts(F.col("event_type"))

    @property
    def user_demand(self) -> DataFrame:
        """Station-hours of many, sparse stations (users)."""
        return self._event_counts(F.col("user_id").cast("string"))

    @property
    def trips(self) -> DataFrame:
        """Raw text trips from order lines: some clocks missing or unreadable, half reversed."""
        joined = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        start = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        end = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
        return joined.select(
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", start).alias("started_at"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "no clock")
            .otherwise(end)
            .alias("ended_at"),
            F.col("l_suppkey").cast("string").alias("origin_station"),
            (F.col("l_partkey") % 50 + 1).cast("string").alias("destination_station"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trip_id"),
        )

    @property
    def raw_trips(self) -> DataFrame:
        """The trips with a second copy of a third of them and 25 blank rows."""
        trips = self.trips
        copies = trips.where(F.col("trip_id").rlike("[1-3]$"))
        blank = self.table("nation").select(
            *[F.when(F.lit(False), F.lit("")).alias(c) for c in trips.columns]
        )
        return trips.unionByName(copies).unionByName(blank)

    @property
    def resolved(self) -> DataFrame:
        from stationflow.operators.trips import resolve_trips

        return resolve_trips(self.trips, ZONE)

    @property
    def trip_demand(self) -> DataFrame:
        from stationflow.operators.trips import mark_events, station_hour_counts

        return station_hour_counts(mark_events(self.resolved))

    @property
    def inventory(self) -> DataFrame:
        """Daily inventory samples with repeated keys, flags and unknown values."""
        bikes = F.col("l_quantity") - 1
        return self.lineitem.select(
            F.col("l_suppkey").cast("string").alias("station"),
            F.col("l_shipdate").alias("time"),
            bikes.alias("bikes"),
            F.lit(49.0).alias("capacity"),
            F.when(F.col("l_returnflag") != "R", F.lit(49.0) - bikes).alias("free"),
            F.when(F.col("l_returnflag") == "A", 1.0)
            .when(F.col("l_returnflag") == "N", 0.0)
            .alias("active"),
            F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("unavailable"),
            F.concat(F.lit("Stop "), F.col("l_suppkey")).alias("name"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                "l_returnflag", "l_linestatus",
            ).alias("position"),
        )

    @property
    def fine_inventory(self) -> DataFrame:
        """Inventory samples at irregular minutes, one per event, some clearly over capacity."""
        return self.events.select(
            F.col("user_id").cast("string").alias("station"),
            F.col("ts").alias("time"),
            F.floor(F.col("value") % 11).cast("double").alias("bikes"),
            F.lit(9.0).alias("capacity"),
            F.concat(F.lit("User "), F.col("user_id")).alias("name"),
            F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("unavailable"),
        )

    @property
    def network(self) -> DataFrame:
        from stationflow.operators.profiles import network_hours

        return network_hours(self.demand)

    @property
    def weather(self) -> DataFrame:
        """Hourly weather labelled by the end of its hour."""
        hour = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
        wet = (F.col("event_type") == "error") & (F.col("value") > 40)
        return self.events.groupBy(hour.alias("time")).agg(
            (F.count_if(wet) * F.lit(0.1)).alias("rain"),
            (F.count_if(wet) * F.lit(0.1)).alias("precipitation"),
            F.avg("value").alias("temperature_2m"),
            F.max("value").alias("wind_speed_10m"),
        )

    @property
    def weather_hours(self) -> DataFrame:
        from stationflow.operators.weather import join_weather

        return join_weather(self.network, self.weather, ZONE)

    @property
    def places(self) -> DataFrame:
        """Station positions seen on trips, with the order in which they were seen."""
        return self.lineitem.select(
            F.col("l_partkey").cast("string").alias("station"),
            F.concat(F.lit("Place "), F.col("l_linenumber")).alias("name"),
            F.col("l_discount").alias("latitude"),
            F.col("l_tax").alias("longitude"),
            F.col("l_shipdate").cast("timestamp").alias("time"),
            "l_orderkey",
            "l_linenumber",
        )

    @property
    def panel(self) -> DataFrame:
        from stationflow.operators.features import dense_panel

        demand = self.demand
        return dense_panel(demand, demand.select("station").distinct())

    @property
    def scoped(self) -> DataFrame:
        from stationflow.operators.dataset import scoped_demand

        return scoped_demand(self.demand, "demo", "core")


def _counts(station: str) -> str:
    return (
        f"SELECT date_trunc('hour', ts) AS time, {station} AS station,"
        " CAST(count_if(event_id % 2 = 0) AS BIGINT) AS departures,"
        " CAST(count_if(event_id % 2 = 1) AS BIGINT) AS arrivals FROM events GROUP BY 1, 2"
    )


def local(x: str) -> str:
    """SQL: UTC wall clock -> local wall clock."""
    return f"(({x}) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}'"


def utc(x: str) -> str:
    """SQL: local wall clock -> UTC wall clock."""
    return f"(({x}) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC'"


CTE = {
    "demand": _counts("event_type"),
    "user_demand": _counts("CAST(user_id AS VARCHAR)"),
    "trips": (
        "SELECT CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS start_wall,"
        " CASE WHEN NOT (l_returnflag = 'N' AND l_linestatus = 'O') THEN l_shipdate END AS end_wall,"
        " l_suppkey AS o, l_partkey % 50 + 1 AS d,"
        " l_orderkey || '-' || l_linenumber AS trip_id,"
        " (l_returnflag = 'N' AND l_linestatus = 'O') AS bad_end"
        " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "resolved": (
        f"SELECT {utc('start_wall')} AS started, {utc('end_wall')} AS ended,"
        " CASE WHEN o > 0 THEN CAST(o AS VARCHAR) END AS origin,"
        " CAST(d AS VARCHAR) AS destination, trip_id FROM trips"
    ),
    "marked": (
        "SELECT *, started IS NOT NULL AND origin IS NOT NULL AS dep_ok,"
        " ended IS NOT NULL AND NOT coalesce(ended < started, false) AS arr_ok FROM resolved"
    ),
    "trip_demand": (
        "SELECT time, station, CAST(sum(d) AS BIGINT) AS departures, CAST(sum(a) AS BIGINT) AS arrivals"
        " FROM (SELECT date_trunc('hour', started) AS time, origin AS station, 1 AS d, 0 AS a"
        " FROM marked WHERE dep_ok UNION ALL"
        " SELECT date_trunc('hour', ended), destination, 0, 1 FROM marked WHERE arr_ok)"
        " GROUP BY 1, 2"
    ),
    "inventory": (
        "SELECT CAST(l_suppkey AS VARCHAR) AS station, l_shipdate AS time, l_quantity - 1 AS bikes,"
        " 49.0::DOUBLE AS capacity, CASE WHEN l_returnflag <> 'R' THEN 50 - l_quantity END AS free,"
        " CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS active,"
        " CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS unavailable,"
        " 'Stop ' || l_suppkey AS name, l_orderkey, l_linenumber, l_partkey, l_quantity,"
        " l_extendedprice, l_returnflag, l_linestatus FROM lineitem"
    ),
    "keys": (
        "SELECT station, time, count(*) AS copies,"
        " min(bikes) IS DISTINCT FROM max(bikes) OR min(free) IS DISTINCT FROM max(free) AS conflict,"
        " min(bikes) IS DISTINCT FROM max(bikes) OR min(active) IS DISTINCT FROM max(active)"
        " OR min(unavailable) IS DISTINCT FROM max(unavailable)"
        " OR (count(active) > 0 AND count(active) < count(*)) AS strict_conflict"
        " FROM inventory GROUP BY 1, 2"
    ),
    "firsts": (
        "SELECT * FROM inventory QUALIFY row_number() OVER (PARTITION BY station, time ORDER BY"
        " l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag,"
        " l_linestatus) = 1"
    ),
    "agreed": "SELECT f.* FROM firsts f JOIN keys USING (station, time) WHERE NOT conflict",
    "states": (
        "SELECT f.*, bikes = 0 AS is_empty, bikes = 49 AS is_full, hour(time) AS hour,"
        " CASE WHEN hour(time) < 6 THEN 'Night (00-05)' ELSE 'Day/evening (06-23)' END AS period,"
        " CASE WHEN coalesce(active = 0, false) OR unavailable = 1 THEN 'Flagged inactive/unavailable'"
        " WHEN coalesce(active = 1, false) AND unavailable = 0 THEN 'Flagged active/available'"
        " ELSE 'Unknown flags' END AS service"
        " FROM firsts f JOIN keys USING (station, time) WHERE NOT strict_conflict"
    ),
    "fine": (
        "SELECT CAST(user_id AS VARCHAR) AS station, ts AS time, floor(value % 11) AS bikes,"
        " 9.0::DOUBLE AS capacity, 'User ' || user_id AS name,"
        " CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS unavailable FROM events"
    ),
    "occupied": (
        "SELECT *, bikes <= 9 AS valid, CASE WHEN bikes <= 9 THEN bikes / capacity END AS ratio,"
        " bikes = 0 AS is_empty, bikes = 9 AS is_full FROM fine"
    ),
    "network": (
        "SELECT time, CAST(sum(departures) AS BIGINT) AS departures,"
        " CAST(sum(arrivals) AS BIGINT) AS arrivals FROM demand GROUP BY 1"
    ),
    "weather": (
        "SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS time,"
        " count_if(event_type = 'error' AND value > 40)::DOUBLE * 0.1::DOUBLE AS rain,"
        " avg(value) AS temperature_2m, max(value) AS wind_speed_10m FROM events GROUP BY 1"
    ),
    "hours": (
        "SELECT n.time, departures, arrivals, rain, temperature_2m,"
        f" month({local('n.time')}) AS month, hour({local('n.time')}) AS hour,"
        f" isodow({local('n.time')}) >= 6 AS weekend, rain >= 0.1::DOUBLE AS wet,"
        f" strftime({local('n.time')}, '%Y-%m-%d') AS date"
        " FROM network n JOIN weather w ON w.time - INTERVAL 1 HOUR = n.time"
    ),
    "dry": (
        "SELECT month, hour, weekend, avg(departures) AS dry_mean, count(*) AS dry_hours"
        " FROM hours WHERE NOT wet GROUP BY ALL"
    ),
    "matched": (
        "SELECT h.*, dry_mean FROM hours h JOIN dry USING (month, hour, weekend)"
        " WHERE wet AND dry_hours >= 3"
    ),
    "panel": (
        "SELECT n.time, s.station, coalesce(d.departures, 0) AS departures,"
        " coalesce(d.arrivals, 0) AS arrivals FROM (SELECT time FROM network WHERE departures > 0) n"
        " CROSS JOIN (SELECT DISTINCT station FROM demand) s"
        " LEFT JOIN demand d ON d.time = n.time AND d.station = s.station"
    ),
    "places": (
        "SELECT CAST(l_partkey AS VARCHAR) AS station, 'Place ' || l_linenumber AS name,"
        " l_discount AS latitude, l_tax AS longitude, l_shipdate AS time, l_orderkey, l_linenumber"
        " FROM lineitem"
    ),
    "dimension": (
        "SELECT station,"
        " arg_max(name, (l_orderkey, l_linenumber)) AS name,"
        " max(latitude) - min(latitude) AS latitude_span,"
        " max(longitude) - min(longitude) AS longitude_span FROM places GROUP BY 1"
    ),
}

# A fragment may only read tables and the fragments named here.
_NEEDS = {
    "resolved": ["trips"], "marked": ["resolved"], "trip_demand": ["marked"],
    "keys": ["inventory"], "firsts": ["inventory"], "agreed": ["firsts", "keys"],
    "states": ["firsts", "keys"], "occupied": ["fine"], "network": ["demand"],
    "hours": ["network", "weather"], "dry": ["hours"], "matched": ["hours", "dry"],
    "panel": ["network", "demand"], "dimension": ["places"],
}


def with_(*names: str, **own: str) -> str:
    """`WITH` clause of the named fragments and their inputs, then the query's own fragments."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({s})" for n, s in own.items()]
    return "WITH " + ",\n".join(parts) + "\n"
