"""Trips, clocks, identifiers, sources and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.functions import clocks, identifiers, measures
from stationflow.operators import canonical, profiles, trips
from stationflow.plans.bindings import CTE, ZONE, Tables, local, utc, with_
from stationflow.plans.registry import query, r, ts
from stationflow.session import shared_dir
from stationflow.sources import commits, reference_data, snapshots, tables
from stationflow.sources import trips as trip_sources

COUNTS = f"SELECT {ts('time')} AS time, station, departures, arrivals FROM trip_demand"


# --- events and counts -------------------------------------------------------------------------


@query("station_hour_counts", "B1 B3 B4 C1 E1 H1", with_("trip_demand") + COUNTS)
def _(t: Tables):
    return t.trip_demand


@query(
    "opaque_station_hours",
    "C1 E1",
    with_(
        "trips",
        resolved=f"SELECT {utc('start_wall')} AS started, {utc('end_wall')} AS ended,"
        " CAST(o AS VARCHAR) AS origin, CAST(d AS VARCHAR) AS destination FROM trips",
        marked=CTE["marked"],
        trip_demand=CTE["trip_demand"],
    )
    + COUNTS,
)
def _(t: Tables):
    resolved = trips.resolve_trips(t.trips, ZONE, stations="opaque")
    return trips.station_hour_counts(trips.mark_events(resolved))


@query(
    "legacy_station_hours",
    "E2 B20",
    with_(
        "resolved",
        kept="SELECT DISTINCT ON (started, ended, origin, destination, trip_id) * FROM resolved"
        " WHERE NOT coalesce(ended < started, false)",
        events="SELECT date_trunc('hour', started) AS time, origin AS station, 1 AS d, 0 AS a,"
        " 2024 AS y FROM kept WHERE started IS NOT NULL AND origin IS NOT NULL UNION ALL"
        " SELECT date_trunc('hour', ended), destination, 0, 1, 2024 FROM kept WHERE ended IS NOT NULL",
    )
    + f"SELECT {ts('time')} AS time, station, sum(d)::BIGINT AS departures, sum(a)::BIGINT AS arrivals,"
    " min(y)::BIGINT AS source_year, sum(d + a)::BIGINT AS total_activity,"
    " sum(a - d)::BIGINT AS net_flow, sum(d)::BIGINT AS demand FROM events GROUP BY time, station",
)
def _(t: Tables):
    typed = t.resolved.select(
        F.lit(2024).alias("year"), "started", "ended", "origin", "destination",
        identifiers.row_key(*[F.col(c) for c in ("trip_id", "started", "ended", "origin", "destination")])
        .alias("record_identity"),
    )
    return trips.legacy_station_hours(typed)


_QUALITY = """
SELECT (SELECT count(*) FROM everything)::BIGINT AS source_rows, 25::BIGINT AS blank_rows,
  ((SELECT count(*) FROM everything) - 25 - count(*))::BIGINT AS duplicate_rows,
  count(*)::BIGINT AS raw_rows, count_if(dep_ok)::BIGINT AS departures, count_if(arr_ok)::BIGINT AS arrivals,
  count_if(NOT dep_ok)::BIGINT AS rejected_departures, count_if(NOT arr_ok)::BIGINT AS rejected_arrivals,
  count_if(arr_ok AND NOT dep_ok)::BIGINT AS arrivals_without_valid_departure,
  count_if(started IS NULL)::BIGINT AS invalid_departure_time,
  count_if(started IS NOT NULL AND NOT dep_ok)::BIGINT AS invalid_departure_station,
  count_if(ended IS NULL)::BIGINT AS invalid_arrival_time,
  count_if(ended IS NOT NULL AND destination IS NULL)::BIGINT AS invalid_arrival_station,
  count_if(ended IS NOT NULL AND destination IS NOT NULL AND coalesce(ended < started, false))::BIGINT
    AS reversed_arrival_time
FROM (SELECT DISTINCT started, ended, origin, destination, trip_id, o, d, start_wall, end_wall, dep_ok, arr_ok
      FROM judged)
"""


@query(
    "ingestion_quality",
    "C2 E4 H2",
    with_(
        "trips",
        everything="SELECT trip_id FROM trips UNION ALL SELECT trip_id FROM trips WHERE"
        " regexp_matches(trip_id, '[1-3]$') UNION ALL SELECT NULL FROM nation",
        resolved=f"SELECT *, {utc('start_wall')} AS started, {utc('end_wall')} AS ended,"
        " CASE WHEN o > 0 THEN CAST(o AS VARCHAR) END AS origin, CAST(d AS VARCHAR) AS destination FROM trips",
        judged=CTE["marked"],
    )
    + _QUALITY,
)
def _(t: Tables):
    return trips.ingestion_quality(t.raw_trips, ZONE)


@query(
    "ingestion_quality_by_source",
    "C2 E4 H2",
    with_(
        "trips",
        resolved=f"SELECT *, {utc('start_wall')} AS started, {utc('end_wall')} AS ended,"
        " CASE WHEN o > 0 THEN CAST(o AS VARCHAR) END AS origin, CAST(d AS VARCHAR) AS destination,"
        " right(trip_id, 1) AS source FROM trips",
        judged=CTE["marked"],
        counted="SELECT source, started, dep_ok, arr_ok, ended, origin, destination, trip_id, o, d,"
        " start_wall, end_wall, sum(CASE WHEN source IN ('1', '2', '3') THEN 2 ELSE 1 END) AS n"
        " FROM judged GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12",
    )
    + """SELECT source, sum(n)::BIGINT AS source_rows, 0::BIGINT AS blank_rows,
  sum(n - 1)::BIGINT AS duplicate_rows, count(*)::BIGINT AS raw_rows,
  count_if(dep_ok)::BIGINT AS departures, count_if(arr_ok)::BIGINT AS arrivals,
  count_if(NOT dep_ok)::BIGINT AS rejected_departures, count_if(NOT arr_ok)::BIGINT AS rejected_arrivals,
  count_if(arr_ok AND NOT dep_ok)::BIGINT AS arrivals_without_valid_departure,
  count_if(started IS NULL)::BIGINT AS invalid_departure_time,
  count_if(started IS NOT NULL AND NOT dep_ok)::BIGINT AS invalid_departure_station,
  count_if(ended IS NULL)::BIGINT AS invalid_arrival_time,
  count_if(ended IS NOT NULL AND destination IS NULL)::BIGINT AS invalid_arrival_station,
  count_if(ended IS NOT NULL AND destination IS NOT NULL AND coalesce(ended < started, false))::BIGINT
    AS reversed_arrival_time FROM counted GROUP BY source
  UNION ALL SELECT 'none', 25, 25, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0""",
)
def _(t: Tables):
    # The blank rows are a source of their own.
    source = F.coalesce(F.substring("trip_id", -1, 1), F.lit("none"))
    return trips.ingestion_quality(t.raw_trips.withColumn("source", source), ZONE, by=["source"])


@query(
    "distinct_trip_rows",
    "C2 H2",
    with_("trips")
    + "SELECT start_wall IS NOT NULL AS has_start, count(*)::BIGINT AS distinct_rows, sum(n)::BIGINT AS rows"
    " FROM (SELECT start_wall, end_wall, o, d, trip_id, bad_end, sum(w) AS n FROM (SELECT *,"
    " CASE WHEN regexp_matches(trip_id, '[1-3]$') THEN 2 ELSE 1 END AS w FROM trips)"
    " GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1",
)
def _(t: Tables):
    distinct = trips.distinct_rows(trips.without_blank_rows(t.raw_trips))
    return distinct.groupBy(F.col("started_at").isNotNull().alias("has_start")).agg(
        F.count(F.lit(1)).alias("distinct_rows"), F.sum("copies").alias("rows")
    )


@query(
    "year_bounded_counts",
    "C3",
    with_("trip_demand") + COUNTS + " WHERE time >= TIMESTAMP '1999-01-01' AND time < TIMESTAMP '2000-01-01'",
)
def _(t: Tables):
    return trips.within_year(t.trip_demand, 1999)


@query(
    "independent_recount",
    "E40 D12",
    with_("trip_demand")
    + "SELECT count(*)::BIGINT AS station_hours, sum(departures)::BIGINT AS departures,"
    " sum(arrivals)::BIGINT AS arrivals, 0::BIGINT AS mismatching_station_hours FROM trip_demand",
)
def _(t: Tables):
    recount = trips.independent_recount(t.resolved)
    summary = canonical.difference_summary(
        recount, t.trip_demand, ["time", "station"], ["departures", "arrivals"]
    )
    return summary.select(
        F.col("left_rows").alias("station_hours"),
        F.col("left_departures").alias("departures"),
        F.col("left_arrivals").alias("arrivals"),
        F.col("mismatching_keys").alias("mismatching_station_hours"),
    )


@query(
    "recount_totals",
    "E40",
    with_("marked")
    + "SELECT count_if(arr_ok AND NOT dep_ok)::BIGINT AS recovered_arrivals,"
    " count_if(coalesce(ended < started, false))::BIGINT AS reversed_clocks,"
    " (count(*) - count(DISTINCT trip_id))::BIGINT AS repeated_trip_ids FROM marked",
)
def _(t: Tables):
    return trips.recount_totals(t.resolved, "trip_id")


@query(
    "aggregate_difference",
    "D12",
    with_("trip_demand", "marked")
    + f"SELECT {ts('time')} AS time, station, sum(d)::BIGINT AS departures FROM ("
    " SELECT time, station, departures AS d FROM trip_demand UNION ALL"
    " SELECT date_trunc('hour', started), origin, -1 FROM marked WHERE dep_ok"
    " AND NOT coalesce(ended < started, false)) GROUP BY time, station HAVING sum(d) <> 0",
)
def _(t: Tables):
    strict = trips.station_hour_counts(trips.mark_events(t.resolved, reversed_clock="trip"))
    return canonical.aggregate_difference(t.trip_demand, strict, ["time", "station"], ["departures"])


# --- station positions -------------------------------------------------------------------------


@query(
    "station_dimension",
    "E6",
    with_(
        "dimension",
        pairs="SELECT DISTINCT station, name, latitude, longitude FROM places",
        centre="SELECT station, median(latitude) AS latitude, median(longitude) AS longitude FROM pairs GROUP BY 1",
    )
    + f"SELECT station, name, {r('latitude')} AS latitude, {r('longitude')} AS longitude,"
    f" {r('latitude_span')} AS latitude_span, {r('longitude_span')} AS longitude_span"
    " FROM dimension JOIN centre USING (station)",
)
def _(t: Tables):
    return trips.station_dimension(t.places, ["l_orderkey", "l_linenumber", "name"])


@query(
    "network_centre",
    "E7",
    with_(
        "places",
        pairs="SELECT DISTINCT station, name, latitude, longitude FROM places",
        centre="SELECT station, median(latitude) AS lat, median(longitude) AS lon FROM pairs GROUP BY 1",
    )
    + f"SELECT {r('median(lat)')} AS latitude, {r('median(lon)')} AS longitude FROM centre",
)
def _(t: Tables):
    return trips.network_centre(trips.station_dimension(t.places, ["l_orderkey", "l_linenumber", "name"]))


@query(
    "stable_stations",
    "C5",
    with_("dimension")
    + "SELECT station FROM dimension WHERE latitude_span <= 0.09 AND longitude_span <= 0.09 AND station IN"
    " (SELECT station FROM places GROUP BY 1 HAVING count(DISTINCT month(time)) = 12)",
)
def _(t: Tables):
    dimension = trips.station_dimension(t.places, ["l_orderkey", "l_linenumber", "name"])
    return trips.stable_stations(t.places, dimension, tolerance=0.09).select("station")


# --- scalar functions --------------------------------------------------------------------------

_NIGHT = "CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) + INTERVAL 150 MINUTE"


def _night_clock():
    """02:30 on every shipping day as text: it meets both clock changes of every year."""
    return F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T02:30:00"))


_CLOCK_CTE = (
    f"WITH c AS (SELECT {_NIGHT} AS w, l_linenumber FROM lineitem),"
    f" u AS (SELECT *, {utc('w')} AS u FROM c),"
    f" k AS (SELECT *, {local('u')} <> w AS gap, ({local('u - INTERVAL 1 HOUR')} = w"
    f" OR {local('u + INTERVAL 1 HOUR')} = w) AS fold FROM u)"
)


@query(
    "strict_clocks",
    "B1",
    _CLOCK_CTE
    + f" SELECT {ts('w')} AS wall, CASE WHEN NOT gap AND NOT fold THEN {ts('u')} END AS utc,"
    " count(*)::BIGINT AS rows FROM k GROUP BY 1, 2",
)
def _(t: Tables):
    text = _night_clock()
    wall = F.concat(text, F.lit("Z"))
    return t.lineitem.groupBy(
        wall.alias("wall"), clocks.utc_text(clocks.strict_utc(text, ZONE)).alias("utc")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "lenient_clocks",
    "B2",
    _CLOCK_CTE
    + f" SELECT {ts('w')} AS wall, {ts('u')} AS utc, CASE WHEN gap THEN 'nonexistent_shifted_forward'"
    " WHEN fold THEN 'ambiguous_standard_time' ELSE 'normal_local_time' END AS resolution,"
    " count(*)::BIGINT AS rows FROM k GROUP BY 1, 2, 3",
)
def _(t: Tables):
    parsed = clocks.with_lenient_utc(t.lineitem.select(_night_clock().alias("text")), {"c": "text"}, ZONE)
    return parsed.groupBy(
        F.concat("text", F.lit("Z")).alias("wall"),
        clocks.utc_text(F.col("c")).alias("utc"),
        F.col("c_resolution").alias("resolution"),
    ).agg(F.count(F.lit(1)).alias("rows"))


_CAL = local("t")


@query(
    "local_calendar",
    "B9 B19 B10",
    f"WITH e AS (SELECT CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR * l_linenumber"
    f" + INTERVAL 30 MINUTE AS t FROM lineitem), d AS (SELECT DISTINCT t FROM e),"
    f" l AS (SELECT t, {_CAL} AS l, {local('t - INTERVAL 1 HOUR')} AS before FROM d)"
    f" SELECT {ts('t')} AS instant, hour(l)::BIGINT AS local_hour,"
    f" {r('sin(2 * pi() * (hour(l) + minute(l) / 60.0) / 24)')} AS hour_sin,"
    f" {r('cos(2 * pi() * (hour(l) + minute(l) / 60.0) / 24)')} AS hour_cos,"
    " (isodow(l) - 1)::BIGINT AS local_weekday,"
    f" {r('sin(2 * pi() * (isodow(l) - 1) / 7)')} AS weekday_sin,"
    f" {r('cos(2 * pi() * (isodow(l) - 1) / 7)')} AS weekday_cos,"
    " day(l)::BIGINT AS day_of_month, month(l)::BIGINT AS month,"
    f" {r('sin(2 * pi() * (month(l) - 1) / 12)')} AS month_sin,"
    f" {r('cos(2 * pi() * (month(l) - 1) / 12)')} AS month_cos,"
    " year(l)::BIGINT AS year, isodow(l) >= 6 AS weekend,"
    " ((epoch(l) - epoch(t)) / 60)::BIGINT AS utc_offset_minutes, (before = l)::BIGINT AS dst_fold,"
    " strftime(l, '%Y-%m-%d') AS local_date, dayofyear(l)::BIGINT AS day_of_year FROM l",
)
def _(t: Tables):
    instant = F.expr(
        "CAST(l_shipdate AS timestamp) + make_dt_interval(0, l_linenumber, 30, 0)"
    ).alias("instant")
    rows = t.lineitem.select(instant).distinct()
    c = F.col("instant")
    return rows.withColumns(clocks.local_calendar(c, ZONE)).withColumns(
        {
            "local_date": clocks.local_date(c, ZONE),
            "day_of_year": clocks.target_calendar(c, ZONE)["day_of_year"],
        }
    )


@query(
    "clock_arithmetic",
    "B3 B11 B22",
    f"SELECT event_id, {ts("date_trunc('hour', ts)")} AS hour,"
    f" {ts("date_trunc('hour', ts) - INTERVAL 2 HOUR")} AS issue,"
    f" {ts("ts + INTERVAL 90 MINUTE")} AS target FROM events",
)
def _(t: Tables):
    instant = F.col("ts").cast("timestamp")
    hour = clocks.hour_floor(instant)
    return t.events.select(
        "event_id",
        hour.alias("hour"),
        clocks.utc_text(clocks.shift_hours(hour, -2)).alias("issue"),
        clocks.utc_text(clocks.shift_minutes(instant, 90)).alias("target"),
    )


@query(
    "station_identifiers",
    "B4 B5 B13",
    "SELECT c_custkey, CASE WHEN c_custkey > 0 AND c_nationkey % 2 = 0 THEN c_custkey END AS positive,"
    " CAST(c_custkey AS VARCHAR) AS normalized,"
    " CAST(c_custkey AS VARCHAR) AS without_decimal,"
    " 'demo:core:' || c_custkey AS instance, c_mktsegment AS key_part,"
    " CAST(c_custkey AS VARCHAR) AS key_station FROM customer",
)
def _(t: Tables):
    key = F.col("c_custkey").cast("string")
    tail = F.when(F.col("c_nationkey") % 2 == 0, F.lit(".0")).otherwise(F.lit(".5"))
    padded = F.concat(F.lit(" 000"), key, F.lit(" "))
    composite = identifiers.row_key(F.col("c_mktsegment"), key)
    part, station = identifiers.split_row_key(composite, ["key_part", "key_station"])
    return t.table("customer").select(
        "c_custkey",
        identifiers.positive_station(F.concat(key, tail)).alias("positive"),
        identifiers.normalized_station(padded).alias("normalized"),
        identifiers.station_without_decimal(F.concat(key, F.lit(".0 "))).alias("without_decimal"),
        identifiers.station_instance(F.lit("demo"), F.lit("core"), key).alias("instance"),
        part,
        station,
    )


@query(
    "station_codes",
    "B25",
    "SELECT station, (row_number() OVER (ORDER BY station) - 1)::BIGINT AS station_code FROM"
    " (SELECT DISTINCT CAST(user_id AS VARCHAR) AS station FROM events)",
)
def _(t: Tables):
    return identifiers.station_codes(t.events.select(F.col("user_id").alias("station")))


@query(
    "locale_numbers",
    "B6 B18 B24 B15",
    f"SELECT o_orderkey, {r('o_totalprice')} AS parsed, {r('o_totalprice')} AS plain,"
    f" {r('o_totalprice / 60')} AS minutes, {r('greatest(o_totalprice - 200000, 0)')} AS clipped FROM orders",
)
def _(t: Tables):
    price = F.col("o_totalprice")
    cents = F.round(price * 100).cast("bigint")
    text = F.concat(
        F.format_string("%d", F.floor(cents / 100000).cast("bigint")),
        F.lit("."),
        F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0"),
        F.lit(","),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    return t.orders.select(
        "o_orderkey",
        measures.locale_number(text).alias("parsed"),
        measures.locale_number(F.format_string("%.2f", price)).alias("plain"),
        measures.seconds_to_minutes(price.cast("string")).alias("minutes"),
        measures.clip_zero(price - 200000).alias("clipped"),
    )


@query(
    "coordinates",
    "B7",
    "WITH p AS (SELECT DISTINCT l_discount AS lat, l_tax AS lon FROM lineitem)"
    f" SELECT {r('lat')} AS latitude, {r('lon')} AS longitude, {r('lat')} AS point_latitude,"
    f" {r('-lon')} AS point_longitude, lat > 0.02 AND lat < 0.08 AND lon > 0 AND lon < 0.05 AS inside FROM p",
)
def _(t: Tables):
    pairs = t.lineitem.select(F.col("l_discount").alias("lat"), F.col("l_tax").alias("lon")).distinct()
    comma = F.regexp_replace(F.format_string("%.2f %.2f", "lon", "lat"), r"\.", ",")
    geo = F.format_string("{'type': 'Point', 'coordinates': [%.2f, %.2f]}", -F.col("lon"), F.col("lat"))
    flat, point = measures.lon_lat_text(comma), measures.point_text(geo)
    return pairs.select(
        flat["latitude"].alias("latitude"),
        flat["longitude"].alias("longitude"),
        point["latitude"].alias("point_latitude"),
        point["longitude"].alias("point_longitude"),
        measures.within_box(
            flat["latitude"], flat["longitude"], (0.02, 0.08), (0.0, 0.05), closed=False
        ).alias("inside"),
    )


@query(
    "snapshot_periods",
    "B12",
    "SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN '2001-01'"
    " ELSE strftime(o_orderdate, '%Y-%m') END AS period, count(*)::BIGINT AS rows FROM orders GROUP BY 1, 2",
)
def _(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM"))
        .when(F.col("o_orderpriority") == "2-HIGH", day)
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(day, F.lit("T12:00:00")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown"))
        .otherwise(F.concat(F.lit('{"$date": "'), day, F.lit('T12:00:00Z"}')))
    )
    period = clocks.snapshot_period(text, F.lit(2001))
    return t.orders.groupBy("o_orderpriority", period.alias("period")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "row_hashes",
    "B14 A14",
    "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS row_hash,"
    " sha256(CAST(o_custkey AS VARCHAR)) AS export_key FROM orders",
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey",
        identifiers.row_hash(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("row_hash"),
        identifiers.export_key(F.col("o_custkey")).alias("export_key"),
    )


@query(
    "metrics_json",
    "B23",
    f"SELECT event_type, count(*)::BIGINT AS rows, {r("avg(CAST(json_extract(props, '$.k') AS DOUBLE))")} AS mae"
    " FROM events GROUP BY 1",
)
def _(t: Tables):
    text = F.regexp_replace("props", '"k"', '"mae"')
    parsed = t.events.select("event_type", measures.metrics_from_json(text).alias("m"))
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("m.mae").alias("mae")
    )


# --- sources: files written from the tables, then read back -------------------------------------


@query("mapped_csv_trips", "A1 B8", with_("trip_demand") + COUNTS)
def _(t: Tables):
    path = shared_dir(t.spark, "mapped-csv")
    t.trips.select(
        F.col("started_at").alias("start"),
        F.col("ended_at").alias("end"),
        F.col("origin_station").alias("from"),
        F.col("destination_station").alias("to"),
        F.lit("0").alias("lat"),
        F.lit("0").alias("lon"),
        "trip_id",
    ).write.option("header", True).csv(path)
    mapping = {
        "started_at": "start", "ended_at": "end", "origin_station": "from",
        "destination_station": "to", "latitude": "lat", "longitude": "lon",
    }
    rows = trip_sources.read_mapped_trips(t.spark, path, mapping)
    return trips.station_hour_counts(trips.mark_events(trips.resolve_trips(rows, ZONE)))


@query("exact_csv_trips", "A2", with_("trip_demand") + COUNTS)
def _(t: Tables):
    path = shared_dir(t.spark, "exact-csv")
    t.trips.select(
        F.col("started_at").alias("unlock_date"),
        F.col("ended_at").alias("lock_date"),
        F.col("origin_station").alias("station_unlock"),
        F.col("destination_station").alias("station_lock"),
        F.col("trip_id").alias("idTrip"),
    ).write.option("header", True).option("sep", ";").csv(path)
    rows = trip_sources.read_exact_trips(t.spark, path)
    return trips.station_hour_counts(trips.mark_events(trips.resolve_trips(rows, ZONE)))


@query(
    "flexible_csv_trips",
    "A3 A4 B2",
    "WITH j AS (SELECT *, l_linestatus = 'F' AS recovered FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    f"), x AS (SELECT recovered, {utc('o_orderdate')} AS started,"
    f" {utc('l_shipdate')} AS ended, CAST(l_suppkey AS VARCHAR) AS origin,"
    " CAST(l_partkey % 50 + 100 AS VARCHAR) AS destination, l_linenumber + 0.5::DOUBLE AS duration FROM j)"
    " SELECT recovered, origin, destination, count(*)::BIGINT AS trips,"
    f" {r('sum(duration)')} AS minutes, min({ts('started')}) AS first_start, max({ts('ended')}) AS last_end"
    " FROM x GROUP BY 1, 2, 3",
)
def _(t: Tables):
    rows = trip_sources.read_flexible_trips(t.spark, _flexible_files(t))
    typed = trip_sources.typed_flexible_trips(rows.withColumn("idtrip", F.col("recovered").cast("string")), 2024, ZONE)
    return typed.groupBy((F.col("trip_id") == "true").alias("recovered"), "origin", "destination").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("duration_minutes").alias("minutes"),
        F.min("started").alias("first_start"),
        F.max("ended").alias("last_end"),
    )


def _flexible_files(t: Tables, origin: Column | None = None) -> str:
    """Trips whose headers vary in form; the extra separator makes a part of the rows wider than their header."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    joined = t.lineitem.join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    trip_id = F.when(F.col("l_linestatus") == "F", F.lit("T;x")).otherwise(F.lit("T"))
    path = shared_dir(t.spark, "flexible-csv")
    joined.select(
        trip_id.alias("id trip"),
        F.format_string("%d.5", "l_linenumber").alias("Trip_Minutes"),
        F.date_format("o_orderdate", iso).alias("Unlock Date"),
        F.date_format("l_shipdate", iso).alias("LOCK_DATE"),
        (F.col("l_suppkey").cast("string") if origin is None else origin).alias("station unlock"),
        (F.col("l_partkey") % 50 + 100).alias("Station-Lock"),
    ).write.option("header", True).option("sep", ";").option("quote", "\u0000").csv(path)
    return path


@query(
    "flexible_read_counts",
    "A3 A4",
    "SELECT count(*)::BIGINT AS raw_rows, count_if(l_returnflag <> 'R')::BIGINT AS trips,"
    " count_if(l_returnflag <> 'R' AND l_linestatus = 'F')::BIGINT AS recovered_trips,"
    " count_if(l_returnflag = 'R' AND l_linestatus <> 'F')::BIGINT AS invalid_rows,"
    " count_if(l_returnflag = 'R' AND l_linestatus = 'F')::BIGINT AS unread_rows"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t: Tables):
    # A returned part has no origin: a plain row is then invalid, a wide one cannot be recovered.
    origin = F.when(F.col("l_returnflag") != "R", F.col("l_suppkey").cast("string"))
    rows = trip_sources.read_flexible_trips(t.spark, _flexible_files(t, origin), keep_unread=True)
    counts = trip_sources.flexible_read_counts(rows, 2024, ZONE)
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns[1:]])


@query(
    "legacy_json_trips",
    "A5 B18",
    "WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    " SELECT CAST(l_suppkey AS VARCHAR) AS origin, CAST(l_partkey % 50 AS VARCHAR) AS destination,"
    f" count(*)::BIGINT AS trips, {r('sum(l_quantity) / 60')} AS minutes,"
    f" min({ts(utc('o_orderdate'))}) AS first_start, 0::BIGINT AS arrivals_known FROM j GROUP BY 1, 2",
)
def _(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    clock = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    start = F.when(
        F.col("l_returnflag") == "R",
        F.concat(F.lit('{"$date": "'), clock, F.lit('"}')),
    ).otherwise(F.concat(F.lit('"'), clock, F.lit('"')))
    line = F.concat(
        F.lit('{"_id": {"$oid": "'), F.col("l_orderkey"), F.lit('"}, "unplug_hourTime": '), start,
        F.lit(', "idunplug_station": '), F.col("l_suppkey"),
        F.lit(', "idplug_station": '), F.col("l_partkey") % 50,
        F.lit(', "travel_time": '), F.col("l_quantity"), F.lit("}"),
    )
    path = shared_dir(t.spark, "legacy-json")
    joined.select(line.alias("value")).write.text(path)
    rows = trip_sources.read_legacy_trips(t.spark, path, 2024, ZONE)
    return rows.groupBy("origin", "destination").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("duration_minutes").alias("minutes"),
        F.min("started").alias("first_start"),
        F.count("ended").alias("arrivals_known"),
    )


def _snapshot_line():
    station = F.struct(
        F.col("l_suppkey").alias("id"),
        (F.col("l_quantity") - 1).cast("int").alias("dock_bikes"),
        F.lit(49).alias("total_bases"),
        (F.lit(50) - F.col("l_quantity")).cast("int").alias("free_bases"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).alias("activate"),
        F.concat(F.lit("Antón "), F.col("l_suppkey")).alias("name"),
    )
    return F.to_json(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("_id"), F.array(station).alias("stations"))
    )


_SNAPSHOT_SUM = (
    "SELECT CAST(l_suppkey AS VARCHAR) AS station, count(*)::BIGINT AS rows,"
    f" {r('sum(l_quantity - 1)')} AS bikes, {r('sum(50 - l_quantity)')} AS free,"
    " count_if(l_returnflag <> 'R')::BIGINT AS flagged, 'Antón ' || l_suppkey AS name,"
    f" {ts('max(l_shipdate)')} AS last_time FROM lineitem GROUP BY l_suppkey"
)


def _snapshot_sum(rows):
    return rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("bikes").alias("bikes"),
        F.sum("free").alias("free"),
        F.count("active").alias("flagged"),
        F.max("name").alias("name"),
        F.max("time").alias("last_time"),
    )


@query("snapshot_lines", "A6", _SNAPSHOT_SUM)
def _(t: Tables):
    path = shared_dir(t.spark, "snapshot-lines")
    t.lineitem.select(_snapshot_line().alias("value")).write.text(path)
    return _snapshot_sum(snapshots.read_snapshot_lines(t.spark, path))


@query("reordered_documents", "A6", _SNAPSHOT_SUM)
def _(t: Tables):
    # `_id` behind the stations, two documents a line, braces and quotes in texts.
    moved = F.regexp_replace(_snapshot_line(), r'^\{("_id":[^,]*),(.*)\}$', r'{"note":"} \\" {",$2,$1}')
    path = shared_dir(t.spark, "reordered-documents")
    t.lineitem.select(F.concat(F.regexp_replace(moved, ',"', ',\n  "'), F.lit(" ")).alias("value")).write.option("lineSep", " ").text(path)
    return _snapshot_sum(snapshots.read_snapshot_documents(t.spark, path, any_order=True))


@query("snapshot_documents", "A6", _SNAPSHOT_SUM)
def _(t: Tables):
    # Spread over lines, numbers wrapped.
    text = F.regexp_replace(_snapshot_line(), '"dock_bikes":(\\d+)', '"dock_bikes":NumberInt($1)')
    text = F.regexp_replace(text, ',"', ',\n  "')
    path = shared_dir(t.spark, "snapshot-documents")
    t.lineitem.select(text.alias("value")).write.text(path)
    return _snapshot_sum(snapshots.read_snapshot_documents(t.spark, path))


@query(
    "snapshot_field_census",
    "A17",
    "WITH f AS (SELECT l_returnflag, unnest(['id', 'dock_bikes', 'total_bases', 'free_bases', 'activate', 'name'])"
    " AS field FROM lineitem), g AS (SELECT field, NULL AS value FROM f WHERE field <> 'activate' OR l_returnflag <> 'R'"
    " UNION ALL SELECT field, CASE l_returnflag WHEN 'A' THEN '1' ELSE '0' END FROM f"
    " WHERE field = 'activate' AND l_returnflag <> 'R')"
    " SELECT field, value, count(*)::BIGINT AS stations FROM g GROUP BY 1, 2",
)
def _(t: Tables):
    path = shared_dir(t.spark, "snapshot-census")
    t.lineitem.select(_snapshot_line().alias("value")).write.text(path)
    census = snapshots.field_census(t.spark, path)
    return census.groupBy("field", "value").agg(F.sum("stations").alias("stations"))


@query(
    "monthly_station_metadata",
    "A13 B12 F6",
    "SELECT CAST(l_suppkey AS VARCHAR) AS station_id, strftime(l_shipdate, '%Y-%m') AS snapshot_period,"
    " 49::BIGINT AS total_bases, 'demo' AS provider_id, 'Antón ' || l_suppkey AS name,"
    " sha256('demo|' || l_suppkey || '|' || strftime(l_shipdate, '%Y-%m') || '|all|Antón ' || l_suppkey || '|')"
    " AS record_identity FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y-%m')",
)
def _(t: Tables):
    path = shared_dir(t.spark, "snapshot-metadata")
    t.lineitem.select(_snapshot_line().alias("value")).write.text(path)
    rows = snapshots.read_snapshot_lines(t.spark, path).withColumn("source", F.lit("all"))
    monthly = snapshots.monthly_metadata(rows, "demo", "core", 2024)
    return monthly.select(
        "station_id", "snapshot_period", "total_bases", "provider_id", "name", "record_identity"
    )


@query(
    "weather_rows",
    "A7",
    with_("weather")
    + f"SELECT {ts('time')} AS time, {r('rain')} AS rain, {r('temperature_2m')} AS temperature_2m,"
    f" {r('wind_speed_10m')} AS wind_speed_10m FROM weather",
)
def _(t: Tables):
    # Parallel arrays of at most one year of hours, as the payload format prescribes.
    hour = F.struct(F.unix_timestamp("time").alias("time"), "rain", "precipitation", "temperature_2m", "wind_speed_10m")
    yearly = t.weather.groupBy(F.year("time").alias("year")).agg(
        F.sort_array(F.collect_list(hour)).alias("h")
    )
    path = shared_dir(t.spark, "weather")
    names = ("time", "rain", "precipitation", "temperature_2m", "wind_speed_10m")
    yearly.select(F.struct(*[F.col(f"h.{n}").alias(n) for n in names]).alias("hourly")).write.json(path)
    return reference_data.read_weather(t.spark, path).drop("precipitation")


@query(
    "station_master",
    "A8 B6 B7 B8 B15",
    f"SELECT CAST(s_suppkey AS VARCHAR) AS station_id, {r('s_acctbal')} AS capacity,"
    f" {r('s_nationkey')} AS available_bikes, {r('s_nationkey / 10.0')} AS latitude,"
    f" {r('-s_nationkey / 10.0')} AS longitude, {r('greatest(s_acctbal - s_nationkey, 0)')} AS station_score"
    " FROM supplier",
)
def _(t: Tables):
    path = shared_dir(t.spark, "station-master")
    tenth = F.format_string("%.1f", F.col("s_nationkey") / 10)
    t.supplier.select(
        F.col("s_suppkey").alias("Number"),
        F.regexp_replace(F.format_string("%.2f", "s_acctbal"), r"\.", ",").alias("TotalBases"),
        F.col("s_nationkey").alias("dock_bikes"),
        F.concat(F.lit("-"), tenth, F.lit(" "), tenth).alias("PosicionSTR"),
    ).write.option("header", True).csv(path)
    return reference_data.read_station_master(t.spark, path).select(
        "station_id", "capacity", "available_bikes", "latitude", "longitude", "station_score"
    )


@query(
    "source_manifest",
    "A9",
    "SELECT count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS key_sum, true AS half_are_duplicates FROM orders",
)
def _(t: Tables):
    base = shared_dir(t.spark, "manifest")
    for copy in ("a", "b"):
        t.orders.select("o_orderkey", "o_custkey").write.option("header", True).csv(f"{base}/{copy}")
    paths = [f"{base}/a/*.csv", f"{base}/b/*.csv"]
    manifest = reference_data.source_manifest(t.spark, paths)
    counts = manifest.agg((F.count_if("duplicate") * 2 == F.count(F.lit(1)))).scalar()
    rows = trip_sources.read_text_csv(t.spark, reference_data.distinct_files(manifest))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum")
    ).withColumn("half_are_duplicates", counts)


# --- sinks --------------------------------------------------------------------------------------

_DEMAND = f"SELECT {ts('time')} AS time, station, departures, arrivals FROM demand"


@query("table_sink", "A10 G8", with_("demand") + _DEMAND)
def _(t: Tables):
    store = shared_dir(t.spark, "sink")
    commits.save_table(t.demand.withColumn("departures", F.col("departures") + 1), store, "demand", ["station"], ["time"])
    commits.save_table(t.demand, store, "demand", ["station"], ["time"])
    rows = commits.read_table(t.spark, store, "demand", "time timestamp, departures bigint, arrivals bigint, station string")
    return rows.select("time", "station", "departures", "arrivals")


@query("station_exports", "A14", with_("demand")
       + "SELECT sha256(station) AS export_key, count(*)::BIGINT AS rows, sum(departures)::BIGINT AS departures"
       " FROM demand GROUP BY station")
def _(t: Tables):
    path = tables.write_station_exports(t.demand, shared_dir(t.spark, "exports"))
    rows = t.spark.read.schema("export_key string, departures bigint").json(path)
    return rows.groupBy("export_key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("departures").alias("departures")
    )


def _published(t: Tables) -> str:
    """A store with two batches of one network and one of another; the first batch is active again.

    The second batch lies a day later and names the stations; of the other network one station has a place.
    """
    store = shared_dir(t.spark, "store")
    stored = tables.write_table(t.demand, shared_dir(t.spark, "demand"))
    demand = t.spark.read.parquet(stored)
    changed = demand.withColumns({"departures": F.col("departures") + 1, "time": clocks.shift_hours(F.col("time"), 24)})
    every = demand.select("station").distinct()
    named = every.select("station", F.concat(F.lit("Stop "), "station").alias("name"), F.length("station").alias("capacity"))
    placed = every.where("station = 'error'").select("station", F.lit(40.5).alias("latitude"), F.lit(-3.5).alias("longitude"))
    later = demand.withColumn("departures", F.col("departures") + 1)
    for rows, network, about in ((demand, "core", None), (changed, "core", named), (later, "outer", placed), (demand, "core", None)):
        tables.publish(t.spark, store, rows, "demo", network, "events", about, "Europe/Paris", "FR", network.title())
    return store


@query(
    "versioned_publication",
    "A11 A10 C7 T6",
    with_("demand")
    + "SELECT network_id, count(*)::BIGINT AS rows, sum(departures + k)::BIGINT AS departures,"
    " sum(arrivals)::BIGINT AS arrivals, sum(arrivals - departures - k)::BIGINT AS net_flow,"
    " count(DISTINCT station)::BIGINT AS stations FROM demand,"
    " (VALUES ('core', 0), ('outer', 1)) n(network_id, k) GROUP BY 1",
)
def _(t: Tables):
    rows = tables.active_observations(t.spark, _published(t))
    return rows.groupBy("network_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("departures").alias("departures"),
        F.sum("arrivals").alias("arrivals"),
        F.sum("net_flow").alias("net_flow"),
        F.count_distinct("station_id").alias("stations"),
    )


@query(
    "published_stations",
    "A11 A12",
    with_("demand")
    + "SELECT 'demo' AS provider_id, network_id, station AS station_id, CASE WHEN network_id = 'core' THEN 'Stop ' || station END AS name,"
    " CASE WHEN network_id = 'core' THEN length(station) END::BIGINT AS capacity,"
    " CASE WHEN network_id = 'outer' AND station = 'error' THEN 40.5 END::DOUBLE AS latitude, 'events' AS source_name"
    " FROM (SELECT DISTINCT station FROM demand), (VALUES ('core'), ('outer')) n(network_id)",
)
def _(t: Tables):
    return tables.stations(t.spark, _published(t)).drop("address", "available_bikes", "longitude")


@query(
    "published_validity",
    "A11 E41",
    with_("demand")
    + "SELECT 'demo:' || network_id || ':' || station AS station_instance_id, station AS provider_station_id,"
    f" {ts('min(time)')} AS valid_from,"
    f" {ts('max(time) + INTERVAL 1 HOUR')} AS after_first,"
    f" {ts('max(time) + to_hours(CAST(more AS INTEGER)) + INTERVAL 1 HOUR')} AS valid_to"
    " FROM demand, (VALUES ('core', 24), ('outer', 0)) n(network_id, more) GROUP BY network_id, station, more",
)
def _(t: Tables):
    store = _published(t)
    now = tables.station_instances(t.spark, store).select("station_instance_id", "provider_station_id", "valid_from", "valid_to")
    log = commits.history(t.spark, store).where("operation LIKE 'publish%'")
    first = {r["network"]: r["sequence"] for r in _first_publications(t, store, log)}
    former = [
        commits.read_table(t.spark, store, f"station_instances/demo/{network}", tables.INSTANCES, commits.snapshot(t.spark, store, sequence))
        for network, sequence in sorted(first.items())
    ]
    before = former[0].unionByName(former[1]).select("station_instance_id", F.col("valid_to").alias("after_first"))
    return now.join(before, "station_instance_id")


def _first_publications(t: Tables, store: str, log):
    """The first commit that published each of the two networks."""
    batches = tables.batches(t.spark, store).select("network_id", F.concat(F.lit("publish "), "batch_id").alias("operation"))
    return log.join(batches, "operation").groupBy(F.col("network_id").alias("network")).agg(F.min("sequence").alias("sequence")).collect()


@query(
    "publication_log",
    "A11 C7",
    with_("demand")
    + "SELECT p.timezone, p.calendar_version, w.name, w.network_id, n.batches, n.published, n.rows,"
    " (SELECT count(*) FROM demand)::BIGINT AS active_rows FROM (VALUES ('Europe/Paris', 'FR')) p(timezone, calendar_version),"
    " (VALUES ('core', 'Core'), ('outer', 'Outer')) w(network_id, name) JOIN (SELECT network_id, count(*)::BIGINT AS batches,"
    " count(*)::BIGINT AS published, sum(c)::BIGINT AS rows FROM (VALUES ('core'), ('core'), ('outer')) b(network_id),"
    " (SELECT count(*) AS c FROM demand) GROUP BY 1) n ON n.network_id = w.network_id",
)
def _(t: Tables):
    store = _published(t)
    now = commits.snapshot(t.spark, store)
    batches = tables.batches(t.spark, store, now)
    counts = batches.groupBy("provider_id", "network_id").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("status") == "published").alias("published"), F.sum("expected_rows").alias("rows")
    )
    active = batches.join(tables.active_versions(t.spark, store, now), ["provider_id", "network_id", "batch_id"])
    active = active.select("provider_id", "network_id", F.col("expected_rows").alias("active_rows"))
    all_ = tables.networks(t.spark, store, now).join(tables.providers(t.spark, store, now), "provider_id")
    return all_.join(counts, ["provider_id", "network_id"]).join(active, ["provider_id", "network_id"]).drop("provider_id")


@query(
    "published_rows",
    "A11 B13 B14 B20",
    with_("demand")
    + f"SELECT station AS station_id, {ts('time')} AS observed_at, departures, arrivals,"
    " departures + arrivals AS total_activity, arrivals - departures AS net_flow, departures AS demand,"
    f" sha256('demo:core:' || station || ':' || {ts('time')} || ':' || departures || ':' || arrivals)"
    " AS source_record_hash FROM demand",
)
def _(t: Tables):
    return tables.published_rows(t.demand, "demo", "core").drop(
        "station_instance_id", "source_record_id", "original_time_text"
    )


@query(
    "station_upsert",
    "A12",
    "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'New ' || s_suppkey ELSE s_name END AS name,"
    f" {r('CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END')} AS capacity FROM supplier",
)
def _(t: Tables):
    existing = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("capacity"))
    incoming = t.supplier.select(
        "s_suppkey",
        F.when(F.col("s_nationkey") < 5, F.concat(F.lit("New "), F.col("s_suppkey"))).alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_acctbal") + 1).alias("capacity"),
    )
    return tables.upsert_stations(existing, incoming, ["s_suppkey"])


@query(
    "insert_if_absent",
    "A13",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(t: Tables):
    existing = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.insert_absent(existing, t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "validity_intervals",
    "E41",
    with_("user_demand")
    + "SELECT station, min(" + ts("time") + ") AS valid_from, max(" + ts("time + INTERVAL 1 HOUR") + ") AS valid_to"
    " FROM (SELECT station, time FROM user_demand UNION ALL"
    " SELECT CAST(user_id AS VARCHAR), CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-20'"
    " ELSE TIMESTAMP '2024-01-15' END FROM events) GROUP BY 1",
)
def _(t: Tables):
    day = F.when(F.col("event_type") == "error", "2024-01-20").otherwise("2024-01-15")
    known = t.events.select(
        F.col("user_id").cast("string").alias("station"),
        F.concat(day, F.lit(" 00:00:00")).cast("timestamp").alias("valid_from"),
        F.concat(day, F.lit(" 01:00:00")).cast("timestamp").alias("valid_to"),
    )
    return profiles.validity_intervals(t.user_demand, known)
