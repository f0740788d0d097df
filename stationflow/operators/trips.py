"""Trips to validated events to station-hour counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks, identifiers
from stationflow.operators import sequences
from stationflow.schemas import require_columns

TRIP_COLUMNS = ("started_at", "ended_at", "origin_station", "destination_station")


def blank_row(columns: Sequence[str]):
    """True when every column is null."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNull()
    return condition


def without_blank_rows(raw: DataFrame) -> DataFrame:
    return raw.dropna(how="all")


def distinct_rows(raw: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with the number of `copies`; `scope` columns (a file) keep copies apart.

    Exact whole-row identity. Copies are counted before the shuffle, so a hot group of equal
    rows costs one row per task.
    """
    columns = [c for c in raw.columns if c not in scope]
    return raw.groupBy(*columns, *scope).agg(F.count(F.lit(1)).alias("copies"))


def resolve_trips(trips: DataFrame, tz: str, stations: str = "integer") -> DataFrame:
    """Add UTC instants and checked station ids next to the raw text columns.

    `stations="integer"` accepts whole positive numbers only, `"opaque"` any non-blank text.
    """
    require_columns(trips, TRIP_COLUMNS, "trips")
    check = {"integer": identifiers.positive_station, "opaque": identifiers.opaque_station}[stations]
    timed = clocks.with_strict_utc(trips, {"started": "started_at", "ended": "ended_at"}, tz)
    return timed.withColumns(
        {
            "origin": check(F.col("origin_station")).cast("string"),
            "destination": check(F.col("destination_station")).cast("string"),
        }
    )


def mark_events(trips: DataFrame, reversed_clock: str = "arrival") -> DataFrame:
    """Judge the two ends of a trip independently.

    A missing start never invalidates an arrival. An arrival before a known start is rejected;
    `reversed_clock="trip"` rejects the departure of such a trip as well.
    """
    require_columns(trips, ("started", "ended", "origin", "destination"), "resolved trips")
    backwards = F.coalesce(F.col("ended") < F.col("started"), F.lit(False))
    departs = F.col("started").isNotNull() & F.col("origin").isNotNull()
    arrives = F.col("ended").isNotNull() & F.col("destination").isNotNull() & ~backwards
    if reversed_clock == "trip":
        departs = departs & ~backwards
    elif reversed_clock != "arrival":
        raise ValueError("reversed_clock must be 'arrival' or 'trip'")
    return trips.withColumns({"departure_ok": departs, "arrival_ok": arrives, "reversed": backwards})


def explode_events(marked: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per valid event: (time, station, departures, arrivals)."""
    departure = F.struct(
        F.col("departure_ok").alias("ok"),
        clocks.hour_floor(F.col("started")).alias("time"),
        F.col("origin").alias("station"),
        F.lit(1).cast("bigint").alias("departures"),
        F.lit(0).cast("bigint").alias("arrivals"),
    )
    arrival = F.struct(
        F.col("arrival_ok").alias("ok"),
        clocks.hour_floor(F.col("ended")).alias("time"),
        F.col("destination").alias("station"),
        F.lit(0).cast("bigint").alias("departures"),
        F.lit(1).cast("bigint").alias("arrivals"),
    )
    events = marked.select(*carry, F.explode(F.array(departure, arrival)).alias("e"))
    return events.where("e.ok").select(*carry, "e.time", "e.station", "e.departures", "e.arrivals")


def station_hour_counts(marked: DataFrame) -> DataFrame:
    """(time, station, departures, arrivals); every event counts at its own station and hour."""
    return (
        explode_events(marked)
        .groupBy("time", "station")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
    )


def within_year(demand: DataFrame, year: int, time: str = "time") -> DataFrame:
    """Half-open UTC year; a plain comparison, so it reaches the Parquet scan."""
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp") for y in (year, year + 1))
    return demand.where((F.col(time) >= start) & (F.col(time) < end))


def legacy_station_hours(trips: DataFrame) -> DataFrame:
    """Counts of typed trips: one row per record identity, reversed trips drop both events."""
    require_columns(
        trips, ("record_identity", "year", "started", "ended", "origin", "destination"), "trips"
    )
    rest = [c for c in ("year", "started", "ended", "origin", "destination")]
    unique = trips.groupBy("record_identity").agg(F.min(F.struct(*rest)).alias("t"))
    marked = mark_events(unique.select("t.*"), reversed_clock="trip")
    return (
        explode_events(marked, carry=["year"])
        .groupBy("time", "station")
        .agg(
            F.sum("departures").alias("departures"),
            F.sum("arrivals").alias("arrivals"),
            F.min("year").alias("source_year"),
        )
        .withColumns(
            {
                "total_activity": F.col("departures") + F.col("arrivals"),
                "net_flow": F.col("arrivals") - F.col("departures"),
                "demand": F.col("departures"),
            }
        )
    )


def ingestion_quality(
    raw: DataFrame,
    tz: str,
    stations: str = "integer",
    by: Sequence[str] = (),
) -> DataFrame:
    """Reconciled counters of raw text trips: accepted + rejected = distinct non-blank rows.

    `by` (for instance a file column) reports per group and keeps duplicates apart by group.
    """
    data_columns = [c for c in raw.columns if c not in by]
    grouped = distinct_rows(raw, by).withColumn("blank", blank_row(data_columns))
    marked = mark_events(resolve_trips(grouped, tz, stations))
    row = ~F.col("blank")
    start, end = F.col("started").isNotNull(), F.col("ended").isNotNull()
    departs, arrives = F.col("departure_ok"), F.col("arrival_ok")
    goal = F.col("destination").isNotNull()
    n = F.col("copies")
    counters = {
        "source_rows": F.sum(n),
        "blank_rows": F.sum(F.when(F.col("blank"), n).otherwise(0)),
        "duplicate_rows": F.sum(F.when(row, n - 1).otherwise(0)),
        "raw_rows": F.count_if(row),
        "departures": F.count_if(row & departs),
        "arrivals": F.count_if(row & arrives),
        "rejected_departures": F.count_if(row & ~departs),
        "rejected_arrivals": F.count_if(row & ~arrives),
        "arrivals_without_valid_departure": F.count_if(row & arrives & ~departs),
        "invalid_departure_time": F.count_if(row & ~start),
        "invalid_departure_station": F.count_if(row & start & ~departs),
        "invalid_arrival_time": F.count_if(row & ~end),
        "invalid_arrival_station": F.count_if(row & end & ~goal),
        "reversed_arrival_time": F.count_if(row & end & goal & F.col("reversed")),
    }
    return marked.groupBy(*by).agg(*[c.alias(name) for name, c in counters.items()])


def independent_recount(resolved: DataFrame) -> DataFrame:
    """The same counts by another route: each direction is counted by itself in SQL, then merged.

    Validity is counted, not filtered: a filter would be pushed below the clock conversion and
    repeat it.
    """
    return resolved.sparkSession.sql(
        """
        SELECT time, station, sum(d) AS departures, sum(a) AS arrivals FROM (
          SELECT date_trunc('hour', started) AS time, origin AS station,
                 count_if(started IS NOT NULL AND origin IS NOT NULL) AS d, 0L AS a
          FROM {trips} GROUP BY 1, 2 HAVING d > 0
          UNION ALL
          SELECT date_trunc('hour', ended), destination, 0L,
                 count_if(ended IS NOT NULL AND destination IS NOT NULL
                          AND (started IS NULL OR ended >= started)) AS n
          FROM {trips} GROUP BY 1, 2 HAVING n > 0)
        GROUP BY time, station
        """,
        trips=resolved,
    )


def recount_totals(resolved: DataFrame, trip_id: str) -> DataFrame:
    """Recovered arrivals, reversed clocks and repeated trip ids of resolved trips (one row)."""
    marked = mark_events(resolved)
    flags = marked.select(
        trip_id,
        (F.col("arrival_ok") & ~F.col("departure_ok")).cast("bigint").alias("recovered"),
        F.col("reversed").cast("bigint").alias("reversed"),
    )
    per_id = flags.groupBy(trip_id).agg(
        F.count(F.lit(1)).alias("n"), F.sum("recovered").alias("r"), F.sum("reversed").alias("v")
    )
    repeated = F.when(F.col(trip_id).isNotNull(), F.col("n") - 1).otherwise(0)
    return per_id.agg(
        F.sum("r").alias("recovered_arrivals"),
        F.sum("v").alias("reversed_clocks"),
        F.sum(repeated).alias("repeated_trip_ids"),
    )


ROWS_PER_TASK = 300_000  # places that a task tells apart at most, unless more are equal


def _distinct_places(places: DataFrame, order: Sequence[str]) -> tuple[DataFrame, sequences.Dealt | None]:
    """(station, name, latitude, longitude, `_last`) of known stations; `_last` is the greatest `order` of a place.

    The engine merges small shuffle partitions by their compressed size, so tasks of a large table would hold
    ever more places. Large tables are dealt by rows: first by place and a part of the order, so that copies of
    one place meet in several tasks, then by place.
    """
    keys = ["station", "name", "latitude", "longitude"]
    known = places.where(F.col("station").isNotNull()).select(*keys, F.struct(*order).alias("_last"))
    last = F.max("_last").alias("_last")
    tasks = -(-known.count() // ROWS_PER_TASK)
    if tasks <= known.rdd.getNumPartitions():
        return known.groupBy(*keys).agg(last), None
    copies = known.withColumn("_copy", F.pmod(F.xxhash64("_last"), F.lit(16))).repartition(tasks, *keys, "_copy")
    some = copies.groupBy(*keys, "_copy").agg(last).withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(64 * tasks)))
    return some.repartition(tasks, "_slot").groupBy(*keys, "_slot").agg(last), sequences.Dealt("_slot", tasks)


def station_dimension(places: DataFrame, order: Sequence[str]) -> DataFrame:
    """(station, name, latitude, longitude, latitude_span, longitude_span).

    Distinct places only; the name is the last in `order`; coordinates are exact medians.
    """
    distinct, dealt = _distinct_places(places, order)
    slot = [dealt.column] if dealt else []
    latest = F.struct("_last", "name").alias("latest")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude") for f in (F.min, F.max)]
    again = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude") for f in (F.min, F.max)]
    name = sequences.grouped(
        distinct.withColumn("latest", latest), ["station"], [F.max("latest").alias("latest"), *ends],
        [F.max("latest").alias("latest"), *again], dealt,
    ).select(
        "station", "latest.name", (F.col("max_latitude") - F.col("min_latitude")).alias("latitude_span"),
        (F.col("max_longitude") - F.col("min_longitude")).alias("longitude_span"),
    )
    axes = distinct.select(
        "station",
        *slot,
        F.explode(
            F.array(
                F.struct(F.lit("latitude").alias("axis"), F.col("latitude").alias("v")),
                F.struct(F.lit("longitude").alias("axis"), F.col("longitude").alias("v")),
            )
        ).alias("a"),
    ).select("station", *slot, "a.axis", "a.v")
    medians = sequences.exact_quantiles(axes, "v", {"median": 0.5}, keys=["station", "axis"], dealt=dealt)
    centre = medians.groupBy("station").agg(
        F.max(F.when(F.col("axis") == "latitude", F.col("median"))).alias("latitude"),
        F.max(F.when(F.col("axis") == "longitude", F.col("median"))).alias("longitude"),
    )
    return name.join(centre, "station").select(
        "station", "name", "latitude", "longitude", "latitude_span", "longitude_span"
    )


def network_centre(stations: DataFrame) -> DataFrame:
    """Median of the station medians (one row)."""
    axes = stations.select(
        F.explode(
            F.array(
                F.struct(F.lit("latitude").alias("axis"), F.col("latitude").alias("v")),
                F.struct(F.lit("longitude").alias("axis"), F.col("longitude").alias("v")),
            )
        ).alias("a")
    ).select("a.axis", "a.v")
    medians = sequences.exact_quantiles(axes, "v", {"median": 0.5}, keys=["axis"])
    return medians.agg(
        F.max(F.when(F.col("axis") == "latitude", F.col("median"))).alias("latitude"),
        F.max(F.when(F.col("axis") == "longitude", F.col("median"))).alias("longitude"),
    )


def stable_stations(
    demand: DataFrame, stations: DataFrame, months: int = 12, tolerance: float = 0.01
) -> DataFrame:
    """Stations seen in `months` distinct calendar months whose position stays within tolerance."""
    # One number per station, a bit for each month: its size does not depend on the rows.
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), F.month("time")))
    seen = (
        demand.groupBy("station")
        .agg(F.bit_count(F.coalesce(bits, F.lit(0))).alias("_months"))
        .where(F.col("_months") == months)
    )
    still = stations.where(
        (F.col("latitude_span") <= tolerance) & (F.col("longitude_span") <= tolerance)
    )
    return still.join(seen, "station", "left_semi")
