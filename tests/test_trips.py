import pytest
from pyspark.sql import functions as F

from helpers import ZONE, at, one, rows, trips as raw
from stationflow.operators import canonical, trips


def counted(spark, data, **how):
    marked = trips.mark_events(trips.resolve_trips(raw(spark, data), ZONE), **how)
    return rows(trips.station_hour_counts(marked), "time", "station", "departures", "arrivals")


def test_each_event_counts_at_its_own_hour_and_station(spark):
    assert counted(spark, [("2022-01-01 12:59", "2022-01-01 13:10", "1", "2")]) == [
        ("2022-01-01 11:00:00", "1", 1, 0),
        ("2022-01-01 12:00:00", "2", 0, 1),
    ]


def test_unknown_arrival_creates_no_event(spark):
    assert counted(spark, [("2022-01-01 12:59", None, "1", "2")]) == [("2022-01-01 11:00:00", "1", 1, 0)]


MIXED = [
    ("2022-01-01 10:00", "2022-01-01 10:30", "1", "2"),
    (None, "2022-01-01 11:00", "1", "2"),
    ("bad", "2022-01-01 11:30", "x", "3"),
    ("2022-01-01 12:00", "2022-01-01 11:00", "0", "2"),
]


def test_quality_reconciles(spark):
    got = one(trips.ingestion_quality(raw(spark, MIXED + [MIXED[0], (None,) * 4]), ZONE))
    assert got["source_rows"] == 6 and got["blank_rows"] == 1 and got["duplicate_rows"] == 1
    assert got["raw_rows"] == 4
    assert got["departures"] == 1 and got["arrivals"] == 3
    assert got["arrivals_without_valid_departure"] == 2
    assert got["reversed_arrival_time"] == 1
    for event in ("departures", "arrivals"):
        assert got[event] + got[f"rejected_{event}"] == got["raw_rows"]


def test_reversed_clock_policies(spark):
    data = [("2022-01-01 12:00", "2022-01-01 11:00", "1", "2")]
    assert len(counted(spark, data)) == 1
    assert counted(spark, data, reversed_clock="trip") == []
    with pytest.raises(ValueError):
        counted(spark, data, reversed_clock="never")


def test_opaque_stations_keep_slashes_and_zeros(spark):
    resolved = trips.resolve_trips(
        raw(spark, [("2022-01-01 12:00", "2022-01-01 12:10", " shared/01 ", " ")]), "UTC", stations="opaque"
    )
    got = rows(trips.station_hour_counts(trips.mark_events(resolved)))
    assert got == [("2022-01-01 12:00:00", "shared/01", 1, 0)]


def test_duplicates_by_scope(spark):
    data = raw(spark, [MIXED[0]] * 3).withColumn("file", F.when(F.rand(1) >= 0, "a"))
    files = data.union(data.withColumn("file", F.lit("b")))
    assert trips.distinct_rows(files, ["file"]).count() == 2
    assert rows(trips.distinct_rows(files.drop("file")), "copies") == [(6,)]


def test_legacy_counts_skip_identities_and_reversed_trips(spark):
    a, b, c = at("2021-05-01T10:20:00"), at("2021-05-01T11:05:00"), at("2021-05-01T09:00:00")
    df = spark.createDataFrame(
        [("t1", 2021, a, b, "1", "2"), ("t1", 2021, a, b, "1", "2"), ("t2", 2020, a, None, "1", "2"), ("t3", 2021, a, c, "1", "2")],
        "record_identity string, year int, started timestamp, ended timestamp, origin string, destination string",
    )
    got = rows(trips.legacy_station_hours(df), "time", "station", "departures", "arrivals", "source_year", "net_flow")
    assert got == [("2021-05-01 10:00:00", "1", 2, 0, 2020, -2), ("2021-05-01 11:00:00", "2", 0, 1, 2021, 1)]


def test_recount_agrees_and_finds_a_lost_row(spark):
    resolved = trips.resolve_trips(raw(spark, MIXED), ZONE)
    counts = trips.station_hour_counts(trips.mark_events(resolved))
    recount = trips.independent_recount(resolved)
    keys, values = ["time", "station"], ["departures", "arrivals"]
    assert canonical.aggregate_difference(recount, counts, keys, values).count() == 0
    lost = counts.where("station <> '3'")
    assert rows(canonical.aggregate_difference(recount, lost, keys, values), "station", "arrivals") == [("3", 1)]


def test_year_bound_is_half_open(spark):
    df = spark.createDataFrame([(at("2021-12-31T23:00:00"),), (at("2022-01-01T00:00:00"),), (at("2023-01-01T00:00:00"),)], "time timestamp")
    assert rows(trips.within_year(df, 2022)) == [("2022-01-01 00:00:00",)]


def test_station_dimension_and_cohort(spark):
    places = spark.createDataFrame(
        [("1", "Old", 40.0, -3.0, 1), ("1", "New", 40.4, -3.0, 2), ("1", "New", 40.1, -3.2, 3), ("1", "New", 40.1, -3.2, 4), ("2", "B", 41.0, -3.0, 5)],
        "station string, name string, latitude double, longitude double, ordinal int",
    )
    got = {r["station"]: r for r in trips.station_dimension(places, ["ordinal"]).collect()}
    assert got["1"]["name"] == "New" and got["1"]["latitude"] == pytest.approx(40.1)
    assert got["1"]["latitude_span"] == pytest.approx(0.4) and got["2"]["longitude_span"] == 0
    demand = spark.createDataFrame([(s, at(f"2022-{m:02d}-05T00:00:00")) for s in "12" for m in range(1, 13)], "station string, time timestamp")
    assert rows(trips.stable_stations(demand, trips.station_dimension(places, ["ordinal"])), "station") == [("2",)]


def test_tasks_of_station_positions_do_not_grow_with_the_rows(spark, monkeypatch):
    # Half of the rows are copies of one place, a third are places of one station; some values are unknown.
    places = spark.range(1200, numPartitions=2).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, "wide").when(F.col("id") % 67 != 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("station"),
        F.when(F.col("id") % 5 != 1, F.concat(F.lit("n"), F.col("id") % 4)).alias("name"),
        F.when(F.col("id") % 2 == 0, 1.5).when(F.col("id") % 11 != 1, F.col("id") % 97 / 7 - 5).alias("latitude"),
        (F.col("id") % 89 / 3).alias("longitude"), F.col("id").alias("ordinal"),
    )
    small = rows(trips.station_dimension(places, ["ordinal"]))
    assert trips._distinct_places(places, ["ordinal"])[1] is None
    monkeypatch.setattr(trips, "ROWS_PER_TASK", 100)
    distinct, dealt = trips._distinct_places(places, ["ordinal"])
    sizes = [len(p) for p in distinct.rdd.glom().collect()]
    assert len(sizes) == dealt.tasks == 12 and max(sizes) <= 200
    got = trips.station_dimension(places, ["ordinal"])
    assert rows(got) == small and got.count() == 22
    known = places.where("station IS NOT NULL")
    plain = known.groupBy("station").agg(F.max_by("name", "ordinal").alias("name"), (F.max("latitude") - F.min("latitude")).alias("span"))
    assert rows(plain) == rows(got, "station", "name", "latitude_span")
    middle = known.select("station", "name", "latitude", "longitude").distinct().groupBy("station").agg(F.median("latitude"), F.median("longitude"))
    assert [(a, pytest.approx(b), pytest.approx(c)) for a, b, c in rows(middle)] == rows(got, "station", "latitude", "longitude")


def test_months_of_a_station_are_counted_once_and_unknown_ones_not(spark):
    times = [("1", at(f"2022-{m:02d}-05T00:00:00")) for m in (*range(1, 13), 3, 3)] + [("2", at("2022-05-01T00:00:00"))] * 12 + [("3", None)]
    demand = spark.createDataFrame(times, "station string, time timestamp")
    still = spark.createDataFrame([(s, 0.0, 0.0) for s in "123"], "station string, latitude_span double, longitude_span double")
    assert rows(trips.stable_stations(demand, still), "station") == [("1",)]
    assert rows(trips.stable_stations(demand, still, months=1), "station") == [("2",)]
    assert rows(trips.stable_stations(demand, still, months=0), "station") == [("3",)]
