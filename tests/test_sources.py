import json
import re

import pytest
from pyspark.sql import functions as F

from helpers import ZONE, at, one, rows
from stationflow.operators import profiles, trips
from stationflow.operators.canonical import DataRuleError
from stationflow.session import shared_dir
from stationflow.sources import reference_data, snapshots, tables
from stationflow.sources import trips as sources


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))
    return str(path)


MAPPING = {
    "started_at": "start", "ended_at": "end", "origin_station": "origin", "destination_station": "destination",
    "latitude": "lat", "longitude": "lon",
}


def test_mapped_csv_keeps_opaque_ids(spark, tmp_path):
    path = write(tmp_path, "a.csv", "start,end,origin,destination,lat,lon\n2022-01-01 10:00,2022-01-01 10:20,shared/01,007,1,2\n")
    got = sources.read_mapped_trips(spark, path, MAPPING)
    assert rows(got, "origin_station", "destination_station") == [("shared/01", "007")]
    with pytest.raises(ValueError):
        sources.read_mapped_trips(spark, path, {k: v for k, v in MAPPING.items() if k != "latitude"})
    with pytest.raises(ValueError):
        sources.read_mapped_trips(spark, path, {**MAPPING, "latitude": "nowhere"})


def test_hourly_year_of_two_networks(spark):
    hours = spark.range(8760).select((F.lit(1640995200) + F.col("id") * 3600).alias("s"), "id")
    again = hours.where("id % 3 = 0")
    late = hours.limit(1).withColumn("s", F.lit(1672531200))
    text = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd HH:mm:ss")
    raw = hours.union(again.withColumn("id", F.col("id") + 10000)).union(late).select(
        text.alias("started_at"), F.lit(None).cast("string").alias("ended_at"),
        F.lit("shared/01").alias("origin_station"), F.lit("x").alias("destination_station"), "id",
    )
    counts = trips.station_hour_counts(trips.mark_events(trips.resolve_trips(raw, "UTC", "opaque")))
    year = trips.within_year(counts, 2022)
    assert one(year.agg(F.sum("departures").alias("n")))["n"] == 8760 + 2920


def test_a_failed_write_leaves_the_former_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        tables.write_table(spark.range(3).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    tables.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_long_instance_ids_are_refused(spark, tmp_path):
    demand = spark.createDataFrame([(at("2022-01-01T00:00:00"), "s" * 60, 1, 1)], "time timestamp, station string, departures bigint, arrivals bigint")
    with pytest.raises(DataRuleError):
        tables.publish(spark, str(tmp_path / "store"), demand, "p" * 60, "n" * 60, "x")
    tables.publish(spark, str(tmp_path / "store"), demand, "p", "n", "x")


def test_exact_csv_and_duplicate_files(spark, tmp_path):
    line = "unlock_date;lock_date;station_unlock;station_lock\n2022-01-01 12:59;2022-01-01 13:10;1;2\n"
    write(tmp_path, "a.csv", line)
    write(tmp_path, "b.csv", line)
    manifest = reference_data.source_manifest(spark, str(tmp_path))
    assert sorted(r["duplicate"] for r in manifest.collect()) == [False, True]
    read = sources.read_exact_trips(spark, reference_data.distinct_files(manifest))
    assert read.count() == 1
    with pytest.raises(ValueError):
        sources.read_exact_trips(spark, write(tmp_path, "c.csv", "unlock_date;lock_date\na;b\n"))


def test_flexible_headers_and_broken_rows(spark, tmp_path):
    write(
        tmp_path, "good.csv",
        "﻿Fecha;Unlock_Date;LOCK date;station_unlock;Station_Lock;trip_minutes;idTrip\n"
        "x;2021-10-30T10:00:00;2021-10-30T10:09:00;225.0;7;9.0;T1\n"
        "2021-10-30;T2;a;5.35;geo;2021-10-30T19:00:00;2021-10-30T19:05:21;3;128;243;9\n",
    )
    write(
        tmp_path, "headless.csv",
        "corrupted header\n2021-10-30,abc123,5.35,point,2021-10-30T19:00:00,2021-10-30T19:05:21,3,128,5,243\nnonsense\n",
    )
    typed = sources.typed_flexible_trips(sources.read_flexible_trips(spark, str(tmp_path)), 2021, ZONE)
    got = rows(typed, "origin", "destination", "duration_minutes", "started")
    assert got == [
        ("128", "243", 5.35, "2021-10-30 17:00:00"),
        ("128", "243", 5.35, "2021-10-30 17:00:00"),
        ("225", "7", 9.0, "2021-10-30 08:00:00"),
    ]
    assert {r["trip_id"] for r in typed.collect()} == {"T1", "T2", "abc123"}


def test_legacy_lines_leave_the_arrival_unknown(spark, tmp_path):
    lines = [
        {"_id": {"$oid": "abc"}, "unplug_hourTime": {"$date": "2018-07-01T10:00:00.000+0200"}, "idunplug_station": 41, "idplug_station": 50, "travel_time": 30},
        {"user_day_code": "u1", "unplug_hourTime": "2018-07-01T11:00:00+02:00", "idunplug_station": "41.0", "idplug_station": 50},
        {"unplug_hourTime": None, "idunplug_station": 1, "idplug_station": 2},
    ]
    path = write(tmp_path, "t.json", "\n".join(json.dumps(x) for x in lines))
    got = rows(sources.read_legacy_trips(spark, path, 2018, ZONE), "trip_id", "started", "origin", "destination", "duration_minutes", "ended")
    assert got == [
        ("abc", "2018-07-01 08:00:00", "41", "50", 0.5, None),
        ("u1", "2018-07-01 09:00:00", "41", "50", None, None),
    ]


def test_snapshot_lines(spark, tmp_path):
    docs = [{"_id": f"2019-01-01T0{i}:00:00", "stations": [{"id": 1, "dock_bikes": i, "free_bases": 20 - i, "total_bases": 20, "name": "A"}]} for i in range(2)]
    path = write(tmp_path, "s.json", "\n".join(json.dumps(d) for d in docs))
    got = rows(snapshots.read_snapshot_lines(spark, path), "station", "time", "bikes", "free")
    assert got == [("1", "2019-01-01 00:00:00", 0.0, 20.0), ("1", "2019-01-01 01:00:00", 1.0, 19.0)]
    census = snapshots.field_census(spark, path)
    assert {r["field"] for r in census.collect()} == {"id", "dock_bikes", "free_bases", "total_bases", "name"}


def test_shell_export_with_quoted_wrapper(spark, tmp_path):
    text = """{
  "_id" : "2018-07-01T00:00:00",
  "stations" : [ { "id" : NumberInt(7), "dock_bikes" : NumberInt( 0 ), "name" : "NumberInt(7) street" } ]
}
{ "_id" : "2018-07-01T01:00:00", "stations" : [ { "id" : 7, "dock_bikes" : 4, "name" : "x" } ] }
"""
    got = rows(snapshots.read_snapshot_documents(spark, write(tmp_path, "m.json", text)), "station", "bikes", "name")
    assert got == [("7", 0.0, "NumberInt(7) street"), ("7", 4.0, "x")]


def many_splits(spark, read):
    """The result of `read` when files are cut into splits of some bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return read()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_documents_and_identities_do_not_depend_on_splits(spark, tmp_path):
    text = "\ufeff" + "\n".join(
        json.dumps({"_id": f"2019-01-01T{i:02}:00:00", "stations": [{"id": i, "name": "Ñ {"}]}, indent=i % 3, ensure_ascii=False)
        for i in range(24)
    )
    path = write(tmp_path, "d.json", text)

    def stations():
        return rows(snapshots.read_snapshot_documents(spark, path), "station", "time", "name")

    assert len(stations()) == 24 and many_splits(spark, stations) == stations()
    lines = "\n".join(json.dumps({"unplug_hourTime": "2018-07-01T11:00:00+02:00", "idunplug_station": 1, "idplug_station": 2}) for _ in range(20))
    legacy = write(tmp_path, "l.json", lines)

    def identities():
        return rows(sources.read_legacy_trips(spark, legacy, 2018, ZONE), "record_identity")

    assert len(set(identities())) == 20 and many_splits(spark, identities) == identities()


def test_manifest_tells_order_and_line_ends_apart(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    texts = ["a,1\nb,2\n", "b,2\na,1\n", "a,1\nb,2", "a,1\r\nb,2\r\n", "", "\n", "a,1\nb,2\n", "\n" * 300 + "x", "x" + "\n" * 300]
    for i, text in enumerate(texts):
        write(folder, f"{i}.csv", text)

    def digests():
        manifest = reference_data.source_manifest(spark, str(folder))
        return {r["path"].rsplit("/", 1)[1]: (r["digest"], r["bytes"], r["duplicate"]) for r in manifest.collect()}

    got = digests()
    assert got["4.csv"][1] == 0 and len({d for d, _, _ in got.values()}) == len(got) - 1 == len(texts) - 1
    assert [n for n, (_, _, again) in got.items() if again] == ["6.csv"]
    assert many_splits(spark, digests) == got


def test_only_the_first_line_is_a_header_and_counts_add_up(spark, tmp_path):
    header = "unlock_date;lock_date;station_unlock;station_lock;trip_minutes;id_trip\n"
    good = "2021-10-30T10:00:00;2021-10-30T10:09:00;225;7;9.0;T1\n"
    write(tmp_path, "a.csv", header + good + good.replace("225", "") + "nonsense;x\n")
    write(tmp_path, "b.csv", "export of October\n" + header + "2021-10-30,abc123,5.35,point,2021-10-30T19:00:00,2021-10-30T19:05:21,3,128,5,243\n")
    all_rows = sources.read_flexible_trips(spark, str(tmp_path), keep_unread=True)
    got = sorted(
        (r["file"].rsplit("/", 1)[1], r["raw_rows"], r["trips"], r["recovered_trips"], r["invalid_rows"], r["unread_rows"])
        for r in sources.flexible_read_counts(all_rows, 2021, ZONE).collect()
    )
    assert got == [("a.csv", 3, 1, 0, 1, 1), ("b.csv", 3, 1, 1, 0, 2)]
    typed = sources.typed_flexible_trips(sources.read_flexible_trips(spark, str(tmp_path)), 2021, ZONE)
    assert rows(typed, "origin", "destination") == [("128", "243"), ("225", "7")]


def test_latin_names_survive_and_bad_lines_fail(spark, tmp_path):
    line = '{"_id": "2018-07-01 00:00:00", "stations": [{"id": 1, "name": "Antón Martín"}]}'
    for name, data in (("latin.json", line.encode("latin-1")), ("utf.json", line.encode())):
        assert rows(snapshots.read_snapshot_lines(spark, write(tmp_path, name, data)), "name") == [("Antón Martín",)]
    for text in (line + "\nnot json\n", '{"_id": "x"}'):
        with pytest.raises(Exception):
            snapshots.read_snapshot_lines(spark, write(tmp_path, "bad.json", text)).collect()


def test_weather_payload(spark, tmp_path):
    payload = {"hourly": {"time": [1640995200, 1640998800], "temperature_2m": [1.5, 2], "precipitation": [0, 0.1], "rain": [0, 0.1], "wind_speed_10m": [3, 4]}}
    got = rows(reference_data.read_weather(spark, write(tmp_path, "w.json", json.dumps(payload, indent=1))), "time", "rain", "temperature_2m")
    assert got == [("2022-01-01 00:00:00", 0.0, 1.5), ("2022-01-01 01:00:00", 0.1, 2.0)]


def test_station_master_keeps_unknown_inventory(spark, tmp_path):
    path = write(tmp_path, "m.csv", "﻿Number;PosicionSTR;TotalBases\n7;-3,70 40,42;24\n8;bad;\n")
    got = {r["station_id"]: r for r in reference_data.read_station_master(spark, path, ";").collect()}
    assert got["7"]["capacity"] == 24 and got["7"]["latitude"] == 40.42
    assert got["7"]["available_bikes"] is None and got["7"]["station_score"] is None
    assert got["8"]["latitude"] is None
    with pytest.raises(ValueError):
        reference_data.read_station_master(spark, write(tmp_path, "x.csv", "OBJECTID\n1\n"))


DEMAND = "time timestamp, station string, departures bigint, arrivals bigint"


def test_publication_switches_per_network_and_survives_failures(spark):
    store = shared_dir(spark, "store")
    t = at("2022-01-01T00:00:00")
    first = spark.createDataFrame([(t, "shared/01", 1, 2)], DEMAND)
    second = spark.createDataFrame([(t, "shared/01", 5, 2), (t, "b", 1, 1)], DEMAND)
    a = tables.publish(spark, store, first, "p", "one", "src")
    other = tables.publish(spark, store, second, "p", "two", "src")
    assert rows(tables.active_versions(spark, store)) == [("p", "one", a), ("p", "two", other)]
    b = tables.publish(spark, store, second, "p", "one", "src")
    assert a != b and tables.active_observations(spark, store).where("network_id = 'one'").count() == 2
    for broken in (first.limit(0), first.union(first), first.withColumn("departures", F.lit(-1)), first.withColumn("station", F.lit(""))):
        with pytest.raises(DataRuleError):
            tables.publish(spark, store, broken, "p", "one", "src")
    assert tables.active_versions(spark, store).where("network_id = 'one'").first()["batch_id"] == b
    assert tables.publish(spark, store, first, "p", "one", "src") == a
    active = tables.active_observations(spark, store).where("network_id = 'one'")
    assert rows(active, "station_id", "net_flow", "source_record_id") == [("shared/01", 1, "p:one:shared/01:2022-01-01T00:00:00Z")]
    assert {r["status"] for r in tables.batches(spark, store).collect()} == {"published"}


def test_a_write_that_loses_rows_does_not_activate(spark, monkeypatch):
    store = shared_dir(spark, "store")
    t = at("2022-01-01T00:00:00")
    good = spark.createDataFrame([(t, "a", 1, 2)], DEMAND)
    bigger = spark.createDataFrame([(t, "a", 1, 2), (t, "b", 1, 2)], DEMAND)
    a = tables.publish(spark, store, good, "p", "n", "src")
    real = tables.write_table
    monkeypatch.setattr(tables, "write_table", lambda df, *args, **kw: real(df.where("station_id = 'a'"), *args, **kw))
    with pytest.raises(DataRuleError):
        tables.publish(spark, store, bigger, "p", "n", "src")
    assert tables.active_versions(spark, store).first()["batch_id"] == a
    assert sorted(r["status"] for r in tables.batches(spark, store).collect()) == ["failed", "published"]


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([("1", "A", 10), ("2", "B", 20)], "station string, name string, capacity int")
    new = spark.createDataFrame([("2", None, 25), ("3", "C", None)], "station string, name string, capacity int")
    assert rows(tables.upsert_stations(old, new, ["station"])) == [("1", "A", 10), ("2", "B", 25), ("3", "C", None)]
    assert rows(tables.insert_absent(old, new, ["station"]), "station") == [("3",)]


def test_validity_widens(spark):
    t = at("2022-01-01T05:00:00")
    seen = spark.createDataFrame([(t, "a", 1, 1)], DEMAND)
    known = spark.createDataFrame([("a", at("2021-01-01T00:00:00"), at("2021-02-01T00:00:00"))], "station string, valid_from timestamp, valid_to timestamp")
    assert rows(profiles.validity_intervals(seen, known)) == [("a", "2021-01-01 00:00:00", "2022-01-01 06:00:00")]


def test_partition_values_stay_texts(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2)], "station string, n int")
    path = tables.write_table(df, str(tmp_path / "t"), partition_by=["station"])
    assert rows(tables.read_text_partitions(spark, path, ["station"]), "station", "n") == [("007", 1), ("7", 2)]


def test_networks_with_leading_zeros_stay_apart(spark, tmp_path):
    store = str(tmp_path / "store")
    t = at("2022-01-01T10:00:00")
    for network, n in (("01", 1), ("1", 2), ("a/b:c", 3)):
        demand = spark.createDataFrame([(t, "5", n, 0)], "time timestamp, station string, departures bigint, arrivals bigint")
        tables.publish(spark, store, demand, "007", network, "test")
    found = rows(tables.active_observations(spark, store), "provider_id", "network_id", "departures")
    assert found == [("007", "01", 1), ("007", "1", 2), ("007", "a/b:c", 3)]


def test_repeated_stations_in_an_upsert(spark):
    old = spark.createDataFrame([("1", "A", 1)], "station string, name string, n int")
    new = spark.createDataFrame([("1", "B", 2), ("1", "C", 3), ("2", "D", 4)], "station string, name string, n int")
    assert rows(tables.upsert_stations(old, new, ["station"], order=["n"])) == [("1", "C", 3), ("2", "D", 4)]


@pytest.mark.parametrize("size", ["64", "128MB"])
def test_documents_in_any_order_and_any_split(spark, tmp_path, size):
    station = '{"id": "7", "name": "a } { \\" b", "dock_bikes": NumberInt(3)}'
    one = '{"stations": [%s, %s],\n "_id": "2018-05-01T00:00:00"}' % (station, station.replace('"7"', '"8"'))
    two = '{\n"note": {"_id": "no", "x": [{}, {}]},\n"_id": "2018-05-01T01:00:00", "stations": [\n%s]\n}' % station
    path = write(tmp_path, "d.json", one + two + "  " + one.replace("T00", "T02") + "\n\n" + two.replace("T01", "T03") + "\n" + "".join(two.replace("T01", f"T{h:02d}") for h in range(4, 24)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = rows(snapshots.read_snapshot_documents(spark, path, any_order=True), "station", "bikes", "name", "time")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 26 and {r[2] for r in got} == {'a } { " b'} and {r[1] for r in got} == {3.0}
    assert sorted(r[3][11:13] for r in got if r[0] == "7") == [f"{h:02d}" for h in range(24)]


def test_unfinished_documents_fail(spark, tmp_path):
    path = write(tmp_path, "d.json", '{"_id": "2018-05-01T00:00:00", "stations": []}\n{"_id": "x", "stations": [')
    with pytest.raises(Exception):
        snapshots.read_snapshot_documents(spark, path, any_order=True).collect()


def test_numbers_stay_wrapped_behind_any_run_of_backslashes(spark):
    texts = ['{"a":"' + "\\" * 83 + '" NumberInt(1)","b":NumberInt( -2 )}', r'{"a":"x\\","b":NumberInt(3)}', '"open NumberInt(4)']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(snapshots.unwrapped_numbers(F.col("t"))).collect()]
    assert got == [texts[0].replace("NumberInt( -2 )", "-2"), r'{"a":"x\\","b":3}', texts[2]]


def test_lines_of_documents_are_not_shuffled_and_borders_of_splits_do_not_show(spark, tmp_path):
    def document(i):
        return json.dumps({"note": '} \\" {' * (i % 4), "stations": [{"id": i, "name": "Ñ {"}], "_id": f"2019-01-01T{i:02}:00:00"}, indent=2 * (i % 3) or None, ensure_ascii=False)

    text = "".join(document(i) + ("\n", " ", "", " \n \n")[i % 4] for i in range(24))
    write(tmp_path, "a.json", text)
    write(tmp_path, "b.json", "﻿" + text)

    def stations():
        return rows(snapshots.read_snapshot_documents(spark, str(tmp_path), any_order=True), "source", "station", "time", "name")

    assert len(stations()) == 48 and many_splits(spark, stations) == stations()
    plan = snapshots.document_texts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = [part.split("FileScan text")[0] for part in plan.split("MapInArrow")[1:]]
    assert len(below) == 2 and not any("Exchange hashpartitioning" in part for part in below)
    write(tmp_path, "c.json", '{"stations": [')
    with pytest.raises(Exception):
        stations()


def test_flexible_rows_stay_where_they_are_read_and_are_recovered_once(spark, tmp_path):
    write(tmp_path, "a.csv", "unlock_date;lock_date;station_unlock;station_lock;trip_minutes;id_trip\n" + "T;x;9.5;2021-10-30T10:00:00;2021-10-30T10:09:00;5;7\nnonsense;x\n")
    read = sources.read_flexible_trips(spark, str(tmp_path))
    assert rows(read, "recovered", "stationunlock", "stationlock", "idtrip") == [(True, "5", "7", "x")]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("fallback-trip") == 1


def test_month_of_a_clock_equals_the_rule_for_texts(spark):
    clock = "cast(t as timestamp_ntz)"
    times = ["2024-02-29 23:59:59", "0001-01-01 00:00:00", "9999-12-31 23:00:00", "+12024-01-02 00:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.expr(clock).alias("time"))
    by_text = snapshots.clocks.snapshot_period(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit(2024))
    got = df.select(snapshots._period(F.col("time"), 2024).alias("a"), by_text.alias("b"))
    assert [r["a"] for r in got.collect()] == [r["b"] for r in got.collect()] == ["2024-02", "0001-01", "9999-12", "2024-01", None]
    plan = got.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("yyyy-MM,") < plan.index("get_json_object")


def test_documents_are_moved_in_records_that_end_at_their_id(spark, tmp_path):
    import pyarrow as pa

    def document(i):
        odd = {"a": 'x"_id', "b": "_id", "c": '"_id"', "d": "\\", "e": '} {"_id"'}
        return json.dumps({"note": odd, "stations": [{"id": i, "name": "Ñ {"}], "_id": f"2019-01-{1 + i % 28:02}T00:00:00"}, indent=2 * (i % 2) or None, ensure_ascii=False)

    text = "﻿" + "\n".join(document(i) for i in range(60))
    (tmp_path / "a.json").write_bytes(text.encode())
    (tmp_path / "b.json").write_bytes(text.replace("Ñ", "N").replace('"N {"', '"Ñ {"', 1).encode("latin-1", "ignore") + "\n".encode() + document(60).encode())

    def stations():
        return rows(snapshots.read_snapshot_documents(spark, str(tmp_path), any_order=True), "source", "station", "name", "time")

    found = stations()
    assert many_splits(spark, stations) == found and len(found) == 121
    assert {r[2] for r in found if r[0].endswith("a.json")} == {"Ñ {"} and sum(r[2] == "Ñ {" for r in found if r[0].endswith("b.json")) == 2
    records = spark.read.option("lineSep", '"_id"').text(str(tmp_path / "a.json")).count()
    assert records < text.count("\n")
    batch = pa.RecordBatch.from_pydict({"file": ["a", "a", "a", "b"], "split": [0, 0, 9, 0], "record": [b'{"s":1,', b': "x"} {', b': "y"}', b'{"s":[]}']})
    runs = list(snapshots._runs(iter([batch])))
    assert runs == [(("a", 0), b'{"s":1,"_id": "x"} {'), (("a", 9), b'"_id": "y"}'), (("b", 0), b'{"s":[]}')]
    told = pa.Table.from_batches(snapshots._documents(iter([batch]), {("a", 9): 1}, edges=False)).to_pydict()
    cut = pa.Table.from_batches(snapshots._documents(iter([batch]), {("a", 9): 1}, edges=True)).to_pydict()
    assert told["text"] == ['{"s":1,"_id": "x"}', '{"s":[]}'] and cut["text"] == [" {", '"_id": "y"}'] and cut["ends"] == [False, True]


def test_depths_of_pieces_equal_a_plain_walk():
    import random

    pick = random.Random(4)
    for _ in range(3000):
        lines = ["".join(pick.choice(["{", "}", '"', "\\", " ", "é", ",", '\\"', '"x"', "} {", "}{"]) for _ in range(pick.randint(0, 9))) for _ in range(pick.randint(1, 4))]
        ends, at, depth = [], 0, 0
        for line in lines:
            strings = [m.span() for m in re.finditer(r'"[^"\\]*(?:\\.[^"\\]*)*"', line)]
            begin = 0
            for k, c in enumerate(line):
                if not any(a <= k < b for a, b in strings):
                    depth += (c == "{") - (c == "}")
                last = k + 1 == len(line)
                if last or (c == "}" and not any(a <= k < b for a, b in strings) and line[k + 1 :].lstrip().startswith("{")):
                    if line[begin : k + 1].strip(" "):
                        ends.append((at + len(line[: k + 1].encode()), depth))
                    begin = k + 1
            at += len(line.encode()) + 1
        found = snapshots._pieces("\n".join(lines).encode())
        assert (list(zip(found[0].tolist(), found[1].tolist())), found[2]) == (ends, depth)
