"""Streams replayed file by file: runs on raw samples, and the account of late and repeated events."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from stationflow.operators import sequences, trips
from stationflow.session import shared_dir
from stationflow.streaming import queries as streams

SAMPLES = "station string, time timestamp, low boolean"
START = at("2022-01-01T00:00:00")


def replay(spark, parts, schema, make, purpose):
    """Feed the parts as one batch each, in order; a far row at the end closes what is open."""
    folder, out = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/part={k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    made = make(stream)
    writer = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def raw_samples(pick, n=240, stations="abc"):
    minutes = pick.sample(range(60 * 72), n)
    return sorted((pick.choice(stations), START + timedelta(minutes=m), pick.random() < 0.6) for m in minutes)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_a_raw_stream_equal_the_batch_runs(spark, seed):
    pick = random.Random(seed)
    samples = sorted(raw_samples(pick), key=lambda r: r[1] + timedelta(minutes=pick.randint(0, 110)))
    closing = [("closing", at("2200-01-01T00:00:00"), False)]
    parts = [samples[i : i + 60] for i in range(0, len(samples), 60)] + [closing]
    found = replay(spark, parts, SAMPLES, lambda s: streams.streaming_event_runs(s, "2 hours", 90, "low"), "raw")
    batch = sequences.event_runs(spark.createDataFrame(samples, SAMPLES), F.col("low"), max_gap_minutes=90)
    assert rows(found, "station", "start", "end", "samples") == rows(batch, "station", "start", "end", "samples")
    assert found.where("samples > 1").count() > 5


def test_a_sample_that_is_no_event_splits_a_run_and_silence_closes_it(spark):
    def sample(minute, low):
        return ("a", START + timedelta(minutes=minute), low)

    parts = [
        [sample(0, True), sample(20, True), sample(40, True)],
        [sample(30, False), sample(30 * 24 * 60, True)],  # late but within the bound; then a far event
        [("b", START + timedelta(days=60), False)],
    ]
    found = replay(spark, parts, SAMPLES, lambda s: streams.streaming_event_runs(s, "2 hours", 90, "low"), "split")
    assert [(r[0], r[3]) for r in rows(found, "station", "start", "end", "samples")] == [("a", 2), ("a", 1), ("a", 1)]


def test_equal_clocks_and_unknown_kinds(spark):
    first = START + timedelta(minutes=5)
    parts = [[("a", START, True), ("a", START, True), ("a", first, None), ("a", first + timedelta(minutes=1), True)], [("b", START + timedelta(days=9), True)]]
    found = replay(spark, parts, SAMPLES, lambda s: streams.streaming_event_runs(s, "1 hour", 90, "low"), "ties")
    assert sorted(r["samples"] for r in found.where("station = 'a'").collect()) == [1, 1, 1]


def test_account_adds_up_over_out_of_order_batches(spark):
    schema = "id bigint, started timestamp, ended timestamp, origin string, destination string"
    pick = random.Random(4)

    def trip(k, hour):
        t = START + timedelta(hours=hour, minutes=pick.randint(0, 59))
        return (k, t, t + timedelta(minutes=10), "o", "d")

    fresh = [trip(k, k // 10) for k in range(200)]  # 20 hours
    late = [trip(1000 + k, 0) for k in range(7)]  # hour 0, once the watermark has passed it
    parts = [fresh[:100], fresh[100:], [fresh[-1], fresh[-2], *late], [trip(5000, 24 * 365)], [trip(5001, 24 * 365)]]
    account = streams.RowAccount("hours")
    spark.streams.addListener(account)
    try:
        found = replay(spark, parts, schema, lambda s: streams.streaming_station_hours(trips.mark_events(s), "id", "2 hours", "hours"), "account")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(account)
    totals = account.totals()
    emitted = found.agg(F.sum(F.col("departures") + F.col("arrivals")).alias("n")).first()["n"]
    assert totals == {"events": 2 * (200 + 2 + 7 + 2), "late": 14, "duplicates": 4, "emitted": emitted, "open": 4}
    assert emitted == 400
    counted = trips.station_hour_counts(trips.mark_events(spark.createDataFrame(fresh, schema)))
    assert rows(found, "time", "station", "departures", "arrivals") == rows(counted, "time", "station", "departures", "arrivals")
