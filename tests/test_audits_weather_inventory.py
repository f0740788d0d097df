from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import at, hours, one, rows
from stationflow.operators import audits, inventory, profiles, weather
from stationflow.operators.canonical import DataRuleError

DEMAND = "time timestamp, station string, departures bigint, arrivals bigint"


def demand(spark, data):
    return profiles.with_measures(spark.createDataFrame(data, DEMAND))


def test_coverage_counts_missing_hours(spark):
    t = hours("2022-01-01T00:00:00", 3)
    got = one(audits.station_coverage(demand(spark, [(t[0], "1", 0, 0), (t[2], "1", 1, 0)])))
    assert got["expected_hourly_observations"] == 3 and got["missing_interval_count"] == 1
    assert got["longest_missing_interval_hours"] == 2.0 and got["zero_demand_ratio"] == 0.5


def test_missingness_is_disjoint(spark):
    t = hours("2022-01-01T00:00:00", 2)
    d = demand(spark, [(t[0], "1", 0, 0), (t[0], "2", 0, 0), (t[1], "2", 1, 0)])
    off = spark.createDataFrame([("2",)], "station string")
    got = dict(rows(audits.missingness_classes(d, off, audits.station_coverage(d)), "state", "slots"))
    assert got == {"OBSERVED": 0, "ZERO_DEMAND": 1, "INACTIVE": 2, "MISSING_OR_UNKNOWN": 0}


def test_horizon_support(spark):
    t = hours("2022-01-01T00:00:00", 2)
    got = dict(rows(audits.horizon_support(demand(spark, [(x, "1", 1, 1) for x in t])), "horizon_minutes", "status"))
    assert got == {30: "BLOCKED", 60: "PASS", 120: "BLOCKED"}


def test_delta_statistics_of_one_row_and_ties(spark):
    t = hours("2022-01-01T00:00:00", 8)
    single = one(audits.delta_statistics(demand(spark, [(t[0], "1", 1, 1)])))
    assert single["unique_timestamp_count"] == 1 and single["most_common_delta_hours"] is None
    got = one(audits.delta_statistics(demand(spark, [(t[i], "1", 1, 1) for i in (0, 1, 3, 4, 6)])))
    assert got["most_common_delta_hours"] == 1.0 and got["median_delta_hours"] == 1.5 and got["gaps_gt_1h"] == 2


def test_identity_confidence(spark):
    def ids(*xs):
        return spark.createDataFrame([(x,) for x in xs], "station string")

    sources = {"demand": ids("1", "2"), "snapshot": ids("2"), "master": ids("3")}
    matrix = audits.identity_matrix(sources)
    assert dict(rows(matrix, "station", "identity_confidence")) == {"1": "WEAK", "2": "PARTIAL", "3": "WEAK"}
    assert one(audits.identity_counts(matrix, list(sources)))["demand_without_snapshot"] == 1


def test_range_guard(spark):
    day = datetime(2022, 1, 1, tzinfo=timezone.utc)
    for start, end in ((day.replace(tzinfo=None), day), (day, day)):
        with pytest.raises(ValueError):
            profiles.checked_range(start, end)
    t = hours("2022-01-01T00:00:00", 3)
    d = demand(spark, [(x, "1", 1, 0) for x in t])
    assert profiles.hourly_series(d, day, day + timedelta(hours=2)).count() == 2
    assert profiles.hourly_series(d, day, day + timedelta(days=4000)).count() == 3


def test_weather_is_aligned_and_matched(spark):
    week = timedelta(days=7)
    t = [at("2022-01-04T10:00:00") + i * week for i in range(5)]
    network = spark.createDataFrame([(x, 5 if i == 4 else 10) for i, x in enumerate(t)], "time timestamp, departures bigint")
    rain = spark.createDataFrame(
        [(x + timedelta(hours=1), 1.0 if i == 4 else 0.0, 8.0) for i, x in enumerate(t)],
        "time timestamp, rain double, temperature_2m double",
    )
    joined = weather.join_weather(network, rain, "UTC").withColumn("month", F.lit(1))
    classes, effect = one(weather.rain_classes(joined)), one(weather.matched_rain_effect(joined))
    assert classes["joined_hours"] == 5 and classes["rainy_hours"] == 1
    assert classes["raw_change_pct"] == pytest.approx(-50) and effect["adjusted_change_pct"] == pytest.approx(-50)
    weather.assert_comparable(joined)
    with pytest.raises(DataRuleError):
        weather.assert_comparable(joined.where("wet"))
    with pytest.raises(DataRuleError):
        weather.assert_unique_hours(network.union(network))


def rain_month(spark):
    """Rain falls in the busy hour, so raw and matched effects have opposite signs."""
    data = []
    for day in range(6):
        for hour in (1, 12):
            wet = (hour == 12 and day in (0, 1)) or (hour == 1 and day == 0)
            busy = 100 if hour == 12 else 5
            data.append((at(f"2022-03-{7 + day % 5 + 7 * (day // 5):02d}T{hour:02d}:00:00"), 0.2 if wet else 0.0, busy * (0.8 if wet else 1.0)))
    return spark.createDataFrame(data, "time timestamp, rain double, departures double").withColumns(
        {
            "temperature_2m": F.lit(5.0),
            "month": F.month("time"),
            "hour": F.hour("time"),
            "weekend": F.weekday("time") >= 5,
            "wet": F.col("rain") >= 0.1,
            "date": F.date_format("time", "yyyy-MM-dd"),
        }
    )


def test_monthly_diagnostics_reverse_the_raw_effect(spark):
    hours_ = rain_month(spark)
    month = one(weather.monthly_diagnostics(hours_))
    assert month["raw_change_pct"] > 0 and month["adjusted_change_pct"] == pytest.approx(-20)
    left = one(weather.leave_one_day_out(hours_))
    assert left["leave_one_day_out_min"] == pytest.approx(-20) and left["leave_one_day_out_max"] == pytest.approx(-20)
    levels = {r["threshold_mm"]: r for r in weather.threshold_sensitivity(hours_).collect()}
    assert levels[0.1]["hours"] == 3 and levels[0.5]["hours"] == 0 and levels[0.5]["adjusted_change_pct"] is None


def test_weather_completeness(spark):
    full = spark.createDataFrame(
        [(x, 1.0, 0.0, 0.0, 2.0) for x in hours("2022-01-01T00:00:00", 8760)],
        "time timestamp, temperature_2m double, precipitation double, rain double, wind_speed_10m double",
    )
    weather.assert_complete_weather(full, 2022)
    for broken in (
        full.where(F.col("time") != F.lit(at("2022-05-05T05:00:00"))),
        full.withColumn("rain", F.when(F.hour("time") != 3, F.col("rain"))),
        full.withColumn("rain", F.lit(-1.0)),
    ):
        with pytest.raises(DataRuleError):
            weather.assert_complete_weather(broken, 2022)


SAMPLE = "station string, time timestamp, bikes double, capacity double, active double, unavailable double, name string, ordinal int"


def test_inventory_diagnostics(spark):
    t = hours("2022-01-01T02:00:00", 8)
    data = [
        ("1", t[0], 0.0, 10.0, 1.0, 0.0, "A", 0),
        ("1", t[1], 0.0, 10.0, 0.0, 0.0, "A", 1),
        ("1", t[5], 10.0, 10.0, None, None, "A", 2),
        ("1", t[6], 11.0, 10.0, 1.0, 0.0, "A", 3),
        ("1", t[7], 3.0, 10.0, 1.0, 0.0, "A", 4),
        ("1", t[7], 4.0, 10.0, 1.0, 0.0, "A", 5),
    ]
    fields = ("bikes", "capacity", "active", "unavailable")
    unique = inventory.unique_samples(spark.createDataFrame(data, SAMPLE), fields, ["ordinal"], null_is_value=True)
    assert one(inventory.conflict_counts(unique))["conflicting_keys"] == 1
    states = inventory.valid_states(unique)
    summary = {(r["level"], r["period"], r["service"], r["hour"]): r for r in inventory.extreme_summary(states).collect()}
    everything = summary[("all", None, None, None)]
    assert (everything["samples"], everything["empty"], everything["full"]) == (3, 2, 1)
    assert summary[("service", None, "Unknown flags", None)]["full"] == 1
    station = one(inventory.station_extremes(states))
    assert station["empty_night"] == 2 and station["empty_flagged"] == 1


def test_null_is_a_value_only_when_asked(spark):
    t = at("2022-01-01T02:00:00")
    data = [("1", t, 1.0, 10.0, 1.0, 0.0, "A", 0), ("1", t, 1.0, 10.0, None, 0.0, "A", 1)]
    df = spark.createDataFrame(data, SAMPLE)
    fields = ("bikes", "capacity", "active", "unavailable")
    assert not one(inventory.unique_samples(df, fields, ["ordinal"]))["conflict"]
    assert one(inventory.unique_samples(df, fields, ["ordinal"], null_is_value=True))["conflict"]


def test_histogram_uses_the_edges_themselves(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.7, 1.0, None)], "ratio double")
    got = {r["bin"]: r["count"] for r in inventory.occupancy_histogram(df).collect()}
    assert len(got) == 10 and sum(got.values()) == 5
    assert (got[0], got[2], got[5], got[6], got[9]) == (1, 1, 1, 1, 1)
