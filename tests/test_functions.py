from pyspark.sql import functions as F

from helpers import ZONE, at, rows
from stationflow.functions import clocks, identifiers, measures


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values(spark, data, expression, kind="string"):
    df = column(spark, data, kind).withColumn("i", F.monotonically_increasing_id())
    return [r["v"] for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def utc(expression):
    return lambda x: clocks.utc_text(expression(x))


def test_strict_clock_rejects_repeated_and_skipped_times(spark):
    got = values(
        spark,
        ["2022-10-30T02:30", "2022-03-27T02:30", "2022-07-01T12:00", "2022-03-27 03:00", "bad", None, "12:30"],
        utc(lambda x: clocks.strict_utc(x, ZONE)),
    )
    assert got == [None, None, "2022-07-01T10:00:00Z", "2022-03-27T01:00:00Z", None, None, None]


def test_staged_and_plain_strict_clocks_agree(spark):
    data = ["2022-10-30T02:30", "2022-03-27T02:30", "2022-07-01T12:00", "2022-07-01T12:00:00+02:00", "bad", None]
    df = clocks.with_strict_utc(column(spark, data), {"a": "x"}, ZONE).withColumn("b", clocks.strict_utc(F.col("x"), ZONE))
    assert df.columns == ["x", "a", "b"]
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_strict_clock_with_offset_is_an_instant(spark):
    got = values(
        spark,
        ["2022-11-06T01:30", "2022-11-06T01:30:00-04:00", "2022-07-01T12:00", "2022-07-01 12:00:00+0200", "2022-07-01T12:00:00Z"],
        utc(lambda x: clocks.strict_utc(x, "America/New_York")),
    )
    assert got == [None, "2022-11-06T05:30:00Z", "2022-07-01T16:00:00Z", "2022-07-01T10:00:00Z", "2022-07-01T12:00:00Z"]


def test_lenient_clock_tags_every_resolution(spark):
    data = ["2022-01-01 12:00:00", "2022-10-30 02:21:53", "2022-03-27 02:21:53", "garbage", "2022-01-01T12:00:00+02:00", "", None]
    df = clocks.with_lenient_utc(column(spark, data), {"c": "x"}, ZONE)
    got = {r["x"]: (r["t"], r["g"]) for r in df.select("x", clocks.utc_text(F.col("c")).alias("t"), F.col("c_resolution").alias("g")).collect()}
    assert got["2022-01-01 12:00:00"] == ("2022-01-01T11:00:00Z", "normal_local_time")
    assert got["2022-10-30 02:21:53"] == ("2022-10-30T01:21:53Z", "ambiguous_standard_time")
    assert got["2022-03-27 02:21:53"] == ("2022-03-27T01:21:53Z", "nonexistent_shifted_forward")
    assert got["garbage"] == (None, "invalid")
    assert got["2022-01-01T12:00:00+02:00"] == ("2022-01-01T10:00:00Z", "already_timezone_aware")
    assert got[""] == (None, "missing") and got[None] == (None, "missing")


def test_local_calendar_keeps_both_fall_back_hours(spark):
    instants = [at("2024-10-27T00:30:00"), at("2024-10-27T01:30:00"), at("2024-01-10T08:00:00")]
    df = column(spark, instants, "timestamp")
    c = clocks.local_calendar(F.col("x"), ZONE)
    got = rows(df.select("x", c["local_hour"].alias("h"), c["dst_fold"].alias("f"), c["utc_offset_minutes"].alias("o"), c["local_weekday"].alias("w")))
    assert got == [
        ("2024-01-10 08:00:00", 9, 0, 60, 2),
        ("2024-10-27 00:30:00", 2, 0, 120, 6),
        ("2024-10-27 01:30:00", 2, 1, 60, 6),
    ]
    assert len(c) == 14


def test_snapshot_period(spark):
    got = values(
        spark,
        ["2018-07", "2018-07-05", "2018-07-05T10:00:00", '{"$date": "2019-02-03T00:00:00Z"}', "what", None],
        lambda x: clocks.snapshot_period(x, F.lit(2018)),
    )
    assert got == ["2018-07", "2018-07", "2018-07", "2019-02", "2018-01", None]


def test_station_identifiers(spark):
    assert values(spark, ["12", "12.0", "0", "-3", "1.5", "x", None, "nan"], lambda x: identifiers.positive_station(x)) == [12, 12, None, None, None, None, None, None]
    assert values(spark, ["00225", " 7 ", "shared/01", "nan", "", None, "000"], lambda x: identifiers.normalized_station(x)) == ["225", "7", "shared/01", "", "", "", "0"]
    assert values(spark, ["225.0", " 7 ", "shared/01"], lambda x: identifiers.station_without_decimal(x)) == ["225", "7", "shared/01"]
    assert identifiers.normalized_header("﻿ Unlock_Date ") == "unlockdate"


def test_locale_numbers_and_points(spark):
    assert values(spark, ["-3.703", "40,42", "1.234,5", "x", None], lambda x: measures.locale_number(x)) == [-3.703, 40.42, 1234.5, None, None]
    point = measures.point_text(F.col("x"))
    df = column(spark, ["{'type': 'Point', 'coordinates': [-3.7, 40.4]}", "nothing"])
    assert rows(df.select(point["longitude"], point["latitude"])) == [(-3.7, 40.4), (None, None)]
    flat = measures.lon_lat_text(F.col("x"))
    df = column(spark, ["-3,70 40,4", "-3.7"])
    assert rows(df.select(flat["longitude"], flat["latitude"])) == [(-3.7, 40.4), (None, None)]


def test_clip_and_percent_change(spark):
    assert values(spark, [-1.0, 2.0, None], measures.clip_zero, "double") == [0.0, 2.0, None]
    assert values(spark, [0.0, 4.0, None], lambda x: measures.percent_change(F.lit(5.0), x), "double") == [None, 25.0, None]


def test_service_state_needs_known_flags(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (None, 0.0), (None, 1.0), (1.0, None)], "a double, u double")
    got = [r[0] for r in df.select(measures.service_state(F.col("a"), F.col("u"))).collect()]
    assert got == [measures.FLAGGED_ON, measures.FLAGGED_OFF, measures.FLAGGED_OFF, measures.UNKNOWN_FLAGS, measures.FLAGGED_OFF, measures.UNKNOWN_FLAGS]


def test_composite_key_round_trip(spark):
    df = spark.createDataFrame([("a/b", "c:d")], "p string, q string")
    key = identifiers.row_key(F.col("p"), F.col("q"))
    assert rows(df.select(*identifiers.split_row_key(key, ["x", "y"]))) == [("a/b", "c:d")]
    assert rows(df.select(identifiers.station_instance(F.lit("p"), F.lit("n"), F.col("p")))) == [("p:n:a/b",)]


def test_station_codes_follow_text_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",), ("b",), ("10",)], "station string")
    got = dict(rows(identifiers.station_codes(df)))
    assert got == {"10": 0, "100": 1, "9": 2, "b": 3}


def test_row_keys_tell_nulls_and_separators_apart(spark):
    parts = [("t", None, "X"), ("t", "X", None), ("t\u001fX", None, None), ("t", "X", "\u001e1"), ("\u001e2", "", None)]
    df = spark.createDataFrame(parts, "a string, b string, c string")
    keyed = df.select(identifiers.row_key(F.col("a"), F.col("b"), F.col("c")).alias("key"))
    assert keyed.distinct().count() == len(parts)
    back = keyed.select(*identifiers.split_row_key(F.col("key"), ["a", "b", "c"]))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(parts, key=str)


def test_station_numbers_beyond_64_bits_are_null(spark):
    assert values(spark, ["1e300", "7"], lambda x: identifiers.positive_station(x)) == [None, 7]
