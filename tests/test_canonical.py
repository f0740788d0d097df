import pytest
from pyspark.sql import functions as F

from helpers import at, one, rows
from stationflow.operators import canonical

T = at("2021-10-30T17:00:00")
SCHEMA = "time timestamp, station string, departures bigint, arrivals bigint, source_year int"


def demand(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_spellings_of_a_station_collapse(spark):
    source = demand(spark, [(T, "00225", 1, 2, 2021), (T, "225", 1, 0, 2020)])
    assert one(canonical.contribution_duplicates(source))["repeated_keys"] == 1
    got = one(canonical.canonical_demand(source, " Demo "))
    assert got["provider"] == "demo" and got["station_id"] == "225" and got["source_year"] == 2020
    assert (got["departures"], got["arrivals"], got["total_activity"], got["net_flow"], got["demand"]) == (2, 2, 4, 0, 2)


def test_bad_rows_are_rejected(spark):
    good = canonical.canonical_demand(demand(spark, [(T, "1", 1, 2, 2021)]), "demo")
    assert canonical.assert_canonical(good) is good
    for broken in (
        good.withColumn("departures", F.lit(-1)),
        good.withColumn("station_id", F.lit("")),
        good.withColumn("net_flow", F.lit(None).cast("bigint")),
        good.union(good),
    ):
        with pytest.raises(canonical.DataRuleError):
            canonical.assert_canonical(broken)


def test_digest_ignores_row_order_but_not_content(spark):
    data = [(T, str(i), i, 0, 2021) for i in range(50)]
    columns = ["station", "departures"]
    first = one(canonical.content_digest(demand(spark, data), columns))
    assert first == one(canonical.content_digest(demand(spark, data[::-1]).repartition(7), columns))
    assert first != one(canonical.content_digest(demand(spark, data[:-1] + data[:1]), columns))
    assert first != one(canonical.content_digest(demand(spark, data + data[:1]), columns))


def test_quality_report_status(spark):
    def status(data):
        df = spark.createDataFrame(data, "timestamp string, demand double")
        return one(canonical.quality_report(df, "timestamp", "demand"))["status"]

    assert status([]) == "FAIL"
    assert status([("2022-01-01 00:00:00", 1.0)]) == "PASS"
    assert status([("2022-01-01 00:00:00", None)]) == "WARN"
    assert status([("2022-01-01 00:00:00", -1.0)] * 2) == "WARN"
    assert status([("bad", 1.0)] * 12) == "FAIL"


def test_store_comparison_is_null_safe(spark):
    left = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, v int")
    right = spark.createDataFrame([(1, None), (2, None), (4, 1)], "k int, v int")
    got = one(canonical.compare_stores(left, right, ["k"], ["v"]))
    assert got == {"left_only": 1, "right_only": 1, "common": 2, "v_differs": 1}
    assert rows(canonical.one_sided_keys(left, right, ["k"])) == [(3, "left_only"), (4, "right_only")]


def test_offending_rows_name_their_rules(spark):
    good = canonical.canonical_demand(demand(spark, [(T, "1", 1, 2, 2021), (T, "2", 1, 2, 2021)]), "demo")
    bad = good.withColumn("demand", F.when(F.col("station_id") == "1", 9).otherwise(F.col("demand")))
    assert rows(canonical.offending_rows(bad, canonical.canonical_rules()), "station_id", "broken_rules") == [("1", ["demand"])]


def test_digest_tells_fields_and_nulls_apart(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("", "")]
    digests = [
        one(canonical.content_digest(spark.createDataFrame([p], "x string, y string"), ["x", "y"]))["digest"] for p in pairs
    ]
    assert len(set(digests)) == len(pairs)
