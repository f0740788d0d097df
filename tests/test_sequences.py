import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, one, rows
from stationflow.operators import sequences, splits

SAMPLES = "station string, time timestamp, event boolean"


def brute_runs(samples, limit=90):
    runs, last = [], {}
    for station, time, event in sorted(samples):
        before = last.get(station)
        gap = (time - before[0]).total_seconds() / 60 if before else None
        if event:
            if before and before[1] and 0 < gap <= limit:
                runs[before[2]][2:] = [time, runs[before[2]][3] + 1]
                index = before[2]
            else:
                runs.append([station, time, time, 1])
                index = len(runs) - 1
            last[station] = (time, True, index)
        else:
            last[station] = (time, False, None)
    return sorted((s, a, b, n) for s, a, b, n in runs)


def found_runs(df):
    from helpers import UTC

    return sorted((r["station"], r["start"].astimezone(UTC), r["end"].astimezone(UTC), r["samples"]) for r in df.collect())


def test_runs_break_at_gaps_and_other_samples(spark):
    day = "2022-01-01T0{}:00:00"
    data = [("1", at(day.format(h)), h != 5) for h in (0, 1, 4, 5, 6)] + [("2", at(day.format(6)), True)]
    runs = sequences.event_runs(spark.createDataFrame(data, SAMPLES), "event")
    got = rows(runs, "station", "start", "samples", "span_minutes")
    assert [r[2:] for r in got] == [(2, 60.0), (1, 0.0), (1, 0.0), (1, 0.0)]
    summary = one(sequences.run_summary(runs))
    assert summary["runs"] == 4 and summary["singleton_runs"] == 3 and summary["observed_span_hours"] == 1.0


@pytest.mark.parametrize("bucket", [0.1, 1, 2, 24])
def test_runs_equal_a_scan_on_a_hot_station(spark, bucket):
    rng = random.Random(7)
    data, clock = [], at("2022-01-01T00:00:00")
    for _ in range(1500):
        clock += timedelta(minutes=rng.choice([5, 30, 89, 90, 91, 400]))
        data.append(("hot", clock, rng.random() < 0.8))
    data += [(str(i % 5), at("2022-01-03T00:00:00") + timedelta(minutes=17 * i), i % 4 != 0) for i in range(300)]
    df = spark.createDataFrame(data, SAMPLES)
    assert found_runs(sequences.event_runs(df, "event", bucket_hours=bucket)) == brute_runs(data)


def test_bucket_must_have_a_length(spark):
    with pytest.raises(ValueError):
        sequences.event_runs(spark.createDataFrame([], SAMPLES), "event", bucket_hours=0)


def test_previous_row_crosses_empty_buckets(spark):
    times = [at(f"2022-01-{d:02d}T{h:02d}:00:00") for d, h in ((1, 1), (1, 2), (4, 0), (9, 5))]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", times[2])], "station string, time timestamp")
    got = rows(sequences.gap_minutes(df, "station", "time"), "station", "gap_minutes")
    assert [x for x in got if x[0] == "a"] == sorted([("a", None), ("a", 60.0), ("a", 4200.0), ("a", 7500.0)], key=str)
    assert ("b", None) in got


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    data = [rng.choice([rng.random() * 500, 7.0, -30.5]) for _ in range(999)]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.951, "e": 1.0}
    got = one(sequences.exact_quantiles(df, "v", wanted))
    expected = df.select(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in wanted.items()]).first().asDict()
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("values", [
    [-1e300, -2.5, -2.4999999, -1e-300, 0.0, -0.0, 1e-320, 3.0, 1e300],
    [1.7e9 + k for k in range(300)],
    [5.0] * 400,
    [float(k % 7 - 3) for k in range(1001)],
])
def test_quantiles_of_any_magnitude_per_key(spark, values):
    data = [("a", v) for v in values] + [("b", -v) for v in values[:5]] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    also = {"n": F.sum("_n"), "top": F.max("_v")}
    got = {r["k"]: r.asDict() for r in sequences.exact_quantiles(df, "v", wanted, ["k"], also).collect()}
    assert got.keys() == {"a", "b"}
    for key, row in got.items():
        own = [v for k, v in data if k == key]
        for name, p in wanted.items():
            at = p * (len(own) - 1)
            low, high = (sorted(own)[int(r)] for r in (at // 1, -(-at // 1)))
            assert row[name] == low + (high - low) * (at - at // 1)
        assert (row["n"], row["top"]) == (len(own), max(own))


def test_value_buckets_never_fall(spark):
    pick = random.Random(8)
    values = sorted(pick.choice([-1, 1]) * 2 ** pick.uniform(-1070, 1020) for _ in range(3000)) + [float("inf")]
    df = spark.createDataFrame([(v,) for v in [float("-inf"), *values]], "v double")
    buckets = [r[0] for r in df.orderBy("v").select(sequences.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 2500


def test_global_rank_is_a_total_order(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "v int")
    ranked = sequences.with_global_rank(df, ["v"], total="n")
    assert all(r["rank"] == r["v"] + 1 and r["n"] == 1000 for r in ranked.collect())


def test_ranks_stay_balanced_with_one_common_prefix(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sequences, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    df = spark.range(20_000, numPartitions=5).select(F.format_string("station-of-madrid-%05d", F.col("id")).alias("s"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ranked = sequences.with_global_rank(df, ["s"])
        assert ranked.where("rank <> cast(right(s, 5) AS bigint) + 1").count() == 0
        stored = spark.read.parquet(str(tmp_path / "ranked"))
        rows_of = stored.select(F.input_file_name().alias("f")).groupBy("f").count()  # one file per range
        sizes = [r["count"] for r in rows_of.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4


def test_ranks_of_an_empty_table(spark):
    assert sequences.with_global_rank(spark.createDataFrame([], "v int"), ["v"], total="n").count() == 0


def test_one_row_per_key_is_ordered(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert rows(sequences.one_row_per_key(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, None)]
    assert rows(sequences.one_row_per_key(df, ["k"], ["o"], keep="last")) == [("a", 2, "x"), ("b", 5, None)]


def test_lags_stay_inside_their_group(spark):
    t = [at(f"2022-01-01T0{h}:00:00") for h in range(3)]
    df = spark.createDataFrame([("a", t[0], 1), ("a", t[1], 2), ("b", t[2], 3)], "s string, time timestamp, v int")
    assert rows(sequences.row_offset_lags(df, "v", "s", "time", [1]), "v", "v_lag_1") == [(1, None), (2, 1), (3, None)]
    with pytest.raises(ValueError):
        sequences.row_offset_lags(df, "v", "s", "time", [0])


def test_seasonal_naive(spark):
    t = [at(f"2022-01-01T0{h}:00:00") for h in range(5)]
    df = spark.createDataFrame([("a", x, v) for x, v in zip(t, (9.0, -1.0, 2.0, 3.0))] + [("b", t[0], 4.0)], "s string, time timestamp, v double")
    got = rows(sequences.seasonal_naive_forecast(df, "s", "time", "v", 4, 3))
    assert [x for x in got if x[0] == "a"] == [("a", 1, 0.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 3.0)]
    assert [x[2] for x in got if x[0] == "b"] == [4.0] * 4
    short = rows(sequences.seasonal_naive_forecast(df, "s", "time", "v", 1, 3))
    assert short == [("a", 1, 0.0), ("b", 1, 4.0)]


def test_row_fraction_split(spark):
    df = spark.createDataFrame([(at("2022-01-01T00:00:00") + timedelta(hours=30 * i),) for i in range(10)], "time timestamp")
    got = rows(splits.row_fraction_split(splits.check_series(df)).groupBy("split").count())
    assert got == [("test", 2), ("train", 6), ("validation", 2)]
    with pytest.raises(ValueError):
        splits.check_series(df.union(df.limit(1)))
    with pytest.raises(Exception, match="times must be known"):
        splits.row_fraction_split(df.union(df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))).count()


def test_segments_break_at_missing_hours(spark):
    t = [at(f"2022-01-01T{h:02d}:00:00") for h in (0, 1, 3, 4, 7)]
    df = spark.createDataFrame([("a", x) for x in t], "s string, time timestamp")
    assert [x[1] for x in rows(sequences.contiguous_segments(df, "s", "time"), "time", "segment")] == [0, 0, 1, 1, 2]
    assert sequences.contiguous_segments(df, "s", "time", last=2).count() == 2
