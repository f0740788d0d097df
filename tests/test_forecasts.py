from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import ZONE, at, hours, one, rows
from stationflow.operators import dataset, features, metrics, models, sequences, splits
from stationflow.operators.canonical import DataRuleError

START = "2022-01-03T00:00:00"


def panel(spark, n=210, skip=()):
    data = [(t, "1", i) for i, t in enumerate(hours(START, n)) if i not in skip]
    return spark.createDataFrame(data, "time timestamp, station string, departures bigint")


def table(df, horizon=1):
    return features.feature_table(df, horizon, ZONE)


def test_features_use_exact_hours(spark):
    first = one(table(panel(spark)).orderBy("target").limit(1))
    assert (first["y"], first["recent"], first["previous"], first["day"], first["week"]) == (169, 167, 166, 145, 1)
    assert (first["mean_24h"], first["mean_7d"]) == (155.5, 83.5)
    assert first["movements_24h"] == sum(range(144, 168))
    assert first["issue"] == first["target"] - timedelta(hours=1)


def test_a_missing_hour_removes_rows_instead_of_shifting(spark):
    targets = {r["y"] for r in table(panel(spark, skip={167})).collect()}
    assert 169 not in targets
    assert 167 not in {r["recent"] for r in table(panel(spark, skip={167})).collect()}


def test_the_future_never_changes_features(spark):
    base = panel(spark)
    changed = base.withColumn(
        "departures", F.when(F.col("time") >= F.lit(at(START) + timedelta(hours=200)), 999).otherwise(F.col("departures"))
    )
    columns = [c for c in table(base).columns if c != "y"]
    known = F.col("issue") <= F.lit(at(START) + timedelta(hours=199))
    before, after = (rows(table(df).where(known), *columns) for df in (base, changed))
    assert before == after and before


def test_dense_panel_fills_only_covered_hours(spark):
    t = hours(START, 4)
    demand = spark.createDataFrame(
        [(t[0], "a", 1, 0), (t[0], "b", 1, 2), (t[2], "b", 0, 3), (t[3], "a", 2, 0)],
        "time timestamp, station string, departures bigint, arrivals bigint",
    )
    got = rows(features.dense_panel(demand, demand), "time", "station", "departures", "arrivals")
    text = [x.strftime("%Y-%m-%d %H:%M:%S") for x in t]
    assert got == [(text[0], "a", 1, 0), (text[0], "b", 1, 2), (text[3], "a", 2, 0), (text[3], "b", 0, 0)]


def gold(spark, n=20, start="2024-05-01T00:00:00", skip=()):
    data = [(t, "007", i) for i, t in enumerate(hours(start, n)) if i not in skip]
    df = spark.createDataFrame(data, "time timestamp, station string, departures bigint")
    return dataset.scoped_demand(df, "Demo", "core")


def test_dataset_targets_lags_and_split(spark):
    built = dataset.observation_dataset(gold(spark), 60, ZONE)
    by_hour = {r["demand_at_feature_time"]: r for r in built.collect()}
    assert by_hour[0]["target_departures"] == 1 and by_hour[0]["station_instance_id"] == "demo:core:7"
    assert by_hour[2]["demand_lag_1h"] == 1 and by_hour[2]["demand_lag_1h_available"]
    assert by_hour[2]["demand_lag_6h"] is None and not by_hour[2]["demand_lag_6h_available"]
    assert one(dataset.unobserved_targets(gold(spark), 60))["target_unobserved_rows"] == 1
    ends = {}
    for r in built.collect():
        ends[r["split"]] = max(ends.get(r["split"], r["target_timestamp"]), r["target_timestamp"])
        assert r["target_timestamp"] > r["feature_timestamp"]
    bounds = one(splits.split_boundaries(built, "feature_timestamp"))
    assert set(ends) == {"train", "validation", "test"} and bounds["train_start"] < bounds["test_end"]
    with pytest.raises(ValueError):
        dataset.observation_dataset(gold(spark), 30, ZONE)


def test_dataset_calendar_around_clock_changes(spark):
    built = dataset.with_targets_and_lags(gold(spark, 3, "2024-10-27T00:00:00"), 60)
    from stationflow.functions.clocks import local_calendar

    c = local_calendar(F.col("feature_timestamp"), ZONE)
    got = rows(built.select(c["local_hour"], c["dst_fold"], c["utc_offset_minutes"]))
    assert got == [(2, 0, 120), (2, 1, 60), (3, 0, 60)]


def test_validation_counts_broken_rows(spark):
    base = gold(spark, 40)
    built = dataset.observation_dataset(base, 60, ZONE)
    assert one(dataset.validate_dataset(built, base, 60))["status"] == "PASS"
    wrong = built.withColumn("demand_lag_2h", F.lit(5.0)).withColumn("horizon_minutes", F.lit(90))
    got = one(dataset.validate_dataset(wrong, base, 60))
    n = built.count()
    assert got["status"] == "BLOCKED" and got["horizon"] == n
    assert got["demand_lag_2h_availability"] == 2 and got["demand_lag_2h_mismatch"] >= n - 3


def test_leakage_guard(spark):
    built = dataset.observation_dataset(gold(spark), 60, ZONE)
    columns = dataset.model_feature_columns(built.columns)
    assert "target_departures" not in columns and "split" not in columns and "demand_lag_24h" in columns
    dataset.assert_no_leakage(built, columns)
    with pytest.raises(DataRuleError):
        dataset.assert_no_leakage(built, [*columns, "net_flow"])
    with pytest.raises(DataRuleError):
        dataset.assert_no_leakage(built.withColumn("target_timestamp", F.col("feature_timestamp")), columns)


def test_metrics_use_sse_over_sst(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (5.0, None)], "y_true double, y_pred double")
    got = one(metrics.score(df))
    assert got["mae"] == pytest.approx(0.5) and got["n_predictions"] == 3 and got["coverage"] == 0.75
    assert got["r2"] == pytest.approx(1 - 1.25 / (14 / 3))
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y_true double, y_pred double")
    assert one(metrics.score(flat))["r2"] is None


def population(spark):
    t = hours("2024-01-01T00:00:00", 4)
    data = [
        ("a", t[0], 60, "test", 1.0, 1.0, 1.0, 1.0),
        ("a", t[1], 60, "test", 2.0, None, 1.0, 1.0),
        ("a", t[2], 60, "test", 3.0, 1.0, None, 1.0),
        ("a", t[3], 60, "test", None, 1.0, 1.0, 1.0),
    ]
    ds = spark.createDataFrame(
        data,
        "station_id string, feature_timestamp timestamp, horizon_minutes int, split string, target_departures double,"
        " demand_lag_1h double, demand_lag_24h double, demand_lag_168h double",
    )
    predictions = ds.where("target_departures is not null").select(
        "station_id", "feature_timestamp", "horizon_minutes", "split",
        F.col("target_departures").alias("y_true"), F.lit(2.0).alias("y_pred"),
    )
    return ds, predictions


def test_common_population_is_shared_by_all_models(spark):
    ds, predictions = population(spark)
    keys = ["station_id", "feature_timestamp"]
    wide = metrics.wide_population(ds, predictions, 60, "model", keys)
    got = {r["model"]: r for r in metrics.common_population(wide, ["model", *metrics.BASELINES]).collect()}
    assert {r["common_population_rows"] for r in got.values()} == {1}
    assert {m: r["rows_excluded"] for m, r in got.items()} == {"model": 0, "naive_1h": 1, "seasonal_naive_24h": 1, "seasonal_naive_168h": 0}
    assert got["model"]["mae"] == 1.0 and got["naive_1h"]["mae"] == 0.0
    labels = one(metrics.label_reconciliation(ds, predictions, keys))
    assert labels == {"matched_rows": 3, "unknown_prediction_keys": 0, "label_mismatches": 0}


CANDIDATE = "model string, validation_mae double, complexity_tier int, model_bytes bigint"


def chosen(spark, data):
    return one(metrics.select_model(spark.createDataFrame(data, CANDIDATE)))["selected_model"]


def test_selection_prefers_the_simplest_within_tolerance(spark):
    linear, boost, tree = ("linear", 1.009, 1, 50), ("boost", 1.0, 3, 9), ("tree", 1.011, 2, 1)
    assert chosen(spark, [boost, linear]) == chosen(spark, [linear, boost]) == "linear"
    assert chosen(spark, [boost, tree]) == "boost"
    assert chosen(spark, [("big", 1.0, 3, 9), ("small", 1.005, 3, 2)]) == "small"
    for bad in (float("nan"), float("inf"), -1.0, None):
        with pytest.raises(DataRuleError):
            metrics.assert_candidates(spark.createDataFrame([("x", bad, 1, 1)], CANDIDATE))


def test_run_comparison(spark):
    df = spark.createDataFrame([("m", "a", 1.0, 2.0), ("m", "b", 3.0, 2.0)], "model string, k string, y_true double, y_pred double")
    assert one(metrics.compare_runs(df, df.orderBy(F.desc("k")), ["k"]))["status"] == "PASS"
    assert one(metrics.compare_runs(df, df.withColumn("y_pred", F.col("y_pred") + 1), ["k"]))["status"] == "BLOCKED"
    swapped = df.withColumn("k", F.translate("k", "ab", "ba"))
    got = one(metrics.compare_runs(df, swapped, ["k"]))
    assert got["metrics_equal"] and not got["predictions_equal"]


def test_gates(spark):
    gates = spark.createDataFrame([("a", "PASS"), ("b", "blocked")], "gate string, status string")
    got = one(metrics.gate_rollup(gates, ["a", "c"]))
    assert got == {"passed": 1, "blocking_gates": "b", "missing_gates": "c", "status": "BLOCKED"}
    assert one(metrics.gate_rollup(gates.where("gate = 'a'"), ["a"]))["status"] == "PASS"


@pytest.fixture(scope="module")
def split(spark):
    t = hours("2024-01-01T00:00:00", 24 * 30)
    data = [(x, s, (i * k + i // 24) % 7) for k, s in ((3, "a"), (5, "b")) for i, x in enumerate(t)]
    df = spark.createDataFrame(data, "time timestamp, station string, departures bigint")
    labelled = splits.fixed_date_split(table(df), 1, "2024-01-18", "2024-01-25").cache()
    splits.check_partitions(labelled)
    return labelled


@pytest.mark.parametrize("kind", ["ridge", "tree", "poisson", "boosting"])
def test_models_predict_finite_nonnegative_values_also_for_unseen_stations(split, kind):
    candidate = next(c for c in models.FITTED_CANDIDATES if c.kind == kind)
    model = models.fit(candidate, split)
    unseen = split.where("split = 'test'").withColumn("station", F.lit("new"))
    scored = models.predict(model, unseen)
    assert scored.count() == unseen.count()
    assert scored.where("prediction < 0 or prediction is null").count() == 0


def test_comparison_selects_on_validation_only(split):
    simple = [*models.BASELINE_CANDIDATES, next(c for c in models.FITTED_CANDIDATES if c.kind == "ridge")]
    got = models.comparison(split, simple).collect()
    assert len(got) == 4 and got[0]["selected"] and sum(r["selected"] for r in got) == 1
    best = min(r["validation_mae"] for r in got)
    assert got[0]["validation_mae"] <= best * 1.01 + 1e-12


def test_small_partitions_are_refused(split):
    with pytest.raises(ValueError):
        splits.check_partitions(split.where("split <> 'test'"))


def test_held_out_scores_of_the_naive_forecasts(spark):
    t = hours("2024-01-01T00:00:00", 10)
    schema = "station string, time timestamp, y double"
    history = spark.createDataFrame([("a", x, v) for x, v in zip(t, (9.0, 1.0, 2.0, 3.0))] + [("b", t[0], 4.0), ("c", t[0], -5.0)], schema)
    actual = spark.createDataFrame([("a", t[4 + k], v) for k, v in enumerate((1.0, 2.0, 4.0, 3.0))] + [("b", t[5], 4.0), ("b", t[6], 4.0)], schema)
    got = {r["station"]: r.asDict() for r in sequences.held_out_scores(actual, history, "station", "time", "y", 3).collect()}
    # naive: 3 throughout; seasonal: 1, 2, 3, then 3 again
    assert got["a"] == pytest.approx({
        "station": "a", "naive_mae": 1.0, "naive_rmse": 1.5**0.5, "naive_r2": -0.2,
        "seasonal_naive_mae": 0.25, "seasonal_naive_rmse": 0.5, "seasonal_naive_r2": 0.8,
    })
    assert got["b"]["naive_mae"] == 0.0 and got["b"]["naive_r2"] is None and got["b"]["seasonal_naive_mae"] is None
    assert got.keys() == {"a", "b"}
    plain = one(sequences.held_out_scores(actual.where("station = 'a'"), history, "station", "time", "y"))
    assert plain["naive_mae"] == 1.0 and plain["seasonal_naive_mae"] is None
    with pytest.raises(Exception, match="training history"):
        sequences.held_out_scores(actual, history.where("station = 'b'"), "station", "time", "y").collect()
