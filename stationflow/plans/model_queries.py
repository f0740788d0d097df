"""Datasets, forecasts, metrics, selection, models and streams on the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks
from stationflow.operators import dataset, features, metrics, models, splits, trips
from stationflow.plans.bindings import CTE, ZONE, Tables, local, with_
from stationflow.plans.demand_queries import feature_sql
from stationflow.plans.registry import query, r, ts
from stationflow.session import shared_dir, spread
from stationflow.streaming import queries as streams

_LAG_NAMES = [f"demand_lag_{k}h" for k in dataset.LAGS_HOURS]


def dataset_fragments(minutes: int) -> dict[str, str]:
    def at(hours: int, direction: str) -> str:
        edge = f"INTERVAL {hours} HOUR {direction}"
        return f"first(departures) OVER (PARTITION BY station ORDER BY time RANGE BETWEEN {edge} AND {edge})"

    lags = ", ".join(f"{at(k, 'PRECEDING')} AS demand_lag_{k}h" for k in dataset.LAGS_HOURS)
    return dict(
        candidates=f"SELECT station, time AS ft, time + INTERVAL {minutes} MINUTE AS tt, departures AS now,"
        f" {at(minutes // 60, 'FOLLOWING')} AS target, {lags} FROM demand",
        kept="SELECT * FROM candidates WHERE target IS NOT NULL",
        ranked="SELECT ft, row_number() OVER (ORDER BY ft) - 1 AS i, count(*) OVER () AS n"
        " FROM (SELECT DISTINCT ft FROM kept)",
        cut="SELECT max(CASE WHEN i = greatest(0, floor(n * 0.70::DOUBLE) - 1) THEN ft END) AS train_end,"
        " max(CASE WHEN i = greatest(1, floor(n * 0.85::DOUBLE) - 1) THEN ft END) AS validation_end,"
        " max(ft) AS test_end FROM ranked",
        ds="SELECT kept.*, CASE WHEN ft <= train_end THEN 'train' WHEN ft <= validation_end THEN 'validation'"
        " ELSE 'test' END AS split FROM kept, cut WHERE tt <= CASE WHEN ft <= train_end THEN train_end"
        " WHEN ft <= validation_end THEN validation_end ELSE test_end END",
    )


def _dataset(t: Tables, minutes: int = 60) -> DataFrame:
    return dataset.observation_dataset(t.scoped, minutes, ZONE)


def _dataset_sql(minutes: int) -> str:
    l = "l"
    return (
        with_("demand", **dataset_fragments(minutes), lc=f"SELECT *, {local('ft')} AS l FROM ds")
        + "SELECT station AS station_id, 'demo:core:' || station AS station_instance_id,"
        f" {ts('ft')} AS feature_timestamp, {ts('tt')} AS target_timestamp, now::DOUBLE AS demand_at_feature_time,"
        " target::DOUBLE AS target_departures, "
        + ", ".join(f"{n}::DOUBLE AS {n}, {n} IS NOT NULL AS {n}_available" for n in _LAG_NAMES)
        + f", hour({l}) AS local_hour, (isodow({l}) - 1) AS local_weekday, day({l}) AS day_of_month,"
        f" month({l}) AS month, year({l}) AS year, isodow({l}) >= 6 AS weekend,"
        f" {minutes}::BIGINT AS horizon_minutes, split FROM lc"
    )


_SHOWN_AWAY = (
    "provider_id", "network_id", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin",
    "month_cos", "utc_offset_minutes", "dst_fold",
)


@query("observation_dataset", "I2 D1 D2 B9 F8 C12", _dataset_sql(60))
def _(t: Tables):
    return _dataset(t).drop(*_SHOWN_AWAY)


@query("observation_dataset_two_hours", "I2 D1 D2 B9 F8 C12", _dataset_sql(120))
def _(t: Tables):
    return _dataset(t, 120).drop(*_SHOWN_AWAY)


@query(
    "dataset_report",
    "E38",
    with_("demand", **dataset_fragments(60))
    + "SELECT split, count(*) AS rows, count(DISTINCT station) AS stations, "
    + ", ".join(f"{r(f'count(demand_lag_{k}h) / count(*)')} AS lag_{k}h_share" for k in dataset.LAGS_HOURS)
    + " FROM ds GROUP BY 1",
)
def _(t: Tables):
    return dataset.dataset_report(_dataset(t))


@query(
    "unobserved_targets",
    "E38 D1",
    with_("demand", **dataset_fragments(60))
    + "SELECT count(*) AS candidate_target_rows, count(target) AS target_observed_rows,"
    " count_if(target IS NULL)::BIGINT AS target_unobserved_rows FROM candidates",
)
def _(t: Tables):
    return dataset.unobserved_targets(t.scoped, 60)


def _damaged(rows: DataFrame) -> DataFrame:
    """Wrong lags for one station, wrong targets at noon, missing flags at midnight."""
    station, hour = F.col("station_id"), F.hour("feature_timestamp")
    return rows.withColumns(
        {
            "demand_lag_1h": F.when(station == "error", F.col("demand_lag_1h") + 1).otherwise(F.col("demand_lag_1h")),
            "target_departures": F.when(hour == 12, F.col("target_departures") + 1).otherwise(F.col("target_departures")),
            "demand_lag_24h_available": F.col("demand_lag_24h_available") & (hour != 0),
            "demand_lag_168h_available": F.lit(True),
        }
    )


@query(
    "dataset_validation",
    "C9 D1 D2",
    with_("demand", **dataset_fragments(60))
    + "SELECT *, target_mismatch + demand_lag_1h_mismatch + demand_lag_24h_mismatch + demand_lag_168h_availability"
    " AS total_violations, 'BLOCKED' AS status FROM (SELECT count(*) AS rows_checked, 0::BIGINT AS horizon,"
    " 0::BIGINT AS target_timestamp, 0::BIGINT AS target_after_feature, 0::BIGINT AS target_missing,"
    " count_if(hour(ft) = 12)::BIGINT AS target_mismatch, "
    + ", ".join(
        f"{mismatch}::BIGINT AS demand_lag_{k}h_mismatch, {availability}::BIGINT AS demand_lag_{k}h_availability"
        for k in dataset.LAGS_HOURS
        for mismatch in [
            {
                1: "count_if(station = 'error' AND demand_lag_1h IS NOT NULL)",
                24: "count_if(hour(ft) = 0 AND demand_lag_24h IS NOT NULL)",
            }.get(k, "0")
        ]
        for availability in ["count_if(demand_lag_168h IS NULL)" if k == 168 else "0"]
    )
    + " FROM ds)",
)
def _(t: Tables):
    return dataset.validate_dataset(_damaged(_dataset(t)), t.scoped, 60)


@query(
    "leakage_guard",
    "C11",
    with_("demand", **dataset_fragments(60))
    + "SELECT count(*) AS rows, count_if(target > 2)::BIGINT AS target_not_after_feature, count_if(target > 2 AND coalesce("
    + ", ".join(_LAG_NAMES)
    + ") IS NOT NULL)::BIGINT AS lag_of_late_target FROM ds",
)
def _(t: Tables):
    rows = _dataset(t)
    columns = dataset.model_feature_columns(rows.columns)
    leaking = rows.withColumn(
        "target_timestamp",
        F.when(F.col("target_departures") > 2, F.col("feature_timestamp")).otherwise(F.col("target_timestamp")),
    )
    return dataset.leakage_violations(leaking.select(*columns, "feature_timestamp", "target_timestamp"))


# --- metrics ------------------------------------------------------------------------------------


def metric_sql(y: str, p: str) -> str:
    both = f"{y} IS NOT NULL AND {p} IS NOT NULL"
    return (
        f"{r(f'avg(abs({y} - {p}))')} AS mae, {r(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS rmse,"
        f" CASE WHEN min({y}) FILTER ({both}) < max({y}) FILTER ({both}) THEN"
        f" {r(f'1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) FILTER ({both}) * count(*) FILTER ({both}))')} END AS r2,"
        f" count(*) FILTER ({both}) AS n_predictions"
    )


_MODELS = {"naive_1h": "demand_lag_1h", "seasonal_naive_24h": "demand_lag_24h", "seasonal_naive_168h": "demand_lag_168h"}
_LONG_BASELINES = " UNION ALL ".join(
    f"SELECT split, '{m}' AS model, target AS y, {c} AS p FROM ds" for m, c in _MODELS.items()
)


@query(
    "baseline_metrics",
    "E35 E34",
    with_("demand", **dataset_fragments(60), long=_LONG_BASELINES)
    + f"SELECT split, 60::BIGINT AS horizon_minutes, model, count(y) AS target_rows, {metric_sql('y', 'p')},"
    f" {r('count(p) / count(y)')} AS coverage FROM long GROUP BY split, model",
)
def _(t: Tables):
    return metrics.baseline_metrics(_dataset(t))


@query(
    "missing_lags",
    "E37",
    with_("demand", **dataset_fragments(60))
    + "SELECT split, count(*) AS target_rows, 0::BIGINT AS target_missing_rows, "
    + ", ".join(
        f"count_if({c} IS NULL)::BIGINT AS {m}_missing, count({c}) AS {m}_valid,"
        f" {r(f'count({c}) / count(*)')} AS {m}_coverage"
        for m, c in _MODELS.items()
    )
    + " FROM ds GROUP BY 1",
)
def _(t: Tables):
    return metrics.missing_lags(_dataset(t))


_PREDICTION_KEYS = ["station_id", "feature_timestamp", "target_timestamp", "horizon_minutes", "split"]


def _mean_model(rows: DataFrame) -> DataFrame:
    """A stand-in model: the mean of two lags, unknown where either is missing."""
    mean = (F.col("demand_lag_1h") + F.col("demand_lag_24h")) / 2
    return rows.select(
        *_PREDICTION_KEYS,
        F.col("target_departures").alias("y_true"),
        mean.alias("y_pred"),
        F.lit("mean").alias("model"),
    )


@query(
    "common_population",
    "E36 I12 H3 D10",
    with_(
        "demand",
        **dataset_fragments(60),
        wide="SELECT target AS y, (demand_lag_1h + demand_lag_24h) / 2.0 AS m, demand_lag_1h AS a,"
        " demand_lag_24h AS b, demand_lag_168h AS c FROM ds WHERE split = 'test'",
        long="SELECT y, m IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS common,"
        " unnest(['mean', 'naive_1h', 'seasonal_naive_24h', 'seasonal_naive_168h']) AS model,"
        " unnest([m, a, b, c]) AS p FROM wide",
        scored="SELECT *, CASE WHEN common THEN y END AS yc, CASE WHEN common THEN p END AS pc FROM long",
    )
    + "SELECT model, count(*) AS target_rows, count(p) AS valid_rows, count_if(common)::BIGINT AS"
    f" common_population_rows, {metric_sql('yc', 'pc')}, count(*) - count(p) AS rows_excluded,"
    f" {r('count(p) / count(*)')} AS natural_coverage, {r('count_if(common) / count(*)')} AS coverage,"
    " count(p) = count_if(common) AS same_population,"
    " CASE WHEN count_if(common) > 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM scored GROUP BY 1",
)
def _(t: Tables):
    rows = _dataset(t)
    wide = metrics.wide_population(rows, _mean_model(rows), 60, "mean", _PREDICTION_KEYS[:3])
    return metrics.common_population(wide, ["mean", *metrics.BASELINES])


@query(
    "label_reconciliation",
    "D11",
    with_("demand", **dataset_fragments(60))
    + "SELECT count_if(hour(ft) <> 3)::BIGINT AS matched_rows, count_if(hour(ft) = 3)::BIGINT AS unknown_prediction_keys,"
    " count_if(station = 'view' AND hour(ft) <> 3)::BIGINT AS label_mismatches FROM ds",
)
def _(t: Tables):
    rows = _dataset(t)
    moved = F.when(F.hour("feature_timestamp") == 3, clocks.shift_hours(F.col("feature_timestamp"), 9000))
    predictions = _mean_model(rows).withColumns(
        {
            "y_true": F.when(F.col("station_id") == "view", F.col("y_true") + 1).otherwise(F.col("y_true")),
            "feature_timestamp": F.coalesce(moved, F.col("feature_timestamp")),
        }
    )
    return metrics.label_reconciliation(rows, predictions, ["station_id", "feature_timestamp", "split"])


def _features(t: Tables) -> DataFrame:
    return features.feature_table(t.panel, 1, ZONE)


_BASELINE_LONG = dict(
    long="SELECT station, issue, target, y, unnest(['Last completed hour', 'Same hour yesterday',"
    " 'Same hour last week']) AS model, unnest([recent, day, week]) AS p FROM features"
)


@query(
    "baseline_predictions",
    "I3",
    feature_sql(1)
    + ", " + ", ".join(f"{n} AS ({s})" for n, s in _BASELINE_LONG.items())
    + f" SELECT station, {ts('issue')} AS issue, {ts('target')} AS target, model, y::DOUBLE AS y_true,"
    " p::DOUBLE AS y_pred FROM long",
)
def _(t: Tables):
    return models.baseline_predictions(_features(t))


def _scored(t: Tables) -> DataFrame:
    return metrics.score(models.baseline_predictions(_features(t)), ["model"])


_SCORED = (
    feature_sql(1)
    + ", " + ", ".join(f"{n} AS ({s})" for n, s in _BASELINE_LONG.items())
    + f", scored AS (SELECT model, count(y) AS target_rows, {metric_sql('y', 'p')},"
    f" {r('count(p) / count(y)')} AS coverage FROM long GROUP BY 1) "
)


@query("forecast_scores", "E34", _SCORED + "SELECT * FROM scored")
def _(t: Tables):
    return _scored(t)


_CANDIDATES = ", candidates AS (SELECT model, mae AS validation_mae, length(model) AS tier FROM scored) "


def _candidates(t: Tables) -> DataFrame:
    return _scored(t).select(
        "model",
        F.col("mae").alias("validation_mae"),
        F.length("model").alias("complexity_tier"),
        F.lit(0).alias("model_bytes"),
    )


@query(
    "model_selection",
    "G5",
    _SCORED
    + _CANDIDATES
    + ", b AS (SELECT min(validation_mae) AS best FROM candidates),"
    " e AS (SELECT c.*, best FROM candidates c, b WHERE validation_mae <= best * 1.25::DOUBLE + 1e-12),"
    " w AS (SELECT arg_min(model, (tier, validation_mae)) AS m, arg_min(validation_mae, (tier, validation_mae)) AS v,"
    " any_value(best) AS best, string_agg(model, ',' ORDER BY model) AS names FROM e)"
    f" SELECT m AS selected_model, {r('best')} AS best_validation_mae, {r('best * 1.25::DOUBLE')} AS maximum_eligible_mae,"
    f" names AS eligible_models, {r('(v / best - 1) * 100')} AS selected_validation_penalty_pct FROM w WHERE m IS NOT NULL",
)
def _(t: Tables):
    return metrics.select_model(_candidates(t), tolerance=0.25)


@query(
    "comparison_table",
    "G7",
    _SCORED
    + _CANDIDATES
    + f"SELECT model, {r('validation_mae')} AS validation_mae, tier AS complexity_tier, 0::BIGINT AS model_bytes,"
    " model = 'Same hour yesterday' AS selected FROM candidates ORDER BY selected DESC, validation_mae, model",
)
def _(t: Tables):
    return metrics.comparison_table(_candidates(t), "Same hour yesterday")


@query(
    "week_summary",
    "E44",
    feature_sql(1)
    + ", wk AS (SELECT *, mean_24h AS prediction FROM features WHERE target >= TIMESTAMP '2024-01-15'"
    " AND target < TIMESTAMP '2024-01-22'), s AS (SELECT station, count(*) AS n, sum(y) AS y, sum(prediction) AS p,"
    " avg(abs(y - prediction)) AS pm, avg(abs(y - recent)) AS rm, avg(abs(y - day)) AS dm, avg(abs(y - week)) AS wm,"
    " count_if(movements_24h = 0) AS z FROM wk GROUP BY 1)"
    f" SELECT station, n AS target_hours, y::BIGINT AS recorded_departures, {r('p')} AS predicted_departures,"
    f" {r('pm')} AS prediction_mae, {r('rm')} AS recent_mae, {r('dm')} AS day_mae, {r('wm')} AS week_mae,"
    " z::BIGINT AS inactive_rows, CASE WHEN rm <= dm AND rm <= wm THEN 'Last completed hour'"
    " WHEN dm <= wm THEN 'Same hour yesterday' ELSE 'Same hour last week' END AS best_baseline,"
    " pm > least(rm, dm, wm) AS beaten_by_baseline FROM s",
)
def _(t: Tables):
    return metrics.week_summary(_features(t).withColumn("prediction", F.col("mean_24h")), "2024-01-15 00:00:00")


def _prediction_table(t: Tables) -> DataFrame:
    keys = ["station", "target"]
    wide = _features(t).withColumn("mean_model", F.col("mean_24h") - 1)
    return metrics.unpivot_predictions(wide, keys, "y", {"recent": "recent", "day": "day", "mean": "mean_model"})


_PREDICTED = (
    feature_sql(1)
    + ", long AS (SELECT station, target, y, unnest(['recent', 'day', 'mean']) AS model,"
    " unnest([recent, day, mean_24h - 1]) AS p FROM features) "
)


@query(
    "prediction_audit",
    "E39 E33 E34",
    _PREDICTED
    + f"SELECT model, count(*) AS rows, count_if(p < 0)::BIGINT AS negative_predictions, 0::BIGINT AS duplicates,"
    f" {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse,"
    f" {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, model <> 'day' AS matches_saved_metrics"
    " FROM long GROUP BY 1",
)
def _(t: Tables):
    predictions = _prediction_table(t)
    saved = metrics.score(predictions, ["model"]).withColumn(
        "mae", F.when(F.col("model") == "day", F.col("mae") + 0.001).otherwise(F.col("mae"))
    )
    return metrics.prediction_audit(predictions, saved, ["station", "target"])


@query(
    "shared_population",
    "E39 D11 H3",
    _PREDICTED
    + ", kept AS (SELECT * FROM long WHERE NOT (model = 'mean' AND p < 0)), k AS (SELECT station, target,"
    " count(DISTINCT model) AS m FROM kept GROUP BY 1, 2), n AS (SELECT count(DISTINCT model) AS models FROM kept)"
    " SELECT any_value(models) AS models, count(m) AS keys, coalesce(count_if(m < models), 0)::BIGINT AS"
    " incomplete_keys, 0::BIGINT AS label_conflicts, coalesce(count_if(m < models), 0) = 0 AS"
    " common_keys_and_labels_equal FROM n LEFT JOIN k ON true",
)
def _(t: Tables):
    rows = _prediction_table(t).where(~((F.col("model") == "mean") & (F.col("y_pred") < 0)))
    return metrics.shared_population(rows, ["station", "target"])


@query(
    "covered_stations",
    "E39 G2",
    _PREDICTED
    + "SELECT station, count_if(model = 'mean')::BIGINT AS rows FROM long GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(t: Tables):
    rows = _prediction_table(t).groupBy("station").agg(F.count_if(F.col("model") == "mean").alias("rows"))
    return rows.orderBy(F.desc("rows"), "station").limit(20)


@query(
    "run_comparison",
    "E46 E30",
    _PREDICTED
    + ", two AS (SELECT model, y, p AS a, CASE WHEN model = 'mean' THEN p + 0.01::DOUBLE ELSE p END AS b FROM long),"
    " c AS (SELECT model, abs(avg(abs(y - a)) - avg(abs(y - b))) <= 1e-9 AND"
    " abs(sqrt(avg((y - a) ** 2)) - sqrt(avg((y - b) ** 2))) <= 1e-9 AND"
    " abs(sum((y - a) ** 2) - sum((y - b) ** 2)) / (var_pop(y) * count(*)) <= 1e-9 AS near,"
    " count_if(a <> b) = 0 AS same FROM two GROUP BY 1)"
    " SELECT model, near AS metrics_equal, same AS predictions_equal,"
    " CASE WHEN near AND same THEN 'PASS' ELSE 'BLOCKED' END AS status FROM c",
)
def _(t: Tables):
    first = _prediction_table(t)
    second = first.withColumn(
        "y_pred", F.when(F.col("model") == "mean", F.col("y_pred") + 0.01).otherwise(F.col("y_pred"))
    )
    return metrics.compare_runs(first, second, ["station", "target"])


@query(
    "replay_lookup",
    "B24 D15 B15",
    with_("demand", **dataset_fragments(60))
    + f"SELECT station AS station_id, {ts('ft')} AS feature_timestamp, {ts('tt')} AS target_timestamp,"
    " 60::BIGINT AS horizon_minutes, 'mean' AS model, split, (demand_lag_1h + demand_lag_24h) / 2.0::DOUBLE AS"
    " prediction_departures, target::DOUBLE AS observed_departures,"
    " abs(target - (demand_lag_1h + demand_lag_24h) / 2.0::DOUBLE) AS absolute_error FROM ds"
    " WHERE station = 'click' AND split = 'test'",
)
def _(t: Tables):
    served = metrics.replay(_mean_model(_dataset(t)))
    return served.where((F.col("station_id") == "click") & (F.col("split") == "test"))


# --- gates, lineage, registry --------------------------------------------------------------------


@query(
    "gate_rollup",
    "C15",
    "WITH g AS (SELECT o_orderpriority AS gate, avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders) AS ok"
    " FROM orders GROUP BY 1) SELECT count_if(ok)::BIGINT AS passed,"
    " coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT ok), '') AS blocking_gates, 'tests' AS missing_gates,"
    " 'BLOCKED' AS status FROM g",
)
def _(t: Tables):
    average = t.orders.agg(F.avg("o_totalprice")).scalar()
    means = t.orders.groupBy(F.col("o_orderpriority").alias("gate")).agg(F.avg("o_totalprice").alias("mean"))
    gates = means.withColumn("average", average).select(
        "gate", F.when(F.col("mean") > F.col("average"), "pass").otherwise("blocked").alias("status")
    )
    return metrics.gate_rollup(gates, ["1-URGENT", "2-HIGH", "tests"])


@query(
    "artifact_lineage",
    "C16",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'dataset_id differs' WHEN o_custkey < 100 THEN"
    " 'contract_id differs' ELSE 'current' END AS lineage FROM orders",
)
def _(t: Tables):
    current = t.orders.select(
        "o_orderkey", F.lit("F").alias("dataset_id"), F.greatest("o_custkey", F.lit(100)).alias("contract_id")
    )
    artifacts = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("dataset_id"), F.col("o_custkey").alias("contract_id")
    )
    rows = metrics.lineage_status(artifacts, current, ["o_orderkey"], ["dataset_id", "contract_id"])
    return rows.select("o_orderkey", "lineage")


@query(
    "latest_validated_model",
    "G6 T21",
    "SELECT o_orderpriority, o_orderkey AS model_version, " + ts("o_orderdate") + " AS created_at FROM orders"
    " WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_orderpriority"
    " ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def _(t: Tables):
    registry = t.orders.select(
        "o_orderpriority",
        F.col("o_orderkey").alias("model_version"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "validated").otherwise("draft").alias("status"),
    )
    return metrics.latest_validated(registry, ["o_orderpriority"]).drop("status")


# --- fitted models: no SQL equivalent ------------------------------------------------------------


def model_split(t: Tables) -> DataFrame:
    """Feature rows of all users, stored once, with fixed-date splits."""
    demand = t.user_demand
    panel = features.dense_panel(demand, demand.select("station").distinct())
    path = shared_dir(t.spark, "features")
    features.feature_table(panel, 1, ZONE).write.parquet(path)
    stored = spread(t.spark.read.parquet(path), "station", "target")
    return splits.fixed_date_split(stored, 1, "2024-01-20", "2024-01-25")


def _fit_and_score(t: Tables, kind: str) -> DataFrame:
    candidate = next(c for c in models.FITTED_CANDIDATES if c.kind == kind)
    split = model_split(t)
    scored = models.predict(models.fit(candidate, split), split)
    long = scored.select(
        "split", F.lit(candidate.model).alias("model"), F.col("y").alias("y_true"), F.col("prediction").alias("y_pred")
    )
    return metrics.score(long, ["model", "split"])


@query("ridge_model", "I4 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "ridge")


@query("tree_model", "I5 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "tree")


@query("forest_model", "I6 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "forest")


@query("boosting_model", "I7 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "boosting")


@query("poisson_model", "I8 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "poisson")


@query("count_boosting_model", "I7 I9 I10")
def _(t: Tables):
    return _fit_and_score(t, "count_boosting")


# The panel of users in place of that of event types.
_SPLIT = feature_sql(1).replace(f"demand AS ({CTE['demand']})", f"demand AS ({CTE['user_demand']})") + (
    ", split AS (SELECT *, CASE WHEN target < TIMESTAMP '2024-01-20' THEN 'train' WHEN target < TIMESTAMP '2024-01-25'"
    " THEN 'validation' ELSE 'test' END AS split FROM features"
    " WHERE target + INTERVAL 2 HOUR < TIMESTAMP '2024-01-20' OR (target >= TIMESTAMP '2024-01-20'"
    " AND target + INTERVAL 2 HOUR < TIMESTAMP '2024-01-25') OR target >= TIMESTAMP '2024-01-25') "
)
_CHECKED = ("ridge", "tree", "poisson", "count_boosting")


@query(
    "model_checks",
    "I4 I5 I7 I8 I9 I10",
    _SPLIT
    + "SELECT kind AS model, split, count(*)::BIGINT AS rows, round(avg(y), 6)::DOUBLE AS mean_y, 0::BIGINT AS negative,"
    " 0::BIGINT AS missing, true AS no_worse_than_the_mean, true AS keeps_the_mean"
    f" FROM split, unnest({list(_CHECKED)}) AS m(kind) GROUP BY 1, 2",
)
def _(t: Tables):
    """What holds for any fit: all rows have a prediction, none is negative; over the training rows the
    squared error is at most that of the mean, and predictions have the labels' mean."""
    split = model_split(t)
    constant = split.where("split = 'train'").agg(F.avg("y")).first()[0]
    checks = []
    for kind in _CHECKED:
        candidate = next(c for c in models.FITTED_CANDIDATES if c.kind == kind)
        scored = models.predict(models.fit(candidate, split), split)
        error, far = F.sum((F.col("y") - F.col("prediction")) ** 2), F.sum((F.col("y") - F.lit(constant)) ** 2)
        train = F.first("split") == "train"
        checks.append(
            scored.groupBy(F.lit(kind).alias("model"), "split").agg(
                F.count(F.lit(1)).alias("rows"), F.avg("y").alias("mean_y"), F.count_if(F.col("prediction") < 0).alias("negative"),
                F.count_if(F.col("prediction").isNull()).alias("missing"),
                (~train | (error <= far * (1 + 1e-9))).alias("no_worse_than_the_mean"),
                (~train | (F.abs(F.avg("prediction") - F.avg("y")) <= 0.01 * F.avg("y"))).alias("keeps_the_mean"),
            )
        )
    return functools.reduce(DataFrame.unionByName, checks)


@query(
    "comparison_checks",
    "I3 I11 G5 G7",
    _SPLIT
    + f", long AS (SELECT split, y, unnest(['Last completed hour', 'Same hour yesterday', 'Same hour last week']) AS model,"
    " unnest([recent, day, week]) AS p FROM split)"
    f" SELECT model, {r('avg(abs(y - p)) FILTER (split = $$validation$$)')} AS validation_mae,"
    f" {r('avg(abs(y - p)) FILTER (split = $$test$$)')} AS mae,"
    " true AS one_selected, true AS selected_within_tolerance FROM long GROUP BY 1",
)
def _(t: Tables):
    """The baselines of a comparison to the digit, and that one model within the tolerance is selected."""
    ridge = next(c for c in models.FITTED_CANDIDATES if c.kind == "ridge")
    table = models.comparison(model_split(t), [*models.BASELINE_CANDIDATES, ridge])
    facts = table.agg(
        (F.count_if("selected") == 1).alias("one_selected"),
        (F.max(F.when(F.col("selected"), F.col("validation_mae"))) <= F.min("validation_mae") * 1.01).alias("selected_within_tolerance"),
    ).first()
    rows = table.where("complexity_tier = 0").select("model", "validation_mae", "mae")
    return rows.withColumns({k: F.lit(v) for k, v in facts.asDict().items()})


@query("model_comparison", "I11 G5 G7 C13")
def _(t: Tables):
    return models.comparison(model_split(t), [*models.BASELINE_CANDIDATES, *models.FITTED_CANDIDATES])


# --- streams ------------------------------------------------------------------------------------


def _drain(t: Tables, stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over everything available, then read what it appended."""
    out = shared_dir(t.spark, purpose)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _event_stream(t: Tables) -> DataFrame:
    # A stream lists a pattern or a folder, not a single file.
    at = {"ts": F.lit(streams.CLOSING_TIME), "value": F.lit(0), "event_type": F.lit("closing"), "user_id": F.lit(0)}
    row = [at.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.events.schema]
    closing = t.spark.range(1).select(*row)
    return streams.closed_stream(
        t.spark, f"{t.folder}/events*.parquet", t.spark.createDataFrame(closing.collect(), t.events.schema), shared_dir(t.spark, "closing")
    )


@query(
    "streaming_station_hours",
    "S1 E1 C1",
    "WITH e AS (SELECT date_trunc('hour', ts) AS time, event_type AS station, 1 AS d, 0 AS a FROM events UNION ALL"
    " SELECT date_trunc('hour', ts + INTERVAL 30 MINUTE), CAST(user_id AS VARCHAR), 0, 1 FROM events)"
    f" SELECT {ts('time')} AS time, station, sum(d)::BIGINT AS departures, sum(a)::BIGINT AS arrivals FROM e"
    " GROUP BY time, station",
)
def _(t: Tables):
    start = F.col("ts").cast("timestamp")
    stream = _event_stream(t).select(
        "event_id",
        start.alias("started"),
        clocks.shift_minutes(start, 30).alias("ended"),
        F.col("event_type").alias("origin"),
        F.col("user_id").cast("string").alias("destination"),
    )
    counted = streams.streaming_station_hours(trips.mark_events(stream), "event_id")
    return _drain(t, counted, "stream-hours")


@query(
    "streaming_event_runs",
    "S2 F4",
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS station, ts AS time FROM events WHERE value % 11 < 3),"
    " f AS (SELECT *, coalesce(epoch_us(time - lag(time) OVER (PARTITION BY station ORDER BY time)) <= 5400000000, false)"
    " AS joined FROM e), n AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY station ORDER BY time) AS run FROM f)"
    f" SELECT station, {ts('min(time)')} AS start, {ts('max(time)')} AS \"end\", count(*) AS samples,"
    f" {r('epoch_us(max(time) - min(time)) / 60000000.0::DOUBLE')} AS span_minutes FROM n GROUP BY station, run",
)
def _(t: Tables):
    low = _event_stream(t).where("value % 11 < 3")
    stream = low.select(F.col("user_id").cast("string").alias("station"), F.col("ts").cast("timestamp").alias("time"))
    return _drain(t, streams.streaming_event_runs(stream), "stream-runs")


@query(
    "streaming_raw_runs",
    "S2 F4",
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS station, ts AS time, coalesce(value % 11 < 7, false) AS event FROM events),"
    " f AS (SELECT *, lag(time) OVER w AS before, lag(event) OVER w AS was FROM e WINDOW w AS (PARTITION BY station ORDER BY time, event)),"
    " n AS (SELECT *, sum((event AND NOT coalesce(was AND epoch_us(time - before) BETWEEN 1 AND 21600000000, false))::INT)"
    " OVER (PARTITION BY station ORDER BY time, event) AS run FROM f)"
    f" SELECT station, {ts('min(time)')} AS start, {ts('max(time)')} AS \"end\", count(*) AS samples,"
    f" {r('epoch_us(max(time) - min(time)) / 60000000.0::DOUBLE')} AS span_minutes FROM n WHERE event GROUP BY station, run",
)
def _(t: Tables):
    samples = _event_stream(t).select(
        F.col("user_id").cast("string").alias("station"), F.col("ts").cast("timestamp").alias("time"), (F.col("value") % 11 < 7).alias("low")
    )
    return _drain(t, streams.streaming_event_runs(samples, max_gap_minutes=360, event="low"), "stream-raw-runs")


def _replay_parts(t: Tables) -> list[DataFrame]:
    """Three files of a stream: most events; half of those held back; then the others, and a third of the
    first file once more."""
    kept = t.events.where("event_id % 10 != 0")
    last = t.events.where("event_id % 20 = 10").unionByName(kept.where("event_id % 3 = 0"))
    return [kept, t.events.where("event_id % 20 = 0"), last]


@query(
    "stream_accounts",
    "S1 E1",
    "WITH kept AS (SELECT * FROM events WHERE event_id % 10 <> 0), mark AS (SELECT max(ts) + INTERVAL 30 MINUTE - INTERVAL 2 HOUR AS w FROM kept),"
    " last AS (SELECT * FROM events WHERE event_id % 20 = 10 UNION ALL SELECT * FROM kept WHERE event_id % 3 = 0),"
    " both_ends AS (SELECT event_id, ts AS time FROM last UNION ALL SELECT event_id, ts + INTERVAL 30 MINUTE FROM last),"
    " n AS (SELECT (SELECT 2 * count(*) FROM events WHERE event_id % 20 <> 10) AS first, count(*) AS again, count_if(time <= w) AS late,"
    " count_if(time > w AND event_id % 10 <> 0) AS duplicates FROM both_ends, mark)"
    " SELECT (first + again)::BIGINT AS events, late::BIGINT AS late, duplicates::BIGINT AS duplicates,"
    " (first + again - late - duplicates)::BIGINT AS counted FROM n",
)
def _(t: Tables):
    folder = shared_dir(t.spark, "replay")
    for k, part in enumerate(_replay_parts(t)):
        part.coalesce(1).write.parquet(f"{folder}/part={k}")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    start = F.col("ts").cast("timestamp")
    trips_ = stream.select(
        "event_id", start.alias("started"), clocks.shift_minutes(start, 30).alias("ended"),
        F.col("event_type").alias("origin"), F.col("user_id").cast("string").alias("destination"),
    )
    account = streams.RowAccount("replay")
    t.spark.streams.addListener(account)
    try:
        rows = _drain(t, streams.streaming_station_hours(trips.mark_events(trips_), "event_id", account="replay"), "stream-accounts")
        emitted = rows.agg(F.coalesce(F.sum(F.col("departures") + F.col("arrivals")), F.lit(0)).alias("n")).first()["n"]
        t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        t.spark.streams.removeListener(account)
    found = account.totals()
    if found["emitted"] != emitted:
        raise ValueError(f"the account tells {found['emitted']} emitted events, the table has {emitted}")
    row = (found["events"], found["late"], found["duplicates"], found["emitted"] + found["open"])
    return t.spark.createDataFrame([row], "events bigint, late bigint, duplicates bigint, counted bigint")
