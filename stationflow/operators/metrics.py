"""Forecast metrics, common populations, model selection and run comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.canonical import DataRuleError, content_digest, hash_sums, marked_text

# Baseline name -> lag column, and the selection policy.
BASELINES = {
    "naive_1h": "demand_lag_1h",
    "seasonal_naive_24h": "demand_lag_24h",
    "seasonal_naive_168h": "demand_lag_168h",
}
SELECTION_TOLERANCE = 0.01
LABEL_TOLERANCE = 1e-9


def metric_columns(y: Column, prediction: Column) -> dict[str, Column]:
    """MAE, RMSE, R2 and row count over rows where both are known.

    R2 is 1 - SSE / SST and null for a constant target; the built-in `regr_r2` is a squared
    correlation and a different number.
    """
    both = y.isNotNull() & prediction.isNotNull()
    error = F.when(both, y - prediction)
    actual = F.when(both, y.cast("double"))
    spread = F.var_pop(actual) * F.count(actual)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(F.min(actual) < F.max(actual), 1 - F.sum(error * error) / spread),
        "n_predictions": F.count(error),
    }


def score(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of a long table with y_true and y_pred; target rows include missing predictions."""
    columns = metric_columns(F.col("y_true"), F.col("y_pred"))
    return (
        predictions.groupBy(*by)
        .agg(
            F.count("y_true").alias("target_rows"), *[c.alias(n) for n, c in columns.items()]
        )
        .withColumn("coverage", F.try_divide("n_predictions", "target_rows"))
    )


def unpivot_predictions(
    wide: DataFrame, keys: Sequence[str], y: str, models: Mapping[str, str]
) -> DataFrame:
    """(keys, model, y_true, y_pred) from one prediction column per model."""
    pairs = [
        F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred"))
        for m, c in models.items()
    ]
    return wide.select(
        *keys, F.col(y).cast("double").alias("y_true"), F.explode(F.array(*pairs)).alias("p")
    ).select(*keys, "y_true", "p.model", "p.y_pred")


def baseline_metrics(dataset: DataFrame) -> DataFrame:
    """Scores of the lag baselines by split and horizon on the rows where the lag exists."""
    long = unpivot_predictions(
        dataset, ["split", "horizon_minutes"], "target_departures", BASELINES
    )
    return score(long, ["split", "horizon_minutes", "model"])


def wide_population(
    dataset: DataFrame, predictions: DataFrame, horizon: int, model: str, keys: Sequence[str]
) -> DataFrame:
    """Test rows with a known target, one column per model; a left join, no key sets."""
    test = (F.col("split") == "test") & (F.col("horizon_minutes") == horizon)
    targets = dataset.where(test & F.col("target_departures").isNotNull()).select(
        *keys, "target_departures", *[F.col(c).alias(m) for m, c in BASELINES.items()]
    )
    known = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    scored = predictions.where(test & known).select(
        *keys, F.col("y_true").alias("label"), F.col("y_pred").alias(model)
    )
    return targets.join(scored, list(keys), "left")


def common_population(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: metrics, coverage and exclusions on the rows every model can score."""
    common = F.lit(True)
    for m in models:
        common = common & F.col(m).isNotNull()
    pairs = [F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("y_pred")) for m in models]
    long = wide.select(
        F.col("target_departures").cast("double").alias("y_true"),
        common.alias("common"),
        F.explode(F.array(*pairs)).alias("p"),
    ).select("y_true", "common", "p.model", "p.y_pred")
    inside = F.when(F.col("common"), F.col("y_true"))
    columns = metric_columns(inside, F.col("y_pred"))
    result = long.groupBy("model").agg(
        F.count(F.lit(1)).alias("target_rows"),
        F.count("y_pred").alias("valid_rows"),
        F.count_if("common").alias("common_population_rows"),
        *[c.alias(n) for n, c in columns.items()],
    )
    return result.withColumns(
        {
            "rows_excluded": F.col("target_rows") - F.col("valid_rows"),
            "natural_coverage": F.try_divide("valid_rows", "target_rows"),
            "coverage": F.try_divide("common_population_rows", "target_rows"),
            "same_population": F.col("valid_rows") == F.col("common_population_rows"),
            "status": F.when(F.col("common_population_rows") > 0, "PASS").otherwise("BLOCKED"),
        }
    )


def missing_lags(dataset: DataFrame) -> DataFrame:
    """Natural coverage and missing rows of the baselines and the target, by split."""
    columns = [
        F.count(F.lit(1)).alias("target_rows"),
        F.count_if(F.col("target_departures").isNull()).alias("target_missing_rows"),
    ]
    for model, lag in BASELINES.items():
        valid = F.col(lag).isNotNull() & F.col("target_departures").isNotNull()
        columns += [
            F.count_if(F.col(lag).isNull()).alias(f"{model}_missing"),
            F.count_if(valid).alias(f"{model}_valid"),
            (F.count_if(valid) / F.count(F.lit(1))).alias(f"{model}_coverage"),
        ]
    return dataset.groupBy("split").agg(*columns)


def label_reconciliation(dataset: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: predictions joined to their targets and labels that differ beyond tolerance."""
    joined = dataset.select(*keys, "target_departures", F.lit(True).alias("_row")).join(
        predictions.select(*keys, "y_true"), list(keys), "full_outer"
    )
    both = F.col("target_departures").isNotNull() & F.col("y_true").isNotNull()
    apart = F.abs(F.col("target_departures") - F.col("y_true")) > LABEL_TOLERANCE
    return joined.agg(
        F.count_if(both).alias("matched_rows"),
        F.count_if(F.col("_row").isNull()).alias("unknown_prediction_keys"),
        F.count_if(both & apart).alias("label_mismatches"),
    )


def select_model(candidates: DataFrame, tolerance: float = SELECTION_TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """The simplest candidate within tolerance of the best validation error, per group `by`.

    Order among the eligible: complexity tier, stored size, validation error, name. Test scores
    are never read. The candidates are a handful of models.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = candidates.withColumn("_best", F.min("validation_mae").over(w))
    eligible = F.col("validation_mae") <= F.col("_best") * (1 + tolerance) + 1e-12
    order = F.struct("complexity_tier", "model_bytes", "validation_mae", "model")
    chosen = ranked.where(eligible).groupBy(*by).agg(
        F.min_by("model", order).alias("selected_model"),
        F.min_by("validation_mae", order).alias("_mae"),
        F.max("_best").alias("best_validation_mae"),
        F.sort_array(F.collect_list("model")).alias("eligible_models"),
    )
    best = F.col("best_validation_mae")
    return chosen.where(F.col("selected_model").isNotNull()).select(
        *by,
        "selected_model",
        "best_validation_mae",
        (best * (1 + tolerance)).alias("maximum_eligible_mae"),
        "eligible_models",
        F.when(best > 0, (F.col("_mae") / best - 1) * 100).otherwise(0.0).alias(
            "selected_validation_penalty_pct"
        ),
    )


def assert_candidates(candidates: DataFrame) -> DataFrame:
    """Raise when there is no candidate or a validation error is not a finite positive number."""
    mae = F.col("validation_mae")
    bad = mae.isNull() | F.isnan(mae) | (mae == float("inf")) | (mae < 0)
    found = candidates.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if not found["n"] or found["bad"]:
        raise DataRuleError("every candidate needs a finite validation error")
    return candidates


def comparison_table(candidates: DataFrame, selected: str) -> DataFrame:
    """Selected model first, then by validation error."""
    return candidates.withColumn("selected", F.col("model") == selected).orderBy(
        F.desc("selected"), "validation_mae", "model"
    )


def prediction_audit(predictions: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recompute saved metrics per model; negative predictions, duplicate keys, equality.

    With constant labels R2 is null, and equal to a saved null.
    """
    per_key = predictions.groupBy("model", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("y_true").alias("_y"),
        F.sum("y_pred").alias("_p"),
        F.sum(F.abs(F.col("y_true") - F.col("y_pred"))).alias("_abs"),
        F.sum((F.col("y_true") - F.col("y_pred")) ** 2).alias("_sq"),
        F.sum(F.col("y_true") ** 2).alias("_yy"),
        F.min("y_true").alias("_low"),
        F.max("y_true").alias("_high"),
        F.count_if(F.col("y_pred") < 0).alias("_neg"),
    )
    totals = per_key.groupBy("model").agg(
        F.sum("_n").alias("rows"),
        F.sum("_neg").alias("negative_predictions"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        (F.sum("_abs") / F.sum("_n")).alias("mae"),
        F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rmse"),
        F.when(
            F.min("_low") < F.max("_high"),
            1 - F.try_divide(F.sum("_sq"), F.sum("_yy") - F.sum("_y") * F.sum("_y") / F.sum("_n")),
        ).alias("r2"),
    )
    expected = saved.select("model", F.lit(True).alias("_saved"), *[F.col(m).alias(f"_{m}") for m in ("mae", "rmse", "r2")])
    equal = F.lit(True)
    for m in ("mae", "rmse", "r2"):
        near = F.abs(F.col(m) - F.col(f"_{m}")) <= 1e-9 + 1e-9 * F.abs(F.col(f"_{m}"))
        equal = equal & F.coalesce(near, F.isnull(m) & F.isnull(f"_{m}") & F.col("_saved").isNotNull())
    return totals.join(expected, "model", "left").select(
        "model", "rows", "negative_predictions", "duplicates", "mae", "rmse", "r2",
        equal.alias("matches_saved_metrics"),
    )


def shared_population(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: models, distinct keys, keys some model lacks, keys with unequal labels."""
    models = predictions.select("model").distinct().agg(F.count(F.lit(1))).scalar()
    per_key = predictions.groupBy(*keys).agg(
        F.count_distinct("model").alias("_m"),
        (F.max("y_true") - F.min("y_true")).alias("_spread"),
    )
    counted = per_key.withColumn("_models", models).agg(
        F.coalesce(F.max("_models"), F.lit(0)).alias("models"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_m") < F.col("_models")).alias("incomplete_keys"),
        F.count_if(F.abs("_spread") > LABEL_TOLERANCE).alias("label_conflicts"),
    )
    return counted.withColumn(
        "common_keys_and_labels_equal",
        (F.col("incomplete_keys") == 0) & (F.col("label_conflicts") == 0),
    )


def week_summary(forecasts: DataFrame, week_start: str) -> DataFrame:
    """Per station over seven days: sums, errors of model and baselines, the best baseline."""
    start = F.lit(week_start).cast("timestamp")
    week = forecasts.where(
        (F.col("target") >= start) & (F.col("target") < start + F.expr("INTERVAL 7 DAYS"))
    )
    y = F.col("y")
    errors = {n: F.avg(F.abs(y - F.col(n))) for n in ("prediction", "recent", "day", "week")}
    summary = week.groupBy("station").agg(
        F.count(F.lit(1)).alias("target_hours"),
        F.sum("y").alias("recorded_departures"),
        F.sum("prediction").alias("predicted_departures"),
        *[c.alias(f"{n}_mae") for n, c in errors.items()],
        F.count_if(F.col("movements_24h") == 0).alias("inactive_rows"),
    )
    names = {"recent": "Last completed hour", "day": "Same hour yesterday", "week": "Same hour last week"}
    ranked = F.array(
        *[
            F.struct(F.col(f"{n}_mae").alias("mae"), F.lit(i).alias("i"), F.lit(label).alias("name"))
            for i, (n, label) in enumerate(names.items())
        ]
    )
    best = F.array_min(ranked)
    return summary.withColumn("best_baseline", best["name"]).withColumn(
        "beaten_by_baseline", F.col("prediction_mae") > best["mae"]
    )


def compare_runs(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two prediction runs: metrics within tolerance and equal content per model; time is ignored."""
    def summary(df: DataFrame, tag: str) -> DataFrame:
        columns = metric_columns(F.col("y_true"), F.col("y_pred"))
        hashed = df.withColumn("_h", F.sha2(marked_text([*keys, "y_true", "y_pred"]), 256))
        return hashed.groupBy("model").agg(
            *[c.alias(f"{n}_{tag}") for n, c in columns.items()],
            F.array(*hash_sums(F.col("_h"))).alias(f"hash_{tag}"),
        )

    both = summary(first, "a").join(summary(second, "b"), "model", "full_outer")
    near = F.lit(True)
    for m in ("mae", "rmse", "r2"):
        close = F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")) <= LABEL_TOLERANCE
        unknown = F.col(f"{m}_a").isNull() & F.col(f"{m}_b").isNull()
        near = near & F.coalesce(close | unknown, unknown)
    same = F.coalesce(
        (F.col("hash_a") == F.col("hash_b")) & (F.col("n_predictions_a") == F.col("n_predictions_b")),
        F.lit(False),
    )
    return both.select(
        "model",
        near.alias("metrics_equal"),
        same.alias("predictions_equal"),
        F.when(near & same, "PASS").otherwise("BLOCKED").alias("status"),
    )


def replay(predictions: DataFrame) -> DataFrame:
    """Served form of stored predictions: clipped, rounded, with the absolute error."""
    from stationflow.functions.measures import replay_prediction

    return predictions.select(
        "station_id",
        "feature_timestamp",
        "target_timestamp",
        "horizon_minutes",
        "model",
        "split",
        replay_prediction(F.col("y_pred")).alias("prediction_departures"),
        F.col("y_true").alias("observed_departures"),
        F.abs(F.col("y_true") - F.col("y_pred")).alias("absolute_error"),
    )


def gate_rollup(gates: DataFrame, required: Sequence[str]) -> DataFrame:
    """Overall status of named gates: blocking names, missing names, PASS only when none is left.

    The gates are a short list of named checks.
    """
    wanted = gates.sparkSession.createDataFrame([(g,) for g in required], "gate string")
    known = gates.select("gate", F.upper("status").alias("status"))
    both = known.join(wanted.withColumn("_due", F.lit(True)), "gate", "full_outer")
    blocked = F.col("status").isNotNull() & (F.col("status") != "PASS")
    missing = F.col("status").isNull()
    return both.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(blocked, F.col("gate"))))).alias("blocking_gates"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(missing, F.col("gate"))))).alias("missing_gates"),
        F.when(F.count_if(blocked | missing) == 0, "PASS").otherwise("BLOCKED").alias("status"),
    )


def lineage_status(artifacts: DataFrame, current: DataFrame, on: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """First id of each artifact that is not the current one, or 'current'."""
    now = current.select(*on, *[F.col(i).alias(f"_now_{i}") for i in ids])
    reason = F.lit(None).cast("string")
    for i in reversed(list(ids)):
        stale = ~F.col(i).eqNullSafe(F.col(f"_now_{i}"))
        reason = F.when(stale, F.lit(f"{i} differs")).otherwise(reason)
    return artifacts.join(now, list(on), "left").select(
        *artifacts.columns, F.coalesce(reason, F.lit("current")).alias("lineage")
    )


def latest_validated(registry: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest validated registry row."""
    rest = [c for c in registry.columns if c not in by]
    newest = registry.where(F.col("status") == "validated").groupBy(*by).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "model_version")).alias("r")
    )
    return newest.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def run_digest(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return content_digest(predictions, [*keys, "model", "y_true", "y_pred"])
