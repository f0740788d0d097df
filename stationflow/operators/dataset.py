"""The observation dataset: exact targets, exact lags, calendar, split; and its validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks, identifiers
from stationflow.operators import features, splits
from stationflow.operators.canonical import DataRuleError

# Fixed values of the dataset contract.
LAGS_HOURS = (1, 2, 3, 6, 12, 24, 48, 168)
HORIZONS_MINUTES = (60, 120)
KEYS = (
    "provider_id", "network_id", "station_instance_id", "station_id", "feature_timestamp",
    "target_timestamp",
)
TARGET = "target_departures"
FORBIDDEN_FEATURES = (
    "target_departures", "target_timestamp", "source_year", "arrivals", "total_activity", "net_flow",
)
MODEL_FEATURES = (
    "station_id", "demand_at_feature_time", "hour", "day_of_week", "day_of_month", "month",
    "local_hour", "hour_sin", "hour_cos", "local_weekday", "weekday_sin", "weekday_cos",
    "month_sin", "month_cos", "year", "weekend",
)

_IDENTITY = ("provider_id", "network_id", "station_instance_id", "station_id")


def scoped_demand(demand: DataFrame, provider: str, network: str) -> DataFrame:
    """(identity columns, observed_at, demand) of one network's station-hours."""
    station = identifiers.normalized_station(F.col("station"))
    p, n = F.lit(provider.strip().lower()), F.lit(network)
    return demand.select(
        p.alias("provider_id"),
        n.alias("network_id"),
        identifiers.station_instance(p, n, station).alias("station_instance_id"),
        station.alias("station_id"),
        F.col("time").alias("observed_at"),
        F.col("departures").cast("double").alias("demand"),
    )


def with_targets_and_lags(base: DataFrame, horizon_minutes: int) -> DataFrame:
    """Every base row with the demand exactly a horizon later and at eight exact lags.

    One window replaces nine self-joins: one shuffle, one sort.
    """
    lookups = {TARGET: ("demand", horizon_minutes / 60)}
    lookups |= {f"demand_lag_{k}h": ("demand", -k) for k in LAGS_HOURS}
    looked = features.with_exact_offsets(base, _IDENTITY, "observed_at", lookups)
    flags = {
        f"demand_lag_{k}h_available": F.col(f"demand_lag_{k}h").isNotNull() for k in LAGS_HOURS
    }
    return (
        looked.withColumnsRenamed(
            {"observed_at": "feature_timestamp", "demand": "demand_at_feature_time"}
        )
        .withColumn(
            "target_timestamp", clocks.shift_minutes(F.col("feature_timestamp"), horizon_minutes)
        )
        .withColumns(flags)
    )


def observation_dataset(base: DataFrame, horizon_minutes: int, tz: str) -> DataFrame:
    """Rows with an observed target, calendar columns, horizon and split."""
    if horizon_minutes not in HORIZONS_MINUTES:
        raise ValueError(f"horizon must be one of {HORIZONS_MINUTES}")
    rows = with_targets_and_lags(base, horizon_minutes).where(F.col(TARGET).isNotNull())
    rows = rows.withColumns(clocks.local_calendar(F.col("feature_timestamp"), tz)).withColumn(
        "horizon_minutes", F.lit(horizon_minutes)
    )
    return splits.split_by_boundaries(rows, "feature_timestamp", "target_timestamp")


def dataset_report(dataset: DataFrame) -> DataFrame:
    """Per split: rows, stations and the share of rows with each lag."""
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station_id").alias("stations"),
        *[
            F.avg(F.col(f"demand_lag_{k}h_available").cast("double")).alias(f"lag_{k}h_share")
            for k in LAGS_HOURS
        ],
    )


def unobserved_targets(base: DataFrame, horizon_minutes: int) -> DataFrame:
    """Candidate rows and how many have no observed target (one row)."""
    rows = features.with_exact_offsets(
        base, _IDENTITY, "observed_at", {TARGET: ("demand", horizon_minutes / 60)}
    )
    return rows.agg(
        F.count(F.lit(1)).alias("candidate_target_rows"),
        F.count(TARGET).alias("target_observed_rows"),
        F.count_if(F.col(TARGET).isNull()).alias("target_unobserved_rows"),
    )


def validate_dataset(dataset: DataFrame, base: DataFrame, horizon_minutes: int) -> DataFrame:
    """One row of violation counts: the dataset against values looked up again in the source."""
    expected = with_targets_and_lags(base, horizon_minutes)
    lag_columns = [f"demand_lag_{k}h" for k in LAGS_HOURS]
    source = expected.select(
        *_IDENTITY,
        "feature_timestamp",
        *[F.col(c).alias(f"_x_{c}") for c in (TARGET, *lag_columns)],
    )
    both = dataset.join(source, [*_IDENTITY, "feature_timestamp"], "left")
    due = clocks.shift_minutes(F.col("feature_timestamp"), horizon_minutes)
    rules: dict[str, Column] = {
        "horizon": F.col("horizon_minutes") != horizon_minutes,
        "target_timestamp": F.col("target_timestamp") != due,
        "target_after_feature": F.col("target_timestamp") <= F.col("feature_timestamp"),
        "target_missing": F.col(f"_x_{TARGET}").isNull(),
        "target_mismatch": F.col(f"_x_{TARGET}").isNotNull()
        & ~F.col(TARGET).eqNullSafe(F.col(f"_x_{TARGET}")),
    }
    for c in lag_columns:
        known = F.col(f"_x_{c}").isNotNull()
        flag = F.col(f"{c}_available")
        rules[f"{c}_availability"] = ~known & (flag | F.col(c).isNotNull())
        rules[f"{c}_mismatch"] = known & (~flag | ~F.col(c).eqNullSafe(F.col(f"_x_{c}")))
    counts = both.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
    total = sum((F.col(name) for name in rules), F.lit(0))
    return counts.withColumn("total_violations", total).withColumn(
        "status", F.when(F.col("total_violations") == 0, "PASS").otherwise("BLOCKED")
    )


def model_feature_columns(columns: Iterable[str]) -> list[str]:
    """Columns a model may read: the white list plus lags and their flags."""
    return [
        c
        for c in columns
        if c not in FORBIDDEN_FEATURES and (c in MODEL_FEATURES or c.startswith("demand_lag_"))
    ]


def leakage_violations(dataset: DataFrame) -> DataFrame:
    """Rows whose target is not strictly later than the feature time, overall and with each lag."""
    late = F.col("target_timestamp") <= F.col("feature_timestamp")
    return dataset.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(late).alias("target_not_after_feature"),
        F.count_if(
            late
            & F.coalesce(*[F.col(f"demand_lag_{k}h") for k in LAGS_HOURS]).isNotNull()
        ).alias("lag_of_late_target"),
    )


def assert_no_leakage(dataset: DataFrame, feature_columns: Iterable[str]) -> DataFrame:
    """Raise on forbidden feature names or targets that are not in the future."""
    leaked = sorted(set(FORBIDDEN_FEATURES) & set(feature_columns))
    if leaked:
        raise DataRuleError(f"forbidden columns among the features: {leaked}")
    if leakage_violations(dataset).first()["target_not_after_feature"]:
        raise DataRuleError("the target time must be strictly after the feature time")
    return dataset


def keyed_lookup(demand: DataFrame, keys: DataFrame, on: Iterable[str]) -> DataFrame:
    """Demand of a batch of keys; repeated keys are asked once."""
    on = list(on)
    return demand.join(keys.select(*on).distinct(), on)


def dataset_catalog(observations: DataFrame) -> DataFrame:
    """Distinct published (provider, network, year) scopes."""
    return observations.select(
        "provider_id", "network_id", F.year("observed_at").alias("year")
    ).distinct()
