"""Inventory samples: conflicts, occupancy, extremes, profiles and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import measures
from stationflow.operators import sequences

KEY = ("station", "time")


def unique_samples(
    raw: DataFrame,
    fields: Sequence[str],
    order: Sequence[str],
    null_is_value: bool = False,
) -> DataFrame:
    """One row per (station, time): the first in `order`, with `conflict` when a field disagrees.

    `null_is_value` lets a null disagree with a number. Both answers come from one aggregate, so
    repeated copies of a key combine before the shuffle.
    """
    rest = [c for c in raw.columns if c not in KEY]
    conflict = F.lit(False)
    for f in fields:
        differs = ~F.min(f).eqNullSafe(F.max(f))
        if null_is_value:
            differs = differs | ((F.count(f) > 0) & (F.count(f) < F.count(F.lit(1))))
        conflict = conflict | differs
    grouped = raw.where(F.col("time").isNotNull()).groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"),
        conflict.alias("conflict"),
        F.count(F.lit(1)).alias("copies"),
    )
    return grouped.select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in rest], "conflict", "copies")


def conflict_counts(unique: DataFrame) -> DataFrame:
    """Conflicting keys and rows beyond the first of their key (one row)."""
    return unique.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if("conflict").alias("conflicting_keys"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
    )


def agreed_samples(unique: DataFrame) -> DataFrame:
    return unique.where(~F.col("conflict")).drop("conflict", "copies")


def with_occupancy(samples: DataFrame) -> DataFrame:
    return samples.withColumns(measures.occupancy_measures(F.col("bikes"), F.col("capacity")))


def with_states(samples: DataFrame) -> DataFrame:
    """Hour, night or day, and the reported service state of each sample."""
    return samples.withColumns(
        {
            "hour": F.hour("time"),
            "period": measures.day_period(F.col("time")),
            "service": measures.service_state(F.col("active"), F.col("unavailable")),
        }
    )


def station_occupancy(samples: DataFrame) -> DataFrame:
    """Per station: rows, valid rows, mean ratio, extreme counts and rates."""
    stats = samples.groupBy("station").agg(
        F.min_by("name", "time").alias("name"),
        F.count(F.lit(1)).alias("rows"),
        F.count("ratio").alias("valid_rows"),
        F.avg("ratio").alias("mean_occupancy"),
        F.count_if("empty").alias("empty_samples"),
        F.count_if("full").alias("full_samples"),
        F.count_if("near_empty").alias("near_empty_samples"),
        F.count_if("near_full").alias("near_full_samples"),
        F.count_if(F.col("unavailable") == 1).alias("unavailable_samples"),
    )
    return stats.withColumns(
        {
            "empty_rate": F.try_divide("empty_samples", "valid_rows"),
            "full_rate": F.try_divide("full_samples", "valid_rows"),
        }
    )


def with_run_counts(stats: DataFrame, **runs: DataFrame) -> DataFrame:
    """Attach the number of runs of each kind per station; stations without runs get zero."""
    for name, table in runs.items():
        counts = table.groupBy("station").agg(F.count(F.lit(1)).alias(name))
        stats = stats.join(counts, "station", "left").na.fill(0, [name])
    return stats


def occupancy_heatmap(samples: DataFrame) -> DataFrame:
    return samples.groupBy("station", F.hour("time").alias("hour")).agg(
        F.avg("ratio").alias("occupancy"), F.count("ratio").alias("samples")
    )


def occupancy_profile(samples: DataFrame, dimension: str) -> DataFrame:
    """Mean ratio and extreme rates by hour, weekday (Monday = 0) or month of the source clock."""
    bucket = {
        "hour": F.hour("time"),
        "weekday": F.weekday("time"),
        "month": F.date_format("time", "yyyy-MM"),
    }[dimension]
    profile = samples.groupBy(bucket.cast("string").alias("bucket")).agg(
        F.avg("ratio").alias("occupancy"),
        F.count("ratio").alias("samples"),
        F.count_if("empty").alias("empty_samples"),
        F.count_if("full").alias("full_samples"),
    )
    return profile.withColumns(
        {
            "empty_rate": F.try_divide("empty_samples", "samples"),
            "full_rate": F.try_divide("full_samples", "samples"),
        }
    )


def histogram_edges(bins: int = 10) -> list[float]:
    """Edges of equal bins over [0, 1] as i * (1 / bins); the last edge is exactly one."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def occupancy_histogram(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, bin_from, bin_to, count); the last bin is closed. Compares with the edges themselves,
    because flooring ratio * bins puts some edge values into the wrong bin."""
    edges = histogram_edges(bins)
    ratio = F.col("ratio")
    index: Column = F.lit(0)
    for i in range(1, bins):
        index = F.when(ratio >= F.lit(edges[i]), F.lit(i)).otherwise(index)
    counted = (
        samples.where(ratio.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    every = samples.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, bin_from double, bin_to double"
    )
    return every.join(counted, "bin", "left").select(
        "bin", "bin_from", "bin_to", F.coalesce("n", F.lit(0)).alias("count")
    )


def inventory_quality(samples: DataFrame) -> DataFrame:
    """Nulls by column and implausible readings (one row). A null never balances a sum."""
    bikes, capacity, free = F.col("bikes"), F.col("capacity"), F.col("free")
    return samples.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station").alias("stations"),
        *[
            F.count_if(F.col(c).isNull()).alias(f"missing_{c}")
            for c in ("bikes", "capacity", "free", "active", "unavailable")
        ],
        F.count_if(bikes < 0).alias("negative_bikes"),
        F.count_if(bikes > capacity).alias("bikes_over_capacity"),
        F.count_if(capacity <= 0).alias("invalid_capacity"),
        F.count_if(~F.coalesce(bikes + free == capacity, F.lit(False))).alias(
            "inventory_not_balanced"
        ),
    )


def flag_values(samples: DataFrame) -> DataFrame:
    """(flag, value, rows) of the two service flags, nulls left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("flag"), F.col(c).cast("double").alias("value"))
            for c in ("active", "unavailable")
        ]
    )
    long = samples.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return long.groupBy("flag", "value").agg(F.count(F.lit(1)).alias("rows"))


def gap_statistics(samples: DataFrame, limit_minutes: float = 90.0) -> DataFrame:
    """Median, 95th percentile, longest gap and gaps over the limit of same-station samples."""
    gaps = sequences.gap_minutes(samples.select("station", "time"), "station", "time").where(
        F.col("gap_minutes").isNotNull()
    )
    n, v = F.col("_n"), F.col("_v")
    return sequences.exact_quantiles(
        gaps,
        "gap_minutes",
        {"median_gap": 0.5, "p95_gap": 0.95},
        also={
            "gaps": F.coalesce(F.sum(n), F.lit(0)),
            "max_gap": F.max(v),
            "over_limit": F.coalesce(F.sum(F.when(v > limit_minutes, n)), F.lit(0)),
        },
    )


def valid_states(unique: DataFrame) -> DataFrame:
    """Agreed, valid samples with their states: the input of the summaries below."""
    return with_states(with_occupancy(agreed_samples(unique)).where("valid"))


def extreme_summary(samples: DataFrame) -> DataFrame:
    """Samples, empty and full counts and percents for five groupings in one pass."""
    counted = samples.groupingSets(
        [[], ["period"], ["service"], ["period", "service"], ["hour", "service"]],
        "period",
        "service",
        "hour",
    ).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("samples"),
        F.count_if("empty").alias("empty"),
        F.count_if("full").alias("full"),
    )
    # Bits of the grouping id from the left: period, service, hour; a set bit is a summed column.
    level = (
        F.when(F.col("_g") == 7, "all")
        .when(F.col("_g") == 3, "period")
        .when(F.col("_g") == 5, "service")
        .when(F.col("_g") == 1, "period_service")
        .otherwise("hour_service")
    )
    return counted.select(
        level.alias("level"),
        "period",
        "service",
        "hour",
        "samples",
        "empty",
        "full",
        (F.col("empty") / F.col("samples") * 100).alias("empty_pct"),
        (F.col("full") / F.col("samples") * 100).alias("full_pct"),
    )


def station_extremes(samples: DataFrame) -> DataFrame:
    """Per station: extreme counts and percents, how many at night and under an inactive flag."""
    columns = [F.count(F.lit(1)).alias("samples")]
    for event in ("empty", "full"):
        hit = F.col(event)
        off = F.col("service") == measures.FLAGGED_OFF
        columns += [
            F.count_if(hit).alias(event),
            (F.count_if(hit) / F.count(F.lit(1)) * 100).alias(f"{event}_pct"),
            F.count_if(hit & (F.col("hour") < 6)).alias(f"{event}_night"),
            F.count_if(hit & off).alias(f"{event}_flagged"),
        ]
    return samples.groupBy("station").agg(F.min_by("name", "time").alias("name"), *columns)


def station_groups(samples: DataFrame) -> DataFrame:
    """(station, period, service): samples, empty and full."""
    return samples.groupBy("station", "period", "service").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("empty").alias("empty"),
        F.count_if("full").alias("full"),
    )


def collapse_groups(groups: DataFrame, dimension: str) -> DataFrame:
    """Roll (period, service) groups up to one of the two dimensions."""
    rolled = groups.groupBy(dimension).agg(
        F.sum("samples").alias("samples"), F.sum("empty").alias("empty"), F.sum("full").alias("full")
    )
    return rolled.withColumns(
        {
            "empty_pct": F.col("empty") / F.col("samples") * 100,
            "full_pct": F.col("full") / F.col("samples") * 100,
        }
    )
