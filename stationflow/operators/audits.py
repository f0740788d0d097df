"""Temporal coverage, gaps, missingness and identity evidence of observed demand.

Station windows here run over distinct station-hours, so one station holds at most as many rows
as the calendar has hours, whatever its share of the trips.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators import sequences

DELTA_THRESHOLDS = {"gaps_gt_1h": 1, "gaps_gt_6h": 6, "gaps_gt_24h": 24, "gaps_gt_48h": 48, "gaps_gt_7d": 168}


def _hours(later, earlier):
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def station_coverage(demand: DataFrame, station: str = "station", time: str = "time") -> DataFrame:
    """Per station: span, expected and missing hours, longest gap, zero-activity share."""
    w = Window.partitionBy(station).orderBy(time)
    gap = _hours(F.col(time), F.lag(time).over(w))
    zero = F.col("total_activity") == 0
    stats = (
        demand.select(station, time, "total_activity", gap.alias("_gap"))
        .groupBy(station)
        .agg(
            F.min(time).alias("first_observed_at"),
            F.max(time).alias("last_observed_at"),
            F.count(F.lit(1)).alias("observation_count"),
            F.coalesce(F.max("_gap"), F.lit(0.0)).alias("longest_missing_interval_hours"),
            F.count_if(zero).alias("zero_demand_count"),
        )
    )
    expected = F.floor(_hours(F.col("last_observed_at"), F.col("first_observed_at"))) + 1
    return stats.withColumn("expected_hourly_observations", expected).withColumns(
        {
            "observed_coverage_ratio": F.col("observation_count")
            / F.col("expected_hourly_observations"),
            "missing_interval_count": F.greatest(
                F.col("expected_hourly_observations") - F.col("observation_count"), F.lit(0)
            ),
            "zero_demand_ratio": F.col("zero_demand_count") / F.col("observation_count"),
        }
    )


def coverage_distribution(coverage: DataFrame) -> DataFrame:
    """Quantiles of the coverage measures over stations, one row per measure."""
    columns = (
        "observation_count",
        "expected_hourly_observations",
        "missing_interval_count",
        "observed_coverage_ratio",
    )
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]
    long = coverage.select(F.explode(F.array(*pairs)).alias("p")).select("p.measure", "p.v")
    wanted = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    return sequences.exact_quantiles(long, "v", wanted, keys=["measure"])


def coverage_thresholds(coverage: DataFrame) -> DataFrame:
    """How many stations stay below each coverage threshold (one row)."""
    seen, hours = F.col("observation_count"), F.col("expected_hourly_observations")
    ratio = F.col("observed_coverage_ratio")
    return coverage.agg(
        F.count(F.lit(1)).alias("stations"),
        F.count_if(seen < 10).alias("under_10_observations"),
        F.count_if(seen < 24).alias("under_24_observations"),
        F.count_if(hours < 7 * 24).alias("under_7_days"),
        F.count_if(hours < 30 * 24).alias("under_30_days"),
        F.count_if(hours < 90 * 24).alias("under_90_days"),
        F.count_if(ratio < 0.9).alias("under_90_percent"),
        F.count_if(ratio < 0.5).alias("under_50_percent"),
    )


def delta_statistics(demand: DataFrame, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Gaps between distinct hours, globally or by key: mode (smallest on ties), median, range,
    and counts over fixed thresholds."""
    keys = list(keys)
    distinct = demand.select(*keys, time).distinct()
    linked = sequences.with_previous(distinct, keys, [time], F.date_trunc("month", F.col(time)))
    gaps = linked.select(
        *keys, _hours(F.col(time), F.col("previous")[time]).alias("gap")
    )
    per_gap = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("gap").isNotNull()

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    stats = per_gap.groupBy(*keys).agg(
        F.sum("n").alias("unique_timestamp_count"),
        F.max_by("gap", F.when(known, F.struct(F.col("n"), -F.col("gap")))).alias(
            "most_common_delta_hours"
        ),
        F.min("gap").alias("minimum_delta_hours"),
        F.max("gap").alias("maximum_delta_hours"),
        total(F.col("gap") == 1).alias("consecutive_one_hour_intervals"),
        *[total(F.col("gap") > h).alias(name) for name, h in DELTA_THRESHOLDS.items()],
    )
    median = sequences.exact_quantiles(gaps, "gap", {"median_delta_hours": 0.5}, keys=keys)
    if keys:
        return stats.join(median, keys, "left")
    return sequences.attach_row(stats, median)


def horizon_support(
    demand: DataFrame, minutes: Sequence[int] = (30, 60, 120), station: str = "station", time: str = "time"
) -> DataFrame:
    """Pairs of observed rows exactly a horizon apart, per horizon; none means BLOCKED."""
    seconds = F.unix_timestamp(time)
    w = Window.partitionBy(station).orderBy("_s")
    rows = demand.select(station, seconds.alias("_s"))
    flags = rows.select(
        *[
            F.count(F.lit(1)).over(w.rangeBetween(m * 60, m * 60)).alias(f"_m{m}")
            for m in minutes
        ]
    )
    sums = flags.agg(*[F.coalesce(F.sum(f"_m{m}"), F.lit(0)).alias(f"_m{m}") for m in minutes])
    long = sums.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("horizon_minutes"), F.col(f"_m{m}").alias("direct_observed_pairs"))
                    for m in minutes
                ]
            )
        ).alias("h")
    ).select("h.*")
    status = F.when(F.col("direct_observed_pairs") > 0, "PASS").otherwise("BLOCKED")
    return long.withColumn("status", status)


def missingness_classes(
    demand: DataFrame, inactive: DataFrame, coverage: DataFrame, station: str = "station"
) -> DataFrame:
    """Counts and percents of the four states; INACTIVE is decided before ZERO_DEMAND.

    `inactive` lists stations an inventory source reported as out of service; `coverage` supplies
    the hours expected but not observed.
    """
    flagged = inactive.select(station).distinct().withColumn("_off", F.lit(True))
    state = (
        F.when(F.col("_off").isNotNull(), "INACTIVE")
        .when(F.col("total_activity") == 0, "ZERO_DEMAND")
        .otherwise("OBSERVED")
    )
    per_station = demand.groupBy(station, "total_activity").agg(F.count(F.lit(1)).alias("n"))
    observed = (
        per_station.join(flagged, station, "left")
        .groupBy(state.alias("state"))
        .agg(F.sum("n").alias("slots"))
    )
    missing = coverage.agg(
        F.coalesce(F.sum("missing_interval_count"), F.lit(0)).alias("slots")
    ).select(F.lit("MISSING_OR_UNKNOWN").alias("state"), "slots")
    names = demand.sparkSession.createDataFrame(
        [("OBSERVED",), ("ZERO_DEMAND",), ("INACTIVE",), ("MISSING_OR_UNKNOWN",)], "state string"
    )
    counts = names.join(observed.unionByName(missing), "state", "left").select(
        "state", F.coalesce("slots", F.lit(0)).alias("slots")
    )
    share = F.col("slots") / F.sum("slots").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.coalesce(share * 100, F.lit(0.0)))


def identity_matrix(sources: Mapping[str, DataFrame], station: str = "station") -> DataFrame:
    """One row per id: which sources know it, and PARTIAL confidence from two sources on."""
    tagged = None
    for name, df in sources.items():
        part = df.select(F.col(station).cast("string").alias(station), F.lit(name).alias("_src"))
        tagged = part if tagged is None else tagged.unionByName(part)
    present = tagged.where(F.col(station).isNotNull()).groupBy(station).agg(
        *[F.max(F.col("_src") == name).alias(f"in_{name}") for name in sources]
    )
    held = sum((F.col(f"in_{n}").cast("int") for n in sources), F.lit(0))
    return present.withColumn(
        "identity_confidence", F.when(held >= 2, "PARTIAL").otherwise("WEAK")
    )


def identity_counts(matrix: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Ids per source, shared by all, and one-sided differences of the first two (one row)."""
    flags = [F.col(f"in_{n}") for n in sources]
    shared = flags[0]
    for flag in flags[1:]:
        shared = shared & flag
    a, b = flags[0], flags[1]
    return matrix.agg(
        *[F.count_if(F.col(f"in_{n}")).alias(f"{n}_stations") for n in sources],
        F.count_if(shared).alias("common_all"),
        F.count_if(a & ~b).alias(f"{sources[0]}_without_{sources[1]}"),
        F.count_if(b & ~a).alias(f"{sources[1]}_without_{sources[0]}"),
    )


def identity_evidence(snapshots: DataFrame, attributes: Sequence[str], station: str = "station") -> DataFrame:
    """Long form (station, attribute, value, rows): every distinct value each station was seen with.

    The long form keeps stations with very many values out of a single row.
    """
    pairs = [
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes
    ]
    long = snapshots.select(station, F.explode(F.array(*pairs)).alias("p"))
    return (
        long.where(F.col("p.value").isNotNull())
        .groupBy(station, F.col("p.attribute").alias("attribute"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def snapshot_entry_exit(snapshots: DataFrame, station: str = "station", period: str = "period") -> DataFrame:
    """First and last snapshot period per station and how many periods it appears in."""
    return snapshots.groupBy(station).agg(
        F.min(period).alias("first_snapshot"),
        F.max(period).alias("last_snapshot"),
        F.count_distinct(period).alias("periods"),
        F.count(F.lit(1)).alias("rows"),
    )


def snapshot_coverage(snapshots: DataFrame, station: str = "station", period: str = "period") -> DataFrame:
    """Row count, stations and the sorted list of periods (months, so the list is short)."""
    totals = snapshots.agg(
        F.count(F.lit(1)).alias("snapshot_rows"), F.count_distinct(station).alias("stations")
    )
    months = snapshots.select(period).distinct().agg(
        F.sort_array(F.collect_set(period)).alias("periods")
    )
    return sequences.attach_row(totals, months)
