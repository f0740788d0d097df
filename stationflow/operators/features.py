"""Time-exact lags, trailing windows and the dense modelling panel.

Windows are partitioned by station over one row per hour: a station holds at most as many rows as
the calendar has hours. All lookups of one table share a single shuffle and a single sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions import clocks
from stationflow.operators.profiles import covered_hours


def _clock_window(keys: Sequence[str], seconds: str):
    return Window.partitionBy(*keys).orderBy(seconds)


def exact_offset(value: Column, window, seconds: int) -> Column:
    """`value` of the row whose clock is exactly `seconds` away; null when there is none."""
    return F.first(value).over(window.rangeBetween(seconds, seconds))


def with_exact_offsets(
    df: DataFrame, keys: Sequence[str], time: str, lookups: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Add {name: (column, hours)}: the column's value exactly that many hours away."""
    w = _clock_window(keys, "_s")
    added = {
        name: exact_offset(F.col(column), w, int(hours * 3600))
        for name, (column, hours) in lookups.items()
    }
    return df.withColumn("_s", F.unix_timestamp(time)).withColumns(added).drop("_s")


def dense_panel(demand: DataFrame, stations: DataFrame) -> DataFrame:
    """Every cohort station in every hour the network recorded a departure; absent counts are 0.

    The only zero-filling step. The covered hours are one array, as long as the calendar; every
    station explodes it. Stations are dealt out by a fixed number of partitions first, because
    the short station list alone would be merged into a few tasks before it grows.
    """
    hours = covered_hours(demand).agg(F.sort_array(F.collect_set("time"))).scalar()
    tasks = 4 * int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cohort = stations.select("station").distinct().repartition(tasks, "station")
    slots = cohort.select("station", F.explode(hours).alias("time"))
    return slots.join(
        demand.select("time", "station", "departures", "arrivals"), ["time", "station"], "left"
    ).na.fill(0, ["departures", "arrivals"])


def feature_table(panel: DataFrame, horizon: int, tz: str) -> DataFrame:
    """Features known at issue = target - horizon for every target hour; complete rows only.

    Trailing means and sums come from running totals looked up at both ends of the window, which
    costs the same for 24 and for 168 hours; the row counts at the ends prove that no hour is
    missing.
    """
    w = Window.partitionBy("station").orderBy("_s")
    arrivals = F.col("arrivals") if "arrivals" in panel.columns else F.lit(0).cast("bigint")
    rows = panel.select(
        "station", "time", F.col("departures").cast("bigint").alias("y"),
        F.unix_timestamp("time").alias("_s"),
        (F.col("departures") + arrivals).cast("bigint").alias("_moves"),
    )
    running = rows.select(
        "*",
        F.sum("y").over(w).alias("_sum_y"),
        F.sum("_moves").over(w).alias("_sum_m"),
        F.row_number().over(w).alias("_n"),
    )
    newest = (horizon + 1) * 3600
    at_end = F.struct("_sum_y", "_sum_m", "_n")
    before = F.struct(
        (F.col("_sum_y") - F.col("y")).alias("_sum_y"),
        (F.col("_sum_m") - F.col("_moves")).alias("_sum_m"),
        (F.col("_n") - 1).alias("_n"),
    )
    looked = running.withColumns(
        {
            "recent": exact_offset(F.col("y"), w, -newest),
            "previous": exact_offset(F.col("y"), w, -newest - 3600),
            "day": exact_offset(F.col("y"), w, -24 * 3600),
            "week": exact_offset(F.col("y"), w, -168 * 3600),
            "_end": exact_offset(at_end, w, -newest),
            "_24": exact_offset(before, w, -newest - 23 * 3600),
            "_168": exact_offset(before, w, -newest - 167 * 3600),
        }
    )

    def window_sum(start: str, field: str, hours: int) -> Column:
        complete = F.col("_end")["_n"] - F.col(start)["_n"] == hours
        return F.when(complete, F.col("_end")[field] - F.col(start)[field])

    target = F.col("time")
    return looked.select(
        "station",
        clocks.shift_hours(target, -horizon).alias("issue"),
        target.alias("target"),
        "y",
        "recent",
        "previous",
        "day",
        "week",
        (window_sum("_24", "_sum_y", 24) / F.lit(24.0)).alias("mean_24h"),
        (window_sum("_168", "_sum_y", 168) / F.lit(168.0)).alias("mean_7d"),
        window_sum("_24", "_sum_m", 24).alias("movements_24h"),
        *[c.alias(n) for n, c in clocks.target_calendar(target, tz).items()],
    ).dropna(subset=["y", "recent", "previous", "day", "week", "mean_24h", "mean_7d", "movements_24h"])
