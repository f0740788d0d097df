"""Rain association: interval-aligned join, matched strata, monthly diagnostics.

The inputs are network hours, one row per hour of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks
from stationflow.functions.measures import percent_change
from stationflow.operators.canonical import DataRuleError

# Fixed values of the comparison policy.
WET_MM = 0.1
MIN_DRY_HOURS = 3
THRESHOLDS_MM = (0.1, 0.5, 1.0)


def weather_violations(weather: DataFrame, year: int) -> DataFrame:
    """One row: missing and surplus hours of the year, null cells, negative amounts."""
    values = [c for c in weather.columns if c != "time"]
    start = F.lit(f"{year}-01-01 00:00:00").cast("timestamp")
    end = F.lit(f"{year}-12-31 23:00:00").cast("timestamp")
    calendar = weather.sparkSession.range(1).select(
        F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("time"),
        F.lit(1).alias("_due"),
    )
    null = sum((F.col(c).isNull().cast("int") for c in values), F.lit(0))
    negative = F.coalesce((F.col("rain") < 0) | (F.col("precipitation") < 0), F.lit(False))
    hours = weather.groupBy("time").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(null).alias("_null"),
        F.count_if(negative).alias("_negative"),
    )
    both = hours.join(calendar, "time", "full_outer")
    return both.agg(
        F.count_if(F.col("_n").isNull()).alias("missing_hours"),
        F.count_if(F.col("_due").isNull()).alias("hours_outside_year"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_hours"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_values"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_rows"),
    )


def assert_complete_weather(weather: DataFrame, year: int) -> DataFrame:
    """Raise unless the weather covers every hour of the year; nothing is imputed."""
    bad = {k: v for k, v in weather_violations(weather, year).first().asDict().items() if v}
    if bad:
        raise DataRuleError(f"weather is incomplete: {bad}")
    return weather


def join_weather(network: DataFrame, weather: DataFrame, tz: str) -> DataFrame:
    """Trips of [t, t+1h) meet the rain reported at t+1h; adds the local stratum columns."""
    shifted = weather.withColumn("time", clocks.shift_hours(F.col("time"), -1))
    joined = network.join(shifted, "time")
    local = clocks.local_time(F.col("time"), tz)
    return joined.withColumns(
        {
            "month": F.month(local),
            "hour": F.hour(local),
            "weekend": F.weekday(local) >= 5,
            "wet": F.col("rain") >= WET_MM,
            "date": F.date_format(local, "yyyy-MM-dd"),
        }
    )


def assert_unique_hours(*tables: DataFrame) -> None:
    for df in tables:
        if not df.groupBy("time").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise DataRuleError("hours must be unique on both sides of the weather join")


def with_dry_reference(hours: DataFrame, strata: tuple[str, ...]) -> DataFrame:
    """Wet hours with the dry mean of their stratum; strata under three dry hours are left out."""
    dry = (
        hours.where(~F.col("wet"))
        .groupBy(*strata)
        .agg(F.avg("departures").alias("dry_mean"), F.count(F.lit(1)).alias("dry_hours"))
    )
    matched = hours.where("wet").join(dry, list(strata), "left")
    return matched.where(F.col("dry_hours") >= MIN_DRY_HOURS)


def rain_classes(hours: DataFrame) -> DataFrame:
    """Mean, hours and departures of wet and dry hours and the raw change (one row)."""
    wet, dry = F.col("wet"), ~F.col("wet")
    stats = hours.agg(
        F.count(F.lit(1)).alias("joined_hours"),
        F.count_if(wet).alias("rainy_hours"),
        F.count_if(dry).alias("dry_hours"),
        F.avg(F.when(wet, F.col("departures"))).alias("rainy_mean"),
        F.avg(F.when(dry, F.col("departures"))).alias("dry_mean"),
        F.sum(F.when(wet, F.col("departures"))).alias("rainy_total"),
        F.sum(F.when(dry, F.col("departures"))).alias("dry_total"),
    )
    return stats.withColumn("raw_change_pct", percent_change(F.col("rainy_mean"), F.col("dry_mean")))


def matched_rain_effect(hours: DataFrame) -> DataFrame:
    """Wet hours against the dry mean of their month, hour and weekend stratum (one row)."""
    matched = with_dry_reference(hours, ("month", "hour", "weekend"))
    return matched.agg(
        F.count(F.lit(1)).alias("matched_rainy_hours"),
        F.avg("departures").alias("matched_rainy_mean"),
        F.avg("dry_mean").alias("matched_dry_mean"),
    ).withColumn(
        "adjusted_change_pct", percent_change(F.col("matched_rainy_mean"), F.col("matched_dry_mean"))
    )


def assert_comparable(hours: DataFrame) -> DataFrame:
    """Raise when a rain class is empty or no wet hour has a dry reference."""
    classes = rain_classes(hours).first()
    if not classes["rainy_hours"] or not classes["dry_hours"]:
        raise DataRuleError("both rainy and dry hours are needed")
    effect = matched_rain_effect(hours).first()
    if not effect["matched_rainy_hours"] or effect["matched_dry_mean"] <= 0:
        raise DataRuleError("no matched dry reference for the rainy hours")
    return hours


def monthly_rain_means(hours: DataFrame) -> DataFrame:
    return hours.groupBy("month", "wet").agg(
        F.avg("departures").alias("mean"), F.count(F.lit(1)).alias("hours")
    )


def daily_totals(hours: DataFrame) -> DataFrame:
    return hours.groupBy("date").agg(
        F.sum("departures").alias("departures"),
        F.sum("rain").alias("rain"),
        F.avg("temperature_2m").alias("temperature"),
        F.count(F.lit(1)).alias("hours"),
    )


def _month_matched(hours: DataFrame) -> DataFrame:
    return with_dry_reference(hours, ("month", "hour", "weekend"))


def monthly_diagnostics(hours: DataFrame) -> DataFrame:
    """Per month: wet and dry hours, means, totals, raw and adjusted change, daytime share."""
    wet, dry = F.col("wet"), ~F.col("wet")
    day = F.col("hour").between(6, 23).cast("double")

    def over(condition: Column, value: Column, how=F.avg) -> Column:
        return how(F.when(condition, value))

    d, temperature = F.col("departures"), F.col("temperature_2m")
    basic = hours.groupBy("month").agg(
        F.count_if(wet).alias("rainy_hours"),
        F.count_if(dry).alias("dry_hours"),
        F.count_distinct(F.when(wet, F.col("date"))).alias("rainy_days"),
        F.coalesce(over(wet, F.col("rain"), F.sum), F.lit(0.0)).alias("rain_mm"),
        over(wet, d).alias("rainy_mean"),
        over(dry, d).alias("dry_mean"),
        F.coalesce(over(wet, d, F.sum), F.lit(0)).alias("rainy_total"),
        F.coalesce(over(dry, d, F.sum), F.lit(0)).alias("dry_total"),
        (over(wet, day) * 100).alias("rainy_daytime_pct"),
        (over(dry, day) * 100).alias("dry_daytime_pct"),
        over(wet, temperature).alias("rainy_temperature"),
        over(dry, temperature).alias("dry_temperature"),
    )
    matched = _month_matched(hours).groupBy("month").agg(
        F.count(F.lit(1)).alias("matched_hours"),
        F.avg("departures").alias("matched_rainy_mean"),
        F.avg("dry_mean").alias("matched_dry_mean"),
    )
    return (
        basic.join(matched, "month", "left")
        .na.fill(0, ["matched_hours"])
        .withColumns(
            {
                "raw_change_pct": percent_change(F.col("rainy_mean"), F.col("dry_mean")),
                "adjusted_change_pct": percent_change(
                    F.col("matched_rainy_mean"), F.col("matched_dry_mean")
                ),
            }
        )
    )


def rainy_dates(hours: DataFrame) -> DataFrame:
    return hours.where("wet").groupBy("month", "date").agg(
        F.count(F.lit(1)).alias("hours"),
        F.sum("rain").alias("rain_mm"),
        F.sum("departures").alias("departures"),
    )


def leave_one_day_out(hours: DataFrame) -> DataFrame:
    """Per month: range of the adjusted change with one rainy day removed.

    Month totals minus day totals give every remainder, so no day is joined with the others.
    """
    matched = _month_matched(hours)
    per_day = matched.groupBy("month", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("departures").alias("a"), F.sum("dry_mean").alias("b")
    )
    per_month = per_day.groupBy("month").agg(
        F.sum("n").alias("_n"), F.sum("a").alias("_a"), F.sum("b").alias("_b")
    )
    rest = per_day.join(per_month, "month").where(F.col("_n") > F.col("n"))
    left = F.col("_n") - F.col("n")
    change = percent_change((F.col("_a") - F.col("a")) / left, (F.col("_b") - F.col("b")) / left)
    return rest.groupBy("month").agg(
        F.min(change).alias("leave_one_day_out_min"),
        F.max(change).alias("leave_one_day_out_max"),
        F.count(F.lit(1)).alias("days"),
    )


def threshold_sensitivity(hours: DataFrame) -> DataFrame:
    """(month, threshold): matched hours and days at or over it and the adjusted change."""
    levels = F.array(*[F.lit(x) for x in THRESHOLDS_MM])
    months = hours.select("month").distinct().select("month", F.explode(levels).alias("threshold_mm"))
    matched = (
        _month_matched(hours)
        .withColumn("threshold_mm", F.explode(F.filter(levels, lambda x: F.col("rain") >= x)))
        .groupBy("month", "threshold_mm")
        .agg(
            F.count(F.lit(1)).alias("hours"),
            F.count_distinct("date").alias("days"),
            F.avg("departures").alias("_a"),
            F.avg("dry_mean").alias("_b"),
        )
    )
    return months.join(matched, ["month", "threshold_mm"], "left").select(
        "month",
        "threshold_mm",
        F.coalesce("hours", F.lit(0)).alias("hours"),
        F.coalesce("days", F.lit(0)).alias("days"),
        percent_change(F.col("_a"), F.col("_b")).alias("adjusted_change_pct"),
    )
