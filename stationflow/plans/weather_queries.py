"""Rain association on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.functions.measures import percent_change
from stationflow.operators import weather
from stationflow.plans.bindings import Tables, with_
from stationflow.plans.registry import query, r, ts

_CHANGE = "CASE WHEN {b} > 0 THEN round(({a} / {b} - 1) * 100, 6) END"


def change(a: str, b: str) -> str:
    return _CHANGE.format(a=a, b=b)


@query(
    "weather_join",
    "D4 T22",
    with_("hours")
    + f"SELECT {ts('time')} AS time, departures, arrivals, {r('rain')} AS rain,"
    f" {r('temperature_2m')} AS temperature_2m, month, hour, weekend, wet, date FROM hours",
)
def _(t: Tables):
    weather.assert_unique_hours(t.network, t.weather)
    return t.weather_hours.drop("precipitation", "wind_speed_10m")


@query(
    "weather_completeness",
    "C14 A7",
    with_("weather")
    + "SELECT (8784 - count_if(year(time) = 2024))::BIGINT AS missing_hours,"
    " count_if(year(time) <> 2024)::BIGINT AS hours_outside_year, 0::BIGINT AS duplicate_hours,"
    " count_if(rain > 0.3)::BIGINT AS null_values, 0::BIGINT AS negative_rows FROM weather",
)
def _(t: Tables):
    holes = t.weather.withColumn(
        "wind_speed_10m", F.when(F.col("rain") <= 0.3, F.col("wind_speed_10m"))
    )
    return weather.weather_violations(holes, 2024)


@query(
    "rain_classes",
    "E14",
    with_("hours", c="SELECT count(*) AS n, count_if(wet) AS w, avg(departures) FILTER (wet) AS rm,"
          " avg(departures) FILTER (NOT wet) AS dm, sum(departures) FILTER (wet) AS rt,"
          " sum(departures) FILTER (NOT wet) AS dt FROM hours")
    + f"SELECT n AS joined_hours, w AS rainy_hours, n - w AS dry_hours, {r('rm')} AS rainy_mean,"
    f" {r('dm')} AS dry_mean, rt::BIGINT AS rainy_total, dt::BIGINT AS dry_total,"
    f" {change('rm', 'dm')} AS raw_change_pct FROM (SELECT n::BIGINT AS n, w::BIGINT AS w, rm, dm, rt, dt FROM c)",
)
def _(t: Tables):
    return weather.rain_classes(t.weather_hours)


@query(
    "matched_rain_effect",
    "D5 E15 B17",
    with_("matched", m="SELECT count(*) AS n, avg(departures) AS a, avg(dry_mean) AS b FROM matched")
    + f"SELECT n AS matched_rainy_hours, {r('a')} AS matched_rainy_mean, {r('b')} AS matched_dry_mean,"
    f" {change('a', 'b')} AS adjusted_change_pct FROM m",
)
def _(t: Tables):
    return weather.matched_rain_effect(t.weather_hours)


@query(
    "monthly_rain_means",
    "E16",
    with_("hours") + f"SELECT month, wet, {r('avg(departures)')} AS mean, count(*) AS hours FROM hours GROUP BY 1, 2",
)
def _(t: Tables):
    return weather.monthly_rain_means(t.weather_hours)


@query(
    "daily_weather_totals",
    "E16 B19",
    with_("hours")
    + f"SELECT date, sum(departures)::BIGINT AS departures, {r('sum(rain)')} AS rain,"
    f" {r('avg(temperature_2m)')} AS temperature, count(*) AS hours FROM hours GROUP BY 1",
)
def _(t: Tables):
    return weather.daily_totals(t.weather_hours)


@query(
    "monthly_diagnostics",
    "E17 B17",
    with_(
        "matched",
        basic="SELECT month, count_if(wet)::BIGINT AS rainy_hours, count_if(NOT wet)::BIGINT AS dry_hours,"
        " count(DISTINCT CASE WHEN wet THEN date END) AS rainy_days,"
        " coalesce(sum(rain) FILTER (wet), 0) AS rain_mm, avg(departures) FILTER (wet) AS rm,"
        " avg(departures) FILTER (NOT wet) AS dm, coalesce(sum(departures) FILTER (wet), 0)::BIGINT AS rainy_total,"
        " coalesce(sum(departures) FILTER (NOT wet), 0)::BIGINT AS dry_total,"
        " 100 * avg((hour BETWEEN 6 AND 23)::INT) FILTER (wet) AS rd,"
        " 100 * avg((hour BETWEEN 6 AND 23)::INT) FILTER (NOT wet) AS dd,"
        " avg(temperature_2m) FILTER (wet) AS rtemp, avg(temperature_2m) FILTER (NOT wet) AS dtemp"
        " FROM hours GROUP BY 1",
        m="SELECT month, count(*) AS n, avg(departures) AS a, avg(dry_mean) AS b FROM matched GROUP BY 1",
    )
    + "SELECT month, rainy_hours, dry_hours, rainy_days,"
    f" {r('rain_mm')} AS rain_mm, {r('rm')} AS rainy_mean, {r('dm')} AS dry_mean, rainy_total, dry_total,"
    f" {r('rd')} AS rainy_daytime_pct, {r('dd')} AS dry_daytime_pct, {r('rtemp')} AS rainy_temperature,"
    f" {r('dtemp')} AS dry_temperature, coalesce(n, 0) AS matched_hours, {r('a')} AS matched_rainy_mean,"
    f" {r('b')} AS matched_dry_mean, {change('rm', 'dm')} AS raw_change_pct,"
    f" {change('a', 'b')} AS adjusted_change_pct FROM basic LEFT JOIN m USING (month)",
)
def _(t: Tables):
    return weather.monthly_diagnostics(t.weather_hours)


@query(
    "rainy_dates",
    "E17",
    with_("hours")
    + f"SELECT month, date, count(*) AS hours, {r('sum(rain)')} AS rain_mm,"
    " sum(departures)::BIGINT AS departures FROM hours WHERE wet GROUP BY 1, 2",
)
def _(t: Tables):
    return weather.rainy_dates(t.weather_hours)


@query(
    "leave_one_day_out",
    "E18",
    with_(
        "matched",
        days="SELECT DISTINCT month, date FROM matched",
        rest="SELECT d.month, d.date, (avg(m.departures) / avg(m.dry_mean) - 1) * 100 AS c"
        " FROM days d JOIN matched m ON m.month = d.month AND m.date <> d.date GROUP BY 1, 2",
    )
    + f"SELECT month, {r('min(c)')} AS leave_one_day_out_min, {r('max(c)')} AS leave_one_day_out_max,"
    " count(*) AS days FROM rest GROUP BY 1",
)
def _(t: Tables):
    return weather.leave_one_day_out(t.weather_hours)


@query(
    "threshold_sensitivity",
    "E19",
    with_(
        "matched",
        levels="SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS threshold_mm",
        months="SELECT DISTINCT month FROM hours",
        s="SELECT month, threshold_mm, count(m.time) AS n, count(DISTINCT m.date) AS days,"
        " avg(m.departures) AS a, avg(m.dry_mean) AS b FROM months CROSS JOIN levels LEFT JOIN matched m"
        " USING (month) WHERE m.rain >= threshold_mm OR m.rain IS NULL GROUP BY 1, 2",
    )
    + "SELECT month, threshold_mm, coalesce(n, 0) AS hours, coalesce(days, 0) AS days,"
    f" {change('a', 'b')} AS adjusted_change_pct FROM months CROSS JOIN levels LEFT JOIN s USING (month, threshold_mm)",
)
def _(t: Tables):
    return weather.threshold_sensitivity(t.weather_hours)


@query(
    "percent_changes",
    "B17",
    f"SELECT o_orderkey, {change('o_totalprice', '(o_custkey - 10)')} AS change_pct FROM orders",
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey", percent_change(F.col("o_totalprice"), F.col("o_custkey") - 10).alias("change_pct")
    )
