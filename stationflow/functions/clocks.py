"""Civil clocks, UTC instants and calendar columns."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_OFFSET_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"


def _zone(tz: str | Column) -> Column:
    return F.lit(tz) if isinstance(tz, str) else tz


def _shift(t: Column, hours: int) -> Column:
    return t + F.expr(f"INTERVAL {hours} HOURS")


def _wall_clock(text: Column) -> Column:
    """Parse ISO-like text that starts with a full date; anything else is null."""
    text = F.trim(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def has_offset(text: Column) -> Column:
    """True when the text names an instant by itself."""
    return F.trim(text).rlike(r"\d[ T]\d.*" + _OFFSET_SUFFIX)


def strict_utc(text: Column, tz: str | Column) -> Column:
    """Local text to UTC; clocks that occur twice or never, and unreadable text, become null.

    For whole tables prefer `with_strict_utc`, which evaluates each step once.
    """
    wall, zone = _wall_clock(text), _zone(tz)
    utc = F.to_utc_timestamp(wall, zone)
    return _strict(has_offset(text), wall, utc, zone)


def _strict(aware: Column, wall: Column, utc: Column, zone: Column) -> Column:
    # `to_utc_timestamp` takes the first of two readings, so only a later one must be excluded.
    exact = (F.from_utc_timestamp(utc, zone) == wall) & (
        F.from_utc_timestamp(_shift(utc, 1), zone) != wall
    )
    return F.when(aware, wall).when(exact, utc)


def with_strict_utc(df: DataFrame, columns: Mapping[str, str], tz: str | Column) -> DataFrame:
    """Add {instant column: text column} by the strict rule.

    The steps are projections of their own: the optimizer keeps them apart because later steps
    read them more than once, so the text is parsed and converted a single time per row.
    """
    zone = _zone(tz)
    walls = {f"_wall_{n}": _wall_clock(F.col(text)) for n, text in columns.items()}
    readings = {f"_utc_{n}": F.to_utc_timestamp(F.col(f"_wall_{n}"), zone) for n in columns}
    instants = {
        n: _strict(has_offset(F.col(text)), F.col(f"_wall_{n}"), F.col(f"_utc_{n}"), zone)
        for n, text in columns.items()
    }
    staged = df.withColumns(walls).withColumns(readings).withColumns(instants)
    return staged.drop(*walls, *readings)


def with_lenient_utc(df: DataFrame, columns: Mapping[str, str], tz: str | Column) -> DataFrame:
    """Add {name: text column} as `name` and `name_resolution` by the lenient rule: repeated
    clocks take standard time, skipped clocks move forward by the gap. Staged like the strict one."""
    zone = _zone(tz)
    walls = {f"_wall_{n}": _wall_clock(F.col(text)) for n, text in columns.items()}
    readings = {f"_utc_{n}": F.to_utc_timestamp(F.col(f"_wall_{n}"), zone) for n in columns}
    added: dict[str, Column] = {}
    for n, text in columns.items():
        wall, utc, raw = F.col(f"_wall_{n}"), F.col(f"_utc_{n}"), F.col(text)
        blank = raw.isNull() | (raw == "")
        gap = F.from_utc_timestamp(utc, zone) != wall
        later = F.from_utc_timestamp(_shift(utc, 1), zone) == wall
        added[f"{n}_resolution"] = (
            F.when(blank, "missing")
            .when(wall.isNull(), "invalid")
            .when(has_offset(raw), "already_timezone_aware")
            .when(gap, "nonexistent_shifted_forward")
            .when(later, "ambiguous_standard_time")
            .otherwise("normal_local_time")
        )
    staged = df.withColumns(walls).withColumns(readings).withColumns(added)
    instants = {
        n: F.when(F.col(f"{n}_resolution") == "already_timezone_aware", F.col(f"_wall_{n}"))
        .when(F.col(f"{n}_resolution") == "ambiguous_standard_time", _shift(F.col(f"_utc_{n}"), 1))
        .otherwise(F.col(f"_utc_{n}"))
        for n in columns
    }
    return staged.withColumns(instants).drop(*walls, *readings)


def hour_floor(t: Column) -> Column:
    return F.date_trunc("hour", t)


def utc_text(t: Column) -> Column:
    return F.date_format(t, UTC_TEXT)


def local_time(t: Column, tz: str | Column) -> Column:
    return F.from_utc_timestamp(t, _zone(tz))


def local_date(t: Column, tz: str | Column) -> Column:
    return F.date_format(local_time(t, tz), "yyyy-MM-dd")


def local_calendar(t: Column, tz: str | Column) -> dict[str, Column]:
    """The 14 local calendar values of an instant, keyed by output column name."""
    local = local_time(t, tz)
    day_hour = F.hour(local) + F.minute(local) / F.lit(60.0)
    weekday = F.weekday(local)
    month = F.month(local)
    hour_angle = day_hour * (2 * math.pi / 24)
    weekday_angle = weekday * (2 * math.pi / 7)
    month_angle = (month - 1) * (2 * math.pi / 12)
    return {
        "local_hour": F.hour(local),
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "local_weekday": weekday,
        "weekday_sin": F.sin(weekday_angle),
        "weekday_cos": F.cos(weekday_angle),
        "day_of_month": F.dayofmonth(local),
        "month": month,
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
        "year": F.year(local),
        "weekend": weekday >= 5,
        "utc_offset_minutes": ((F.unix_timestamp(local) - F.unix_timestamp(t)) / 60).cast("int"),
        "dst_fold": (local_time(_shift(t, -1), tz) == local).cast("int"),
    }


def target_calendar(t: Column, tz: str | Column) -> dict[str, Column]:
    """Calendar of a forecast target in the provider's zone."""
    local = local_time(t, tz)
    return {
        "hour": F.hour(local),
        "weekday": F.weekday(local),
        "month": F.month(local),
        "day_of_year": F.dayofyear(local),
    }


def snapshot_period(value: Column, year: Column) -> Column:
    """`YYYY-MM` of a period, date, timestamp or {"$date": ..} text; unreadable text is January."""
    inner = F.coalesce(F.get_json_object(value, "$['$date']"), F.trim(value))
    parsed = F.date_format(_wall_clock(inner), "yyyy-MM")
    fallback = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01"))
    return F.when(
        value.isNotNull(),
        F.when(inner.rlike(r"^\d{4}-\d{2}$"), inner).otherwise(F.coalesce(parsed, fallback)),
    )


def shift_hours(t: Column, hours: int) -> Column:
    """t + hours; forecast issue times use a negative shift."""
    return _shift(t, hours)


def shift_minutes(t: Column, minutes: int) -> Column:
    return t + F.expr(f"INTERVAL {minutes} MINUTES")
