"""Small fixtures as DataFrames."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

ZONE = "Europe/Paris"
UTC = timezone.utc


def rows(df, *columns):
    """Rows as sorted tuples, instants as naive UTC text."""
    if columns:
        df = df.select(*columns)

    def plain(x):
        if isinstance(x, datetime):
            return (x.astimezone(UTC) if x.tzinfo else x).strftime("%Y-%m-%d %H:%M:%S")
        return x

    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=str)


def one(df) -> dict:
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def hours(start: str, n: int) -> list[datetime]:
    return [at(start) + timedelta(hours=i) for i in range(n)]


def trips(spark, data):
    return spark.createDataFrame(
        data, "started_at string, ended_at string, origin_station string, destination_station string"
    )
