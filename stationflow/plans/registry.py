"""Query registration and the common output form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.functions.clocks import UTC_TEXT
from stationflow.plans.bindings import Tables
from stationflow.session import use_utc


@dataclass(frozen=True)
class Registered:
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Registered] = {}


def finish(df: DataFrame) -> DataFrame:
    """Plain output types: bigint, double rounded to six digits, text, boolean; UTC text clocks."""
    columns = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(t, T.DecimalType):
            c = c.cast("double" if t.scale else "bigint")
        elif isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, UTC_TEXT)
        elif isinstance(t, T.ArrayType):
            c = F.concat_ws(",", c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with the operators it exercises."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Tables(use_utc(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Registered(covers, run, sql)
        return fn

    return wrap


def ts(x: str) -> str:
    """SQL text of a timestamp in the output form."""
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
