"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stationflow.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` below the shared folder and read it back; survives the loss of any executor."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
