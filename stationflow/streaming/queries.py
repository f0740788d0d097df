"""Streaming forms of two batch operators, and the account of what a stream did with its rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stationflow.operators.trips import explode_events
from stationflow.session import ship_package


# Far behind every event, but within the range of nanosecond clocks: a row at this time lets the watermark
# pass all windows.
CLOSING_TIME = "2262-01-01 00:00:00"


def closed_stream(spark: SparkSession, paths: str, closing: DataFrame, folder: str) -> DataFrame:
    """All files of `paths` as a stream that ends, so that append mode emits every window.

    `closing` is one valid row with the columns of the files and `CLOSING_TIME` as its event time; it is
    written to `folder` and read along. The files and the row are one batch of an `availableNow` run, so the
    order of files drops nothing; the batch without data behind it emits what is still open. The
    window of the closing row itself stays open and is never emitted.
    """
    closing.write.parquet(folder)
    files = spark.readStream.schema(closing.schema).parquet(paths)
    return files.unionByName(spark.readStream.schema(closing.schema).parquet(folder))


def streaming_station_hours(
    marked: DataFrame, record_id: str, lateness: str = "2 hours", account: str | None = None
) -> DataFrame:
    """(time, station, departures, arrivals) in append mode.

    `marked` is a stream from `mark_events`. A record repeated within the lateness counts once; an event
    behind the watermark is left out. With a name for `account`, a `RowAccount` of that name tells how many
    events came in, came late, were duplicates, and went out.
    """
    events = explode_events(marked.withColumn("_id", F.col(record_id)), carry=["_id", "started", "ended"])
    kind = F.when(F.col("departures") == 1, "d").otherwise("a")
    clock = F.when(F.col("departures") == 1, F.col("started")).otherwise(F.col("ended"))
    timed = events.withColumns({"_kind": kind, "event_time": clock})
    if account:
        timed = timed.observe(f"{account}_in", F.count(F.lit(1)).alias("events"))
    unique = timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["_id", "_kind"])
    counts = (
        unique.groupBy(F.window("event_time", "1 hour"), "station")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
        .select(F.col("window.start").alias("time"), "station", "departures", "arrivals")
    )
    if account:
        counts = counts.observe(f"{account}_out", F.coalesce(F.sum(F.col("departures") + F.col("arrivals")), F.lit(0)).alias("events"))
    return counts


class RowAccount(StreamingQueryListener):
    """Where the events of a stream of station hours went, batch by batch, from the engine's own counters.

    A batch tells rows as late by the watermark that the batch before it worked with.

    Add it with `spark.streams.addListener`. Events = late + duplicates + emitted + open, where open ones
    wait in windows that the watermark has not passed. Late rows are dropped before the windows, where
    every row is still one event.
    """

    def __init__(self, account: str):
        self.account = account
        self.batches: dict[int, dict[str, int]] = {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        told = progress.observedMetrics
        if f"{self.account}_in" not in told:
            return
        dropped = [o for o in progress.stateOperators if o.operatorName.startswith("dedupe")]
        self.batches[progress.batchId] = {
            "events": told[f"{self.account}_in"]["events"],
            "late": sum(o.numRowsDroppedByWatermark for o in dropped),
            "duplicates": sum(o.customMetrics.get("numDroppedDuplicateRows", 0) for o in dropped),
            "emitted": told[f"{self.account}_out"]["events"],
        }

    def totals(self) -> dict[str, int]:
        sums = {k: sum(b[k] for b in self.batches.values()) for k in ("events", "late", "duplicates", "emitted")}
        return sums | {"open": sums["events"] - sums["late"] - sums["duplicates"] - sums["emitted"]}


_RUN_STATE = "waiting array<bigint>, kinds array<boolean>, start bigint, end bigint, samples bigint"
_RUN_ROWS = "station string, start timestamp, end timestamp, samples bigint, span_minutes double"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: Any, max_gap: int) -> Iterator[pd.DataFrame]:
    """Runs of one station that the watermark has closed.

    The state holds the samples ahead of the watermark and the run that is open behind it. Those the
    watermark has passed are final: no earlier one can come, so they are taken in order.
    """
    waiting, kinds, start, end, samples = state.get if state.exists else ([], [], 0, 0, 0)
    pairs = list(zip(waiting, kinds))
    for part in parts:
        micros = part["time"].to_numpy().astype("datetime64[us]").astype(np.int64)
        pairs += zip(micros.tolist(), part["event"].fillna(False).astype(bool).tolist())
    mark = state.getCurrentWatermarkMs() * 1000
    pairs.sort()
    runs = []

    def close() -> None:
        nonlocal samples
        if samples:
            runs.append((key[0], start, end, samples))
        samples = 0

    done = 0
    for at, event in pairs:
        if at > mark:
            break
        done += 1
        if samples and not (event and 0 < at - end <= max_gap):
            close()
        if event:
            start, samples = start if samples else at, samples + 1
            end = at
    pairs = pairs[done:]
    if samples and mark >= end + max_gap:
        close()
    if pairs or samples:
        state.update(([p[0] for p in pairs], [p[1] for p in pairs], start, end, samples))
        due = [p[0] for p in pairs[:1]] + [end + max_gap] * bool(samples)
        state.setTimeoutTimestamp(max(min(due) // 1000, mark // 1000 + 1))
    elif state.exists:
        state.remove()
    if runs:
        out = pd.DataFrame(runs, columns=["station", "start", "end", "samples"])
        out["span_minutes"] = (out["end"] - out["start"]) / 60_000_000
        for name in ("start", "end"):
            out[name] = pd.to_datetime(out[name], unit="us", utc=True)
        yield out


def streaming_event_runs(
    samples: DataFrame, lateness: str = "2 hours", max_gap_minutes: float = 90.0, event: str | None = None
) -> DataFrame:
    """Maximal runs of event samples per station in append mode, as `sequences.event_runs` finds them.

    `samples` is a raw stream of `station` and `time`, in any order within the lateness; the boolean
    column `event` tells event samples (all of them if none is named). A run ends at a sample that is
    no event, at a gap over `max_gap_minutes` and at a repeated clock. State is keyed by station and
    holds what the watermark has not passed plus one open run; a timer closes runs of stations
    that fall silent.
    """
    ship_package(samples.sparkSession)
    kind = F.col(event) if event else F.lit(True)
    keyed = samples.select(F.col("station").cast("string").alias("station"), F.col("time").cast("timestamp").alias("time"), kind.alias("event"))
    step = functools.partial(_advance, max_gap=int(max_gap_minutes * 60_000_000))
    return keyed.withWatermark("time", lateness).groupBy("station").applyInPandasWithState(
        step, _RUN_ROWS, _RUN_STATE, "append", "EventTimeTimeout"
    )
