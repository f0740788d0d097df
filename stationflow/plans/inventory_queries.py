"""Inventory samples on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import inventory, sequences
from stationflow.plans.bindings import Tables, with_
from stationflow.plans.registry import query, r, ts

_AUDIT_FIELDS = ("bikes", "capacity", "free")
_STATE_FIELDS = ("bikes", "capacity", "active", "unavailable")


def _unique(t: Tables):
    return inventory.unique_samples(t.inventory, _AUDIT_FIELDS, ["position"])


def _states(t: Tables):
    unique = inventory.unique_samples(t.inventory, _STATE_FIELDS, ["position"], null_is_value=True)
    return inventory.valid_states(unique)


def _occupied(t: Tables):
    return inventory.with_occupancy(t.fine_inventory)


@query(
    "conflicting_keys",
    "E25 C10",
    with_("keys")
    + "SELECT count(*)::BIGINT AS keys, count_if(conflict)::BIGINT AS conflicting_keys,"
    " sum(copies - 1)::BIGINT AS duplicate_rows FROM keys",
)
def _(t: Tables):
    return inventory.conflict_counts(_unique(t))


@query(
    "conflicting_keys_with_nulls",
    "E25",
    with_("keys")
    + "SELECT count(*)::BIGINT AS keys, count_if(strict_conflict)::BIGINT AS conflicting_keys,"
    " sum(copies - 1)::BIGINT AS duplicate_rows FROM keys",
)
def _(t: Tables):
    return inventory.conflict_counts(
        inventory.unique_samples(t.inventory, _STATE_FIELDS, ["position"], null_is_value=True)
    )


@query(
    "agreed_samples",
    "E25 F6 D10",
    with_("agreed")
    + f"SELECT station, {ts('time')} AS time, {r('bikes')} AS bikes, {r('free')} AS free, name FROM agreed",
)
def _(t: Tables):
    return inventory.agreed_samples(_unique(t)).select("station", "time", "bikes", "free", "name")


@query(
    "occupancy_measures",
    "B21",
    with_("occupied")
    + "SELECT valid, is_empty AS \"empty\", is_full AS \"full\", coalesce(ratio < 0.1, false) AS near_empty,"
    f" coalesce(ratio > 0.9, false) AS near_full, {r('ratio')} AS ratio, count(*)::BIGINT AS rows"
    " FROM occupied GROUP BY 1, 2, 3, 4, 5, 6",
)
def _(t: Tables):
    columns = ("valid", "empty", "full", "near_empty", "near_full", "ratio")
    return _occupied(t).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "station_occupancy",
    "E20",
    with_("occupied")
    + "SELECT station, arg_min(name, time) AS name, count(*)::BIGINT AS rows, count(ratio)::BIGINT AS valid_rows,"
    f" {r('avg(ratio)')} AS mean_occupancy, count_if(is_empty)::BIGINT AS empty_samples,"
    " count_if(is_full)::BIGINT AS full_samples, count_if(ratio < 0.1)::BIGINT AS near_empty_samples,"
    " count_if(ratio > 0.9)::BIGINT AS near_full_samples, count_if(unavailable = 1)::BIGINT AS unavailable_samples,"
    f" {r('count_if(is_empty) / nullif(count(ratio), 0)')} AS empty_rate,"
    f" {r('count_if(is_full) / nullif(count(ratio), 0)')} AS full_rate FROM occupied GROUP BY 1",
)
def _(t: Tables):
    return inventory.station_occupancy(_occupied(t))


@query(
    "occupancy_heatmap",
    "E21",
    with_("occupied")
    + f"SELECT station, hour(time) AS hour, {r('avg(ratio)')} AS occupancy, count(ratio) AS samples"
    " FROM occupied GROUP BY 1, 2",
)
def _(t: Tables):
    return inventory.occupancy_heatmap(_occupied(t))


def _profile_sql(bucket: str) -> str:
    return with_("occupied") + (
        f"SELECT CAST({bucket} AS VARCHAR) AS bucket, {r('avg(ratio)')} AS occupancy, count(ratio) AS samples,"
        " count_if(is_empty)::BIGINT AS empty_samples, count_if(is_full)::BIGINT AS full_samples,"
        f" {r('count_if(is_empty) / count(ratio)')} AS empty_rate,"
        f" {r('count_if(is_full) / count(ratio)')} AS full_rate FROM occupied GROUP BY 1"
    )


@query("occupancy_by_hour", "E21", _profile_sql("hour(time)"))
def _(t: Tables):
    return inventory.occupancy_profile(_occupied(t), "hour")


@query("occupancy_by_weekday", "E21", _profile_sql("(isodow(time) - 1)"))
def _(t: Tables):
    return inventory.occupancy_profile(_occupied(t), "weekday")


@query("occupancy_by_month", "E21", _profile_sql("strftime(time, '%Y-%m')"))
def _(t: Tables):
    return inventory.occupancy_profile(_occupied(t), "month")


_BINS = ", ".join(
    f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)"
    for i, (a, b) in enumerate(zip(inventory.histogram_edges(), inventory.histogram_edges()[1:]))
)


@query(
    "occupancy_histogram",
    "E22",
    "WITH q AS (SELECT value / 51 AS ratio FROM events WHERE value <= 51),"
    f" b AS (SELECT * FROM (VALUES {_BINS}) v(bin, bin_from, bin_to))"
    f" SELECT bin::BIGINT AS bin, {r('bin_from')} AS bin_from, {r('bin_to')} AS bin_to, count(ratio) AS count FROM b LEFT JOIN q"
    " ON ratio >= bin_from AND (ratio < bin_to OR (bin = 9 AND ratio <= 1)) GROUP BY 1, 2, 3",
)
def _(t: Tables):
    ratio = F.when(F.col("value") <= 51, F.col("value") / 51)
    return inventory.occupancy_histogram(t.events.select(ratio.alias("ratio")))


@query(
    "inventory_quality",
    "E23",
    with_("inventory")
    + "SELECT count(*)::BIGINT AS rows, count(DISTINCT station)::BIGINT AS stations,"
    " count_if(bikes IS NULL)::BIGINT AS missing_bikes, count_if(capacity IS NULL)::BIGINT AS missing_capacity,"
    " count_if(free IS NULL)::BIGINT AS missing_free, count_if(active IS NULL)::BIGINT AS missing_active,"
    " count_if(unavailable IS NULL)::BIGINT AS missing_unavailable, count_if(bikes < 0)::BIGINT AS negative_bikes,"
    " count_if(bikes > capacity)::BIGINT AS bikes_over_capacity, count_if(capacity <= 0)::BIGINT AS invalid_capacity,"
    " count_if((bikes + free) IS DISTINCT FROM capacity)::BIGINT AS inventory_not_balanced FROM inventory",
)
def _(t: Tables):
    return inventory.inventory_quality(t.inventory)


@query(
    "flag_values",
    "E23",
    with_("inventory")
    + "SELECT 'active' AS flag, active::DOUBLE AS value, count(*) AS rows FROM inventory WHERE active IS NOT NULL"
    " GROUP BY 2 UNION ALL SELECT 'unavailable', unavailable::DOUBLE, count(*) FROM inventory GROUP BY 2",
)
def _(t: Tables):
    return inventory.flag_values(t.inventory)


@query(
    "gap_statistics",
    "E24 F5",
    with_(
        "fine",
        gaps="SELECT epoch_us(time - lag(time) OVER (PARTITION BY station ORDER BY time)) / 60000000.0::DOUBLE"
        " AS gap FROM fine",
    )
    + f"SELECT count(gap) AS gaps, {r('max(gap)')} AS max_gap, count_if(gap > 90)::BIGINT AS over_limit,"
    f" {r('median(gap)')} AS median_gap, {r('quantile_cont(gap, 0.95)')} AS p95_gap FROM gaps",
)
def _(t: Tables):
    return inventory.gap_statistics(t.fine_inventory)


def _runs(event: str) -> dict[str, str]:
    return dict(
        flagged=f"SELECT station, time, {event} AS e, lag({event}) OVER w AS before,"
        " epoch_us(time - lag(time) OVER w) AS gap FROM occupied WINDOW w AS (PARTITION BY station ORDER BY time)",
        numbered="SELECT *, sum((e AND NOT (coalesce(before, false) AND gap > 0 AND gap <= 5400000000))::INT)"
        " OVER (PARTITION BY station ORDER BY time) AS run FROM flagged",
        runs="SELECT station, min(time) AS start_time, max(time) AS end_time, count(*) AS samples,"
        " epoch_us(max(time) - min(time)) / 60000000.0::DOUBLE AS span FROM numbered WHERE e GROUP BY station, run",
    )


_RUN_ROWS = (
    f"SELECT station, {ts('start_time')} AS start, {ts('end_time')} AS \"end\", samples::BIGINT AS samples,"
    f" {r('span')} AS span_minutes FROM runs"
)


def _station_free(t: Tables):
    """All users as one network-wide station: dense samples, so runs grow long and cross days."""
    return _occupied(t).withColumn("station", F.lit("all"))


@query("empty_runs", "F4", with_("occupied", **_runs("is_empty")) + _RUN_ROWS)
def _(t: Tables):
    return sequences.event_runs(_occupied(t), "empty")


@query(
    "available_runs",
    "F4",
    with_("fine", occupied="SELECT 'all' AS station, time, bikes > 0 AS is_available FROM fine", **_runs("is_available"))
    + _RUN_ROWS,
)
def _(t: Tables):
    return sequences.event_runs(_station_free(t).withColumn("available", F.col("bikes") > 0), "available", bucket_hours=0.25)


@query(
    "run_summary",
    "F4 E20",
    with_("occupied", **_runs("is_full"))
    + f"SELECT count(*) AS runs, count_if(samples = 1)::BIGINT AS singleton_runs, {r('sum(span) / 60')}"
    f" AS observed_span_hours, {r('max(span)')} AS max_span_minutes, {r('median(span)')} AS median_span_minutes FROM runs",
)
def _(t: Tables):
    return sequences.run_summary(sequences.event_runs(_occupied(t), "full"))


@query(
    "longest_runs",
    "G3",
    with_("occupied", **_runs("is_full"))
    + _RUN_ROWS
    + " ORDER BY span DESC, station, start_time LIMIT 10",
)
def _(t: Tables):
    return sequences.longest_runs(sequences.event_runs(_occupied(t), "full"))


@query(
    "station_run_counts",
    "D14 E20 F4",
    with_("occupied", **_runs("is_empty"))
    + "SELECT station, count(*) AS rows, coalesce(any_value(n), 0) AS empty_runs FROM occupied LEFT JOIN"
    " (SELECT station, count(*) AS n FROM runs GROUP BY 1) USING (station) GROUP BY 1",
)
def _(t: Tables):
    samples = _occupied(t)
    stats = inventory.with_run_counts(
        inventory.station_occupancy(samples), empty_runs=sequences.event_runs(samples, "empty")
    )
    return stats.select("station", "rows", "empty_runs")


@query(
    "service_states",
    "B16",
    with_("states")
    + f"SELECT station, {ts('time')} AS time, period, service FROM states",
)
def _(t: Tables):
    return _states(t).select("station", "time", "period", "service")


_SUMS = (
    "count(*) AS samples, count_if(is_empty)::BIGINT AS \"empty\", count_if(is_full)::BIGINT AS \"full\","
    f" {r('100.0 * count_if(is_empty) / count(*)')} AS empty_pct, {r('100.0 * count_if(is_full) / count(*)')} AS full_pct"
)


@query(
    "extreme_summary",
    "E26",
    with_("states")
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, {'period' if 'period' in by else 'NULL'} AS period,"
        f" {'service' if 'service' in by else 'NULL'} AS service,"
        f" {'hour' if 'hour' in by else 'NULL'} AS hour, {_SUMS} FROM states"
        + (f" GROUP BY {', '.join(by)}" if by else "")
        for level, by in (
            ("all", ()), ("period", ("period",)), ("service", ("service",)),
            ("period_service", ("period", "service")), ("hour_service", ("hour", "service")),
        )
    ),
)
def _(t: Tables):
    return inventory.extreme_summary(_states(t))


@query(
    "station_extremes",
    "E26",
    with_("states")
    + "SELECT station, arg_min(name, time) AS name, count(*) AS samples, "
    + ", ".join(
        f"count_if(is_{e})::BIGINT AS \"{e}\", {r(f'100.0 * count_if(is_{e}) / count(*)')} AS {e}_pct,"
        f" count_if(is_{e} AND hour < 6)::BIGINT AS {e}_night,"
        f" count_if(is_{e} AND service = 'Flagged inactive/unavailable')::BIGINT AS {e}_flagged"
        for e in ("empty", "full")
    )
    + " FROM states GROUP BY 1",
)
def _(t: Tables):
    return inventory.station_extremes(_states(t))


@query(
    "station_groups",
    "E26",
    with_("states")
    + "SELECT station, period, service, count(*) AS samples, count_if(is_empty)::BIGINT AS \"empty\","
    " count_if(is_full)::BIGINT AS \"full\" FROM states GROUP BY 1, 2, 3",
)
def _(t: Tables):
    return inventory.station_groups(_states(t))


@query("collapsed_groups", "E26", with_("states") + f"SELECT service, {_SUMS} FROM states GROUP BY 1")
def _(t: Tables):
    return inventory.collapse_groups(inventory.station_groups(_states(t)), "service")
