"""Canonical demand, read queries, temporal audits and sequences on the test tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stationflow.operators import audits, canonical, dataset, features, profiles, sequences, splits
from stationflow.plans.bindings import ZONE, Tables, local, with_
from stationflow.plans.registry import query, r, ts
from stationflow.session import shared_dir
from stationflow.sources import commits, lookups


# --- canonical layer ----------------------------------------------------------------------------

_CANONICAL = (
    "SELECT 'demo' AS provider, station AS station_id, time, departures, arrivals,"
    " year(time) AS source_year FROM demand"
)


def _contributions(t: Tables):
    """Every station-hour twice under two spellings of its id."""
    padded = t.user_demand.withColumn("source_year", F.year("time"))
    other = padded.withColumns(
        {"station": F.concat(F.lit("00"), "station"), "source_year": F.col("source_year") + 1}
    )
    return padded.unionByName(other)


@query(
    "canonical_demand",
    "E3 B5 B20",
    with_("user_demand")
    + f"SELECT 'demo' AS provider, station AS station_id, {ts('time')} AS observed_at,"
    " 2 * departures AS departures, 2 * arrivals AS arrivals, 2 * (departures + arrivals) AS total_activity,"
    " 2 * (arrivals - departures) AS net_flow, 2 * departures AS demand, year(time) AS source_year FROM user_demand",
)
def _(t: Tables):
    return canonical.canonical_demand(_contributions(t), "Demo ")


@query(
    "contribution_duplicates",
    "E3 E33",
    with_("user_demand")
    + "SELECT (2 * count(*))::BIGINT AS rows, count(*)::BIGINT AS unique_keys, count(*)::BIGINT AS duplicate_keys,"
    " count(*)::BIGINT AS repeated_keys, 'BLOCKED' AS status FROM user_demand",
)
def _(t: Tables):
    return canonical.contribution_duplicates(_contributions(t))


def _damaged(t: Tables):
    """Canonical rows with broken identities wherever more arrivals than departures occur."""
    rows = canonical.canonical_demand(
        t.user_demand.withColumn("source_year", F.year("time")), "demo"
    )
    more = F.col("arrivals") > F.col("departures")
    return rows.withColumns(
        {
            "net_flow": F.when(more, F.col("net_flow") + 1).otherwise(F.col("net_flow")),
            "total_activity": F.when(F.col("arrivals") > 1, None).otherwise(F.col("total_activity")),
            "station_id": F.when(F.col("departures") > 1, "").otherwise(F.col("station_id")),
        }
    )


@query(
    "count_invariants",
    "C8",
    with_("user_demand")
    + "SELECT count(*)::BIGINT AS rows, count_if(departures > 1)::BIGINT AS null_key, 0::BIGINT AS negative_counts,"
    " count_if(arrivals > 1)::BIGINT AS total_activity, count_if(arrivals > departures)::BIGINT AS net_flow,"
    " 0::BIGINT AS demand FROM user_demand",
)
def _(t: Tables):
    return canonical.count_violations(_damaged(t), canonical.canonical_rules())


@query(
    "offending_rows",
    "C8 G4",
    with_(
        "user_demand",
        damaged="SELECT 'demo' AS provider, CASE WHEN departures > 1 THEN '' ELSE station END AS station_id,"
        " time AS observed_at, departures, arrivals, year(time)::BIGINT AS source_year,"
        " CASE WHEN arrivals <= 1 THEN departures + arrivals END AS total_activity,"
        " arrivals - departures + (arrivals > departures)::BIGINT AS net_flow, departures AS demand FROM user_demand",
    )
    + f"SELECT provider, station_id, {ts('observed_at')} AS observed_at, departures, arrivals, source_year,"
    " total_activity, net_flow, demand, concat_ws(',', CASE WHEN departures > 1 THEN 'null_key' END,"
    " CASE WHEN arrivals > 1 THEN 'total_activity' END, CASE WHEN arrivals > departures THEN 'net_flow' END)"
    " AS broken_rules FROM damaged d WHERE departures > 1 OR arrivals > 1 OR arrivals > departures"
    " ORDER BY provider, station_id, d.observed_at, departures, arrivals, source_year,"
    " total_activity NULLS FIRST, net_flow, demand LIMIT 10",
)
def _(t: Tables):
    return canonical.offending_rows(_damaged(t), canonical.canonical_rules())


@query(
    "document_quality",
    "C10",
    "SELECT (SELECT count(*) - count(DISTINCT (source, lang, n_chars)) FROM documents)::BIGINT AS duplicate_rows,"
    " (SELECT count(*) FROM documents WHERE source IS NULL)"
    " + (SELECT count(*) FROM documents WHERE lang IS NULL)"
    " + (SELECT count(*) FROM documents WHERE n_chars IS NULL)::BIGINT AS missing_values,"
    " (SELECT count(*) FROM documents)::BIGINT AS invalid_timestamps, 0::BIGINT AS negative_demand,"
    " 'FAIL' AS status",
)
def _(t: Tables):
    return canonical.quality_report(
        t.table("documents").select("source", "lang", "n_chars"), timestamp="lang", demand="n_chars"
    )


@query(
    "duplicate_keys",
    "E33",
    "WITH c AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2)"
    " SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS unique_keys, sum(n - 1)::BIGINT AS duplicate_keys,"
    " count_if(n > 1)::BIGINT AS repeated_keys, 'BLOCKED' AS status FROM c",
)
def _(t: Tables):
    return canonical.duplicate_keys(t.lineitem, ["l_suppkey", "l_shipdate"])


_WORDS = ", '|', ".join(
    f"CAST(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS VARCHAR)" for i in range(8)
)


@query(
    "content_digest",
    "E30",
    with_(
        "demand",
        fields=f"SELECT station AS a, {ts('time')} AS b, departures::VARCHAR AS c, arrivals::VARCHAR AS d FROM demand",
        hashed="SELECT sha256(concat_ws('|', 'v' || length(a) || ':' || a, 'v' || length(b) || ':' || b,"
        " 'v' || length(c) || ':' || c, 'v' || length(d) || ':' || d)) AS h FROM fields",
    )
    + f"SELECT count(*)::BIGINT AS rows, sha256(concat(count(*), '|', {_WORDS})) AS digest FROM hashed",
)
def _(t: Tables):
    text = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = t.demand.select("station", text.alias("time"), "departures", "arrivals")
    return canonical.content_digest(rows, ["station", "time", "departures", "arrivals"])


def _other_store(t: Tables):
    """The user demand without its afternoon rows, with extra rows and some changed values."""
    d = t.user_demand
    kept = d.where(F.hour("time") < 18).withColumn(
        "arrivals", F.when(F.col("departures") > 0, None).otherwise(F.col("arrivals"))
    )
    moved = d.where(F.hour("time") >= 18).withColumn("time", F.col("time") + F.expr("INTERVAL 1 YEAR"))
    return kept.unionByName(moved)


_STORE_COUNTS = (
    "SELECT count_if(hour(time) >= 18)::BIGINT AS left_only, count_if(hour(time) >= 18)::BIGINT AS right_only,"
    " count_if(hour(time) < 18)::BIGINT AS common, 0::BIGINT AS departures_differs,"
    " count_if(hour(time) < 18 AND departures > 0)::BIGINT AS arrivals_differs FROM user_demand"
)


@query("store_comparison", "D8 D9", with_("user_demand") + _STORE_COUNTS)
def _(t: Tables):
    return canonical.compare_stores(
        t.user_demand, _other_store(t), ["time", "station"], ["departures", "arrivals"]
    )


@query(
    "one_sided_keys",
    "D8",
    with_("user_demand")
    + f"SELECT {ts('time')} AS time, station, 'left_only' AS side FROM user_demand WHERE hour(time) >= 18"
    f" UNION ALL SELECT {ts('time + INTERVAL 1 YEAR')}, station, 'right_only' FROM user_demand WHERE hour(time) >= 18",
)
def _(t: Tables):
    return canonical.one_sided_keys(t.user_demand, _other_store(t), ["time", "station"])


_A, _B = "SELECT DISTINCT o_custkey AS k FROM orders", (
    "SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS k FROM customer"
)


def _key_sets(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("k"))
    other = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    b = t.table("customer").select(other.alias("k"))
    return a, b


@query("key_intersection", "H3", f"SELECT k FROM ({_A}) INTERSECT SELECT k FROM ({_B})")
def _(t: Tables):
    return canonical.key_intersection(*_key_sets(t), ["k"])


@query("key_difference", "H4", f"SELECT k FROM ({_A}) EXCEPT SELECT k FROM ({_B})")
def _(t: Tables):
    return canonical.key_difference(*_key_sets(t), ["k"])


@query("key_union", "H5", f"SELECT k FROM ({_A}) UNION SELECT k FROM ({_B})")
def _(t: Tables):
    return canonical.key_union(*_key_sets(t), ["k"])


@query(
    "key_subset",
    "H6",
    f"SELECT count(*)::BIGINT AS missing_keys, count(*) = 0 AS is_subset FROM ({_A}) a WHERE k NOT IN ({_B})",
)
def _(t: Tables):
    return canonical.is_subset(*_key_sets(t), ["k"])


# --- read queries -------------------------------------------------------------------------------


def _profile_sql(bucket: str, where: str = "") -> str:
    return with_("user_demand" if not where else "demand") + (
        f"SELECT ({bucket})::BIGINT AS bucket, count(*)::BIGINT AS observed_rows,"
        f" {r('avg(departures)')} AS mean_departures, sum(departures)::BIGINT AS total_departures,"
        f" {r('avg(arrivals)')} AS mean_arrivals FROM {'user_demand' if not where else 'demand'} {where} GROUP BY 1"
    )


@query("profile_by_hour", "E9", _profile_sql("hour(time)"))
def _(t: Tables):
    return profiles.calendar_profile(t.user_demand, "hour")


@query("profile_by_weekday", "E9", _profile_sql("dayofweek(time)"))
def _(t: Tables):
    return profiles.calendar_profile(t.user_demand, "weekday")


@query("profile_by_week", "E9", _profile_sql("weekofyear(time)"))
def _(t: Tables):
    return profiles.calendar_profile(t.user_demand, "week")


@query("profile_by_month", "E9", _profile_sql("month(time)", "WHERE station = 'click'"))
def _(t: Tables):
    return profiles.calendar_profile(t.demand, "month", station="click")


def _local_sql(bucket: str) -> str:
    return with_("user_demand") + (
        f"SELECT CAST({bucket} AS VARCHAR) AS bucket, sum(departures)::BIGINT AS departures,"
        " sum(arrivals)::BIGINT AS arrivals, count(*)::BIGINT AS rows,"
        f" {r('sum(departures) / count(*)')} AS mean_departures FROM user_demand GROUP BY 1"
    )


@query("local_profile_by_hour", "E10", _local_sql(f"hour({local('time')})"))
def _(t: Tables):
    return profiles.local_profile(t.user_demand, "hour", ZONE)


@query("local_profile_by_weekday", "E10", _local_sql(f"(isodow({local('time')}) - 1)"))
def _(t: Tables):
    return profiles.local_profile(t.user_demand, "weekday", ZONE)


@query("local_profile_by_month", "E10", _local_sql(f"strftime({local('time')}, '%Y-%m')"))
def _(t: Tables):
    return profiles.local_profile(t.user_demand, "month", ZONE)


@query(
    "coverage_summary",
    "E8",
    with_("user_demand")
    + "SELECT count(*)::BIGINT AS station_hours, count(DISTINCT station)::BIGINT AS stations,"
    f" count(DISTINCT time)::BIGINT AS hours, {ts('min(time)')} AS first_time, {ts('max(time)')} AS last_time,"
    " sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals,"
    " sum(departures + arrivals)::BIGINT AS total_activity, sum(arrivals - departures)::BIGINT AS net_flow"
    " FROM user_demand",
)
def _(t: Tables):
    return profiles.coverage_summary(t.user_demand)


@query("network_hours", "E5", with_("network") + f"SELECT {ts('time')} AS time, departures, arrivals FROM network")
def _(t: Tables):
    return t.network


@query(
    "covered_hours",
    "C4",
    with_("network") + f"SELECT {ts('time')} AS time, departures, arrivals FROM network WHERE departures > 0",
)
def _(t: Tables):
    return profiles.covered_hours(t.demand)


def _ranking_sql(value: str, limit: int = 20) -> str:
    return with_("user_demand") + (
        f"SELECT station, sum({value})::BIGINT AS value, count(*)::BIGINT AS observed_rows FROM user_demand"
        f" GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"
    )


@query("station_ranking", "E11 G2", _ranking_sql("departures"))
def _(t: Tables):
    return profiles.station_ranking(t.user_demand)


@query("station_ranking_by_activity", "E11 G2", _ranking_sql("departures + arrivals", 50))
def _(t: Tables):
    return profiles.station_ranking(t.user_demand, "activity", 50)


@query(
    "hourly_series",
    "E12 C6",
    with_("user_demand")
    + f"SELECT {ts('time')} AS time, sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals,"
    " count(*)::BIGINT AS observed_station_hours FROM user_demand WHERE time >= TIMESTAMP '2024-01-05 10:00'"
    " AND time < TIMESTAMP '2024-01-20' GROUP BY 1",
)
def _(t: Tables):
    start = datetime(2024, 1, 5, 10, tzinfo=timezone.utc)
    return profiles.hourly_series(t.user_demand, start, datetime(2024, 1, 20, tzinfo=timezone.utc))


@query(
    "latest_history",
    "G1",
    with_("user_demand")
    + f"SELECT {ts('time')} AS time, station, departures, arrivals FROM user_demand u"
    " ORDER BY u.time DESC, station LIMIT 100",
)
def _(t: Tables):
    return profiles.latest_history(t.user_demand)


@query(
    "rectangle_coverage",
    "E13",
    with_("user_demand")
    + "SELECT count(*)::BIGINT AS rows, count(DISTINCT station)::BIGINT AS stations,"
    " count(DISTINCT time)::BIGINT AS unique_hours, count_if(departures = 0)::BIGINT AS zero_departure_rows,"
    " (date_diff('hour', min(time), max(time)) + 1)::BIGINT AS calendar_hours,"
    " (date_diff('hour', min(time), max(time)) + 1 - count(DISTINCT time))::BIGINT AS missing_global_hours,"
    f" {r("count(*)::DOUBLE / ((date_diff('hour', min(time), max(time)) + 1) * count(DISTINCT station))")}"
    " AS full_rectangle_coverage FROM user_demand",
)
def _(t: Tables):
    return profiles.rectangle_coverage(t.user_demand)


_OUTLOOK = with_(
    "user_demand",
    p="SELECT hour(time) AS h, avg(departures) AS d, avg(arrivals) AS a, count(*) AS n FROM user_demand GROUP BY 1",
    o="SELECT i AS position, (i + 17) % 24 AS h FROM range(24) x(i)",
)


@query(
    "outlook",
    "E45",
    _OUTLOOK
    + f"SELECT position::BIGINT AS position, h::BIGINT AS hour, {r('d')} AS departures, {r('a')} AS arrivals,"
    " coalesce(n, 0)::BIGINT AS rows FROM o LEFT JOIN p USING (h)",
)
def _(t: Tables):
    return profiles.outlook(profiles.calendar_profile(t.user_demand, "hour"), 17)


@query(
    "outlook_summary",
    "E45",
    _OUTLOOK
    + f"SELECT {r('sum(coalesce(d, 0))')} AS total_departures,"
    " arg_max(h, (coalesce(d, -1), -position))::BIGINT AS peak_hour FROM o LEFT JOIN p USING (h)",
)
def _(t: Tables):
    return profiles.outlook_summary(profiles.outlook(profiles.calendar_profile(t.user_demand, "hour"), 17))


@query(
    "stations_with_observations",
    "D7",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)",
)
def _(t: Tables):
    stations = t.supplier.select(F.col("s_suppkey").alias("station"), "s_name")
    observed = t.lineitem.select(F.col("l_suppkey").alias("station"))
    return profiles.stations_with_observations(stations, observed).withColumnRenamed("station", "s_suppkey")


@query(
    "keyed_lookup",
    "A16",
    with_("demand")
    + f"SELECT DISTINCT station, {ts('d.time')} AS time, departures FROM demand d JOIN events e"
    " ON e.event_type = d.station AND date_trunc('hour', e.ts)"
    " + CASE WHEN e.value > 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 400 DAY END = d.time",
)
def _(t: Tables):
    # One key per event: an hour with demand, or one long after all demand.
    hour = F.date_trunc("hour", "ts")
    late = F.when(F.col("value") > 30, hour + F.expr("INTERVAL 1 HOUR")).otherwise(hour + F.expr("INTERVAL 400 DAY"))
    keys = t.events.select(F.col("event_type").alias("station"), late.alias("time"))
    return dataset.keyed_lookup(t.demand.drop("arrivals"), keys, ["station", "time"])


def _stored_demand(t: Tables) -> str:
    """The demand of users laid out by station, then once more with one station's departures raised."""
    store = shared_dir(t.spark, "lookups")
    demand = t.user_demand
    lookups.save_keyed_table(demand, store, "demand", ["station"], 32)
    raised = F.when(F.col("station") == "7", F.col("departures") + 1).otherwise(F.col("departures"))
    lookups.save_keyed_table(demand.withColumn("departures", raised), store, "demand", ["station"], 32)
    return store


@query(
    "stored_lookup",
    "A16 D15",
    with_("user_demand")
    + f"SELECT 'one' AS way, station, {ts('time')} AS time, departures + (station = '7')::BIGINT AS departures FROM user_demand"
    f" WHERE station = '7' UNION ALL SELECT 'many', station, {ts('time')}, departures + (station = '7')::BIGINT FROM user_demand"
    " WHERE station IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE value > 50)",
)
def _(t: Tables):
    store = _stored_demand(t)
    one = lookups.lookup(t.spark, store, "demand", {"station": 7})
    wanted = t.events.where("value > 50").select(F.col("user_id").cast("string").alias("station"))
    many = lookups.lookup_many(t.spark, store, "demand", wanted)
    both = one.withColumn("way", F.lit("one")).unionByName(many.withColumn("way", F.lit("many")))
    return both.select("way", "station", "time", "departures")


@query(
    "version_difference",
    "E30 E46 D8 D9",
    with_("user_demand")
    + f"SELECT c.change, station, {ts('time')} AS time, departures + c.more AS departures, arrivals, 1::BIGINT AS copies"
    " FROM user_demand, (VALUES ('removed', 0), ('added', 1)) c(change, more) WHERE station = '7'",
)
def _(t: Tables):
    store = _stored_demand(t)
    first, second = (commits.snapshot(t.spark, store, k) for k in (1, 2))
    rows = lookups.changed_rows(t.spark, store, "demand", first, second)
    return rows.select("change", "station", "time", "departures", "arrivals", "copies")


@query(
    "dataset_catalog",
    "A15",
    "SELECT DISTINCT 'demo' AS provider_id, o_orderpriority AS network_id, year(o_orderdate) AS year FROM orders",
)
def _(t: Tables):
    rows = t.orders.select(
        F.lit("demo").alias("provider_id"),
        F.col("o_orderpriority").alias("network_id"),
        F.col("o_orderdate").alias("observed_at"),
    )
    return dataset.dataset_catalog(rows)


# --- temporal audits ----------------------------------------------------------------------------

_GAPS = (
    "SELECT station, time, departures + arrivals AS total_activity, date_diff('hour', lag(time) OVER"
    " (PARTITION BY station ORDER BY time), time) AS gap FROM user_demand"
)
_COVERAGE = (
    "SELECT station, min(time) AS first_time, max(time) AS last_time, count(*) AS n,"
    " date_diff('hour', min(time), max(time)) + 1 AS expected, coalesce(max(gap), 0) AS longest,"
    " count_if(total_activity = 0) AS zeros FROM gaps GROUP BY 1"
)


def _coverage(t: Tables):
    return audits.station_coverage(profiles.with_measures(t.user_demand))


@query(
    "station_coverage",
    "E27 F5",
    with_("user_demand", gaps=_GAPS, coverage=_COVERAGE)
    + f"SELECT station, {ts('first_time')} AS first_observed_at, {ts('last_time')} AS last_observed_at,"
    f" n::BIGINT AS observation_count, {r('longest')} AS longest_missing_interval_hours,"
    f" zeros::BIGINT AS zero_demand_count, expected::BIGINT AS expected_hourly_observations,"
    f" {r('n::DOUBLE / expected')} AS observed_coverage_ratio,"
    f" (expected - n)::BIGINT AS missing_interval_count, {r('zeros::DOUBLE / n')} AS zero_demand_ratio FROM coverage",
)
def _(t: Tables):
    return _coverage(t)


_QUANTILES = ", ".join(
    f"round(quantile_cont(v, {p}), 6) AS {name}"
    for name, p in (("min", "0.0"), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", "1.0"))
)


@query(
    "coverage_distribution",
    "E28",
    with_(
        "user_demand",
        gaps=_GAPS,
        coverage=_COVERAGE,
        long="SELECT 'observation_count' AS measure, n::DOUBLE AS v FROM coverage UNION ALL"
        " SELECT 'expected_hourly_observations', expected::DOUBLE FROM coverage UNION ALL"
        " SELECT 'missing_interval_count', (expected - n)::DOUBLE FROM coverage UNION ALL"
        " SELECT 'observed_coverage_ratio', n::DOUBLE / expected FROM coverage",
    )
    + f"SELECT measure, {_QUANTILES} FROM long GROUP BY 1",
)
def _(t: Tables):
    return audits.coverage_distribution(_coverage(t))


@query(
    "coverage_thresholds",
    "E28",
    with_("user_demand", gaps=_GAPS, coverage=_COVERAGE)
    + "SELECT count(*)::BIGINT AS stations, count_if(n < 10)::BIGINT AS under_10_observations,"
    " count_if(n < 24)::BIGINT AS under_24_observations, count_if(expected < 168)::BIGINT AS under_7_days,"
    " count_if(expected < 720)::BIGINT AS under_30_days, count_if(expected < 2160)::BIGINT AS under_90_days,"
    " count_if(n / expected < 0.9)::BIGINT AS under_90_percent,"
    " count_if(n / expected < 0.5)::BIGINT AS under_50_percent FROM coverage",
)
def _(t: Tables):
    return audits.coverage_thresholds(_coverage(t))


def _delta_sql(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    select = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return with_(
        "user_demand",
        distinct_times=f"SELECT DISTINCT {select}time FROM user_demand",
        gaps=f"SELECT {select}date_diff('hour', lag(time) OVER ({part}ORDER BY time), time)::DOUBLE AS gap"
        " FROM distinct_times",
        modes=f"SELECT {select}gap AS mode_gap FROM gaps WHERE gap IS NOT NULL GROUP BY {select}gap QUALIFY"
        f" row_number() OVER ({part}ORDER BY count(*) DESC, gap) = 1",
    ) + (
        f"SELECT {select}count(*)::BIGINT AS unique_timestamp_count, any_value(mode_gap) AS most_common_delta_hours,"
        " min(gap) AS minimum_delta_hours, max(gap) AS maximum_delta_hours,"
        f" {r('median(gap)')} AS median_delta_hours,"
        " count_if(gap = 1)::BIGINT AS consecutive_one_hour_intervals, count_if(gap > 1)::BIGINT AS gaps_gt_1h,"
        " count_if(gap > 6)::BIGINT AS gaps_gt_6h, count_if(gap > 24)::BIGINT AS gaps_gt_24h,"
        " count_if(gap > 48)::BIGINT AS gaps_gt_48h, count_if(gap > 168)::BIGINT AS gaps_gt_7d FROM gaps"
        + (f" LEFT JOIN modes USING ({keys})" if keys else " CROSS JOIN modes")
        + group
    )


@query("delta_statistics", "E29 F5", _delta_sql(""))
def _(t: Tables):
    return audits.delta_statistics(t.user_demand)


@query("station_delta_statistics", "E29 F5", _delta_sql("station"))
def _(t: Tables):
    return audits.delta_statistics(t.user_demand, keys=["station"])


_PAIRS = " UNION ALL ".join(
    f"SELECT {m}::BIGINT AS horizon_minutes, (SELECT count(*) FROM user_demand a JOIN user_demand b"
    f" ON a.station = b.station AND b.time = a.time + INTERVAL {m} MINUTE)::BIGINT AS direct_observed_pairs"
    for m in (30, 60, 120)
)


@query(
    "horizon_support",
    "E32 D1",
    with_("user_demand", pairs=_PAIRS)
    + "SELECT *, CASE WHEN direct_observed_pairs > 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM pairs",
)
def _(t: Tables):
    return audits.horizon_support(t.user_demand)


@query(
    "missingness_classes",
    "E31",
    with_(
        "user_demand",
        gaps=_GAPS,
        coverage=_COVERAGE,
        off="SELECT DISTINCT CAST(user_id AS VARCHAR) AS station FROM events WHERE value > 100",
        s="SELECT CASE WHEN station IN (SELECT station FROM off) THEN 'INACTIVE' WHEN departures + arrivals = 0"
        " THEN 'ZERO_DEMAND' ELSE 'OBSERVED' END AS state FROM user_demand",
        c="SELECT state, count(s.state) AS slots FROM (VALUES ('OBSERVED'), ('ZERO_DEMAND'), ('INACTIVE')) v(state)"
        " LEFT JOIN s USING (state) GROUP BY 1 UNION ALL"
        " SELECT 'MISSING_OR_UNKNOWN', sum(expected - n) FROM coverage",
    )
    + f"SELECT state, slots::BIGINT AS slots, {r('100.0 * slots / sum(slots) OVER ()')} AS percent FROM c",
)
def _(t: Tables):
    demand = profiles.with_measures(t.user_demand)
    # Ids below zero belong to no station.
    inactive = F.when(F.col("value") > 100, F.col("user_id")).otherwise(-1 - F.col("user_id"))
    off = t.events.select(inactive.cast("string").alias("station"))
    return audits.missingness_classes(demand, off, _coverage(t))


def _identity_sources(t: Tables):
    return {
        "demand": t.orders.select(F.col("o_custkey").alias("station")),
        "snapshot": t.lineitem.select(F.col("l_suppkey").alias("station")),
        "master": t.table("customer").select(
            F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("station")
        ),
    }


_IDENTITY = (
    "WITH s AS (SELECT o_custkey AS station, 1 AS d, 0 AS p, 0 AS m FROM orders UNION ALL"
    " SELECT l_suppkey, 0, 1, 0 FROM lineitem UNION ALL"
    " SELECT CASE WHEN c_acctbal > 5000 THEN c_custkey ELSE -c_custkey END, 0, 0, 1 FROM customer),"
    " i AS (SELECT CAST(station AS VARCHAR) AS station, max(d) = 1 AS in_demand, max(p) = 1 AS in_snapshot,"
    " max(m) = 1 AS in_master, max(d) + max(p) + max(m) AS held FROM s GROUP BY 1) "
)


@query(
    "identity_matrix",
    "D13 H5",
    _IDENTITY
    + "SELECT station, in_demand, in_snapshot, in_master,"
    " CASE WHEN held >= 2 THEN 'PARTIAL' ELSE 'WEAK' END AS identity_confidence FROM i",
)
def _(t: Tables):
    return audits.identity_matrix(_identity_sources(t))


@query(
    "identity_counts",
    "D13 H3 H4",
    _IDENTITY
    + "SELECT count_if(in_demand)::BIGINT AS demand_stations, count_if(in_snapshot)::BIGINT AS snapshot_stations,"
    " count_if(in_master)::BIGINT AS master_stations, count_if(held = 3)::BIGINT AS common_all,"
    " count_if(in_demand AND NOT in_snapshot)::BIGINT AS demand_without_snapshot,"
    " count_if(in_snapshot AND NOT in_demand)::BIGINT AS snapshot_without_demand FROM i",
)
def _(t: Tables):
    sources = _identity_sources(t)
    return audits.identity_counts(audits.identity_matrix(sources), list(sources))


@query(
    "identity_evidence",
    "E43",
    "WITH l AS (SELECT l_suppkey AS station, unnest(['flag', 'status', 'period']) AS attribute,"
    " unnest([l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m')]) AS value FROM lineitem)"
    " SELECT station, attribute, value, count(*)::BIGINT AS rows FROM l GROUP BY 1, 2, 3",
)
def _(t: Tables):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("station"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
    )
    return audits.identity_evidence(rows, ["flag", "status", "period"])


def _periods(t: Tables):
    return t.lineitem.select(
        F.col("l_suppkey").alias("station"), F.date_format("l_shipdate", "yyyy-MM").alias("period")
    )


@query(
    "snapshot_entry_exit",
    "E42",
    "WITH p AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem)"
    " SELECT station, min(period) AS first_snapshot, max(period) AS last_snapshot,"
    " count(DISTINCT period)::BIGINT AS periods, count(*)::BIGINT AS rows FROM p GROUP BY 1",
)
def _(t: Tables):
    return audits.snapshot_entry_exit(_periods(t))


@query(
    "snapshot_coverage",
    "E42",
    "WITH p AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem)"
    " SELECT count(*)::BIGINT AS snapshot_rows, count(DISTINCT station)::BIGINT AS stations,"
    " string_agg(DISTINCT period, ',' ORDER BY period) AS periods FROM p",
)
def _(t: Tables):
    return audits.snapshot_coverage(_periods(t))


# --- sequences and splits -----------------------------------------------------------------------


@query(
    "row_offset_lags",
    "F1",
    with_("user_demand")
    + f"SELECT {ts('time')} AS time, station, departures, arrivals,"
    " lag(departures, 1) OVER w AS departures_lag_1, lag(departures, 24) OVER w AS departures_lag_24"
    " FROM user_demand u WINDOW w AS (PARTITION BY station ORDER BY u.time)",
)
def _(t: Tables):
    return sequences.row_offset_lags(t.user_demand, "departures", "station", "time", [1, 24])


@query(
    "sample_gaps",
    "F5",
    "SELECT event_id, round(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 60000000.0, 6)"
    " AS gap_minutes FROM events",
)
def _(t: Tables):
    rows = t.events.select(F.col("user_id").alias("station"), F.col("ts").alias("time"), "event_id")
    return sequences.gap_minutes(rows, "station", "time").select("event_id", "gap_minutes")


@query(
    "first_and_last_rows",
    "F6",
    "SELECT l_suppkey, l_orderkey AS first_order, (SELECT max(l_orderkey) FROM lineitem b WHERE"
    " b.l_suppkey = a.l_suppkey) AS last_order FROM lineitem a QUALIFY row_number() OVER"
    " (PARTITION BY l_suppkey ORDER BY l_orderkey) = 1",
)
def _(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey")
    first = sequences.one_row_per_key(rows, ["l_suppkey"], ["l_orderkey"])
    last = sequences.one_row_per_key(rows, ["l_suppkey"], ["l_orderkey"], keep="last")
    return first.withColumnRenamed("l_orderkey", "first_order").join(
        last.withColumnRenamed("l_orderkey", "last_order"), "l_suppkey"
    )


@query(
    "row_fraction_split",
    "F7",
    with_(
        "network",
        ranked="SELECT time, row_number() OVER (ORDER BY time) AS i, count(*) OVER () AS n FROM network",
    )
    + f"SELECT {ts('time')} AS time, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train'"
    " WHEN i <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ranked",
)
def _(t: Tables):
    return splits.row_fraction_split(splits.check_series(t.network)).select("time", "split")


_BOUNDS = dict(
    times="SELECT DISTINCT time FROM user_demand",
    ranked="SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM times",
    cut="SELECT max(CASE WHEN i = greatest(0, floor(n * 0.70::DOUBLE) - 1) THEN time END) AS train_end,"
    " max(CASE WHEN i = greatest(1, floor(n * 0.85::DOUBLE) - 1) THEN time END) AS validation_end,"
    " min(time) AS first_time, max(time) AS last_time FROM ranked",
)


@query(
    "split_boundaries",
    "F8",
    with_("user_demand", **_BOUNDS)
    + f"SELECT {ts('first_time')} AS train_start, {ts('train_end')} AS train_end,"
    f" {ts('(SELECT min(time) FROM times WHERE time > train_end)')} AS validation_start,"
    f" {ts('validation_end')} AS validation_end,"
    f" {ts('(SELECT min(time) FROM times WHERE time > validation_end)')} AS test_start,"
    f" {ts('last_time')} AS test_end FROM cut",
)
def _(t: Tables):
    return splits.split_boundaries(t.user_demand, "time")


@query(
    "split_purge",
    "F8 C12 B22",
    with_("user_demand", **_BOUNDS)
    + "SELECT CASE WHEN time <= train_end THEN 'train' WHEN time <= validation_end THEN 'validation' ELSE 'test'"
    " END AS split, count(*)::BIGINT AS rows, " + ts("max(time)") + " AS last_feature FROM user_demand, cut"
    " WHERE time + INTERVAL 1 HOUR <= CASE WHEN time <= train_end THEN train_end"
    " WHEN time <= validation_end THEN validation_end ELSE last_time END GROUP BY 1",
)
def _(t: Tables):
    rows = t.user_demand.withColumn("target", F.col("time") + F.expr("INTERVAL 1 HOUR"))
    split = splits.split_by_boundaries(rows, "time", "target")
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.max("time").alias("last_feature")
    )


@query(
    "fixed_date_split",
    "F9",
    with_("user_demand")
    + "SELECT CASE WHEN time < TIMESTAMP '2024-01-20' THEN 'train' WHEN time < TIMESTAMP '2024-01-26'"
    " THEN 'validation' ELSE 'test' END AS split, count(*)::BIGINT AS rows FROM user_demand"
    " WHERE time + INTERVAL 2 HOUR < TIMESTAMP '2024-01-20' OR (time >= TIMESTAMP '2024-01-20'"
    " AND time + INTERVAL 2 HOUR < TIMESTAMP '2024-01-26') OR time >= TIMESTAMP '2024-01-26' GROUP BY 1",
)
def _(t: Tables):
    rows = t.user_demand.withColumnRenamed("time", "target")
    split = splits.fixed_date_split(rows, 1, "2024-01-20", "2024-01-26")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "held_out_scores",
    "F10",
    with_(
        "user_demand",
        known="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS age, count(*) OVER (PARTITION BY station) AS n"
        " FROM user_demand WHERE time < TIMESTAMP '2024-01-20'",
        unseen="SELECT station, departures::DOUBLE AS y, row_number() OVER (PARTITION BY station ORDER BY time) AS step"
        " FROM user_demand WHERE time >= TIMESTAMP '2024-01-20' AND station IN (SELECT station FROM known)",
        scored="SELECT u.station, y, l.departures::DOUBLE AS naive, s.departures::DOUBLE AS seasonal FROM unseen u"
        " JOIN known l ON l.station = u.station AND l.age = 1 LEFT JOIN known s ON s.station = u.station AND s.n >= 24"
        " AND s.age = 25 - least(u.step, 24)",
        tops="SELECT station, count(*) AS n, min(y) < max(y) AS varied, sum(y * y) - sum(y) * sum(y) / count(*) AS sst,"
        " avg(abs(y - naive)) AS a, avg((y - naive) ** 2) AS b, avg(abs(y - seasonal)) AS c, avg((y - seasonal) ** 2) AS d FROM scored GROUP BY 1",
    )
    + f"SELECT station, {r('a')} AS naive_mae, {r('sqrt(b)')} AS naive_rmse, CASE WHEN varied THEN {r('1 - b * n / sst')} END AS naive_r2,"
    f" {r('c')} AS seasonal_naive_mae, {r('sqrt(d)')} AS seasonal_naive_rmse,"
    f" CASE WHEN varied THEN {r('1 - d * n / sst')} END AS seasonal_naive_r2 FROM tops",
)
def _(t: Tables):
    border = F.col("time") < F.lit("2024-01-20").cast("timestamp")
    known = t.user_demand.where(border)
    unseen = t.user_demand.where(~border).join(known.select("station").distinct(), "station", "left_semi")
    return sequences.held_out_scores(unseen, known, "station", "time", "departures", 24)


@query(
    "seasonal_naive_forecast",
    "F10",
    with_(
        "user_demand",
        tail="SELECT station, departures, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS age,"
        " count(*) OVER (PARTITION BY station) AS n FROM user_demand",
        steps="SELECT i + 1 AS step FROM range(36) x(i)",
    )
    + "SELECT station, step::BIGINT AS step, departures::DOUBLE AS forecast FROM tail JOIN steps ON age ="
    " CASE WHEN n < 24 THEN 1 ELSE greatest(25 - step, 1) END",
)
def _(t: Tables):
    return sequences.seasonal_naive_forecast(t.user_demand, "station", "time", "departures", 36, 24)


@query(
    "naive_forecast",
    "F10",
    with_("user_demand")
    + "SELECT station, (i + 1)::BIGINT AS step, arg_max(departures, time)::DOUBLE AS forecast FROM user_demand,"
    " range(3) x(i) GROUP BY 1, 2",
)
def _(t: Tables):
    return sequences.seasonal_naive_forecast(t.user_demand, "station", "time", "departures", 3)


@query(
    "contiguous_segments",
    "F11",
    with_(
        "demand",
        newest="SELECT * FROM demand QUALIFY row_number() OVER (PARTITION BY station ORDER BY time DESC) <= 168",
        steps="SELECT *, coalesce((date_diff('hour', lag(time) OVER (PARTITION BY station ORDER BY time), time)"
        " <> 1)::INT, 0) AS b FROM newest",
    )
    + f"SELECT {ts('time')} AS time, station, departures, sum(b) OVER (PARTITION BY station ORDER BY s.time)::BIGINT"
    " AS segment FROM steps s",
)
def _(t: Tables):
    return sequences.contiguous_segments(t.demand.drop("arrivals"), "station", "time", last=168)


# --- features -----------------------------------------------------------------------------------


@query(
    "dense_panel",
    "D6 C4",
    with_("panel") + f"SELECT {ts('time')} AS time, station, departures, arrivals FROM panel",
)
def _(t: Tables):
    return t.panel


@query(
    "exact_lags",
    "D3 F2",
    with_("user_demand")
    + f"SELECT a.station, {ts('a.time')} AS time, a.departures, b.departures AS hour_ago, c.departures AS day_ago"
    " FROM user_demand a LEFT JOIN user_demand b ON b.station = a.station AND b.time = a.time - INTERVAL 1 HOUR"
    " LEFT JOIN user_demand c ON c.station = a.station AND c.time = a.time - INTERVAL 24 HOUR",
)
def _(t: Tables):
    lags = {"hour_ago": ("departures", -1), "day_ago": ("departures", -24)}
    return features.with_exact_offsets(t.user_demand, ["station"], "time", lags).drop("arrivals")


def feature_sql(horizon: int) -> str:
    end = horizon + 1
    frame = "PARTITION BY station ORDER BY time RANGE BETWEEN INTERVAL {a} HOUR PRECEDING AND INTERVAL {b} HOUR PRECEDING"
    w24, w168 = frame.format(a=end + 23, b=end), frame.format(a=end + 167, b=end)
    offset = "first(departures) OVER (" + frame + ")"
    looks = {n: offset.format(a=h, b=h) for n, h in (("recent", end), ("previous", end + 1), ("day", 24), ("week", 168))}
    return with_(
        "panel",
        looked="SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in looks.items())
        + f", avg(departures) OVER ({w24}) AS mean_24h, count(*) OVER ({w24}) AS n24,"
        f" avg(departures) OVER ({w168}) AS mean_7d, count(*) OVER ({w168}) AS n168,"
        f" sum(departures + arrivals) OVER ({w24}) AS movements_24h FROM panel",
        features=f"SELECT station, time - INTERVAL {horizon} HOUR AS issue, time AS target, departures AS y, recent,"
        f" previous, day, week, mean_24h, mean_7d, movements_24h, {local('time')} AS l FROM looked"
        " WHERE n24 = 24 AND n168 = 168 AND recent IS NOT NULL AND previous IS NOT NULL AND day IS NOT NULL"
        " AND week IS NOT NULL",
    )


FEATURE_ROWS = (
    f"SELECT station, {ts('issue')} AS issue, {ts('target')} AS target, y, recent, previous, day, week,"
    f" {r('mean_24h')} AS mean_24h, {r('mean_7d')} AS mean_7d, movements_24h::BIGINT AS movements_24h,"
    " hour(l) AS hour, (isodow(l) - 1) AS weekday, month(l) AS month, dayofyear(l) AS day_of_year FROM features"
)


@query("feature_table", "I1 F2 F3 C13 B10", feature_sql(1) + FEATURE_ROWS)
def _(t: Tables):
    return features.feature_table(t.panel, 1, ZONE)


@query("feature_table_two_hours", "I1 F2 F3 C13 B10", feature_sql(2) + FEATURE_ROWS)
def _(t: Tables):
    return features.feature_table(t.panel, 2, ZONE)
