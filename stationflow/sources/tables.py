"""Table sinks, and publication of a network's rows, stations and validity in one commit.

A store holds `observations/provider_id=../network_id=../batch_id=..`, one folder per content and
never changed, and what `commits` keeps: providers, networks, the visible batch of each network and
the states of batches in the log entries themselves, and per network a table of its stations and one
of their validity. A publication changes all of them with one entry, its last step; a lost executor or
driver before it leaves the former state.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.functions import clocks, identifiers
from stationflow.operators import profiles
from stationflow.operators.canonical import DataRuleError, hash_sums, marked_text
from stationflow.sources import commits
from stationflow.sources.commits import Change, Snapshot

_SCOPE = ("provider_id", "network_id")
# Fixed value: longest station instance id of a published row.
MAX_INSTANCE_CHARS = 160
# Fixed value: what a validity interval of a published station rests on.
PROVENANCE = "Source identifier; physical-place continuity is not asserted."
PROVIDERS = "provider_id string, timezone string, calendar_version string"
NETWORKS = "provider_id string, network_id string, name string"
VERSIONS = "provider_id string, network_id string, batch_id string"
BATCHES = (
    "batch_id string, provider_id string, network_id string, source_name string, timezone string, expected_rows bigint,"
    " status string, recorded_at string"
)
STATIONS = (
    "provider_id string, network_id string, station_id string, name string, address string, capacity bigint,"
    " available_bikes bigint, latitude double, longitude double, source_name string"
)
INSTANCES = (
    "provider_id string, network_id string, station_instance_id string, provider_station_id string,"
    " valid_from timestamp, valid_to timestamp, identity_provenance string"
)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> str:
    """Write a table beside its place, then put it there; a job that fails leaves the former table as it was.

    The folder written first has a hidden name, which no reader of the folder above it lists. Where
    the file system cannot rename folders at once, or readers may not miss the table between its two
    renames, use `commits.save_table`.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    path = path.rstrip("/")
    name = path.rsplit("/", 1)[-1]
    beside = path.removesuffix(name)
    fresh, former = (f"{beside}_{state}-{uuid.uuid4().hex}-{name}" for state in ("new", "former"))
    df.write.partitionBy(*partition_by).parquet(fresh)
    spark = df.sparkSession
    if commits.exists(spark, path):
        commits.rename(spark, path, former)
        commits.rename(spark, fresh, path)
        commits.delete(spark, former)
    else:
        commits.rename(spark, fresh, path)
    return path


def read_text_partitions(spark: SparkSession, path: str, partition_by: Sequence[str]) -> DataFrame:
    """A partitioned table with its partition values as they were written: `007` is not `7`."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in partition_by else f.dataType) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_station_exports(df: DataFrame, path: str, station: str = "station") -> str:
    """One folder of JSON per station, named by the hash of the id.

    The rebalance groups a station's rows into few files and still splits a hot station.
    """
    keyed = df.withColumn("export_key", identifiers.export_key(F.col(station)))
    keyed = keyed.hint("rebalance", "export_key")
    keyed.write.mode("overwrite").partitionBy("export_key").json(path)
    return path


def active_versions(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    """(provider_id, network_id, batch_id) visible in the snapshot `at`, by default now; one row per network."""
    return commits.read_rows(spark, store, "network_versions", VERSIONS, at)


def batches(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    """All batches with their latest status (loading, validated, published or failed), when they were
    created and first published."""
    log = commits.history(spark, store, BATCHES, at).where("event IS NOT NULL").select("sequence", "event.*")
    fields = ("provider_id", "network_id", "source_name", "timezone", "expected_rows", "status")
    clock = F.col("recorded_at").cast("timestamp")
    return log.groupBy("batch_id").agg(
        *[F.max_by(c, "sequence").alias(c) for c in fields],
        F.min(clock).alias("created_at"),
        F.min(F.when(F.col("status") == "published", clock)).alias("published_at"),
    )


def providers(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    return commits.read_rows(spark, store, "providers", PROVIDERS, at)


def networks(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    return commits.read_rows(spark, store, "networks", NETWORKS, at)


def stations(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    """Stations of all published networks."""
    return commits.read_tables(spark, store, "stations/", STATIONS, at)


def station_instances(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    """Validity intervals of the stations of all published networks."""
    return commits.read_tables(spark, store, "station_instances/", INSTANCES, at)


def active_observations(spark: SparkSession, store: str, at: Snapshot | None = None) -> DataFrame:
    """Observations of the active batches. The pointer join prunes the other batch folders."""
    rows = read_text_partitions(spark, f"{store}/observations", [*_SCOPE, "batch_id"])
    return rows.join(active_versions(spark, store, at), [*_SCOPE, "batch_id"], "left_semi")


def published_rows(demand: DataFrame, provider: str, network: str, also: Sequence[str] = ()) -> DataFrame:
    """Station-hours in the published form, with record ids and row hashes; `also` names further columns to keep."""
    p, n = F.lit(provider), F.lit(network)
    instance = identifiers.station_instance(p, n, F.col("station"))
    instant = clocks.utc_text(F.col("time"))
    record = F.concat_ws(":", instance, instant)
    rows = demand.select(
        F.col("station").cast("string").alias("station_id"),
        instance.alias("station_instance_id"),
        F.col("time").alias("observed_at"),
        F.col("departures").cast("bigint").alias("departures"),
        F.col("arrivals").cast("bigint").alias("arrivals"),
        record.alias("source_record_id"),
        F.sha2(F.concat_ws(":", record, "departures", "arrivals"), 256).alias("source_record_hash"),
        instant.alias("original_time_text"),
        *also,
    )
    return profiles.with_measures(rows)


def _judged_rows(demand: DataFrame, provider: str, network: str) -> tuple[DataFrame, Observation]:
    """Rows to publish, and what their write tells: how many there are, how many are bad, and the sums
    of their hashes."""
    whole = (F.col("departures") % 1 == 0) & (F.col("arrivals") % 1 == 0)
    fine = (F.col("departures") >= 0) & (F.col("arrivals") >= 0) & whole & F.col("time").isNotNull()
    instance = identifiers.station_instance(F.lit(provider), F.lit(network), F.col("station"))
    short = F.length(F.col("station").cast("string")).between(1, 64) & (F.length(instance) <= MAX_INSTANCE_CHARS)
    judged = demand.withColumn("_bad", ~F.coalesce(fine & short, F.lit(False)))
    rows = published_rows(judged, provider, network, also=["_bad"])
    content = marked_text(["station_id", "original_time_text", "departures", "arrivals"])
    told = Observation()
    words = [w.alias(f"w{i}") for i, w in enumerate(hash_sums(F.sha2(content, 256)))]
    rows = rows.observe(told, F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad"), *words)
    return rows.drop("_bad"), told


def _per_station(rows: DataFrame) -> DataFrame:
    """(station, rows, station-hours, first and last hour) of the rows to publish."""
    hours = rows.groupBy("station_id", "observed_at").agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("station_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("hours"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last")
    )


def _path_text(value: str) -> str:
    """A partition value as a folder name, escaped as Spark's own writer does."""
    special = set("\"#%'*/:=?\\{[]^\x7f")
    return "".join(f"%{ord(c):02X}" if c in special or c < " " else c for c in value)


def publish(
    spark: SparkSession, store: str, demand: DataFrame, provider: str, network: str, source_name: str,
    stations: DataFrame | None = None, timezone: str = "UTC", calendar_version: str = "UTC", name: str | None = None,
) -> str:
    """Validate, write and activate a batch; returns its id.

    `demand` has `time`, `station`, `departures` and `arrivals`; it is evaluated once, by the write,
    which also tells row count and digest. `stations` (`station` and any of name, address, capacity,
    available_bikes, latitude, longitude) adds to what is known of published stations. The id is a
    content address: scope, source and the order-free digest of the rows. Empty, repeated or
    implausible rows raise, and nothing becomes visible.

    Provider, network, stations, validity intervals, batch and the pointer to it switch in one commit.
    Publishers may work at the same time: who loses the race for a log entry applies its change to
    the winner's state. Publishing known content again only switches the pointer back to it.
    """
    scope = {"provider_id": provider, "network_id": network}
    root = f"{store}/observations"
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    rows, told = _judged_rows(demand, provider, network)
    write_table(rows.hint("rebalance", "station_id"), staged, sort_by=["station_id", "observed_at"])
    counts = told.get
    facts_place = commits.write_version(_per_station(spark.read.schema(rows.schema).parquet(staged)), store, "facts")
    facts = spark.read.parquet(f"{store}/{facts_place}")
    found = facts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("hours"), F.lit(0)).alias("hours")).first()
    if not counts["rows"] or counts["bad"]:
        commits.delete(spark, staged)
        raise DataRuleError(f"publication needs valid, nonempty rows: {counts['rows']} rows, {counts['bad']} of them bad")
    if found["hours"] != found["rows"]:
        commits.delete(spark, staged)
        raise DataRuleError("publication needs unique station-hours")
    content = "|".join([str(counts["rows"]), *(str(counts[f"w{i}"]) for i in range(8))])
    batch_id = hashlib.sha256("|".join([provider, network, source_name, content]).encode()).hexdigest()
    batch = scope | {"batch_id": batch_id, "source_name": source_name, "timezone": timezone, "expected_rows": counts["rows"]}

    def state(status: str) -> Change:
        return Change(event=batch | {"status": status, "recorded_at": datetime.now(UTC).isoformat()})

    target = "/".join([root, *(f"{k}={_path_text(v)}" for k, v in (scope | {"batch_id": batch_id}).items())])
    if not commits.exists(spark, target):
        commits.commit(spark, store, lambda base: state("loading"), f"load {batch_id}")
        if found["rows"] != counts["rows"]:
            commits.commit(spark, store, lambda base: state("failed"), f"fail {batch_id}")
            commits.delete(spark, staged)
            raise DataRuleError(f"wrote {found['rows']} rows of {counts['rows']}")
        commits.commit(spark, store, lambda base: state("validated"), f"validate {batch_id}")
        files, path = commits.folder(spark, target)
        files.mkdirs(path.getParent())
        if not commits.exists(spark, target):
            commits.rename(spark, staged, target)
    commits.delete(spark, staged)

    place = f"{_path_text(provider)}/{_path_text(network)}"
    ids = [F.lit(v).alias(k) for k, v in scope.items()]
    fields = [f for f in T.StructType.fromDDL(STATIONS).fields if f.name not in (*scope, "station_id", "source_name")]
    given = stations if stations is not None else facts.select(F.col("station_id").alias("station")).limit(0)
    given = given.select(
        F.col("station").cast("string").alias("station_id"),
        *[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields],
    )
    one = given.groupBy("station_id").agg(*[F.max(f.name).alias(f.name) for f in fields])
    incoming = facts.select("station_id").join(one, "station_id", "left").select(*ids, "*", F.lit(source_name).alias("source_name"))
    seen = facts.select(
        *ids, identifiers.station_instance(F.lit(provider), F.lit(network), F.col("station_id")).alias("station_instance_id"),
        F.col("station_id").alias("provider_station_id"), F.col("first").alias("valid_from"), clocks.shift_hours(F.col("last"), 1).alias("valid_to"),
    )

    def switch(base: Snapshot) -> Change:
        former = commits.read_table(spark, store, f"stations/{place}", STATIONS, base)
        intervals = commits.read_table(spark, store, f"station_instances/{place}", INSTANCES, base).select(*seen.columns)
        widened = (
            intervals.unionByName(seen)
            .groupBy(*scope, "station_instance_id", "provider_station_id")
            .agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
            .withColumn("identity_provenance", F.lit(PROVENANCE))
        )
        tables = {f"stations/{place}": upsert_stations(former, incoming, [*_SCOPE, "station_id"]), f"station_instances/{place}": widened}
        rows = {
            "providers": {provider: {"provider_id": provider, "timezone": timezone, "calendar_version": calendar_version}},
            "networks": {place: scope | {"name": name or network}},
            "network_versions": {place: scope | {"batch_id": batch_id}},
        }
        return Change({k: commits.write_version(df, store, k) for k, df in tables.items()}, rows, state("published").event)

    commits.commit(spark, store, switch, f"publish {batch_id}")
    commits.delete(spark, f"{store}/{facts_place}")
    return batch_id


def upsert_stations(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Last write wins per station; a null in the new row keeps the known value.

    Of several incoming rows of a station the last by `order` counts, by all fields if none is given.
    """
    fields = [c for c in incoming.columns if c not in keys]
    last = F.max_by(F.struct(*fields), F.struct(*(order or fields))).alias("_row")
    one = incoming.groupBy(*keys).agg(last)
    new = one.select(*keys, *[F.col(f"_row.{c}").alias(f"_new_{c}") for c in fields])
    both = existing.join(new, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in fields])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the target does not hold yet."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")
