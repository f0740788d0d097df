"""Weather payloads, station masters and the source manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions import measures
from stationflow.session import ship_package
from stationflow.sources.commits import folder
from stationflow.sources.trips import read_text_csv

_VALUES = ("temperature_2m", "precipitation", "rain", "wind_speed_10m")
# Fixed column candidates of station masters, in order of preference.
STATION_ID = ("station_id", "number", "id")
CAPACITY = ("totalbase", "totalbases", "capacity")
BIKES = (
    "dock_bikes", "dockbikes", "available_bikes", "availablebikes", "bikes_available", "free_bikes",
)
LATITUDE = ("point_y", "latitude", "lat")
LONGITUDE = ("point_x", "longitude", "lon", "lng")


def read_weather(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hourly rows of payloads whose `hourly` struct holds parallel arrays and unix seconds."""
    arrays = ", ".join(f"{v}: array<double>" for v in _VALUES)
    payload = (
        spark.read.schema(f"hourly struct<time: array<bigint>, {arrays}>")
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(paths)
    )
    rows = payload.select(
        F.explode(F.arrays_zip(*[F.col(f"hourly.{c}") for c in ("time", *_VALUES)])).alias("h")
    )
    return rows.select(
        F.timestamp_seconds("h.time").alias("time"), *[F.col(f"h.{v}").alias(v) for v in _VALUES]
    )


def _candidate(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def station_master(raw: DataFrame) -> DataFrame:
    """Stations from a master file of varying headers. Unknown inventory stays null and keeps the
    station; a file without a service id is refused."""
    named = raw.toDF(*[c.replace("\ufeff", "").strip().lower() for c in raw.columns])
    columns = named.columns
    station = _candidate(columns, STATION_ID)
    if station is None:
        raise ValueError("station master lacks a service station id")

    def number(names: Sequence[str]) -> Column:
        found = _candidate(columns, names)
        return measures.locale_number(F.col(found)) if found else F.lit(None).cast("double")

    def text(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    lat, lon = number(LATITUDE), number(LONGITUDE)
    if not (_candidate(columns, LATITUDE) and _candidate(columns, LONGITUDE)):
        point = measures.lon_lat_text(text("posicionstr"))
        lat, lon = point["latitude"], point["longitude"]
    capacity, bikes = number(CAPACITY), number(BIKES)
    return named.select(
        F.col(station).cast("string").alias("station_id"),
        text("name").alias("name"),
        text("address").alias("address"),
        capacity.alias("capacity"),
        bikes.alias("available_bikes"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        text("activate").alias("activate"),
        measures.clip_zero(capacity - bikes).alias("station_score"),
    )


def read_station_master(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    return station_master(read_text_csv(spark, paths, sep))


# A Mersenne prime and a base below it.
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def _split_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, hash, power) of each split: its lines as digits of one number, and base ** lines."""
    now, number, power = None, 0, 1

    def row() -> pa.RecordBatch:
        cells = [[now[0]], [now[1]], [f"{number:x}"], [f"{power:x}"]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["path", "start", "hash", "power"])

    for batch in batches:
        for path, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, start) != now:
                if now is not None:
                    yield row()
                now, number, power = (path, start), 0, 1
            digit = int.from_bytes(hashlib.blake2b(line, digest_size=16).digest(), "big") + 1
            number, power = (number * _BASE + digit) % _PRIME, power * _BASE % _PRIME
    if now is not None:
        yield row()


def _file_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, digest): the numbers of a file's splits, in order, put together."""
    for batch in batches:
        digests = []
        for size, splits in zip(batch.column("bytes").to_pylist(), batch.column("splits").to_pylist(), strict=True):
            number = 0
            for s in splits:
                number = (number * int(s["power"], 16) + int(s["hash"], 16)) % _PRIME
            digests.append(hashlib.sha256(f"{size}|{number:x}".encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())], ["path", "bytes", "digest"])


def _empty_files(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """Files without a byte, which no reader lists."""
    found = []
    for pattern in [paths] if isinstance(paths, str) else paths:
        files, target = folder(spark, pattern)
        for status in files.globStatus(target) or ():
            for file in files.listStatus(status.getPath()) if status.isDirectory() else (status,):
                name = file.getPath().getName()
                if file.isFile() and not file.getLen() and not name.startswith(("_", ".")):
                    found.append((file.getPath().toUri().toString(), 0))
    return sorted(set(found))


def source_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, bytes, digest, first_path, duplicate): identity of every source file, empty ones too.

    The digest covers the size and the lines in their order: a file is a number whose digits are
    hashes of its lines. Numbers of neighbouring splits combine by one product and one sum, so each
    split is read once, wherever it lies, and the result does not depend on how files are split.
    Files with the same lines in another order or with other line ends differ.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")
    )
    files = files.unionByName(spark.createDataFrame(_empty_files(spark, paths), "path string, bytes bigint"))
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )
    splits = lines.mapInArrow(_split_hashes, "path string, start bigint, hash string, power string")
    per_file = splits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "hash", "power"))).alias("splits"))
    joined = files.join(per_file, "path", "left").select("path", "bytes", F.coalesce("splits", F.array().cast(per_file.schema["splits"].dataType)).alias("splits"))
    listed = joined.mapInArrow(_file_hashes, "path string, bytes bigint, digest string")
    first = listed.groupBy("digest").agg(F.min("path").alias("first_path"), F.collect_list(F.struct("path", "bytes")).alias("files"))
    return first.select("digest", "first_path", F.explode("files").alias("f")).select(
        "f.path", "f.bytes", "digest", "first_path", (F.col("f.path") != F.col("first_path")).alias("duplicate")
    )


def distinct_files(manifest: DataFrame) -> list[str]:
    """Paths to read, identical content once."""
    return sorted(r["path"] for r in manifest.where(~F.col("duplicate")).select("path").toLocalIterator())
