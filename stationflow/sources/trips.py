"""Trip files: mapped CSV, exact-clock CSV, CSV with unruly headers and rows, JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.functions import clocks, identifiers, measures
from stationflow.schemas import require_columns

REQUIRED_MAPPING = (
    "started_at", "ended_at", "origin_station", "destination_station", "latitude", "longitude",
)
EXACT_MAPPING = {
    "started_at": "unlock_date",
    "ended_at": "lock_date",
    "origin_station": "station_unlock",
    "destination_station": "station_lock",
}
_HEADER_FIELDS = ("unlockdate", "lockdate", "stationunlock", "stationlock")
_ISO_CLOCK = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def read_text_csv(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """CSV with a header, every column as text. A file with another header is an error."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    names = reader.csv(paths).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.schema(schema).option("enforceSchema", False).csv(paths)


def numbered_rows(scan: DataFrame) -> DataFrame:
    """Rows of a file scan with `file` and `file_row`, the row's number in its file from 0.

    The number does not depend on how the files are split: rows are numbered within each split, and
    the splits of a file (one row each) are summed up in order. `scan` is a file read without further steps;
    its rows stay where they are read, as the few splits would deal them to few tasks.
    """
    rows = scan.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("file", "_split")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select("file", "_split", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return (
        rows.join(F.broadcast(splits), ["file", "_split"])
        .withColumn("file_row", F.col("_row") + F.col("_shift"))
        .drop("_split", "_row", "_shift")
    )


def map_columns(raw: DataFrame, mapping: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Rename source columns to the canonical names; the other columns stay for row identity."""
    missing = sorted(set(required) - set(mapping))
    if missing:
        raise ValueError(f"missing column mappings: {missing}")
    require_columns(raw, mapping.values(), "trip file")
    return raw.withColumnsRenamed({source: name for name, source in mapping.items()})


def read_mapped_trips(
    spark: SparkSession,
    paths: str | Sequence[str],
    mapping: Mapping[str, str],
    sep: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    return map_columns(read_text_csv(spark, paths, sep, encoding), mapping, REQUIRED_MAPPING)


def read_exact_trips(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Semicolon files with unlock and lock clocks."""
    return map_columns(read_text_csv(spark, paths, sep=";"), EXACT_MAPPING, tuple(EXACT_MAPPING))


def header_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str | None, str, list[str]]]:
    """(header line, separator, files) for every header form that names the four trip fields, and one
    entry without a line for the files that have none.

    A header is the first line of its file. It is picked on the executors; one line per file comes back.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    first = lines.where(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "row").alias("value"))
    headers = first.select("file", F.regexp_replace("value", "^\ufeff", "").alias("line"))
    plain = F.regexp_replace(F.lower("line"), "[^a-z0-9;,]+", "")
    condition = F.lit(True)
    for name in _HEADER_FIELDS:
        condition = condition & plain.rlike(f"(^|[;,]){name}([;,]|$)")
    separator = F.when(plain.rlike(r"(^|;)unlockdate(;|$)"), ";").otherwise(",")
    named = F.coalesce(condition, F.lit(False))
    found = headers.select(
        "file", F.when(named, F.col("line")).alias("line"), F.when(named, separator).otherwise(",").alias("sep")
    )
    groups: dict[tuple[str | None, str], list[str]] = {}
    for row in found.toLocalIterator():
        groups.setdefault((row["line"], row["sep"]), []).append(row["file"])
    ordered = sorted(groups.items(), key=lambda g: (g[0][0] is None, g[0][0] or "", g[0][1]))
    return [(line, sep, sorted(files)) for (line, sep), files in ordered]


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)`, where the value is computed a single time however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def recovered_trip(line: Column, sep: str = ",") -> Column:
    """Read a row of the wrong width from its tokens: an array of one trip, or null.

    Minutes are the first decimal number, the clocks are the next two timestamps behind it, the
    stations are the two largest whole numbers behind the second clock, in row order.
    """
    mark, cut = "\u0001", "\u0002"
    token = f"[^{mark}]*"
    stamp = f"({token}{_ISO_CLOCK}{token})"
    skip = f"(?:.*?{mark})??"
    row = f"^({skip}(\\d+\\.\\d+){mark}{skip}){stamp}{mark}{skip}{stamp}{mark}(.*)$"
    border = "[,;]" if sep == ";" else ","
    marked = F.regexp_replace(F.regexp_replace(line, '"', ""), rf"\s*{border}(\s*{border})*\s*", mark)

    def parts(text: Column) -> Column:
        """The five groups of a row, found in one search; empty texts if it does not match."""
        one_by_one = F.array(*[F.regexp_extract(text, row, k) for k in range(1, 6)])
        together = F.split(F.regexp_replace(text, row, cut.join(f"${k}" for k in range(1, 6))), cut, -1)
        return F.when(F.contains(text, F.lit(cut)), one_by_one).otherwise(together)

    def trip(text: Column, part: Column, by_size: Column) -> Column:
        first, second, tokens = F.get(by_size, 0)["x"], F.get(by_size, 1)["x"], F.split(text, mark)
        in_order = F.array_position(tokens, first) <= F.array_position(tokens, second)
        named = F.regexp_extract(F.get(part, 0), f"^{token}{mark}{skip}({token}[A-Za-z]{token}){mark}", 1)
        usable = (F.size(tokens) >= 6) & (F.size(by_size) >= 2)
        return F.when(
            usable,
            F.array(
                F.struct(
                    F.get(part, 2).alias("unlockdate"),
                    F.get(part, 3).alias("lockdate"),
                    F.when(in_order, first).otherwise(second).alias("stationunlock"),
                    F.when(in_order, second).otherwise(first).alias("stationlock"),
                    F.get(part, 1).alias("tripminutes"),
                    F.when(named != "", named).otherwise("fallback-trip").alias("idtrip"),
                )
            ),
        )

    def sized(part: Column) -> Column:
        numbers = F.regexp_extract_all(F.coalesce(F.get(part, 4), F.lit("")), F.lit(f"(?<![^{mark}])(\\d+)(?![^{mark}])"), F.lit(1))
        return F.array_sort(
            F.transform(numbers, lambda x, i: F.struct((-x.try_cast("bigint")).alias("n"), i.alias("i"), x.alias("x")))
        )

    return _once(
        F.regexp_replace(F.trim(marked), f"^{mark}|{mark}$", ""),
        lambda text: _once(parts(text), lambda part: _once(sized(part), lambda by_size: trip(text, part, by_size))),
    )


_FLEXIBLE = ("unlockdate", "lockdate", "stationunlock", "stationlock", "tripminutes", "idtrip")


def read_flexible_trips(
    spark: SparkSession, paths: str | Sequence[str], keep_unread: bool = False
) -> DataFrame:
    """(file, file_row, recovered, six text fields) of files whose headers and rows vary.

    Rows as wide as their header are read by name. Rows of another width, and all rows of files
    without a usable header, go through `recovered_trip`; rows it cannot read are left out, or kept
    with null fields by `keep_unread`, for `flexible_read_counts`.
    """
    # Not `inline`: Spark would test its array for emptiness in a filter, and read each row twice for that.
    inline = F.inline_outer
    parts = []
    for line, sep, files in header_groups(spark, paths):
        if line is None:
            lines = numbered_rows(spark.read.text(files))
            parts.append(
                lines.select("file", "file_row", F.lit(True).alias("recovered"), inline(recovered_trip(F.col("value"), sep)))
            )
            continue
        names = [identifiers.normalized_header(n) for n in line.split(sep)]
        fields = [n or f"_blank{i}" for i, n in enumerate(names)]
        schema = ", ".join(f"`{n}` string" for n in [*fields, "_corrupt"])
        scan = (
            spark.read.schema(schema)
            .option("header", True)
            .option("sep", sep)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .option("columnPruning", False)
            .csv(files)
        )
        rows = numbered_rows(scan)
        if "idtrip" not in fields and "idbike" in fields:
            rows = rows.withColumnRenamed("idbike", "idtrip")
            fields[fields.index("idbike")] = "idtrip"
        bad = F.col("_corrupt").isNotNull()
        by_name = F.array(
            F.struct(
                *[
                    (F.col(n) if n in fields else F.lit(None).cast("string")).alias(n)
                    for n in _FLEXIBLE
                ]
            )
        )
        # Inlining an array computes each trip once, whatever is built on its fields later.
        parts.append(
            rows.select(
                "file",
                "file_row",
                bad.alias("recovered"),
                inline(F.when(bad, recovered_trip(F.col("_corrupt"), sep)).otherwise(by_name)),
            )
        )
    columns = ("file string", "file_row bigint", "recovered boolean", *[f"{n} string" for n in _FLEXIBLE])
    result = spark.createDataFrame([], ", ".join(columns))
    for part in parts:
        result = result.unionByName(part)
    return result if keep_unread else result.where(~F.col("recovered") | F.col("idtrip").isNotNull())


def _typed_rows(rows: DataFrame, year: int, tz: str) -> DataFrame:
    """Flexible rows with typed fields and `valid`: a start, two stations and no bad end clock."""
    timed = clocks.with_lenient_utc(rows, {"started": "unlockdate", "ended": "lockdate"}, tz)
    typed = timed.select(
        F.lit(year).alias("year"),
        F.col("idtrip").alias("trip_id"),
        "started",
        "ended",
        identifiers.station_without_decimal(F.col("stationunlock")).alias("origin"),
        identifiers.station_without_decimal(F.col("stationlock")).alias("destination"),
        F.col("tripminutes").try_cast("double").alias("duration_minutes"),
        F.col("file").alias("source_member"),
        F.col("started_resolution").alias("started_at_resolution"),
        F.col("ended_resolution").alias("ended_at_resolution"),
        F.concat_ws(":", "file", "idtrip", "file_row").alias("record_identity"),
        "recovered",
        F.col("unlockdate").isNull().alias("_blank"),
    )
    valid = (
        F.col("started").isNotNull()
        & (F.col("origin") != "")
        & (F.col("destination") != "")
        & (F.col("ended_at_resolution") != "invalid")
    )
    return typed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def typed_flexible_trips(rows: DataFrame, year: int, tz: str) -> DataFrame:
    """Typed trips with clock tags; rows without a start or a station are left out.

    `record_identity` is file, trip and row number: the same at every reading, however files are split.
    """
    typed = _typed_rows(rows, year, tz)
    kept = [c for c in typed.columns if c not in ("valid", "recovered", "_blank")]
    # A plain filter would be pushed below the clocks and read each of them many times over.
    held = F.inline_outer(F.when(F.col("valid"), F.array(F.struct(*kept))))
    return typed.select(held).where(F.col("started").isNotNull())


def flexible_read_counts(rows: DataFrame, year: int, tz: str) -> DataFrame:
    """What became of the rows of each file: (file, raw_rows, trips, recovered_trips, invalid_rows, unread_rows).

    `rows` comes from `read_flexible_trips(keep_unread=True)`. Trips, invalid rows (read, but without a
    start, a station or a usable end) and unread rows add up to the raw rows; recovered trips are
    among the trips.
    """
    unread = F.col("recovered") & F.col("_blank")
    return (
        _typed_rows(rows, year, tz)
        .groupBy(F.col("source_member").alias("file"))
        .agg(
            F.count(F.lit(1)).alias("raw_rows"),
            F.count_if("valid").alias("trips"),
            F.count_if(F.col("valid") & F.col("recovered")).alias("recovered_trips"),
            F.count_if(~F.col("valid") & ~unread).alias("invalid_rows"),
            F.count_if(~F.col("valid") & unread).alias("unread_rows"),
        )
    )


def read_legacy_trips(spark: SparkSession, paths: str | Sequence[str], year: int, tz: str) -> DataFrame:
    """JSON lines with hour-rounded starts; the arrival clock is unknown and stays null."""
    lines = numbered_rows(spark.read.text(paths)).where(F.trim("value") != "")
    fields = (
        "unplug_hourTime string, idunplug_station string, idplug_station string,"
        " travel_time string, user_day_code string, _id string"
    )
    raw = lines.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r"), "file", "file_row").select(
        "r.*", "file", "file_row"
    )
    clock = F.coalesce(
        F.get_json_object("unplug_hourTime", "$['$date']"), F.col("unplug_hourTime")
    )
    timed = clocks.with_lenient_utc(raw.withColumn("_clock", clock), {"started": "_clock"}, tz)
    ordinal = F.col("file_row")
    trip_id = F.coalesce(
        F.nullif(F.col("user_day_code"), F.lit("")),
        F.get_json_object("_id", "$['$oid']"),
        F.concat_ws("-", F.lit(year), "file", ordinal),
    )
    return (
        timed.select(
            F.lit(year).alias("year"),
            trip_id.alias("trip_id"),
            "started",
            F.lit(None).cast("timestamp").alias("ended"),
            identifiers.station_without_decimal(F.col("idunplug_station")).alias("origin"),
            identifiers.station_without_decimal(F.col("idplug_station")).alias("destination"),
            measures.seconds_to_minutes(F.col("travel_time")).alias("duration_minutes"),
            F.col("file").alias("source_member"),
            F.col("started_resolution").alias("started_at_resolution"),
            F.lit("unknown_from_hour_rounded_start").alias("ended_at_resolution"),
            F.concat_ws(":", "file", trip_id, ordinal).alias("record_identity"),
        )
        .where(
            F.col("started").isNotNull() & (F.col("origin") != "") & (F.col("destination") != "")
        )
    )
