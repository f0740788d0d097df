"""Inventory snapshots: JSON lines, and pretty-printed exports with shell number wrappers."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.functions import clocks
from stationflow.schemas import SNAPSHOT_DOCUMENT
from stationflow.session import ship_package

# What numbers are not unwrapped in, taken whole: an escape outside of strings, and a string, closed or not.
_KEPT = r'(?s)(\\[\\"]|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$))'
_FIRST_KEY = '"_id"'
# A quoted string, taken whole, so that braces in it do not count.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def decoded_text(data: Column) -> Column:
    """UTF-8 bytes as text; other bytes are read as Latin-1, never replaced."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(
        F.decode(data, "ISO-8859-1")
    )
    return F.when(F.startswith(text, F.lit("\ufeff")), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)


def unwrapped_numbers(text: Column) -> Column:
    """`NumberInt(n)` as n, outside of quoted strings. One pass over the text, which never looks back."""
    plain = F.regexp_replace(text, _KEPT + r"|NumberInt\s*\(\s*([-0-9]+)\s*\)", "$1$2")
    return F.when(F.contains(text, F.lit("NumberInt")), plain).otherwise(text)


def _stations(parsed: DataFrame, document: str, file: str) -> DataFrame:
    """One row per station of every document. A document without a station list is an error."""
    checked = F.when(
        F.col(f"{document}.stations").isNull(),
        F.raise_error(F.concat(F.lit("unexpected snapshot in "), F.col(file))),
    ).otherwise(F.col(f"{document}.stations"))
    rows = parsed.select(
        F.col(f"{document}._id").alias("_time"),
        F.col(file).alias("source"),
        F.posexplode(checked).alias("ordinal", "s"),
    )

    def number(name: str) -> Column:
        return F.col(f"s.{name}").try_cast("double")

    return rows.select(
        F.coalesce("s.id", "s.number", F.lit("")).alias("station"),
        F.expr("try_to_timestamp(_time)").cast("timestamp_ntz").alias("time"),
        number("dock_bikes").alias("bikes"),
        number("total_bases").alias("capacity"),
        number("free_bases").alias("free"),
        number("activate").alias("active"),
        number("no_available").alias("unavailable"),
        F.col("s.name").alias("name"),
        F.col("s.number").alias("station_number"),
        F.col("s.address").alias("address"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        "source",
        "ordinal",
    )


def read_snapshot_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One JSON document per line; files are split freely. Bad JSON fails the read."""
    lines = spark.read.text(paths).select(
        decoded_text(F.col("value").cast("binary")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
    )
    parsed = lines.where(F.trim("text") != "").select(
        F.from_json("text", SNAPSHOT_DOCUMENT, {"mode": "FAILFAST"}).alias("d"), "file"
    )
    return _stations(parsed, "d", "file")


_QUOTED = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_TOLD = np.zeros(256, bool)
_TOLD[list(b'"{}\\\n')] = True
_QUOTE, _OPEN, _CLOSE, _ESCAPE, _LINE = b'"{}\\\n'


def _bare(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which of the characters `kind` at `at` lie outside of the quoted strings of their line.

    All lines at once: a quote opens or closes a string unless a backslash escapes it. Lines with an open string or
    a backslash outside of strings are read one by one.
    """
    escapes = np.flatnonzero(kind == _ESCAPE)
    first = np.diff(at[escapes], prepend=-2) != 1  # of a run of backslashes; every other one escapes what follows
    number = np.arange(len(escapes))
    active = np.zeros(len(at) + 1, bool)
    active[escapes] = (number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0
    quote = kind == _QUOTE
    quote[1:] &= ~(active[:-2] & (at[1:] == at[:-1] + 1))
    line = np.cumsum(kind == _LINE)
    so_far = np.cumsum(quote)
    ends = np.flatnonzero(kind == _LINE)
    begun = np.concatenate([[0], so_far[ends]])
    inside = (so_far - quote - begun[line]) % 2 == 1
    odd = np.diff(np.append(begun, so_far[-1] if len(at) else 0)) % 2 == 1
    odd[line[(kind == _ESCAPE) & ~inside]] = True
    for k in np.flatnonzero(odd).tolist():
        a, b = (0 if k == 0 else ends[k - 1] + 1), (len(at) if k == len(ends) else ends[k])
        begin, end = (0 if k == 0 else at[ends[k - 1]] + 1), (len(data) if k == len(ends) else at[ends[k]])
        inside[a:b] = False
        for m in _QUOTED.finditer(data[begin:end].tobytes()):
            inside[a:b] |= (at[a:b] >= begin + m.start()) & (at[a:b] < begin + m.end())
    return ~inside


def _pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(ends, depths, depth): where each piece of a text that is not of spaces alone ends, a piece being a line or its part up
    to a brace that closes before an opening one outside of strings; the depth that the text adds up to there, and in all."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_TOLD[data])
    kind = data[at]
    bare = _bare(data, at, kind)
    closes = np.flatnonzero((kind[:-1] == _CLOSE) & bare[:-1] & (kind[1:] == _OPEN))
    cuts = [a + 1 for a, b in zip(at[closes].tolist(), at[closes + 1].tolist()) if b == a + 1 or data[a + 1 : b].tobytes().isspace()]
    ends = np.sort(np.concatenate([at[kind == _LINE], [len(data)], np.array(cuts, np.int64)])).astype(np.int64)
    brace = bare & ((kind == _OPEN) | (kind == _CLOSE))
    depth = np.concatenate([[0], np.cumsum(np.where(kind[brace] == _OPEN, 1, -1))])
    met = np.searchsorted(at[brace], ends)  # braces before each end
    empty = np.flatnonzero(np.diff(met, prepend=0) == 0)
    blank = [k for k in empty.tolist() if not data[ends[k - 1] if k else 0 : ends[k]].tobytes().strip(b" \r\n")]
    kept = np.delete(np.arange(len(ends)), blank)
    return ends[kept], depth[met[kept]], int(depth[-1])


def _utf8(text: bytes) -> bytes:
    """The text in UTF-8: lines that are not read as Latin-1. A mark of byte order at the start of a line is dropped."""
    if b"\xef\xbb\xbf" in text:
        text = re.sub(rb"(?m)^\xef\xbb\xbf", b"", text)
    try:
        pa.array([text], pa.binary()).cast(pa.string())
        return text
    except pa.ArrowInvalid:
        return b"\n".join(decoded.encode() for decoded in map(_line, text.split(b"\n")))


def _line(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, split), text) of the stretches of each split, in order. Records begin behind a `_FIRST_KEY`, which is put
    back before all but the first one of a file."""
    key, last = _FIRST_KEY.encode(), None
    for batch in batches:
        split = batch.column("split").to_numpy(zero_copy_only=False)
        file = batch.column("file")
        changed = np.flatnonzero((split[1:] != split[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1
        borders = [0, *changed.tolist(), len(split)]
        for a, b in zip(borders, borders[1:]):
            if a < b:
                place = (file[a].as_py(), int(split[a]))
                records = batch.column("record").slice(a, b - a)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), records), key)[0].as_py()
                yield place, _utf8(text if place[1] == 0 and place != last else key + text)
                last = place


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, delta): the depth that each stretch of a split adds."""
    for (file, split), text in _runs(batches):
        yield pa.RecordBatch.from_pydict({"file": [file], "split": [split], "delta": [_pieces(text)[2]]})


def _documents(batches: Iterator[pa.RecordBatch], carried: dict[tuple[str, int], int], edges: bool) -> Iterator[pa.RecordBatch]:
    """(file, split, part, ends, text): documents that lie within a split; or, by `edges`, the first part
    of a split that goes on with a document of the split before, and the last one that its end cuts."""
    held: list[bytes] = []
    at, depth, part, goes_on = None, 0, 0, False

    def told(ends: bool, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.repeat(at[0], n), pa.repeat(at[1], n), pa.array(range(part, part + n), pa.int64()), pa.repeat(ends, n), texts]
        return pa.RecordBatch.from_arrays(columns, schema=_DOCUMENT)

    def tail() -> Iterator[pa.RecordBatch]:
        if edges and held:
            yield told(False, pa.array([b"".join(held).decode()]))

    for place, text in _runs(batches):
        if place != at:
            yield from tail()
            held, at, depth, part = [], place, carried.get(place, 0), 0
            goes_on = depth != 0
        ends, depths, added = _pieces(text)
        done = ends[depth + depths == 0]
        depth += added
        start = 0
        if len(done) and (held or (goes_on and part == 0)):  # a document that began before, in this split or another
            if edges == (goes_on and part == 0):
                yield told(True, pa.array([b"".join([*held, text[: int(done[0])]]).decode()]))
            held, part, start, done = [], part + 1, int(done[0]), done[1:]
        if len(done):
            if not edges:
                offsets = pa.py_buffer(np.concatenate([[start], done]).astype(np.int32))
                yield told(True, pc.utf8_ltrim(pa.StringArray.from_buffers(len(done), offsets, pa.py_buffer(text)), " \r\n"))
            part, start, held = part + len(done), int(done[-1]), []
        rest = text[start:]
        if held or rest.strip(b" \r\n"):
            held.append(rest)
    yield from tail()


_DOCUMENT = pa.schema([("file", pa.string()), ("split", pa.int64()), ("part", pa.int64()), ("ends", pa.bool_()), ("text", pa.string())])


def document_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, text) of each top-level JSON object in files of adjacent, possibly pretty-printed objects.

    Files are read in records that end at the name of `_id`, wherever it stands, since a record costs as much to
    move as a line does and holds many. Behind that name no string is open, and a quoted string never spans
    lines, so the depth a record adds is known from the record alone; a closing brace right before an opening
    one only occurs between documents. A first pass adds up the
    depth of each split, so that every split knows at which depth it starts; a second one cuts
    documents out of the splits, side by side and in the order of the file. Only what a split's borders
    cut is shuffled, at most two parts a split. Text behind a last brace that never closes fails the read.
    """
    ship_package(spark)
    records = spark.read.option("lineSep", _FIRST_KEY).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("record"),
    )
    per_split = records.mapInArrow(_added, "file string, split bigint, delta bigint").groupBy("file", "split").agg(F.sum("delta").alias("delta"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_split.select("file", "split", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("carried")).where("carried != 0")
    depths = {(r.file, r.split): r.carried for r in carried.collect()}  # one number per split
    schema = "file string, split bigint, part bigint, ends boolean, text string"
    whole = records.mapInArrow(functools.partial(_documents, carried=depths, edges=False), schema)
    cut = records.mapInArrow(functools.partial(_documents, carried=depths, edges=True), schema)
    # A part belongs to the document that ends with it or after it.
    later = Window.partitionBy("file").orderBy(F.desc("split"), F.desc("part"))
    numbered = cut.withColumn("number", F.sum(F.col("ends").cast("bigint")).over(later))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("split", "part", "text"))), lambda p: p["text"])
    joined = numbered.groupBy("file", "number").agg(F.array_join(texts, "").alias("text"))
    return whole.select("file", "text").unionByName(joined.select("file", "text"))


def read_snapshot_documents(spark: SparkSession, paths: str | Sequence[str], any_order: bool = False) -> DataFrame:
    """Files of adjacent, possibly pretty-printed documents. Bad JSON fails the read.

    By default `_id` is the first field of a document: lines end at that field's name, so splits of a
    file are read side by side, each piece being one document without its opening, followed by the
    brace that opens the next one; `_id` elsewhere makes a document unreadable. With `any_order`
    documents are told apart by their braces (`document_texts`), which reads the files three times.
    """
    if any_order:
        documents = document_texts(spark, paths).select(unwrapped_numbers(F.col("text")).alias("text"), "file")
    else:
        pieces = spark.read.option("lineSep", _FIRST_KEY).text(paths).select(
            decoded_text(F.col("value").cast("binary")).alias("piece"), F.col("_metadata.file_path").alias("file")
        )
        opening = F.col("piece").rlike(r"^\s*\{?\s*$")
        text = F.concat(F.lit("{" + _FIRST_KEY), F.regexp_replace("piece", r"\{\s*$", ""))
        documents = pieces.where(~opening).select(unwrapped_numbers(text).alias("text"), "file")
    parsed = documents.select(
        F.from_json("text", SNAPSHOT_DOCUMENT, {"mode": "FAILFAST"}).alias("d"), "file"
    )
    return _stations(parsed, "d", "file")


def _period(time: Column, year: int) -> Column:
    """Month of a clock. Only years that text writes with other than four digits go through the rule for texts."""
    by_text = clocks.snapshot_period(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(year))
    return F.when(F.year(time).between(1, 9999), F.date_format(time, "yyyy-MM")).otherwise(by_text)


def monthly_metadata(
    snapshots: DataFrame, provider: str, network: str, year: int
) -> DataFrame:
    """Station metadata per period and source, last row of a source wins. `free_bases` holds the
    free docks."""
    from stationflow.functions import identifiers
    from stationflow.operators.sequences import one_row_per_key

    rows = snapshots.select(
        F.lit(provider).alias("provider_id"),
        F.lit(network).alias("network_id"),
        F.col("station").alias("station_id"),
        _period(F.col("time"), year).alias("snapshot_period"),
        F.col("source").alias("source_member"),
        "station_number",
        "name",
        "address",
        F.col("capacity").cast("int").alias("total_bases"),
        F.col("free").cast("int").alias("free_bases"),
        "latitude",
        "longitude",
        F.col("active").cast("int").alias("activate"),
        "time",
        "ordinal",
    )
    keys = ["provider_id", "network_id", "station_id", "snapshot_period", "source_member"]
    last = one_row_per_key(rows, keys, ["time", "ordinal"], keep="last").drop("time", "ordinal")
    return last.withColumn(
        "record_identity",
        identifiers.row_hash(
            *[F.col(c) for c in ("provider_id", "station_id", "snapshot_period", "source_member", "name", "address")]
        ),
    )


def field_census(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, snapshot_id, field, value, stations): which fields a snapshot carries, how often,
    and how often each `activate` value occurs (value is null for the plain field counts)."""
    lines = spark.read.text(paths).select(
        decoded_text(F.col("value").cast("binary")).alias("text"),
        F.col("_metadata.file_name").alias("file"),
    )
    stations = lines.where(F.trim("text") != "").select(
        "file",
        F.get_json_object("text", "$._id").alias("snapshot_id"),
        F.explode(
            F.from_json(F.get_json_object("text", "$.stations"), "array<map<string,string>>")
        ).alias("s"),
    )
    entries = stations.select("file", "snapshot_id", F.explode("s").alias("field", "text")).select(
        "file",
        "snapshot_id",
        "field",
        F.explode(
            F.when(F.col("field") == "activate", F.array(F.lit(None), F.col("text"))).otherwise(
                F.array(F.lit(None).cast("string"))
            )
        ).alias("value"),
    )
    return entries.groupBy("file", "snapshot_id", "field", "value").agg(
        F.count(F.lit(1)).alias("stations")
    )
