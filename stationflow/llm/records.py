"""The columns every operator of this package reads, and how a task walks through them."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationflow.llm.arrays import CHUNK_BYTES, chunks

ID, TEXT = "source_record_id", "raw_text"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors once per application, as `--py-files` would."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="stationflow-")) / "stationflow.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def source_records(df: DataFrame) -> DataFrame:
    """Only the two columns used here; further columns, whatever their names, are dropped."""
    missing = {ID, TEXT} - set(df.columns)
    if missing:
        raise ValueError(f"source records lack {sorted(missing)}")
    ship_package(df.sparkSession)
    return df.select(F.col(ID).alias(ID), F.coalesce(F.col(TEXT).cast("string"), F.lit("")).alias(TEXT))


def records_of_lines(lines: DataFrame) -> DataFrame:
    """Source records of a provider's text files: rows of `file`, `file_row` and `value`, as
    `sources.trips.numbered_rows` gives them. The id is file and row number, as in a trip's identity."""
    return lines.select(F.concat_ws(":", "file", "file_row").alias(ID), F.col("value").alias(TEXT))


def records_of_documents(documents: DataFrame) -> DataFrame:
    """Source records of snapshot documents: rows of `file` and `text`, as `sources.snapshots.document_texts`
    gives them. The id is the file and a digest of the document; equal documents of a file share it."""
    return documents.select(F.concat_ws(":", F.col("file"), F.sha2("text", 256)).alias(ID), F.col("text").alias(TEXT))


def _walk(batches: Iterator[pa.RecordBatch], *, fn, limit: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, TEXT, limit):
        out = fn(part)
        if out is not None and out.num_rows:
            yield out


def map_records(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | StructType,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply `fn` to batches of about `limit` bytes of whole texts; no text is split."""
    return df.mapInArrow(functools.partial(_walk, fn=fn, limit=limit), schema)
