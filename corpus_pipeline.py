"""From documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.credential_scan import redacted_records
from stationflow.llm.decontamination import uncontaminated_records
from stationflow.llm.near_duplicates import near_duplicate_groups
from stationflow.llm.packing import pack_records
from stationflow.llm.quality_rules import good_records
from stationflow.llm.queries import as_records, evaluation_items
from stationflow.llm.records import ID, TEXT
from stationflow.llm.storage import stored
from stationflow.session import use_utc

# Rows of the result cannot be stated in SQL: hashing, tokenization and packing are not part of it.
ORACLE_SQL = None


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Documents as records whose id is all their other columns, so that nothing is joined back."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias(ID), F.col("text").alias(TEXT))


def _documents(records: DataFrame, docs: DataFrame) -> DataFrame:
    row = records.select(f"{ID}.*", F.col(TEXT).alias("text"))
    return row.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. A null text is empty and goes."""
    return _documents(good_records(_whole_rows(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id.

    Equal ids are told apart by a 128-bit hash of the whole row; rows equal in all columns are one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marks = [F.isnull(c) for c in columns]
    keyed = docs.withColumn(
        "_row", F.struct(F.xxhash64(*columns, *marks).alias("a"), F.xxhash64(F.lit("second"), *columns, *marks).alias("b"))
    )
    identity = F.struct(F.isnull("doc_id").alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("_row.*"))
    groups = near_duplicate_groups(keyed.select(identity.alias(ID), F.col("text").alias(TEXT)))
    first = groups.where(F.col(ID) == F.col("component_id")).select(F.struct(f"{ID}.a", f"{ID}.b").alias("_row")).distinct()
    return keyed.join(first, "_row").dropDuplicates(["_row"]).select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _documents(uncontaminated_records(_whole_rows(docs), evaluation_items(spark, sf_dir)), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; `n_chars` counts the text as it is now."""
    found = _documents(redacted_records(_whole_rows(docs)), docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece."""
    return pack_records(as_records(docs)).withColumnsRenamed({ID: "doc_id", "record_tokens": "doc_tokens"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents of a folder; each result is written and read again."""
    docs = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
