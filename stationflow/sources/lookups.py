"""Tables laid out for lookups by key and for comparing versions.

Rows lie in folders by the hash of their keys, sorted by key, with Bloom filters on the keys. A lookup
opens the one folder its key can be in; a comparison of two versions opens the folders whose digests
differ. Layout and digests are part of the commit that publishes a version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationflow.operators.canonical import hash_sums, marked_text
from stationflow.schemas import require_columns
from stationflow.sources import commits
from stationflow.sources.commits import Change, Snapshot

BUCKET = "_bucket"
_LAYOUTS = "layouts"


def _bucket(keys: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def save_keyed_table(df: DataFrame, store: str, name: str, keys: Sequence[str], buckets: int = 64) -> Snapshot:
    """Write `df` as the next version of a table for lookups by `keys`, with one digest per bucket.

    Choose `buckets` so that one holds a file or a few. A hot key fills its bucket with many files, as
    the rebalance splits it; the rows of a bucket are sorted by key within each file.
    """
    require_columns(df, keys, "keyed table")
    spark, place = df.sparkSession, commits.version_place(name)
    filed = df.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *keys)
    writer = filed.write.partitionBy(BUCKET)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(f"{store}/{place}")
    written = spark.read.schema(filed.schema).parquet(f"{store}/{place}")
    hashed = F.sha2(marked_text([f"`{c}`" for c in df.columns]), 256)
    sums = [w.alias(f"w{i}") for i, w in enumerate(hash_sums(hashed))]
    found = written.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"), *sums).collect()  # one row per bucket
    digests = {str(r[BUCKET]): hashlib.sha256("|".join(str(v) for v in list(r)[1:]).encode()).hexdigest() for r in found}
    root = hashlib.sha256("|".join(f"{k}:{digests[k]}" for k in sorted(digests)).encode()).hexdigest()
    layout = {"keys": list(keys), "buckets": buckets, "rows": sum(r["rows"] for r in found), "root": root, "digests": digests,
              "schema": filed.schema.jsonValue()}
    return commits.commit(spark, store, lambda base: Change({name: place}, {_LAYOUTS: {name: layout}}), f"save {name}")


def _layout(store: str, name: str, at: Snapshot) -> Mapping[str, Any]:
    try:
        return at.rows[_LAYOUTS][name]
    except KeyError:
        raise KeyError(f"{store} has no keyed table {name}") from None


def _rows(spark: SparkSession, store: str, name: str, at: Snapshot) -> DataFrame:
    schema = StructType.fromJson(_layout(store, name, at)["schema"])
    return spark.read.schema(schema).parquet(f"{store}/{at.tables[name]}")


def read_keyed_table(spark: SparkSession, store: str, name: str, at: Snapshot | None = None) -> DataFrame:
    return _rows(spark, store, name, at or commits.snapshot(spark, store)).drop(BUCKET)


def lookup(spark: SparkSession, store: str, name: str, key: Mapping[str, Any], at: Snapshot | None = None) -> DataFrame:
    """The rows of one key; only files of its bucket are listed and opened."""
    at = at or commits.snapshot(spark, store)
    layout, rows = _layout(store, name, at), _rows(spark, store, name, at)
    if set(key) != set(layout["keys"]):
        raise ValueError(f"{name} is looked up by {layout['keys']}")
    typed = {k: F.lit(key[k]).cast(rows.schema[k].dataType) for k in layout["keys"]}
    found = rows.where(F.col(BUCKET) == _bucket([typed[k] for k in layout["keys"]], layout["buckets"]))
    for k, v in typed.items():
        found = found.where(F.col(k).isNull() if key[k] is None else F.col(k) == v)
    return found.drop(BUCKET)


def lookup_many(spark: SparkSession, store: str, name: str, wanted: DataFrame, at: Snapshot | None = None) -> DataFrame:
    """The rows whose key is in `wanted`, each once; buckets that no key is in are left closed where the
    engine prunes by the join."""
    at = at or commits.snapshot(spark, store)
    layout, rows = _layout(store, name, at), _rows(spark, store, name, at)
    keys = layout["keys"]
    typed = wanted.select(*[F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys]).distinct()
    return rows.join(typed.withColumn(BUCKET, _bucket(keys, layout["buckets"])), [BUCKET, *keys], "left_semi").drop(BUCKET)


def differing_buckets(spark: SparkSession, store: str, name: str, before: Snapshot, after: Snapshot) -> list[int]:
    """Buckets whose rows differ, told from the digests alone: the root first, then one per bucket."""
    a, b = _layout(store, name, before), _layout(store, name, after)
    if (a["keys"], a["buckets"]) != (b["keys"], b["buckets"]):
        return list(range(max(a["buckets"], b["buckets"])))
    if a["root"] == b["root"] and a["rows"] == b["rows"]:
        return []
    return sorted(int(k) for k in {*a["digests"], *b["digests"]} if a["digests"].get(k) != b["digests"].get(k))


def changed_rows(spark: SparkSession, store: str, name: str, before: Snapshot, after: Snapshot) -> DataFrame:
    """(change, columns, copies) of rows that only one of two versions has: `removed` or `added`.

    Equal rows are counted, so repeated rows differ by their number. Only differing buckets are read.
    """
    buckets = differing_buckets(spark, store, name, before, after)
    parts = [_rows(spark, store, name, s).where(F.col(BUCKET).isin(buckets or [-1])).drop(BUCKET) for s in (before, after)]
    columns = parts[1].columns
    signed = parts[0].withColumn("_sign", F.lit(-1)).unionByName(parts[1].withColumn("_sign", F.lit(1)))
    sums = signed.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("_sign").alias("_sum")).where("_sum <> 0")
    change = F.when(F.col("_sum") > 0, "added").otherwise("removed").alias("change")
    return sums.select(change, *[F.col(f"`{c}`") for c in columns], F.abs("_sum").alias("copies"))
