"""Tables laid out by key: what a lookup opens, and what a comparison of versions reads."""

from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stationflow.session import shared_dir
from stationflow.sources import commits, lookups


@pytest.fixture(scope="module")
def store(spark):
    path = shared_dir(spark, "store")
    df = spark.range(4000).select(
        F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("station"), (F.col("id") / 200).cast("int").alias("hour"), "id"
    )
    lookups.save_keyed_table(df, path, "demand", ["station"], 16)
    lookups.save_keyed_table(df.withColumn("id", F.when(F.col("id") == 205, -1).otherwise(F.col("id"))), path, "demand", ["station"], 16)
    return path


def opened(df):
    return {f.split("_bucket=")[1].split("/")[0] for f in df.inputFiles()}


def test_a_lookup_opens_one_bucket(spark, store):
    found = lookups.lookup(spark, store, "demand", {"station": "s5"})
    plan = found._jdf.queryExecution().executedPlan()
    assert found.count() == 20 and rows(found.where("hour = 1"), "id") == [(-1,)]
    scan = plan.collectLeaves().head()
    text = scan.toString() + scan.metadata().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan.toString() and "EqualTo(station,s5)" in text
    found.collect()
    leaf = found._jdf.queryExecution().executedPlan()
    leaf.executeCollect()
    metrics = leaf.collectLeaves().head().metrics()
    assert metrics.apply("numPartitions").value() == 1 and metrics.apply("numOutputRows").value() <= 1000


def test_lookups_of_many_and_of_none(spark, store):
    wanted = spark.createDataFrame([("s1",), ("s1",), ("s2",), ("nowhere",), (None,)], "station string")
    assert lookups.lookup_many(spark, store, "demand", wanted).groupBy("station").count().orderBy("station").collect() == [("s1", 20), ("s2", 20)]
    assert lookups.lookup(spark, store, "demand", {"station": "nowhere"}).count() == 0
    with pytest.raises(ValueError):
        lookups.lookup(spark, store, "demand", {"hour": 3})
    with pytest.raises(KeyError):
        lookups.lookup(spark, store, "other", {"station": "s1"})


def test_one_changed_row_reads_one_bucket(spark, store):
    first, second = commits.snapshot(spark, store, 1), commits.snapshot(spark, store, 2)
    assert len(lookups.differing_buckets(spark, store, "demand", first, second)) == 1
    changes = lookups.changed_rows(spark, store, "demand", first, second)
    assert rows(changes, "change", "station", "hour", "id", "copies") == [("added", "s5", 1, -1, 1), ("removed", "s5", 1, 205, 1)]
    assert lookups.differing_buckets(spark, store, "demand", second, second) == []
    assert lookups.changed_rows(spark, store, "demand", first, first).count() == 0


def test_keys_of_any_type_nulls_and_repeated_rows(spark):
    path = shared_dir(spark, "store")
    df = spark.createDataFrame([("007", 1, 1.5), ("7", 1, 2.5), ("7", 1, 2.5), (None, 2, 3.5)], "station string, n bigint, _v double")
    a = lookups.save_keyed_table(df, path, "t", ["station", "n"], 4)
    b = lookups.save_keyed_table(df.dropDuplicates(), path, "t", ["station", "n"], 4)
    assert rows(lookups.lookup(spark, path, "t", {"station": "007", "n": 1}), "station") == [("007",)]
    assert rows(lookups.lookup(spark, path, "t", {"station": None, "n": "2"}), "_v") == [(3.5,)]
    assert lookups.lookup(spark, path, "t", {"n": 1, "station": 7}, a).count() == 2
    assert rows(lookups.changed_rows(spark, path, "t", a, b), "change", "station", "copies") == [("removed", "7", 1)]
    c = lookups.save_keyed_table(df, path, "t", ["station", "n"], 8)
    assert lookups.changed_rows(spark, path, "t", a, c).count() == 0
    assert rows(lookups.read_keyed_table(spark, path, "t", b), "_v") == [(1.5,), (2.5,), (3.5,)]
    empty = lookups.save_keyed_table(df.limit(0), path, "t", ["station", "n"], 8)
    assert lookups.lookup(spark, path, "t", {"station": "7", "n": 1}, empty).count() == 0
