"""Chronological train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clocks
from stationflow.operators.sequences import with_global_rank


def row_fraction_split(
    series: DataFrame, time: str = "time", train: float = 0.6, validation: float = 0.2
) -> DataFrame:
    """Label rows of a series with unique times by their position: 60/20/20 by default.

    A row without a time stops the job; none is dropped.
    """
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("split fractions must be positive and leave a test period")
    unknown = F.raise_error(F.lit("times must be known before a chronological split"))
    series = series.withColumn(time, F.coalesce(F.col(time), unknown))
    ranked = with_global_rank(
        series, [time], name="_rank", total="_total"
    )
    train_end = F.floor(F.col("_total") * train)
    validation_end = train_end + F.floor(F.col("_total") * validation)
    split = (
        F.when(F.col("_rank") <= train_end, "train")
        .when(F.col("_rank") <= validation_end, "validation")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_rank", "_total")


def check_series(series: DataFrame, time: str = "time") -> DataFrame:
    """Raise when times repeat or are missing; returns the input."""
    bad = series.groupBy(time).agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) | F.col(time).isNull()
    )
    if not bad.isEmpty():
        raise ValueError("times must be known and unique before a chronological split")
    return series


def split_boundaries(
    dataset: DataFrame, time: str, train: float = 0.70, validation: float = 0.85
) -> DataFrame:
    """One row with the six boundary instants over the distinct times of a dataset."""
    distinct = dataset.select(time).distinct()
    ranked = with_global_rank(
        distinct, [time], name="_rank", total="_total"
    )
    total = F.col("_total")
    train_at = F.greatest(F.lit(0), F.floor(total * train) - 1) + 1
    validation_at = F.greatest(F.lit(1), F.floor(total * validation) - 1) + 1

    def pick(rank: Column, name: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(time))).alias(name)

    return ranked.agg(
        pick(F.lit(1), "train_start"),
        pick(train_at, "train_end"),
        pick(train_at + 1, "validation_start"),
        pick(validation_at, "validation_end"),
        pick(validation_at + 1, "test_start"),
        pick(total, "test_end"),
    )


def split_by_boundaries(
    dataset: DataFrame, feature_time: str, target_time: str, boundaries: DataFrame | None = None
) -> DataFrame:
    """Label rows by the boundaries of their own feature times (or of the given ones) and purge
    rows whose target lies behind the end of their split."""
    if boundaries is None:
        boundaries = split_boundaries(dataset, feature_time)
    names = ("train_end", "validation_start", "validation_end", "test_end")
    # One subquery for all four instants, so the distinct times are ranked once.
    cut = boundaries.select(F.struct(*names)).scalar()
    t = F.col(feature_time)
    split = (
        F.when(t <= F.col("_cut.train_end"), "train")
        .when(t.between(F.col("_cut.validation_start"), F.col("_cut.validation_end")), "validation")
        .otherwise("test")
    )
    limit = (
        F.when(F.col("split") == "train", F.col("_cut.train_end"))
        .when(F.col("split") == "validation", F.col("_cut.validation_end"))
        .otherwise(F.col("_cut.test_end"))
    )
    labelled = dataset.withColumn("_cut", cut).withColumn("split", split)
    return labelled.where(F.col(target_time) <= limit).drop("_cut")


def fixed_date_split(
    features: DataFrame, horizon: int, validation_start: str, test_start: str
) -> DataFrame:
    """Split feature rows by fixed UTC dates; rows whose target interval reaches the next period
    are dropped."""
    first = F.lit(validation_start).cast("timestamp")
    second = F.lit(test_start).cast("timestamp")
    done = clocks.shift_hours(F.col("target"), horizon + 1)
    split = (
        F.when(done < first, "train")
        .when((F.col("target") >= first) & (done < second), "validation")
        .when(F.col("target") >= second, "test")
    )
    return features.withColumn("split", split).where(F.col("split").isNotNull())


def check_partitions(split: DataFrame, minimum: int = 100) -> dict[str, int]:
    """Row counts by split; raises when one of the three is too small."""
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [s for s in ("train", "validation", "test") if counts.get(s, 0) < minimum]
    if short:
        raise ValueError(f"insufficient chronological coverage in {short}: {counts}")
    return counts
