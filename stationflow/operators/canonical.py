"""Canonical demand, its invariants, and comparison of two stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import identifiers, measures
from stationflow.schemas import require_columns


class DataRuleError(ValueError):
    """Raised when a stage receives rows that break its contract."""


def canonical_demand(rows: DataFrame, provider: str) -> DataFrame:
    """Sum contributions by provider, normalized station and time, and derive the identities."""
    require_columns(rows, ("time", "station", "departures", "arrivals", "source_year"), "demand")
    return (
        rows.select(
            F.lit(provider.strip().lower()).alias("provider"),
            identifiers.normalized_station(F.col("station")).alias("station_id"),
            F.col("time").alias("observed_at"),
            "departures",
            "arrivals",
            "source_year",
        )
        .groupBy("provider", "station_id", "observed_at")
        .agg(
            F.sum("departures").cast("bigint").alias("departures"),
            F.sum("arrivals").cast("bigint").alias("arrivals"),
            F.min("source_year").alias("source_year"),
        )
        .withColumns(measures.demand_measures(F.col("departures"), F.col("arrivals")))
    )


def contribution_duplicates(rows: DataFrame) -> DataFrame:
    """Rows and keys that share a canonical key before they are summed (one row)."""
    keyed = rows.select(
        identifiers.normalized_station(F.col("station")).alias("station_id"), F.col("time")
    )
    return duplicate_keys(keyed, ["station_id", "time"])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, unique_keys, duplicate rows beyond the first, keys that repeat, status."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        extra.alias("duplicate_keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.when(extra == 0, "PASS").otherwise("BLOCKED").alias("status"),
    )


def canonical_rules() -> dict[str, Column]:
    """Violation conditions of canonical rows; null counts as a violation."""

    def broken(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    d, a = F.col("departures"), F.col("arrivals")
    return {
        "null_key": F.col("provider").isNull()
        | F.col("observed_at").isNull()
        | broken(F.col("station_id") != ""),
        "negative_counts": broken((d >= 0) & (a >= 0)),
        "total_activity": broken(F.col("total_activity") == d + a),
        "net_flow": broken(F.col("net_flow") == a - d),
        "demand": broken(F.col("demand") == d),
    }


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows break each rule, all rules in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(rule).alias(n) for n, rule in rules.items()]
    )


def offending_rows(df: DataFrame, rules: Mapping[str, Column], sample: int = 10) -> DataFrame:
    """The first `sample` rows that break a rule, in the order of all columns, with the rules' names."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    marked = df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)
    return marked.orderBy(*df.columns).limit(sample)


def assert_canonical(df: DataFrame, sample: int = 10) -> DataFrame:
    """Raise when canonical rows break an invariant or repeat a key; returns the input."""
    rules = canonical_rules()
    found = count_violations(df, rules).first().asDict()
    bad = {n: found[n] for n in rules if found[n]}
    if bad:
        rows = [r.asDict() for r in offending_rows(df, rules, sample).collect()]
        raise DataRuleError(f"canonical demand breaks {bad}: {rows}")
    keys = duplicate_keys(df, ["provider", "station_id", "observed_at"]).first()
    if keys["duplicate_keys"]:
        raise DataRuleError(f"canonical demand repeats {keys['repeated_keys']} keys")
    return df


def quality_report(df: DataFrame, timestamp: str | None = None, demand: str | None = None) -> DataFrame:
    """Duplicate rows, null cells, unreadable clocks, negative demand and an overall status."""
    columns = df.columns
    per_row = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    kinds = dict(df.dtypes)
    clock = F.lit(False)
    if timestamp:
        clock = (
            F.try_to_timestamp(F.col(timestamp)).isNull()
            if kinds[timestamp] == "string"
            else F.col(timestamp).isNull()
        )
    negative = F.coalesce(F.col(demand) < 0, F.lit(False)) if demand else F.lit(False)

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")

    counted = per_row.agg(
        total(n).alias("rows"),
        total(n - 1).alias("duplicate_rows"),
        total(n * nulls).alias("missing_values"),
        total(F.when(clock, n).otherwise(0)).alias("invalid_timestamps"),
        total(F.when(negative, n).otherwise(0)).alias("negative_demand"),
    )
    issues = F.col("duplicate_rows") + F.col("invalid_timestamps") + F.col("negative_demand")
    status = (
        F.when(F.col("rows") == 0, "FAIL")
        .when(issues >= 10, "FAIL")
        .when((issues > 0) | (F.col("missing_values") > 0), "WARN")
        .otherwise("PASS")
    )
    return counted.withColumn("status", status).drop("rows")


def marked_text(columns: Sequence[str]) -> Column:
    """One text per row: each field with its length, null with its own mark; unlike rows never meet."""

    def marked(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.coalesce(F.concat(F.lit("v"), F.length(value).cast("string"), F.lit(":"), value), F.lit("n"))

    return F.concat_ws("|", *[marked(c) for c in columns])


def hash_sums(hash_hex: Column) -> list[Column]:
    """Sums of the eight 32-bit words of SHA-256 texts: they do not depend on the order of rows."""
    return [
        F.sum(F.conv(F.substring(hash_hex, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)
    ]


def content_digest(
    df: DataFrame, columns: Sequence[str], also: Mapping[str, Column] | None = None
) -> DataFrame:
    """(rows, digest): SHA-256 identity of a table that does not depend on row order.

    `also` names further aggregates to compute in the same pass.

    Every row is hashed over its `marked_text`, the eight 32-bit words of the hashes are added up, and the sums are
    hashed once more. Only eight numbers per task travel, and no sort takes place.
    """
    also = dict(also or {})
    hashed = df.withColumn("_h", F.sha2(marked_text(columns), 256))
    words = [w.alias(f"_w{i}") for i, w in enumerate(hash_sums(F.col("_h")))]
    extra = [c.alias(n) for n, c in also.items()]
    sums = hashed.agg(F.count(F.lit(1)).alias("rows"), *words, *extra)
    joined = F.concat_ws(
        "|",
        F.col("rows").cast("string"),
        *[F.coalesce(F.col(f"_w{i}").cast("string"), F.lit("0")) for i in range(8)],
    )
    return sums.select("rows", F.sha2(joined, 256).alias("digest"), *also)


def _sided(df: DataFrame, keys: Sequence[str], fields: Sequence[str], side: str) -> DataFrame:
    return df.select(
        *keys, *[F.col(f).alias(f"_{side}_{f}") for f in fields], F.lit(True).alias(f"_{side}")
    )


def compare_stores(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """One row: one-sided keys, common keys and null-safe differences by field."""
    both = _sided(left, keys, fields, "l").join(
        _sided(right, keys, fields, "r"), list(keys), "full_outer"
    )
    common = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(common).alias("common"),
        *[
            F.count_if(common & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}"))).alias(f"{f}_differs")
            for f in fields
        ],
    )


def one_sided_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one store only, tagged with the side that has them."""
    a = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    seen = a.unionByName(b).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_r") == 0, "left_only").otherwise("right_only")
    return seen.where(F.col("_l") != F.col("_r")).select(*keys, side.alias("side"))


def aggregate_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """left - right per key with missing rows as zero; keys without any difference are left out.

    Signed rows are summed, which needs one combined shuffle instead of an outer join.
    """
    minus = right.select(*keys, *[(-F.col(v)).alias(v) for v in values])
    total = (
        left.select(*keys, *values)
        .unionByName(minus)
        .groupBy(*keys)
        .agg(*[F.sum(v).alias(v) for v in values])
    )
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.col(v) != 0)
    return total.where(differs)


def difference_summary(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row: rows and totals of the left table and the number of keys that disagree.

    Both tables are read once and meet in a single aggregation.
    """
    a = left.select(*keys, *values, *[F.lit(0).alias(f"_r_{v}") for v in values], F.lit(1).alias("_l"))
    b = right.select(
        *keys, *[F.lit(0).alias(v) for v in values], *[F.col(v).alias(f"_r_{v}") for v in values],
        F.lit(0).alias("_l"),
    )
    sums = [F.sum(c).alias(c) for c in (*values, *[f"_r_{v}" for v in values], "_l")]
    per_key = a.unionByName(b).groupBy(*keys).agg(*sums)
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.col(v) != F.col(f"_r_{v}"))
    return per_key.agg(
        F.sum("_l").alias("left_rows"),
        *[F.sum(v).alias(f"left_{v}") for v in values],
        F.count_if(differs).alias("mismatching_keys"),
    )


def is_subset(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many distinct left keys the right side lacks, and whether none is missing."""
    missing = left.select(*keys).join(right.select(*keys), list(keys), "left_anti").distinct()
    n = F.count(F.lit(1))
    return missing.agg(n.alias("missing_keys"), (n == 0).alias("is_subset"))


def key_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))


def key_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()
