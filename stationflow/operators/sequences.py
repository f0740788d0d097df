"""Ordered operators that stay balanced when one key holds a large share of the rows.

A window partitioned by key alone puts a hot key into one task. The helpers here sort only
inside (key, bucket), where a bucket is a stretch of the order (a day, a value range), and carry
one summary row per bucket across its border. The summary is as long as the calendar or the
value range, never as long as the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.session import shared_dir

OCTAVE_BUCKETS = 256


@dataclass(frozen=True)
class Dealt:
    """How a large table lies: in `tasks` partitions by the values of `column`, and so its results."""

    column: str
    tasks: int


def grouped(
    df: DataFrame, keys: Sequence[str], parts: Sequence[Column], again: Sequence[Column], dealt: Dealt | None = None
) -> DataFrame:
    """Aggregates `parts` per key. A dealt table is first summed up where it lies, so a hot key leaves a row per value
    of its column; `again`, over the columns of `parts`, joins these in as many tasks."""
    if dealt is None:
        return df.groupBy(*keys).agg(*parts)
    sums = df.groupBy(*keys, dealt.column).agg(*parts)
    return sums.repartition(dealt.tasks, *keys).groupBy(*keys).agg(*again)


def _window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "previous"
) -> DataFrame:
    """Add the preceding row's `order` columns as struct `name` (null on the first row of a key).

    `bucket` must grow with `order`. Keys and the bucket must not be null.
    """
    keys = list(keys)
    item = F.struct(*order)
    rows = df.withColumn("_bucket", bucket)
    local = rows.withColumn(
        "_local", F.lag(item).over(_window([*keys, "_bucket"]).orderBy(*order))
    )
    tails = rows.groupBy(*keys, "_bucket").agg(F.max(item).alias("_tail"))
    carried = tails.select(
        *keys, "_bucket", F.lag("_tail").over(_window(keys).orderBy("_bucket")).alias("_carried")
    )
    joined = local.join(carried, [*keys, "_bucket"], "left")
    return joined.select(*df.columns, F.coalesce("_local", "_carried").alias(name))


def with_global_rank(
    df: DataFrame, order: Sequence[str], name: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based position of each row in the order of the whole table; `total` adds the size.

    Rows are dealt by ranges whose borders the engine samples from the order itself, so neither a
    common prefix nor a common day fills one task. A row's place in its partition plus the rows of
    the partitions before it is its rank; only one count per partition meets in one task. Equal rows
    of the order have no places of their own, so `order` should name a unique key.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    # Written once: the counts and the ranks must see the same partitions.
    path = shared_dir(df.sparkSession, "ranked")
    placed = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(F.lit(0))
    before = F.sum("_size").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    extra = [F.sum("_size").over(w).alias(total)] if total else []
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), *extra)
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = rows.withColumn("_part", part).join(offsets, "_part")
    return ranked.select(*df.columns, (inside + F.col("_before") + 1).alias(name), *([total] if total else []))


def value_bucket(value: Column) -> Column:
    """A whole number that never falls as the value grows: sign and binary order of magnitude, each octave
    in `OCTAVE_BUCKETS` parts."""
    size = F.abs(value)
    part = F.least(F.floor(F.log2(size) * OCTAVE_BUCKETS), F.lit(2000 * OCTAVE_BUCKETS)) + F.lit(2000 * OCTAVE_BUCKETS)
    return F.when(size == 0, 0).when(F.isnan(value), F.lit(5000 * OCTAVE_BUCKETS)).otherwise(F.signum(value) * part).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    also: Mapping[str, Column] | None = None,
    dealt: Dealt | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of a numeric column, one row per key.

    `also` names further aggregates over the value counts: columns `_v` (value) and `_n` (rows). `dealt` tells
    that `df` is large and how it lies; the counts and buckets are then spread over as many tasks.

    Equal values are counted first (combined before the shuffle). A histogram of them per key, as long
    as the range of magnitudes, tells which buckets hold a wanted rank; only the values of those are
    sorted. So `df` is read once and its counts twice, and no task sorts a key. The built-in
    `percentile` would hold every distinct value of a key in one buffer.
    """
    keys = list(keys)
    valued = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    counts = valued.groupBy(*keys, "_v", *([dealt.column] if dealt else [])).agg(F.count(F.lit(1)).alias("_n"))
    # Never null here. Said so, both readers of the counts have one plan and share its result.
    counts = counts.withColumn("_bucket", value_bucket(F.col("_v"))).where(F.col("_bucket").isNotNull())
    if dealt:
        counts = counts.repartition(dealt.tasks, *keys, "_bucket").groupBy(*keys, "_v", "_bucket").agg(F.sum("_n").alias("_n"))
    w = _window(keys)
    sized = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    sized = sized.repartition(dealt.tasks, *keys) if dealt and keys else sized
    placed = sized.withColumns(
        {"_upto": F.sum("_size").over(w.orderBy("_bucket")), "_total": F.sum("_size").over(w)}
    ).withColumn("_before", F.col("_upto") - F.col("_size"))

    def ranks(p: float) -> list[Column]:
        at = F.lit(p) * (F.col("_total") - 1)
        return [F.floor(at), F.ceil(at)]

    wanted = F.lit(False)
    for p in probabilities.values():
        for rank in ranks(p):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_upto")))
    targets = placed.where(wanted).select(*keys, "_bucket", "_before", "_total")
    end = F.sum("_n").over(_window([*keys, "_bucket"]).orderBy("_v")) + F.col("_before")
    ranked = counts.join(targets, [*keys, "_bucket"]).withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    picks = []
    for label, p in probabilities.items():
        for side, rank in zip(("lo", "hi"), ranks(p)):
            here = (F.col("_start") <= rank) & (rank < F.col("_end"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{label}_{side}"))
    picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    result = []
    for label, p in probabilities.items():
        at = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_{label}_lo"), F.col(f"_{label}_hi")
        result.append((low + (high - low) * (at - F.floor(at))).alias(label))
    quantiles = picked.select(*keys, *result)
    if not also:
        return quantiles
    extra = counts.groupBy(*keys).agg(*[c.alias(n) for n, c in also.items()])
    return quantiles.join(extra, keys) if keys else attach_row(quantiles, extra)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery; nulls when it is empty."""
    value = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", value).select(*df.columns, "_row.*")


def row_offset_lags(
    df: DataFrame, value: str, key: str, time: str, lags: Sequence[int]
) -> DataFrame:
    """`{value}_lag_k`: the value k rows earlier in the same key.

    The input is one row per key and hour, so a key has at most as many rows as the calendar.
    """
    if any(k <= 0 for k in lags):
        raise ValueError("lags must be positive")
    w = Window.partitionBy(key).orderBy(time)
    return df.select(*df.columns, *[F.lag(value, k).over(w).alias(f"{value}_lag_{k}") for k in lags])


def gap_minutes(df: DataFrame, key: str, time: str, bucket: Column | None = None) -> DataFrame:
    """Minutes since the previous sample of the same key; null on the first."""
    if bucket is None:
        bucket = F.date_trunc("day", F.col(time))
    linked = with_previous(df, [key], [time], bucket)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(
        F.col("previous")[time].cast("timestamp")
    )
    return linked.withColumn("gap_minutes", seconds / 60_000_000).drop("previous")


def event_runs(
    samples: DataFrame,
    event: str,
    key: str = "station",
    time: str = "time",
    max_gap_minutes: float = 90.0,
    bucket_hours: float = 24,
) -> DataFrame:
    """Gaps and islands: maximal runs of event samples per key.

    A run ends at a non-event sample, at a gap over `max_gap_minutes`, and at a repeated clock.
    Runs are first cut at bucket borders, so rows of a hot key spread over its buckets; only the
    fragments that touch the borders of each bucket, or the samples there that are no event, are then
    stitched. Buckets may be of any length, also shorter than the allowed gap: the fragment before
    a border is the one of the last bucket with samples, however far back it lies.
    """
    if bucket_hours <= 0:
        raise ValueError("a bucket must have a length")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    bucket = F.floor(micros / int(bucket_hours * 3_600_000_000))
    limit = int(max_gap_minutes * 60_000_000)

    rows = samples.select(
        key, time, F.coalesce(event, F.lit(False)).alias("_event"), micros.alias("_us"),
        bucket.alias("_bucket"),
    )
    w = Window.partitionBy(key, "_bucket").orderBy("_us")
    gap = F.col("_us") - F.lag("_us").over(w)
    continues = F.lag("_event").over(w) & (gap > 0) & (gap <= limit)
    marked = rows.select(
        "*",
        (F.col("_event") & ~F.coalesce(continues, F.lit(False))).alias("_starts"),
        F.lag("_us").over(w).isNull().alias("_head"),
        F.lead("_us").over(w).isNull().alias("_foot"),
    )
    numbered = marked.withColumn("_run", F.sum(F.col("_starts").cast("int")).over(w))
    fragments = (
        numbered.where("_event or _head or _foot")
        .groupBy(key, "_bucket", "_run", "_event")
        .agg(
            F.min(time).alias("start"),
            F.max(time).alias("end"),
            F.min("_us").alias("_first_us"),
            F.max("_us").alias("_last_us"),
            F.count(F.lit(1)).alias("samples"),
            F.max("_head").alias("_head"),
            F.max("_foot").alias("_foot"),
        )
    )
    # Inner fragments keep their own partition (bucket, run), border fragments share the key's.
    border = F.col("_head") | F.col("_foot")
    placed = fragments.select(
        "*",
        F.when(border, F.lit(None)).otherwise(F.col("_bucket")).alias("_place"),
    )
    b = Window.partitionBy(key, "_place").orderBy("_first_us", "_last_us", "_run")
    step = F.col("_first_us") - F.lag("_last_us").over(b)
    linked = (
        F.col("_head")
        & F.lag(F.col("_foot") & F.col("_event")).over(b)
        & (step > 0)
        & (step <= limit)
    )
    grouped = placed.withColumn(
        "_new", (~F.coalesce(linked, F.lit(False))).cast("int")
    ).withColumn("_group", F.sum("_new").over(b))
    return (
        grouped.where("_event")
        .groupBy(key, "_place", "_group")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("samples").alias("samples"),
            ((F.max("_last_us") - F.min("_first_us")) / 60_000_000).alias("span_minutes"),
        )
        .drop("_place", "_group")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Count, singletons, total hours, median and longest span of a run table (one row)."""
    totals = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("samples") == 1).alias("singleton_runs"),
        (F.coalesce(F.sum("span_minutes"), F.lit(0.0)) / 60).alias("observed_span_hours"),
        F.max("span_minutes").alias("max_span_minutes"),
    )
    median = exact_quantiles(runs, "span_minutes", {"median_span_minutes": 0.5})
    return attach_row(totals, median)


def longest_runs(runs: DataFrame, k: int = 10, key: str = "station") -> DataFrame:
    return runs.orderBy(F.desc("span_minutes"), key, "start").limit(k)


def one_row_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first"
) -> DataFrame:
    """Keep the first or last row of every key in an explicit order.

    An aggregate rather than a window: copies combine before the shuffle, however many a key has.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def contiguous_segments(
    df: DataFrame, key: str, time: str, step_minutes: int = 60, last: int | None = None
) -> DataFrame:
    """Number the stretches of a series without a missing step; optionally only the last points.

    The input is one row per key and step, bounded by the calendar.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(time))
    if last:
        df = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last)
        df = df.drop("_rank")
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(w))
    breaks = F.coalesce((seconds != step_minutes * 60).cast("int"), F.lit(0))
    return df.withColumn("_breaks", breaks).withColumn("segment", F.sum("_breaks").over(w)).drop(
        "_breaks"
    )


def seasonal_naive_forecast(
    history: DataFrame, key: str, time: str, value: str, horizon: int, seasonality: int = 1
) -> DataFrame:
    """(key, step, forecast): the last season repeated once, then its last value; clipped at zero.

    A series shorter than a season repeats its last value; `seasonality=1` is the naive forecast.
    Only the newest `seasonality` rows of a key pass the map-side window limit.
    """
    if horizon <= 0 or seasonality <= 0:
        raise ValueError("horizon and seasonality must be positive")
    newest = Window.partitionBy(key).orderBy(F.desc(time))
    tail = (
        history.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= seasonality)
        .withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy(key)))
    )
    full = F.col("_held") == seasonality
    first = F.when(full, F.lit(seasonality) - F.col("_age") + 1).otherwise(F.lit(1))
    newest_row = F.col("_age") == 1
    last = F.when(newest_row, F.greatest(first, F.lit(horizon))).otherwise(first)
    steps = tail.where(full | newest_row).select(
        key, value, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("step")
    )
    forecast = F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("forecast")
    return steps.where(F.col("step") <= horizon).select(key, "step", forecast)


def held_out_scores(
    actual: DataFrame, history: DataFrame, key: str, time: str, value: str, seasonality: int | None = None
) -> DataFrame:
    """Errors of the naive and the seasonal naive forecast of `history` over the `actual` rows behind it.

    One row per key of `actual`: `naive_mae`, `naive_rmse`, `naive_r2`, and the same of `seasonal_naive`,
    null where the key's history is shorter than `seasonality` or that is under 2. R2 is null when all
    actual values are equal. A key without history stops the job. Only the newest `seasonality` rows
    of a key's history are kept.
    """
    season = max(seasonality or 1, 1)
    newest = Window.partitionBy(key).orderBy(F.desc(time))
    tail = (
        history.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= season)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_age")).alias("at"), F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("_tail"))
    )
    step = F.row_number().over(Window.partitionBy(key).orderBy(time))
    rows = actual.select(key, F.col(value).cast("double").alias("_y"), step.alias("_step")).join(tail, key, "left")
    known = F.coalesce("_tail", F.raise_error(F.lit("training history is required")))
    rows = rows.withColumn("_tail", known)
    last = F.element_at("_tail", -1)["v"]
    full = (F.size("_tail") == season) & F.lit(season > 1)
    placed = F.when(full, F.element_at("_tail", F.least(F.col("_step"), F.lit(season)))["v"])
    out = []
    for name, forecast in (("naive", last), ("seasonal_naive", placed)):
        error = F.col("_y") - forecast
        fit = F.sum(error * error)
        spread = F.sum(F.col("_y") * F.col("_y")) - F.sum("_y") * F.sum("_y") / F.count("_y")
        out += [
            F.avg(F.abs(error)).alias(f"{name}_mae"),
            F.sqrt(F.avg(error * error)).alias(f"{name}_rmse"),
            F.when(F.min("_y") < F.max("_y"), 1 - fit / spread).alias(f"{name}_r2"),
        ]
    return rows.groupBy(key).agg(*out)
