"""A quality score for source records: naive Bayes features under a linear support vector machine."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm import arrays as A
from stationflow.llm.records import ID, TEXT, map_records, source_records

FEATURE_BITS = 17
FIT_RECORDS_PER_LABEL = 4096
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
LABEL = "quality"


class QualityModel(NamedTuple):
    """Weight of each hashed n-gram, ratio already multiplied in, and the calibration of the margin."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float


def ngram_features(texts: A.Texts, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): sorted distinct hashed words and word pairs of each text; a-z and A-Z differ."""
    words = A.words_of(texts)
    hashes = A.word_hashes(texts, words)
    keys = []
    for n, rolled in A.rolled(hashes, 2):
        whole = A.in_one(words.doc, n)
        feature = A.mixed(rolled[whole]) >> np.uint64(64 - FEATURE_BITS)
        keys.append(words.doc[: len(whole)][whole].astype(np.int64) << FEATURE_BITS | feature.astype(np.int64))
    key = np.unique(np.concatenate(keys))
    bounds = np.searchsorted(key, np.arange(n_docs + 1) << FEATURE_BITS)
    return key & ((1 << FEATURE_BITS) - 1), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, good, bad) of a whole partition: texts of each label that hold the feature."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for part in A.chunks(batches, TEXT):
        feature, bounds = ngram_features(A.texts_of(part.column(TEXT)), part.num_rows)
        label = part.column(LABEL).to_numpy(zero_copy_only=False).astype(bool)
        of = np.repeat(label, np.diff(bounds))
        counts[1] += np.bincount(feature[of], minlength=1 << FEATURE_BITS)
        counts[0] += np.bincount(feature[~of], minlength=1 << FEATURE_BITS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[1, used]), pa.array(counts[0, used])], ["feature", "good", "bad"]
    )


def _examples(part: pa.RecordBatch) -> pa.RecordBatch:
    feature, bounds = ngram_features(A.texts_of(part.column(TEXT)), part.num_rows)
    feature = feature.astype("<i4")
    packed = [feature[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [part.column("order_key"), part.column(LABEL), pa.array(packed, pa.binary())], ["order_key", LABEL, "features"]
    )


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: float, epochs: int, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with hinge loss; one dual variable per row, in random order."""
    weight, bias = np.zeros(width), 0.0
    alpha = np.zeros(len(rows))
    size = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i], values[i]
            gap = y[i] * (weight[at] @ x + bias) - 1
            new = min(max(alpha[i] - gap / size[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                weight[at] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weight, bias


def _calibrated(margin: np.ndarray, good: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope and offset for margins, labels weighted to their share among all training rows."""
    slope, offset = 1.0, 0.0
    weight = np.where(good, share / max(good.mean(), 1e-9), (1 - share) / max(1 - good.mean(), 1e-9))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g, h = weight * (good - p), weight * p * (1 - p) + 1e-9
        a = np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(a, [(g * margin).sum() - 1e-2 * (slope - 1), g.sum() - 1e-2 * offset])
        slope, offset = slope + 0.5 * step[0], offset + 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(slope), 0.1), float(offset)


def _scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    values = [ratio[r] for r in rows]
    return [v / max(np.sqrt(v @ v), 1e-9) for v in values]


def fit_quality_model(
    records: DataFrame,
    labels: DataFrame,
    fit_records_per_label: int = FIT_RECORDS_PER_LABEL,
    cost: float = COST,
    epochs: int = EPOCHS,
) -> QualityModel:
    """Train on the records named in `labels` (`source_record_id`, `quality` 0 or 1).

    The class log-count ratios of hashed n-grams come from all labelled records, counted in Spark. The
    machine is fitted on a bounded sample: of each label the `fit_records_per_label` records with the
    smallest hash of the id. Three quarters of it train, a quarter calibrates. With no record of
    a label the model gives every text the same score. Labels other than 0 and 1 are ignored; of
    repeated labels of one record the smallest counts.
    """
    df = source_records(records)
    known = (
        labels.where(F.col(LABEL).isin(0, 1) & F.col(ID).isNotNull())
        .groupBy(F.col(ID).alias(ID)).agg(F.min(LABEL).cast("int").alias(LABEL))
    )
    # Labels grow with the records: the same join at every size, each text shuffled once at most.
    counted = df.join(known.hint("merge"), ID).select(TEXT, LABEL).mapInArrow(_count, "feature bigint, good bigint, bad bigint")
    rows = counted.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    share = {r[LABEL]: r["count"] for r in known.groupBy(LABEL).count().collect()}
    width = 1 << FEATURE_BITS
    good, bad = np.full(width, SMOOTHING), np.full(width, SMOOTHING)
    for array, column in ((good, "good"), (bad, "bad")):
        array[rows.column("feature").to_numpy()] += rows.column(column).to_numpy()
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    total = max(sum(share.values()), 1)
    mean = (share.get(1, 0) + 0.5) / (total + 1)
    flat = QualityModel(ratio, np.zeros(width), 0.0, 1.0, float(np.log(mean / (1 - mean))))
    if not share.get(0) or not share.get(1):
        return flat
    key = F.xxhash64(ID, F.lit("fit"))
    chosen = [
        known.where(F.col(LABEL) == v).withColumn("order_key", key).orderBy("order_key", ID).limit(fit_records_per_label)
        for v in (0, 1)
    ]
    picked = df.join(F.broadcast(chosen[0].unionByName(chosen[1])), ID).select("order_key", LABEL, TEXT)
    sample = map_records(picked, _examples, f"order_key bigint, {LABEL} int, features binary")
    # Repeated records would exceed the bound: one of each key.
    examples = sorted(sample.dropDuplicates(["order_key", LABEL]).collect(), key=lambda r: r["order_key"])
    features = [np.frombuffer(r["features"], "<i4") for r in examples]
    y = np.array([r[LABEL] for r in examples]) == 1
    if len(set(y)) < 2:
        return flat
    values = _scaled(features, ratio)
    train = np.arange(len(y)) % 4 != 0
    if len(set(y[train])) < 2:
        train[:] = True
    fit = np.flatnonzero(train)
    weight, bias = dual_coordinate_descent(
        [features[i] for i in fit], [values[i] for i in fit], np.where(y[fit], 1.0, -1.0), width, cost, epochs
    )
    rest = np.flatnonzero(~train) if len(set(y[~train])) == 2 else fit
    margin = np.array([weight[features[i]] @ values[i] + bias for i in rest])
    slope, offset = _calibrated(margin, y[rest].astype(float), share[1] / total)
    return QualityModel(ratio, weight, bias, slope, offset)


def _score(part: pa.RecordBatch, model: QualityModel) -> pa.RecordBatch:
    n = part.num_rows
    feature, bounds = ngram_features(A.texts_of(part.column(TEXT)), n)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    ratio = model.ratio[feature]
    norm = np.sqrt(np.bincount(doc, weights=ratio**2, minlength=n))
    margin = np.bincount(doc, weights=ratio * model.weight[feature], minlength=n) / np.maximum(norm, 1e-9) + model.bias
    score = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))
    return pa.RecordBatch.from_arrays(
        [part.column(ID), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
    )


def score_quality(records: DataFrame, model: QualityModel) -> DataFrame:
    """The model's probability that the `raw_text` of each source record is of good quality.

    Features are indicators of hashed words and word pairs, scaled by their class log-count ratio and
    to unit length. Only the text is read. One row per record, in one pass without a shuffle:
    `source_record_id`, `score` (0 to 1), `predicted` (1 at 0.5 or more). Null and empty texts have no
    features and get the score of the bias; repeated records each get their row; an empty table
    gives an empty result. The model has a fixed size.
    """
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    fn = functools.partial(_score, model=model)
    return map_records(df, fn, f"id {kind}, score double, predicted int").withColumnRenamed("id", ID)
