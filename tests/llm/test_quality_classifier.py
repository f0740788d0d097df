from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from record_tables import by_id, records

from stationflow.llm.quality_classifier import dual_coordinate_descent, fit_quality_model, score_quality
from stationflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def labels(spark, values):
    return spark.createDataFrame(values, "source_record_id bigint, quality int")


def test_learns_words(spark):
    rng = random.Random(1)
    good, bad, both = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)], [f"c{i}" for i in range(60)]
    texts = [" ".join(rng.choice(both + (good if i % 2 else bad)) for _ in range(60)) for i in range(300)]
    df = records(spark, [*texts, None, ""])
    model = fit_quality_model(df, labels(spark, [(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (4, 7)]))
    found = by_id(score_quality(df, model))
    assert len(found) == 302
    assert sum(found[i].predicted == i % 2 for i in range(200, 300)) >= 98
    assert found[300].score == found[301].score and 0 <= found[300].score <= 1


def test_one_label_or_none(spark):
    df = records(spark, ["a b", "c"])
    for known in ([], [(0, 1)]):
        found = by_id(score_quality(df, fit_quality_model(df, labels(spark, known))))
        assert found[0].score == found[1].score


def test_dual_solution():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    w, b = dual_coordinate_descent([np.arange(5)] * 80, list(x), y, 5, 1.0, 400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    for _ in range(200):
        assert loss(w, b) <= loss(w + 0.01 * rng.normal(size=5), b + 0.01 * rng.normal()) + 1e-3


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    scores = QUERIES["op5_quality_classifier"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scores.where("held_out").join(truth, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
