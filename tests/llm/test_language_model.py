from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from record_tables import WORD, by_id, lowered, records
from pyspark.sql import functions as F

from stationflow.llm.elias_fano import EliasFano, SuccessorTrie, codes_of, values_of
from stationflow.llm.language_model import LOWEST, PRIOR, score_records

STEP = -LOWEST / 254


def tokens(text):
    return [*WORD.findall(lowered(text or "")), None]


def brute(texts, train):
    words, pairs = Counter(), Counter()
    for text, used in zip(texts, train, strict=True):
        if used:
            t = tokens(text)
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    total, distinct = sum(words.values()), len(words)
    for text in texts:
        t = tokens(text)
        plain = [(words[w] + 1) / (total + distinct + 1) for w in t]
        smooth = [
            pairs[c, w] / (words[c] + PRIOR) + PRIOR / (words[c] + PRIOR) * p
            for c, w, p in zip([None, *t[:-1]], t, plain, strict=True)
        ]
        yield len(t), sum(words[w] > 0 for w in t), total, sum(map(math.log10, plain)), sum(map(math.log10, smooth))


def check(spark, texts, train, **options):
    df = records(spark, texts).withColumn("in_training", F.element_at(F.array(*map(F.lit, train)), F.col("source_record_id").cast("int") + 1))
    found = by_id(score_records(df, **options))
    assert len(found) == len(texts)
    for i, (n, known, total, base, score) in enumerate(brute(texts, train)):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        # A stored probability is off by half a step at most.
        assert abs(r.score - score) <= n * STEP / 2 + 1e-9


def test_against_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "\u212a", "the", "THE"]
    texts = [None, "", " \n"] + [" ".join(rng.choice(vocabulary[: rng.choice([3, 54])]) for _ in range(rng.randrange(80))) for _ in range(120)]
    train = [i % 4 != 1 for i in range(len(texts))]
    check(spark, texts, train)
    check(spark, texts, train, batch_bytes=500)


def test_no_training_and_no_rows(spark):
    check(spark, ["a b", None], [False, False])
    empty = records(spark, ["x"]).withColumn("in_training", F.lit(True)).limit(0)
    assert score_records(empty).count() == 0


def test_lists_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for k, (n, top) in enumerate(((0, 9), (1, 5), (1000, 10**6), (500, 2**63), (3000, 40))):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        coded = EliasFano.write(values, tmp_path, f"list{k}")
        assert (coded[np.arange(n)] == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64)])
        assert (coded.first_not_below(asked) == np.searchsorted(values, asked)).all()


def test_trie_finds_pairs(tmp_path):
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0).astype(np.uint64)
    p = rng.uniform(1e-6, 1, len(pairs))
    trie = SuccessorTrie.write(tmp_path, pairs[:, 0] * np.uint64(2**50), pairs[:, 1], p, 40, LOWEST)
    known = {(int(a), int(b)): x for (a, b), x in zip(pairs, p, strict=True)}
    a, b = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(62), np.arange(62)))
    got = values_of(trie.codes(a * np.uint64(2**50), b), LOWEST)
    for x, y, value in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert (value == 0) == ((x, y) not in known)
        if value:
            assert abs(math.log10(value / known[x, y])) <= STEP / 2 + 1e-9
    assert codes_of(np.array([LOWEST, 0.0]), LOWEST).tolist() == [1, 255]
