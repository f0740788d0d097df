from __future__ import annotations

import random

from record_tables import WORD
from test_near_duplicates import components, fingerprint
from test_quality_rules import brute as rules

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(12)
    vocabulary = [f"term{i}" for i in range(900)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(25)
    texts = [make(rng.randrange(25, 150)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " extra", None, "", "short one", "again " * 60]
    texts += [make(40) + " " + passage + " " + make(30), make(60) + " password=hunter2hunter " + make(10)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, make(50), None, None, None), (7, make(50), "en", None, 1)], passage


def test_stages_against_brute_force(spark, tmp_path):
    rows, passage = documents()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [r for r in rows if rules(r[1] or "")["kept"]]
    group = components([fingerprint(r[1]) for r in kept], 4)
    first = {}
    for r in kept:
        g = group[fingerprint(r[1])]
        key = (r[0] is None, r[0] or 0)
        if g not in first or key < first[g][0]:
            first[g] = (key, r)
    single = [r for _, r in first.values()]
    clean = [r for r in single if passage not in r[1]]
    redacted = [(r[0], r[1].replace("password=hunter2hunter", "[secret]"), *r[2:4]) for r in clean]
    expected = [kept, single, clean, redacted]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == columns
            width = 4 if k == 3 else 5
            assert sorted((tuple(r)[:width] for r in docs.collect()), key=str) == sorted((r[:width] for r in expected[k]), key=str), name
            if k == 3:
                assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in redacted}
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
    assert all(WORD.search(r[1]) for r in clean)
