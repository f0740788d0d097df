"""Runs of readings against a search of every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from record_tables import WORD, by_id

from stationflow.llm import periodic_runs as P
from stationflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "station string, readings array<string>"


def every_run(readings, min_length=12):
    """(start, length, period), by trying every period; null equals nothing."""
    n, best = len(readings), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            first = i
            while i < n - q and readings[i] is not None and readings[i] == readings[i + q]:
                i += 1
            if i - first + q >= max(min_length, 2 * q) and i > first:
                best.setdefault((first, i - first + q), q)
            i += i == first
    return sorted((s, n, q) for (s, n), q in best.items())


def without_runs(readings, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(readings) if i not in gone]


def made(pick):
    n, kinds = pick.randint(0, 160), pick.choice([1, 2, 3, 5, 50])
    out = [str(pick.randrange(kinds)) for _ in range(n)]
    if n and pick.random() < 0.6:
        a = pick.randrange(n)
        p = 1 + (n - a) // (3 + pick.randrange(8))
        out = out[:a] + [out[a + (i - a) % p] for i in range(a, n)]
        if pick.random() < 0.5:
            out[pick.randrange(n)] = pick.choice(["other", None])
    return out


@pytest.mark.parametrize("min_length", [2, 5, 12, 40])
def test_equals_a_search_of_every_period(spark, min_length):
    pick = random.Random(min_length)
    rows = [(f"s{k}", made(pick)) for k in range(150)]
    found = by_id(P.find_periodic_runs(spark.createDataFrame(rows, SCHEMA), min_length), "station")
    for station, readings in rows:
        runs = every_run(readings, min_length)
        assert [tuple(r) for r in found[station].runs] == runs
        assert found[station].collapsed == without_runs(readings, runs)
        assert found[station].n_readings == len(readings)


def test_classic_words_rich_in_runs():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    for word in (b, "".join("ab"[bin(i).count("1") % 2] for i in range(300)), "ab" * 100 + "a" * 50 + "ab" * 100):
        x = np.array([ord(c) for c in word])
        recurs = np.array([next((d for d in range(1, len(word) - i) if word[i + d] == word[i]), 10**6) for i in range(len(word))])
        assert [tuple(r) for r in P.runs_of(x, recurs, len(word) // 2).tolist()] == every_run(word)


def test_transform_gives_exact_convolutions():
    pick = np.random.default_rng(4)
    x, y = pick.integers(0, P.PRIME, (2, 3, 16), dtype=np.uint64)
    got = P.restored(P.transformed(x) * P.transformed(y) % P._P)
    for r in range(3):
        plain = [sum(int(x[r, i]) * int(y[r, (k - i) % 16]) for i in range(16)) % P.PRIME for k in range(16)]
        assert got[r].tolist() == plain


def test_equal_sums_of_unequal_readings_are_no_run():
    """Differences whose squares add up to the prime look like a match until values are compared."""
    a = next(a for a in range(1, 50_000) if round((P.PRIME - a * a) ** 0.5) ** 2 == P.PRIME - a * a)
    b = round((P.PRIME - a * a) ** 0.5)
    x = np.tile(np.array([7, 9, 0, 0]), 6)
    x[12:14] += [a, b]
    recurs = np.ones(len(x), np.int64)
    assert [tuple(r) for r in P.runs_of(x, recurs, 12).tolist()] == every_run(x.tolist())


@pytest.mark.parametrize("period", [1, 3, 40_001])
def test_long_series(period):
    x = np.arange(250_000) % period
    recurs = np.where(np.arange(len(x)) < len(x) - period, period, 10**9)
    assert P.runs_of(x, recurs, len(x) // 2).tolist() == [[0, len(x), period]]


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(None, None, 1, "x"), ("a", [], 2, "y"), ("a", ["7"] * 12, 3, "z"), ("a", ["7"] * 12, 3, "z"), ("b", [None] * 40, 4, "w")]
    df = spark.createDataFrame(rows, SCHEMA + ", key int, runs string")
    found = P.find_periodic_runs(df)
    assert found.columns == ["station", "n_readings", "runs", "collapsed"]
    assert sorted(len(r.runs) for r in found.collect()) == [0, 0, 0, 1, 1]
    assert P.find_periodic_runs(df.limit(0)).count() == 0


def test_a_stuck_feed_of_a_station(spark):
    rows = [("12", f"2018-03-25 {h:02d}:00:00", 5 if 6 <= h < 20 else h + 100) for h in range(24)] + [("12", "2018-03-26 00:00:00", None)]
    samples = spark.createDataFrame(rows, "station string, time string, bikes int").selectExpr("station", "cast(time AS timestamp_ntz) AS time", "bikes")
    series = P.station_readings(samples, "bikes")
    assert series.first().readings == [str(r[2]) if r[2] is not None else None for r in rows]
    found = P.find_periodic_runs(series).first()
    assert [tuple(r) for r in found.runs] == [(6, 14, 1)] and len(found.collapsed) == 12


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_query_equals_a_search_of_every_period(spark):
    found = by_id(QUERIES["op13_periodic_runs"](spark, FOLDER), "doc_id")
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(documents)
    for r in documents:
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000 and h % 10:
            continue  # a search of every period takes too long; those texts are met above
        runs = every_run(words)
        row = found[r.doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(without_runs(words, runs)).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda t: (-t[1], t[0], t[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert row.start is row.length is row.period is row.exponent_milli is None
