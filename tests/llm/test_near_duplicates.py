from __future__ import annotations

import random

import numpy as np
import xxhash
from record_tables import WORD, by_id, lowered, records

from stationflow.llm.components import connected_components
from stationflow.llm.near_duplicates import grid_masks, near_duplicate_groups, near_links, unary_counts


def fingerprint(text):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(set(values))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def texts():
    rng = random.Random(8)
    vocabulary = [f"word{i}é" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 200]))] for _ in range(25)]
    out = [None, "", "\n\t", "One", "one", "a b", "A  B"]
    for _ in range(220):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_groups_against_all_pairs(spark):
    data = texts()
    prints = [fingerprint(t) for t in data]
    of = components(prints, 4)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(of[p], i)
    found = by_id(near_duplicate_groups(records(spark, data)))
    for i, p in enumerate(prints):
        assert (found[i].fingerprint, found[i].component_id) == (f"{p:016x}", least[of[p]])


def test_no_link_is_lost_in_hot_cells(spark):
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    for base in list(values)[:3]:
        for _ in range(150):
            values.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fingerprint bigint")
    expected = components(list(values), 4)
    for block in (16, 1024):
        linked = {r.node % 2**64: r.component % 2**64 for r in connected_components(near_links(prints, block=block)).collect()}
        groups, truth = {}, {}
        for v in values:
            groups.setdefault(linked.get(v, v), set()).add(v)
            truth.setdefault(expected[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_counts_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (50, 2), dtype=np.int64)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "x bigint, y bigint")
    for r in df.select("x", "y", unary_counts(df.x).alias("u"), unary_counts(df.y).alias("v")).collect():
        counts = lambda n: [(n >> 2 * s & 3).bit_count() for s in range(32)]
        manhattan = sum(abs(a - b) for a, b in zip(counts(r.x), counts(r.y), strict=True))
        assert (r.u ^ r.v).bit_count() == manhattan <= (r.x ^ r.y).bit_count()
    assert len(grid_masks()) == 35


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}
