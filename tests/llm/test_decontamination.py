from __future__ import annotations

import random
import time

from record_tables import records

from stationflow.llm.decontamination import (
    EDIT_RATE, aligned, find_contamination, plain_points, qgrams, uncontaminated_records,
)

LETTERS = "abcdefghijklmnopqrstuvwxyz éñ"


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, item_text string")


def edit_distance(item, text):
    """Least edits of `item` to a part of `text`."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_against_edit_distance(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    known = [make(n) for n in (5, 60, 100, 180, 240)]
    texts = [None, "", make(300), known[0], "x" + known[0].upper() + "y"]
    for item in known[1:]:
        budget = int(EDIT_RATE * len(item))
        for edits in (0, 1, budget, budget + 4, len(item) // 2):
            changed = list(item)
            for _ in range(edits):
                p = rng.randrange(len(changed))
                kind = rng.randrange(3)
                changed[p : p + (kind != 1)] = [] if kind == 2 else ["#"]
            texts.append(make(rng.randrange(90)) + "".join(changed).replace(" ", "\n") + make(rng.randrange(90)))
    found = {(r[0], r[1]): r for r in find_contamination(records(spark, texts), items(spark, known)).collect()}
    for i, text in enumerate(texts):
        plain = (text or "").lower().replace("\n", " ")
        for n, item in enumerate(known):
            least = edit_distance(item, plain)
            budget = max(min(int(EDIT_RATE * len(item)), (len(item) - 10) // 10), 0)
            assert ((i, n) in found) == (least <= budget), (i, n, least)
            if (i, n) in found:
                r = found[(i, n)]
                assert r.edits == least == edit_distance(item, plain[r.start : r.end])


def test_blocks_of_items_and_repeats(spark):
    known = [f"question number {i} asks about the demand at station {i * 31} during rain" for i in range(30)]
    texts = [f"intro {k} outro" for k in known] + ["twice " + known[3] + " and " + known[3]] + ["clean text"]
    df, table = records(spark, texts), items(spark, [*known, None, ""])
    whole = sorted(tuple(r) for r in find_contamination(df, table).collect())
    assert sorted(tuple(r) for r in find_contamination(df, table, block_chars=100).collect()) == whole
    assert sum(r[0] == 30 and r[1] == 3 for r in whole) == 2
    assert [r[0] for r in uncontaminated_records(df, table, block_chars=500).collect()] == [31]
    assert find_contamination(df, table.limit(0)).count() == 0


def test_equal_windows_hash_alike():
    points = plain_points("the same window, the same window")
    for q in (1, 3, 10, 13):
        h = qgrams(points, q)
        assert len(h) == len(points) - q + 1 and h[0] == h[17]


def banded_distance(item, text, first, width):
    """Least edits of `item` to a part of `text`, over paths that keep to the given diagonals."""
    big = 10**6
    cost = {}
    for i in range(len(item) + 1):
        for j in range(max(0, i + first), min(len(text), i + first + width - 1) + 1):
            options = [0 if i == 0 else big]
            if i and j:
                options.append(cost.get((i - 1, j - 1), big) + (item[i - 1] != text[j - 1]))
            if i:
                options.append(cost.get((i - 1, j), big) + 1)
            if j and i:
                options.append(cost.get((i, j - 1), big) + 1)
            cost[i, j] = min(options)
    return min([c for (i, _), c in cost.items() if i == len(item)], default=big)


def test_band_against_its_definition():
    rng = random.Random(11)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        if rng.random() < 0.5:
            p = rng.randrange(len(text) + 1)
            text = text[:p] + item[: rng.randrange(len(item) + 1)] + "b" + item[rng.randrange(len(item)) :] + text[p:]
        first, budget = rng.randrange(-6, 20), rng.randrange(0, 5)
        width = 2 * (budget + 1)
        got = aligned(plain_points(item), plain_points(text), first, width, budget)
        least = banded_distance(item, text, first, width)
        assert (got is not None) == (least <= budget), (item, text, first, budget)
        if got:
            edits, start, end = got
            assert edits == least and 0 <= start <= end <= len(text)
            assert banded_distance(item, text[start:end], first - start, width) == edits


def test_work_grows_with_the_band_not_with_the_text():
    rng = random.Random(12)
    item = plain_points("".join(rng.choice(LETTERS) for _ in range(400)))
    seconds = []
    for size in (10_000, 5_000_000):
        text = plain_points("x" * size)
        text[size // 2 : size // 2 + 400] = item
        text[size // 2 + 7] = 35
        began = time.perf_counter()
        assert aligned(item, text, size // 2 - 20, 50, 24) == (1, size // 2, size // 2 + 400)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 5 * seconds[0] + 0.05


def test_separator_in_items_and_texts(spark):
    known = ["ab\U0010ffffcd", "a question with a \U0010ffff sign about the demand at night", "\U0010ffff"]
    texts = ["ab", "cd", "xab\U0010ffffcdx", "so: " + known[1] + "!", known[1][:18], known[1][19:]]
    found = {tuple(r) for r in find_contamination(records(spark, texts), items(spark, known)).collect()}
    assert found == {(2, 0, 1, 6, 0), (2, 2, 3, 4, 0), (3, 1, 4, 4 + len(known[1]), 0), (3, 2, 22, 23, 0)}
