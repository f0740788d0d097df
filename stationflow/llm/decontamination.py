"""Source records that repeat evaluation items, by the q-gram lemma and banded alignment."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.arrays import mixed
from stationflow.llm.records import ID, TEXT, map_records, source_records

Q = 10
EDIT_RATE = 0.06
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22

_BASE = np.uint64(0xD6E8FEB86659FD93)
_GAP = "\U0010ffff"  # between texts; part of no item


def plain_points(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and ASCII white space as spaces; positions stay."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    points[(points >= 9) & (points <= 13)] = 32
    return points


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q code points from each position, by doubling."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power, at = np.zeros(n, np.uint64), points.astype(np.uint64), 0
    size, factor = 1, _BASE
    while at < q:
        if q & size:
            out = out * factor + power[at : at + n]
            at += size
        if size * 2 <= q:
            power = power[: len(power) - size] * factor + power[size:]
            factor = np.uint64(int(factor) ** 2 % 2**64)
        size *= 2
    return mixed(out)


class Index(NamedTuple):
    """The q-grams of a block of evaluation items."""

    ids: list
    points: list[np.ndarray]
    budget: np.ndarray  # edits allowed per item
    needed: np.ndarray  # q-grams that a region within the budget must share
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram in item and place
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # bit table over hashes
    short: list[int]  # items shorter than q: compared as they are


def build_index(items: list[tuple], q: int, edit_rate: float) -> Index:
    ids, points = [i for i, _ in items], [plain_points(t) for _, t in items]
    length = np.array([len(p) for p in points], np.int64)
    # The lemma needs at least one shared q-gram: length - q + 1 - edits * q >= 1.
    budget = np.maximum(np.minimum((edit_rate * length).astype(np.int64), (length - q) // q), 0)
    grams, item, place = [], [], []
    for n, p in enumerate(points):
        g = qgrams(p, q)
        grams.append(g)
        item.append(np.full(len(g), n))
        place.append(np.arange(len(g)))
    grams, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
    order = np.argsort(grams, kind="stable")
    grams, item, place = grams[order], item[order], place[order]
    distinct, first = np.unique(grams, return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(distinct >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(
        ids, points, budget, length - q + 1 - budget * q, distinct,
        np.append(first, len(grams)), item, place, seen,
        [n for n in range(len(ids)) if 0 < length[n] < q],
    )


_OUTSIDE = np.uint32(0xFFFFFFFF)  # no code point


def aligned(
    item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int
) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of `item` in `text` within `width` diagonals from `first` on.

    Edit distance with free ends in the text; None if over the budget. Cell k of row i ends at place
    i + first + k of the text, so each row has `width` cells and the work is length times width,
    however long the text is. Of equal places the first end wins.
    """
    m, n, big = len(item), len(text), budget + 1
    at = np.arange(width)
    begin = first + at
    row = np.where((begin >= 0) & (begin <= n), 0, big)
    # Places before and behind the text hold no code point; a path that reaches them never comes back.
    low, high = max(first, 0), min(first + m + width, n)
    padded = np.full(m + width, _OUTSIDE)
    if low < high:
        padded[low - first : high - first] = text[low:high]
    for i in range(m):
        change = row + (padded[i : i + width] != item[i])
        leave = np.append(row[1:] + 1, big)
        new = np.minimum(change, leave)
        origin = np.where(change <= leave, begin, np.append(begin[1:], 0))
        # Insertions run along the row: least of new[k] + (j - k) for k <= j.
        shifted = new - at
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, at, 0))
        row, begin = np.minimum(best + at, big), origin[source]
        if row.min() > budget:
            return None
    row = np.where(m + first + at <= n, row, big)
    cell = int(row.argmin())
    return (int(row[cell]), int(begin[cell]), m + first + cell) if row[cell] <= budget else None


def _regions(text: np.ndarray, index: Index, q: int) -> Iterator[tuple[int, int]]:
    """(item, diagonal): bands of 2 * (budget + 1) diagonals, from this one on, that share enough q-grams with an item."""
    hashes = qgrams(text, q)
    at = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    if not len(at):
        return
    found = np.searchsorted(index.grams, hashes[at])
    true = found < len(index.grams)
    true[true] = index.grams[found[true]] == hashes[at[true]]
    at, found = at[true], found[true]
    if not len(at):
        return
    copies = index.first[found + 1] - index.first[found]
    entry = np.repeat(index.first[found] - np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) + np.arange(copies.sum())
    item, diagonal = index.item[entry], np.repeat(at, copies) - index.place[entry]
    # A region within the budget keeps to budget + 1 diagonals: bands of twice that, half overlapping.
    step = index.budget[item] + 1
    band = (diagonal + (1 << 32)) // step
    for shift in (0, 1):
        key = item * (1 << 40) + band - shift
        key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        keys = key[first]
        if shift == 0:
            own, own_count = keys, count
        else:
            # Band b covers diagonals of cells b and b + 1.
            every = np.unique(np.concatenate([own, keys]))
            total = np.zeros(len(every), np.int64)
            total[np.searchsorted(every, own)] += own_count
            total[np.searchsorted(every, keys)] += count
            for k in every[total >= index.needed[every >> 40]].tolist():
                n, b = k >> 40, k & ((1 << 40) - 1)
                yield n, b * (int(index.budget[n]) + 1) - (1 << 32)


def _search(part: pa.RecordBatch, index: Index, q: int) -> pa.RecordBatch | None:
    column = part.column(TEXT).to_pylist()
    joined = plain_points(_GAP.join(column))
    sizes = np.array([len(t) for t in column], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def keep(doc: int, item: int, edits: int, begin: int, end: int) -> None:
        rows = hits.setdefault((doc, item), [])
        for i, (e, b, x) in enumerate(rows):
            if b < end and begin < x:  # one region, met in two bands
                rows[i] = min((e, b, x), (edits, begin, end))
                return
        rows.append((edits, begin, end))

    for item, diagonal in _regions(joined, index, q):
        point, budget = index.points[item], int(index.budget[item])
        width = 2 * (budget + 1)
        low, high = max(diagonal, 0), min(diagonal + width + len(point), len(joined))
        # The texts that this band touches: one, or a few where they are shorter than the item.
        from_doc, to_doc = np.searchsorted(start, [low, max(high - 1, low)], side="right") - 1
        for d in range(int(from_doc), int(to_doc) + 1):
            a = int(start[d])
            text = joined[a : a + int(sizes[d])]
            if min(high, a + len(text)) - max(low, a) < len(point) - budget:
                continue
            skip = max(low - a, 0)
            place = _place(text[skip : max(high - a, 0)].tobytes(), point.tobytes())
            if place >= 0:
                got = (0, skip + place, skip + place + len(point))
            else:
                got = aligned(point, text, diagonal - a, width, budget)
            if got:
                keep(d, item, *got)
    raw = joined.tobytes() if index.short else b""
    for item in index.short:
        point, low = index.points[item], 0
        while (place := _place(raw, point.tobytes(), low)) >= 0:  # the first place in each text that has one
            d = int(np.searchsorted(start, place, side="right")) - 1
            low = place + 1
            if place + len(point) <= start[d] + sizes[d]:
                keep(d, item, 0, place - int(start[d]), place - int(start[d]) + len(point))
                low = int(start[d] + sizes[d])
    if not hits:
        return None
    ids = part.column(ID)
    rows = sorted((d, i, b, e, c) for (d, i), found in hits.items() for c, b, e in found)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array([r[0] for r in rows])), pa.array([index.ids[r[1]] for r in rows]),
         *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))],
        ["id", "item_id", "start", "end", "edits"],
    )


def _place(raw: bytes, part: bytes, low: int = 0) -> int:
    """First place of `part` in `raw` from `low` on, both four bytes a code point, or -1."""
    at = raw.find(part, 4 * low)
    while at >= 0 and at % 4:
        at = raw.find(part, at + 1)
    return at // 4 if at >= 0 else -1


def _item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most about `block_chars` characters, one block on the driver at a time."""
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def find_contamination(
    records: DataFrame,
    evaluation_items: DataFrame,
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Places in the `raw_text` of source records that repeat an evaluation item (`item_id`, `item_text`).

    An item's edit budget is `edit_rate` of its length. By the q-gram lemma, a region within the
    budget shares at least length - q + 1 - budget * q character q-grams with the item, all on
    budget + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals;
    bands that reach the bound are aligned within their diagonals, by edit distance with free ends. A-Z are lower-cased
    and white space counts as spaces. Items shorter than q must occur as they are; empty ones are
    ignored. Whole items are met; half an item in a record is not.

    One row per region: `source_record_id`, `item_id`, `start`, `end` (code points), `edits`; records
    without any give none. The items are a stated query set: they are met in blocks of at most about
    `block_chars` characters, whatever their number, and the records are read once per block and
    never shuffle. Repeated records and repeated items each give their rows; a null text is empty;
    an empty table gives an empty result.
    """
    df = source_records(records)
    items = evaluation_items.select("item_id", F.col("item_text").cast("string")).where("length(item_text) > 0")
    kinds = (df.schema[ID].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    schema = "id {}, item_id {}, start bigint, end bigint, edits bigint".format(*kinds)
    found = None
    for block in _item_blocks(items.orderBy("item_id", "item_text"), block_chars):
        index = build_index(block, q, edit_rate)
        part = map_records(df, functools.partial(_search, index=index, q=q), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", ID)


def _clean(part: pa.RecordBatch, index: Index, q: int) -> pa.RecordBatch:
    numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column(TEXT)], [ID, TEXT])
    found = _search(numbered, index, q)
    keep = np.ones(part.num_rows, bool)
    if found is not None:
        keep[found.column("id").to_numpy()] = False
    return part.filter(pa.array(keep))


def uncontaminated_records(
    records: DataFrame,
    evaluation_items: DataFrame,
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The source records without a region of `find_contamination`, as `source_record_id` and `raw_text`.

    Each block of items filters what the block before it left, in one pass without a shuffle.
    """
    df = source_records(records)
    items = evaluation_items.select("item_id", F.col("item_text").cast("string")).where("length(item_text) > 0")
    for block in _item_blocks(items.orderBy("item_id", "item_text"), block_chars):
        index = build_index(block, q, edit_rate)
        df = map_records(df, functools.partial(_clean, index=index, q=q), df.schema)
    return df
