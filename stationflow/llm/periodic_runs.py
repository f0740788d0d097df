"""Stretches of a station's readings that repeat with a period: stuck feeds and replayed exports."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.records import ship_package

STATION, READINGS = "station", "readings"
MIN_LENGTH = 12
CHUNK_READINGS = 400_000

# A prime of the form k * 2**27 + 1 and a generator of its multiplicative group.
PRIME = 2013265921
GENERATOR = 31
_P = np.uint64(PRIME)
_CELLS = 1 << 18  # numbers transformed at once


@functools.lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half-1 of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % _P])
    return out


def transformed(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    rows, size = a.shape
    half = size // 2
    while half:
        pairs = a.reshape(rows, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        np.remainder(u + v, _P, out=out[:, :, 0])
        np.remainder((u + _P - v) * _roots(half, False), _P, out=out[:, :, 1])
        a, half = out, half // 2
    return a.reshape(rows, size)


def restored(a: np.ndarray) -> np.ndarray:
    """Inverse of `transformed`."""
    rows, size = a.shape
    half = 1
    while half < size:
        pairs = a.reshape(rows, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1] * _roots(half, True) % _P
        out = np.empty_like(pairs)
        np.remainder(u + v, _P, out=out[:, :, 0])
        np.remainder(u + _P - v, _P, out=out[:, :, 1])
        a, half = out, half * 2
    return a.reshape(rows, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def zero_lags(x: np.ndarray, blocks: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) wherever the `size` values of a block recur `low` to `high` places later.

    The sum of squared differences of a block and each part of the window after it is two sums of
    squares less twice a convolution, all modulo a prime: zero for every equal part. The caller compares
    values, as the sum of an unequal part may be a multiple of the prime.
    """
    window = size + high - low
    width = 1 << (window - 1).bit_length()
    starts, distances = [], []
    step = max(1, _CELLS // width)
    for at in range(0, len(blocks), step):
        b = blocks[at : at + step, None]
        place = b + low + np.arange(window)
        inside = place < len(x)
        block = np.zeros((len(b), width), np.uint64)
        block[:, :size] = x[b + size - 1 - np.arange(size)] % PRIME
        later = np.zeros((len(b), width), np.uint64)
        later[:, :window] = np.where(inside, x[np.minimum(place, len(x) - 1)], 0) % PRIME
        squares = np.zeros((len(b), window + 1), np.uint64)
        np.cumsum(later[:, :window] * later[:, :window] % _P, axis=1, out=squares[:, 1:])
        own = (block[:, :size] * block[:, :size] % _P).sum(1, keepdims=True)
        product = restored(transformed(block) * transformed(later) % _P)[:, size - 1 : window]
        total = (own + squares[:, size:] - squares[:, :-size]) % _P
        row, lag = np.nonzero((total + _P * np.uint64(2) - product - product) % _P == 0)
        fits = b[row, 0] + low + lag + size <= len(x)
        starts.append(b[row[fits], 0])
        distances.append(lag[fits] + low)
    return np.concatenate(starts), np.concatenate(distances)


def _stretch(x: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The maximal stretch of places around `i` whose value recurs `d` places later."""
    stop, step = i, 64
    while stop < len(x) - d:
        part = x[stop : min(stop + step, len(x) - d)] != x[stop + d : stop + d + step]
        bad = int(part.argmax())
        if part[bad]:
            stop += bad
            break
        stop, step = stop + len(part), step * 2
    start, step = i, 64
    while start > 0:
        low = max(0, start - step)
        part = (x[low:start] != x[low + d : start + d])[::-1]
        bad = int(part.argmax())
        if part[bad]:
            start -= bad
            break
        start, step = low, step * 2
    return start, stop


def _scales(longest: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """(block size, lowest distance, highest distance), all periods up to `longest` in rising order.

    A run of period q has max(q, min_length - q) places or more that recur q later. The block size is
    the largest power of two of which a stretch that long always holds a whole aligned block.
    """
    q = np.arange(1, longest + 1)
    size = 1 << np.floor(np.log2((np.maximum(q, min_length - q) + 1) / 2)).astype(np.int64)
    low = 0
    while low < len(q):
        high = low
        while high + 1 < len(q) and size[high + 1] == size[low] and high + 1 - low < 2 * size[low]:
            high += 1
        yield int(size[low]), int(q[low]), int(q[high])
        low = high + 1


def runs_of(x: np.ndarray, recurs: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of whole numbers, by start, then period.

    `recurs` is the distance to the next equal value (a large number where there is none), `longest`
    the largest period to look for. Per scale, only blocks whose values all recur within reach are
    transformed, and none that lies deep in a run of a smaller period, where nothing new can be found.
    """
    found = np.zeros((0, 3), np.int64)
    for size, low, high in _scales(longest, min_length):
        n_blocks = (len(x) - low) // size
        if n_blocks <= 0:
            break
        near = (recurs[: n_blocks * size] <= high).reshape(n_blocks, size).all(1)
        blocks = np.flatnonzero(near) * size
        if not len(blocks):
            continue
        reach = np.zeros(len(x), np.int64)  # (end, place in `found`) of the run that reaches furthest
        if len(found):
            np.maximum.at(reach, found[:, 0], (found[:, 0] + found[:, 1]) * (len(found) + 1) + np.arange(1, len(found) + 1))
        reach = np.maximum.accumulate(reach)

        def around(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            end, which = np.divmod(reach[places], len(found) + 1)
            return end, np.where(which > 0, found[np.maximum(which, 1) - 1, 2], len(x)) if len(found) else np.full(len(places), len(x))

        end, period = around(blocks)
        blocks = blocks[(end < blocks + high + size) | (period > size)]
        if not len(blocks):
            continue
        start, distance = zero_lags(x, blocks, size, low, high)
        end, period = around(start)
        new = (end < start + distance + size) | (distance % period != 0)
        start, distance = start[new], distance[new]
        order = np.lexsort((start, distance))
        more, done = [], (0, 0)
        for i, d in zip(start[order].tolist(), distance[order].tolist()):
            if done[0] == d and i < done[1] or not np.array_equal(x[i : i + size], x[i + d : i + d + size]):
                continue
            first, stop = _stretch(x, i, d)
            done = (d, stop)
            if stop - first + d >= max(min_length, 2 * d):
                more.append((first, stop - first + d, d))
        if more:
            # A multiple of a period spans the same places; the smallest period is met first.
            found = np.concatenate([found, np.array(more, np.int64)])
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            first_of = np.ones(len(found), bool)
            first_of[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
            found = found[first_of]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(values: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers equal for equal readings of one row, and the distance to each reading's next occurrence.

    A null reading is unknown and equals no other.
    """
    n = len(values)
    codes = pc.dictionary_encode(values).indices if n else pa.array([], pa.int32())
    unknown = codes.is_null().to_numpy(zero_copy_only=False)
    code = codes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    code[unknown] = np.arange(int(unknown.sum())) + n
    key = row * (2 * n + 1) + code
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    x = np.empty(n, np.int64)
    x[order] = np.concatenate([[0], np.cumsum(~same)])[:n]
    recurs = np.full(n, 2 * n + 1, np.int64)
    recurs[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return x, recurs


def _find(part: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    lists = part.column(READINGS)
    values = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    x, recurs = numbered(values, row)
    runs = runs_of(x, recurs, int(counts.max(initial=0)) // 2, min_length)
    owner = row[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    steps = np.zeros(len(x) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    struct = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - begin[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"]
    )

    def per_row(items: pa.Array, of: np.ndarray) -> pa.Array:
        ends = np.cumsum(np.bincount(of, minlength=len(counts))) if len(counts) else []
        return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), items)

    return pa.RecordBatch.from_arrays(
        [part.column("key"), pa.array(counts), per_row(struct, owner), per_row(values.filter(pa.array(kept)), row[kept])],
        ["key", "n_readings", "runs", "collapsed"],
    )


def _walk(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(READINGS)), 0).to_numpy(zero_copy_only=False)
        offsets, start = np.cumsum(np.concatenate([[0], sizes])), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_READINGS, side="right")) - 1)
            yield _find(batch.slice(start, stop - start), min_length)
            start = stop


def station_readings(samples: DataFrame, measure: str) -> DataFrame:
    """`station` and its `readings`: `measure` as text in order of `time`, as the snapshots recorded it.

    Equal times follow by value; a null measure stays a null reading. A station's samples are bounded
    by the calendar, so they fit one row.
    """
    pair = F.struct(F.col("time"), F.col(measure).cast("string").alias("reading"))
    ordered = F.sort_array(F.collect_list(pair))
    return samples.groupBy(STATION).agg(F.transform(ordered, lambda s: s["reading"]).alias(READINGS))


def find_periodic_runs(series: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Runs in the `readings` (array of text, in order) of each `station`.

    A run is a stretch of readings with smallest period q, at least max(`min_length`, 2q) long, that no
    neighbouring reading extends with that period. Blocks of each dyadic size are sought in the windows
    after them by an exact number-theoretic convolution of squared differences; the distances of their
    occurrences are extended to whole stretches.

    One row per row of `series`, in one pass without a shuffle: `station`, `n_readings`, `runs` (structs
    of `start`, `length`, `period`, by start, then period; places count from 0) and `collapsed`, the
    readings that no run contains after its first q. Null or no readings have no runs; a null reading
    is unknown and equals no other; repeated rows each get their row; an empty table gives an empty
    result; further columns are dropped.
    """
    ship_package(series.sparkSession)
    df = series.select(F.col(STATION).alias("key"), F.col(READINGS).cast("array<string>").alias(READINGS))
    kind = df.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_readings bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed array<string>"
    return df.mapInArrow(functools.partial(_walk, min_length=min_length), schema).withColumnRenamed("key", STATION)
