"""Near-duplicate source records: SimHash fingerprints linked through their segment bit counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm import arrays as A
from stationflow.llm.components import connected_components
from stationflow.llm.records import ID, TEXT, map_records, source_records
from stationflow.llm.storage import stored

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
GROUPS = 7  # of segments; at most MAX_BITS of them can differ between linked fingerprints
BLOCK = 1024  # fingerprints of one cell compared at once

_PAIR_LOW = np.uint64(0x5555555555555555)
_TOP_FIRST = np.arange(63, -1, -1)


def _fingerprints(part: pa.RecordBatch, shingle: int, seed: int) -> pa.RecordBatch:
    texts = A.lowered(A.texts_of(part.column(TEXT)))
    words = A.words_of(texts)
    n = part.num_rows
    out = np.zeros(n, np.uint64)
    raw = texts.data.tobytes()
    bounds = np.searchsorted(words.doc, np.arange(n + 1))
    sizes = np.diff(bounds)
    hasher = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    for i in np.flatnonzero(sizes):
        lo, hi = bounds[i], bounds[i + 1]
        start, end = words.start[lo:hi], words.end[lo:hi]
        spaced = b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        width = (end - start) + 1
        first = np.concatenate([[0], np.cumsum(width[:-1])])
        last = first + width - 1
        k = min(shingle, len(start))
        pieces = zip(first[: len(start) - k + 1].tolist(), last[k - 1 :].tolist(), strict=True)
        h = np.array([hasher(spaced[s:e]) for s, e in pieces], np.uint64)
        bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            block = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
            bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * bits > len(h)).view(">u8")[0]
    return pa.RecordBatch.from_arrays([part.column(ID), pa.array(out.view(np.int64))], ["id", "fingerprint"])


def fingerprints(records: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(`source_record_id`, `fingerprint`): the 64-bit SimHash of each record as a signed bigint.

    A-Z are lower-cased; shingles of `shingle_words` words, repeats included, joined by one space, are
    hashed with XXH64; a bit is 1 if set in over half of the hashes. A shorter text is one shingle;
    a text without words has fingerprint zero.
    """
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    fn = functools.partial(_fingerprints, shingle=shingle_words, seed=seed)
    return map_records(df, fn, f"id {kind}, fingerprint bigint").withColumnRenamed("id", ID)


def unary_counts(fingerprint):
    """Bit counts of the 32 two-bit segments in unary form (0: 00, 1: 01, 2: 11), as a column.

    The Hamming distance of two such values is the Manhattan distance of the count vectors, and never
    above the Hamming distance of the fingerprints.
    """
    low = F.lit(0x5555555555555555)
    a, b = fingerprint.bitwiseAND(low), F.shiftrightunsigned(fingerprint, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_masks(max_bits: int = MAX_BITS, groups: int = GROUPS) -> list[int]:
    """Masks of the grid's faces: every choice of `groups - max_bits` groups of segments.

    Count vectors within Manhattan distance `max_bits` differ in at most `max_bits` groups, so they
    share the cell of at least one face: no link is lost.
    """
    if groups <= max_bits:
        raise ValueError("the grid needs more groups than differing bits")
    edges = [32 * g // groups for g in range(groups + 1)]
    group = [((1 << 2 * edges[g + 1]) - 1) ^ ((1 << 2 * edges[g]) - 1) for g in range(groups)]
    masks = [sum(group[g] for g in faces) for faces in combinations(range(groups), groups - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _unary(x: np.ndarray) -> np.ndarray:
    a, b = x & _PAIR_LOW, (x >> np.uint64(1)) & _PAIR_LOW
    return a | b | ((a & b) << np.uint64(1))


def _pairs_near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Manhattan distance of the counts first, exact distance for what remains."""
    near = np.bitwise_count(_unary(x) ^ _unary(y)) <= max_bits
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= max_bits
    return near


def _forest(size: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The links that join different trees."""
    root = list(range(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _cell_links(x: np.ndarray, side: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one cell block: within side 0, or between sides 0 and 1."""
    if (side == 1).any():
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        rows = cols = np.arange(len(x))
    left, right = [], []
    u = _unary(x)
    for r in rows.tolist():
        to = cols[cols > r] if rows is cols else cols
        near = to[np.bitwise_count(u[to] ^ u[r]) <= max_bits]
        near = near[np.bitwise_count(x[near] ^ x[r]) <= max_bits]
        left.append(np.full(len(near), r))
        right.append(near)
    if not left:
        return []
    return _forest(len(x), np.concatenate(left), np.concatenate(right))


def _links_of(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links between rows of one cell; rows arrive sorted by cell, a cell may span batches."""
    names = ("cell", "fingerprint", "side")
    held = [np.zeros(0, np.int64) for _ in names]
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
        cell, value, side = held
        if not len(cell):
            continue
        cut = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
        if not cut:
            continue
        held = [h[cut:] for h in held]
        cell, value, side = cell[:cut], value[:cut].view(np.uint64), side[:cut]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([first, [cut]]))
        left, right = [], []
        # Small cells: neighbours at each offset of the sorted rows, all cells at once.
        small = np.repeat(size <= 32, size)
        for offset in range(1, 32):
            at = np.flatnonzero(small[:-offset] & (cell[offset:] == cell[:-offset])) if cut > offset else []
            if not len(at):
                break
            near = at[_pairs_near(value[at], value[at + offset], max_bits)]
            left.append(value[near])
            right.append(value[near + offset])
        for f, s in zip(first[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            x = value[f : f + s]
            found = _cell_links(x, side[f : f + s], max_bits)
            if found:
                pairs = np.array(found)
                left.append(x[pairs[:, 0]])
                right.append(x[pairs[:, 1]])
        if left:
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to reach everything reachable.

    Grid join on the count vectors: each fingerprint goes to its cell on every face of the grid; only
    rows of one cell are compared. A cell with more than `block` fingerprints is cut into blocks by
    hash; each pair of blocks becomes its own cell, so no task holds a whole hot cell. Of a cell's
    links only a spanning forest leaves the task, never all pairs of a group.
    """
    masks = grid_masks(max_bits, groups)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("u").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    cells = prints.select("fingerprint", unary_counts(F.col("fingerprint")).alias("u")).select(
        "fingerprint", F.explode(keys).alias("cell")
    )
    hot = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = stored(hot.select("cell", F.ceil(F.col("n") / block).alias("blocks")), "hot-cells")
    dealt = cells.join(hot, "cell", "left")
    own = F.pmod(F.xxhash64("fingerprint", F.lit("block")), F.col("blocks"))
    every = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.struct(
            F.xxhash64("cell", F.least(own, other), F.greatest(own, other)).alias("cell"),
            F.when(own > other, 1).otherwise(0).cast("bigint").alias("side"),
        ),
    )
    plain = F.array(F.struct(F.col("cell").alias("cell"), F.lit(0).cast("bigint").alias("side")))
    spread = dealt.select("fingerprint", F.explode(F.when(F.col("blocks").isNull(), plain).otherwise(every)).alias("c"))
    sorted_cells = (
        spread.select("c.cell", "fingerprint", "c.side").repartition("cell").sortWithinPartitions("cell", "side")
    )
    links = sorted_cells.mapInArrow(functools.partial(_links_of, max_bits=max_bits), "a bigint, b bigint")
    return links.distinct()


def near_duplicate_groups(
    records: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, groups: int = GROUPS
) -> DataFrame:
    """Group source records whose SimHash fingerprints are linked, directly or over others.

    Fingerprints with at most `max_bits` differing bits are linked. Candidates come from a grid over
    the bit counts of two-bit segments (their Manhattan distance is a lower bound) and are verified
    exactly; see `near_links`. Copies collapse to one fingerprint first, so their number costs
    nothing after one pre-aggregated shuffle.

    One row per record: `source_record_id`, `fingerprint` (16 lowercase hex digits), `component_id`
    (smallest id reachable, itself included). Texts without words share fingerprint zero and so one
    group. A null id keeps its row; it is the `component_id` only where no id is present. Repeated
    records each get their row; an empty table gives an empty result.
    """
    prints = stored(fingerprints(records, shingle_words), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(ID).alias("least")), "distinct-fingerprints")
    component = connected_components(near_links(distinct, max_bits, groups))
    least = (
        component.join(distinct, component.node == distinct.fingerprint)
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    linked = component.join(least, "component").select(F.col("node").alias("fingerprint"), "component_id")
    of_print = distinct.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )
    # Copies of one text may hold a third of the rows: salt both sides of the last join.
    salts = 16
    salted = of_print.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        prints.withColumn("salt", F.pmod(F.xxhash64(ID), F.lit(salts)).cast("int"))
        .join(salted, ["fingerprint", "salt"])
        .select(ID, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
    )
