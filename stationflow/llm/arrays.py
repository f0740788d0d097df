"""Numpy views of Arrow text columns: words, word hashes and n-gram hashes of whole batches.

Words are maximal runs outside the six ASCII white-space bytes, so byte positions suffice. Nulls
count as empty texts. All arrays run over one batch; `doc` names the text a word belongs to.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4_000_000

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Texts(NamedTuple):
    data: np.ndarray  # bytes of all texts, without gaps
    offsets: np.ndarray  # one more than texts


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return Texts(data[raw[0] : raw[-1]], raw - raw[0])


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = texts_of(batch.column(text)).offsets
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def lowered(texts: Texts) -> Texts:
    """A-Z in lower case; all other bytes stay."""
    return Texts(_LOWER[texts.data], texts.offsets)


def words_of(texts: Texts) -> Words:
    data, offsets = texts
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = end - start
    out = mixed(size.astype(np.uint64) * _MULT)
    rows, at = None, 0
    longest = int(size.max())
    while at < longest:
        if rows is None:
            part = lanes[start] & _KEEP[np.minimum(size, 8)]
            out = mixed((out ^ part) * _MULT)
            rows = np.flatnonzero(size > 8)
        else:
            left = size[rows] - at
            part = lanes[start[rows] + at] & _KEEP[np.minimum(left, 8)]
            out[rows] = mixed((out[rows] ^ part) * _MULT)
            rows = rows[left > 8]
        at += 8
    return out


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    return span_hashes(texts.data, words.start, words.end)


def rolled(hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n words from each position), n from 1 to `longest`, each from the one before."""
    h = hashes
    yield 1, h
    for n in range(2, longest + 1):
        h = h[:-1] * _BASE + hashes[n - 1 :] if len(hashes) >= n else h[:0]
        yield n, h


def in_one(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each position lie in one text."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def totals(doc: np.ndarray, n_docs: int, values: np.ndarray | None = None) -> np.ndarray:
    """Sum of values (or the number of entries) per text."""
    out = np.bincount(doc, weights=values, minlength=n_docs)
    return out if values is not None and values.dtype.kind == "f" else out.astype(np.int64)
