"""Packing source records into fixed windows of tokens, lexical neighbours together."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm import arrays as A
from stationflow.llm.records import ID, TEXT, map_records, source_records
from stationflow.llm.word_tokens import word_tokens

WINDOW = 2048
END_ID = 1
RECORDS_PER_SHARD = 2048
QUERY_TERMS = 24
TRIES = 64
K1, B = 1.2, 0.75


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(part: pa.RecordBatch, vocabulary: str, window: int, end_id: int) -> pa.RecordBatch:
    """Full windows of long records as finished pieces, and the rest of each record with its ids."""
    n = part.num_rows
    flat, counts = word_tokens(vocabulary).encode(A.texts_of(part.column(TEXT)), n)
    stop = np.cumsum(counts)
    row, start, length, crc, total, rest = [], [], [], [], [], []
    for d in range(n):
        ids = np.append(flat[stop[d] - counts[d] : stop[d]], end_id)
        for at in range(0, len(ids), window):
            piece = ids[at : at + window]
            row.append(d)
            start.append(at)
            length.append(len(piece))
            crc.append(_crc(piece))
            total.append(len(ids))
            rest.append(None if len(piece) == window else piece.astype("<u4" if piece.max() > 65535 else "<u2").tobytes())
    big = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
    return pa.RecordBatch.from_arrays(
        [part.column(ID).take(pa.array(row, pa.int64())), *big, pa.array(rest, pa.binary())],
        ["id", "start", "length", "crc", "total", "rest"],
    )


class Shard:
    """An inverted BM25 index over the unfinished records of one shard."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        length = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(n), length)
        terms = np.concatenate(ids).astype(np.int64) if n else np.zeros(0, np.int64)
        key, tf = np.unique(terms * n + doc, return_counts=True) if n else (terms, terms)
        self.doc, self.term = key % max(n, 1), key // max(n, 1)
        distinct, first = np.unique(self.term, return_index=True)
        self.bounds = np.append(first, len(key))
        df = np.diff(self.bounds)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # Each record's query: its rarest terms that another record shares.
        rank = np.repeat(np.arange(len(distinct)), df)
        shared = np.flatnonzero(np.repeat(df, df) > 1)
        order = shared[np.lexsort((rank[shared], np.repeat(df, df)[shared], self.doc[shared]))]
        self.query_term = rank[order]
        self.query_bounds = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        terms = self.query_term[self.query_bounds[seed] : self.query_bounds[seed + 1]][:QUERY_TERMS]
        if not len(terms):
            return np.zeros(self.n)
        at = np.concatenate([np.arange(self.bounds[t], self.bounds[t + 1]) for t in terms.tolist()])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(ids: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (record, start within its rest, length); every id in exactly one.

    The longest unused record seeds a window; its BM25 neighbours follow in order of score where they
    fit whole, and the best of the others is cut to fill what is left. The last tokens of a shard form
    sequences of power-of-two lengths, which need no padding.
    """
    shard = Shard(ids)
    left = np.array([len(x) for x in ids], np.int64)
    begin = np.zeros(len(ids), np.int64)
    open_tokens = int(left.sum())
    out = []
    seeds = np.argsort(-left, kind="stable").tolist()
    at = 0
    while open_tokens:
        size = window if open_tokens >= window else 1 << (open_tokens.bit_length() - 1)
        sequence: list[tuple[int, int, int]] = []
        space = size

        def take(d: int) -> None:
            nonlocal space
            n = min(space, int(left[d]))
            sequence.append((d, int(begin[d]), n))
            begin[d] += n
            left[d] -= n
            space -= n

        while not left[seeds[at]]:
            at += 1
        seed = seeds[at]
        take(seed)
        if space:
            scores = np.where(left > 0, shard.scores(seed), -1.0)
            best = np.argpartition(-scores, min(TRIES, len(scores) - 1))[: TRIES + 1]
            best = [d for d in best[np.lexsort((best, -scores[best]))].tolist() if left[d]]
            for d in best:
                if left[d] <= space:
                    take(d)
            for d in best:
                if space and left[d]:
                    take(d)
            following = at
            while space:  # fewer neighbours than space: go on with the next longest records
                while not left[seeds[following]]:
                    following += 1
                take(seeds[following])
        open_tokens -= size
        out.append(sequence)
    return out


def _pack(table: pa.Table, window: int) -> pa.Table:
    rows = table.sort_by([("id", "ascending"), ("start", "ascending"), ("crc", "ascending"), ("total", "ascending")])
    rest = rows.column("rest").to_pylist()
    length = rows.column("length").to_pylist()
    crc = rows.column("crc").to_pylist()
    begins = rows.column("start").to_pylist()
    partial = [i for i, r in enumerate(rest) if r is not None]
    ids = [np.frombuffer(rest[i], "<u2" if len(rest[i]) == 2 * length[i] else "<u4") for i in partial]
    piece, start, size, check, sequence, offset = [], [], [], [], [], []
    number = 0
    for i, r in enumerate(rest):
        if r is None:
            for column, value in zip((piece, start, size, check, sequence, offset), (i, begins[i], length[i], crc[i], number, 0), strict=True):
                column.append(value)
            number += 1
    for members in pack_shard(ids, window):
        at = 0
        for d, b, n in members:
            i = partial[d]
            value = crc[i] if n == length[i] else _crc(ids[d][b : b + n])
            for column, v in zip((piece, start, size, check, sequence, offset), (i, begins[i] + b, n, value, number, at), strict=True):
                column.append(v)
            at += n
        number += 1
    take = pa.array(piece, pa.int64())
    shard = rows.column("shard").take(take).to_numpy()
    big = [pa.array(x, pa.int64()) for x in (start, size, check)]
    return pa.Table.from_arrays(
        [rows.column("id").take(take), *big, rows.column("total").take(take),
         pa.array(shard * (1 << 24) + np.array(sequence, np.int64), pa.int64()), pa.array(offset, pa.int64())],
        names=["id", "start", "length", "ids_crc32", "record_tokens", "sequence_id", "offset"],
    )


def pack_records(
    records: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    records_per_shard: int = RECORDS_PER_SHARD,
) -> DataFrame:
    """Pack the `raw_text` of all source records into sequences of at most `window` tokens.

    A record's tokens are its ids by the tokenizer file `vocabulary`, then `end_id`. Full windows of
    a long record are sequences of their own. The rest of each record goes to a shard of about
    `records_per_shard` records; the number of shards follows the number of records. Each shard is an
    inverted BM25 index over token ids: the longest unused record seeds a window, its unused neighbours
    by BM25 fill it, the last one is cut (queries use a record's rarest shared terms). Only the last
    tokens of a shard fall short of a full window and form sequences of power-of-two lengths.

    One row per piece: `source_record_id`, `start` (ids of the record before it), `length`,
    `ids_crc32` (of the ids as unsigned little-endian 32-bit numbers), `record_tokens`, `sequence_id`,
    `offset` (in the sequence, without gaps). A null or empty text is one piece of one token. Repeated
    records are packed each; an empty table gives an empty result. A task holds one shard.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    shards = max(1, -(-df.count() // records_per_shard))
    pieces = map_records(
        df,
        functools.partial(_pieces, vocabulary=vocabulary, window=window, end_id=end_id),
        f"id {kind}, start bigint, length bigint, crc bigint, total bigint, rest binary",
    )
    shard = F.pmod(F.xxhash64("id", "start", "crc"), F.lit(shards)).cast("bigint")
    packed = pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(
        lambda table: _pack(table, window),
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, record_tokens bigint,"
        " sequence_id bigint, offset bigint",
    )
    return packed.withColumnRenamed("id", ID)
