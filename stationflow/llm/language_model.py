"""Bigram scores of source records from an Elias-Fano trie that stays sharded over the cluster."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm import arrays as A
from stationflow.llm.elias_fano import SuccessorTrie, values_of
from stationflow.llm.records import ID, TEXT, ship_package
from stationflow.llm.storage import stored

IN_TRAINING = "in_training"
PRIOR = 500.0  # weight of the unigram distribution, in tokens
BATCH_BYTES = 8_000_000
RECORDS_PER_SHARD = 4096
SUCCESSOR_BITS = 40
LOWEST = -9.0  # smallest stored log10 probability
END = np.uint64(0)  # hash of the end of a text; a word's hash never stands for it


# --- batches: texts as numbers of their own vocabulary -------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One row per batch of texts: ids, tokens per text, tokens, and the vocabulary, commonest first."""
    partition = TaskContext.get().partitionId()
    for number, part in enumerate(A.chunks(batches, TEXT, limit)):
        texts = A.lowered(A.texts_of(part.column(TEXT)))
        words = A.words_of(texts)
        n = part.num_rows
        length = A.totals(words.doc, n) + 1
        token = np.full(int(length.sum()), END)
        hashes = A.word_hashes(texts, words)
        hashes[hashes == END] = np.uint64(1)
        token[np.arange(len(words.start)) + words.doc] = hashes
        vocabulary, place, count = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        numbers = rank[place]
        train = part.column(IN_TRAINING).to_numpy(zero_copy_only=False).astype(bool)
        seen = np.bincount(numbers[np.repeat(train, length)], minlength=len(order))
        # Bytes of equal weight lie together, which compresses the rarely used high ones.
        planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(ID))
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition << 32 | number]), ids, pa.array([length.astype("<i4").tobytes()], pa.binary()),
             pa.array([train.tobytes()], pa.binary()), pa.array([planes], pa.binary()),
             pa.array([vocabulary[order].tobytes()], pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())],
            ["batch", "ids", "length", "train", "tokens", "vocabulary", "seen"],
        )


def _numbers(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _slices(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal shards in a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(first, [*first[1:], len(shard)], strict=True):
        yield int(shard[a]), slice(int(a), int(b))


# --- word counts ---------------------------------------------------------------------------------


def _vocabularies(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for i in range(part.num_rows):
            hashes = _numbers(part.column("vocabulary")[i].as_py(), "<u8")
            order = np.argsort(hashes)
            hashes, seen = hashes[order], _numbers(part.column("seen")[i].as_py())[order]
            rows = [(s, hashes[at].tobytes(), seen[at].tobytes()) for s, at in _slices(_top(hashes, bits))]
            shard, words, counts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array([part.column("batch")[i].as_py()] * len(rows)), pa.array(words, pa.binary()), pa.array(counts, pa.binary())],
                ["shard", "batch", "words", "counts"],
            )


def _count_words(table: pa.Table) -> pa.Table:
    """Training count of every word of a shard, back to each batch in its order; totals in batch -1."""
    words = [_numbers(x, "<u8") for x in table.column("words").to_pylist()]
    counts = np.concatenate([_numbers(x) for x in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    back = np.split(total[place], np.cumsum([len(w) for w in words])[:-1])
    shard = table.column("shard")[0].as_py()
    n = len(words) + 1
    return pa.Table.from_arrays(
        [pa.array([*table.column("batch").to_pylist(), -1]), pa.array([shard] * n), pa.array([*[b.tobytes() for b in back], b""], pa.binary()),
         pa.array([0] * len(words) + [int(total.sum())]), pa.array([0] * len(words) + [int((total > 0).sum())])],
        names=["batch", "shard", "counts", "n_tokens", "n_words"],
    )


# --- pairs ---------------------------------------------------------------------------------------


class Batch(NamedTuple):
    """A batch with the training count of each of its tokens, and its distinct pairs in shard order."""

    length: np.ndarray
    train: np.ndarray
    count: np.ndarray  # per token
    context_count: np.ndarray  # per token: of the token before
    hashes: np.ndarray  # sorted
    pair: np.ndarray  # per token: its pair
    context: np.ndarray  # per pair: place in hashes
    successor: np.ndarray
    shard: np.ndarray
    hot: np.ndarray  # per pair


def _open(row: dict, total: int, bits: int) -> Batch:
    length, train = _numbers(row["length"], "<i4").astype(np.int64), _numbers(row["train"], "?")
    planes = np.frombuffer(row["tokens"], np.uint8).reshape(4, -1)
    token = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    vocabulary = _numbers(row["vocabulary"], "<u8")
    order = np.argsort(vocabulary)
    hashes = vocabulary[order]
    count = np.concatenate([_numbers(r["counts"]) for r in sorted(row["word_counts"], key=lambda r: r["shard"])])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token = place[token]
    before = np.concatenate([[0], token[:-1]])
    before[np.cumsum(length) - length] = np.searchsorted(hashes, END)  # a text begins after an end
    distinct, pair = np.unique(before << 32 | token, return_inverse=True)
    context, successor = distinct >> 32, distinct & 0xFFFFFFFF
    # A context with many of all tokens is split by its successors.
    hot = count[context] > total / (8 << bits)
    shard = _top(hashes[context], bits)
    split = A.mixed(hashes[context[hot]] ^ (hashes[successor[hot]] >> np.uint64(64 - bits)))
    shard[hot] = _top(split, bits)
    by_shard = np.argsort(shard, kind="stable")
    moved = np.empty(len(by_shard), np.int64)
    moved[by_shard] = np.arange(len(by_shard))
    return Batch(
        length, train, count[token], count[before], hashes, moved[pair],
        context[by_shard], successor[by_shard], shard[by_shard], hot[by_shard],
    )


def _rows(part: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[dict]:
    for i in range(part.num_rows):
        yield {n: part.column(n)[i].as_py() for n in names}


_STATE = ("batch", "length", "train", "tokens", "vocabulary", "word_counts")


def _five(values: np.ndarray) -> bytes:
    """The lowest 40 bits of each value, five bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _requests(batches: Iterator[pa.RecordBatch], total: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each batch, per shard: contexts once each, successors, training counts."""
    for part in batches:
        for row in _rows(part, _STATE):
            b = _open(row, total, bits)
            seen = np.bincount(b.pair[np.repeat(b.train, b.length)], minlength=len(b.context))
            counts = {int(c): int(n) for c, n in zip(*_context_totals(b), strict=True)}
            out = []
            for shard, at in _slices(b.shard):
                context = b.context[at]
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                heads = context[first]
                hot = b.hot[at][first]
                out.append((
                    shard, row["batch"], b.hashes[heads].tobytes(),
                    np.diff(np.append(first, len(context))).astype("<u4").tobytes(),
                    _five(b.hashes[b.successor[at]] >> np.uint64(64 - SUCCESSOR_BITS)), seen[at].astype("<u4").tobytes(),
                    b.hashes[heads[hot]].tobytes(), np.array([counts[int(h)] for h in heads[hot]], "<i8").tobytes(),
                ))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                ["shard", "batch", "heads", "runs", "successors", "seen", "hot", "hot_counts"],
            )


def _context_totals(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hot contexts of a batch (places in hashes) and their training counts."""
    token_context = b.context[b.pair]
    hot = b.hot[b.pair]
    places, first = np.unique(token_context[hot], return_index=True)
    return places, b.context_count[hot][first]


def _answer(table: pa.Table, prior: float) -> pa.Table:
    """Build the shard's trie from all pairs seen in training and look every requested pair up in it."""
    contexts, successors = [], []
    for heads, runs, rest in zip(*(table.column(c).to_pylist() for c in ("heads", "runs", "successors")), strict=True):
        contexts.append(np.repeat(_numbers(heads, "<u8"), _numbers(runs, "<u4")))
        successors.append(_from_five(rest))
    context, successor = np.concatenate(contexts), np.concatenate(successors)
    seen = np.concatenate([_numbers(x, "<u4") for x in table.column("seen").to_pylist()]).astype(np.int64)
    used = np.flatnonzero(seen > 0)
    used = used[np.lexsort((successor[used], context[used]))]
    c, s = context[used], successor[used]
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])) if len(c) else np.zeros(0, np.int64)
    count = np.add.reduceat(seen[used], first) if len(c) else np.zeros(0, np.int64)
    c, s = c[first], s[first]
    distinct, place = np.unique(c, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, count)
    hot = [_numbers(x, "<u8") for x in table.column("hot").to_pylist()]
    if sum(map(len, hot)):
        hot_counts = np.concatenate([_numbers(x) for x in table.column("hot_counts").to_pylist()])
        hot, at = np.unique(np.concatenate(hot), return_index=True)
        found = np.searchsorted(distinct, hot)
        here = (found < len(distinct)) & (distinct[np.minimum(found, len(distinct) - 1)] == hot) if len(distinct) else np.zeros(len(hot), bool)
        total[found[here]] = hot_counts[at[here]]
    with tempfile.TemporaryDirectory() as folder:
        trie = SuccessorTrie.write(Path(folder), c, s, count / (total[place] + prior), SUCCESSOR_BITS, LOWEST)
        codes = [trie.codes(x, y).tobytes() for x, y in zip(contexts, successors, strict=True)]
        del trie
    return pa.Table.from_arrays(
        [table.column("batch"), table.column("shard"), pa.array(codes, pa.binary())], names=["batch", "shard", "codes"]
    )


# --- scores --------------------------------------------------------------------------------------


def _finish(batches: Iterator[pa.RecordBatch], total: int, words: int, bits: int, prior: float) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for i, row in enumerate(_rows(part, (*_STATE, "pair_codes"))):
            b = _open(row, total, bits)
            codes = np.frombuffer(b"".join(r["codes"] for r in sorted(row["pair_codes"], key=lambda r: r["shard"])), np.uint8)
            plain = (b.count + 1) / (total + words + 1)
            rest = prior / (b.context_count + prior)
            smooth = values_of(codes[b.pair], LOWEST) + rest * plain
            first = np.cumsum(b.length) - b.length
            n = len(b.length)
            yield pa.RecordBatch.from_arrays(
                [part.column("ids")[i].values, pa.array(~b.train), pa.array(b.length),
                 pa.array(np.add.reduceat((b.count > 0).astype(np.int64), first)), pa.array(np.full(n, total)),
                 pa.array(np.add.reduceat(np.log10(plain), first)), pa.array(np.add.reduceat(np.log10(smooth), first))],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score_records(records: DataFrame, prior: float = PRIOR, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """log10 probability of the `raw_text` of each source record, from those with `in_training` true.

    Tokens are A-Z-lower-cased words, then one end per text. `base_score` adds
    log10((c + 1) / (N + V + 1)) over the tokens, with training counts c, N of all and V distinct.
    `score` is a bigram model: c(context, token) / (c(context) + prior) plus the base probability with
    weight prior / (c(context) + prior); the first token's context is an end. The pair part is a
    quantised probability in an Elias-Fano trie: sorted contexts, monotone pointers, successors
    relative to their context, in memory-mapped files.

    The model is never whole anywhere. Texts are coded in batches against their own vocabulary; only
    distinct words and pairs of a batch travel to their shard, which counts them, builds its trie,
    answers, and drops it. Contexts with a large part of all tokens are split over shards by
    successor. Batches are bucketed in a table of the shared warehouse, so texts never shuffle. Words are
    identified by 64-bit hashes, successors by 40 bits within their context.

    One row per record: `source_record_id`, `held_out`, `n_tokens`, `n_known` (c > 0), `train_tokens`
    (N), `base_score`, `score`. A null or empty text is its end; a null `in_training` is false. Without
    training records all tokens are unknown. Repeated records each get their row (and count each); an
    empty table gives an empty result.
    """
    spark = records.sparkSession
    missing = {ID, TEXT, IN_TRAINING} - set(records.columns)
    if missing:
        raise ValueError(f"source records lack {sorted(missing)}")
    ship_package(spark)
    df = records.select(
        F.col(ID).alias(ID), F.coalesce(F.col(TEXT).cast("string"), F.lit("")).alias(TEXT),
        F.coalesce(F.col(IN_TRAINING).cast("boolean"), F.lit(False)).alias(IN_TRAINING),
    )
    kind = df.schema[ID].dataType.simpleString()
    bits = max(3, (df.count() // RECORDS_PER_SHARD).bit_length())
    name = f"language_model_{uuid.uuid4().hex}"
    coded = df.mapInArrow(
        functools.partial(_encode, limit=batch_bytes),
        f"batch bigint, ids array<{kind}>, length binary, train binary, tokens binary, vocabulary binary, seen binary",
    )
    coded.write.option("compression", "zstd").bucketBy(1 << bits, "batch").saveAsTable(name)
    try:
        table = spark.table(name)
        words = table.select("batch", "vocabulary", "seen").mapInArrow(
            functools.partial(_vocabularies, bits=bits), "shard bigint, batch bigint, words binary, counts binary"
        )
        word_counts = stored(
            words.groupBy("shard").applyInArrow(
                lambda t: _count_words(t), "batch bigint, shard bigint, counts binary, n_tokens bigint, n_words bigint"
            ),
            "word-counts",
        )
        sums = word_counts.where("batch = -1").agg(F.sum("n_tokens"), F.sum("n_words")).first()
        total, distinct = sums[0] or 0, sums[1] or 0
        of_batch = word_counts.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("shard", "counts")).alias("word_counts"))
        state = table.drop("seen").join(of_batch, "batch")
        requests = state.drop("ids").mapInArrow(
            functools.partial(_requests, total=total, bits=bits),
            "shard bigint, batch bigint, heads binary, runs binary, successors binary, seen binary, hot binary, hot_counts binary",
        )
        codes = stored(
            requests.groupBy("shard").applyInArrow(lambda t: _answer(t, prior), "batch bigint, shard bigint, codes binary"),
            "pair-codes",
        )
        pairs = codes.groupBy("batch").agg(F.collect_list(F.struct("shard", "codes")).alias("pair_codes"))
        scores = state.join(pairs, "batch").mapInArrow(
            functools.partial(_finish, total=total, words=distinct, bits=bits, prior=prior),
            f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        )
        return stored(scores, "text-scores").withColumnRenamed("id", ID)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
