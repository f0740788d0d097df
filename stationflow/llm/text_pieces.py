"""Subword ids of source records by a merge-type SentencePiece vocabulary, and texts back from ids."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm import arrays as A
from stationflow.llm.records import ID, TEXT, map_records, source_records

PIECE_IDS, DECODED = "piece_ids", "decoded_text"

SPACE = "▁"  # how a vocabulary writes a space
BLOCK = 1 << 20  # code points worked on at once
ROUND_TRIP_BYTES = 2_000_000  # of texts encoded and decoded at once; a longer text stands alone
HELD_UNITS = 1_000_000
ROW_SYMBOLS = 48  # longer units have a heap of their own

_NONE = np.int32(2**31 - 1)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Vocabulary:
    """Symbols of a merge-type model: characters first, then longer pieces.

    `joinable[a, b]` tells whether any piece holds character b right after a. No merge ever crosses
    two neighbours that are not joinable, so a text falls apart there into independent units.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        how, norm = model.trainer_spec, model.normalizer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = {kinds.NORMAL, kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE}
        if how.model_type != how.BPE or how.treat_whitespace_as_suffix or any(p.type not in plain for p in model.pieces):
            raise ValueError(f"{path} is not a plain merge-type vocabulary")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError(f"{path} normalizes texts; only the identity with a leading space is built")
        self._read(model.pieces, kinds, how)

    def _read(self, pieces, kinds, how) -> None:
        normal = {p.piece: (i, p.score) for i, p in enumerate(pieces) if p.type == kinds.NORMAL}
        letters = sorted({c for piece in normal for c in piece})
        symbol = {c: k for k, c in enumerate(letters, 1)}  # 0: in no piece
        for piece in normal:
            symbol.setdefault(piece, len(symbol) + 1)
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.joinable = np.zeros(self.width * self.width, bool)
        self.n_symbols = len(symbol) + 1
        order = {s: k for k, s in enumerate(sorted({score for _, score in normal.values()}, reverse=True))}
        joins = []
        for piece, (_, score) in normal.items():
            for a, b in zip(piece, piece[1:]):
                self.joinable[symbol[a] * self.width + symbol[b]] = True
            for k in range(1, len(piece)):
                if piece[:k] in symbol and piece[k:] in symbol:
                    joins.append((symbol[piece[:k]] * self.n_symbols + symbol[piece[k:]], order[score], symbol[piece]))
        joins = np.array(sorted(joins), np.int64).reshape(-1, 3)
        self.pairs, self.pair_rank, self.pair_symbol = joins[:, 0].copy(), joins[:, 1].astype(np.int32), joins[:, 2].astype(np.int32)

        self.byte_ids = np.zeros(256, np.int32)
        bytes_of = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value], bytes_of[i] = i, bytes([value])
            elif p.type == kinds.NORMAL:
                bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.UNKNOWN:
                self.unknown, bytes_of[i] = i, how.unk_surface.encode()
        self.byte_fallback = how.byte_fallback
        self.is_byte = np.array([p.type == kinds.BYTE for p in pieces])
        self.is_control = np.array([p.type == kinds.CONTROL for p in pieces])
        self.piece_bytes = bytes_of
        self.bytes_size = np.array([len(b) for b in bytes_of], np.int64)
        self.bytes_begin = np.cumsum(self.bytes_size) - self.bytes_size
        self.bytes_data = np.frombuffer(b"".join(bytes_of), np.uint8)

        ids: list[list[int]] = [[]] * self.n_symbols
        for text, k in symbol.items():
            ids[k] = [normal[text][0]] if text in normal else self.fallback(ord(text))
        self.symbol_size = np.array([len(x) for x in ids], np.int64)
        self.symbol_begin = np.cumsum(self.symbol_size) - self.symbol_size
        self.symbol_ids = np.array([i for x in ids for i in x], np.int32)
        # A character that no piece holds parts the leading space from what follows it.
        self.fence = next(c for c in map(chr, (10, *range(0xE000, 0xF8FF))) if c not in symbol)

    def fallback(self, code: int) -> list[int]:
        """Ids of a character outside the vocabulary."""
        return self.byte_ids[list(chr(code).encode())].tolist() if self.byte_fallback else [self.unknown]

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of neighbouring symbols put together; the best score has rank 0."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key if len(self.pairs) else np.zeros(key.shape, bool)
        return np.where(found, self.pair_rank[at], _NONE), self.pair_symbol[at]


def merged_rows(symbols: np.ndarray, v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge units of equal length side by side, each by its own agenda; yields (rows, symbols) as they end.

    A row's agenda is its line of pair ranks: in each step every row takes its best pair, the leftmost
    of equals, and enters the two pairs that the new symbol forms. So all rows shrink by one a step.
    """
    rows = np.arange(len(symbols))
    rank, target = v.joined(symbols[:, :-1], symbols[:, 1:])
    while len(rows):
        if symbols.shape[1] == 1:
            yield rows, symbols
            return
        line = np.arange(len(rows))
        best = rank.argmin(1)
        more = rank[line, best] < _NONE
        if not more.all():
            yield rows[~more], symbols[~more]
            rows, symbols, rank, target, best = rows[more], symbols[more], rank[more], target[more], best[more]
            line = np.arange(len(rows))
            if not len(rows):
                return
        new = target[line, best]
        width = symbols.shape[1] - 1
        place = np.arange(width)
        symbols = np.take_along_axis(symbols, place + (place > best[:, None]), 1)
        symbols[line, best] = new
        place = np.arange(width - 1)
        skip = place + (place >= best[:, None])
        rank, target = np.take_along_axis(rank, skip, 1), np.take_along_axis(target, skip, 1)
        for rows_of, at in ((line[best > 0], best[best > 0] - 1), (line[best < width - 1], best[best < width - 1])):
            rank[rows_of, at], target[rows_of, at] = v.joined(symbols[rows_of, at], symbols[rows_of, at + 1])


def merged_unit(symbols: list[int], v: Vocabulary) -> list[int]:
    """Merge one long unit: a heap of adjacent pairs by score, then place; outdated entries are passed over."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, target = v.joined(np.array(symbols[:-1]), np.array(symbols[1:]))
    agenda = [(r, i, symbols[i], symbols[i + 1], t) for i, (r, t) in enumerate(zip(rank.tolist(), target.tolist())) if r < _NONE]
    heapq.heapify(agenda)

    def enter(left: int, right: int) -> None:
        r, t = v.joined(np.array([symbols[left]]), np.array([symbols[right]]))
        if r[0] < _NONE:
            heapq.heappush(agenda, (int(r[0]), left, symbols[left], symbols[right], int(t[0])))

    while agenda:
        _, left, a, b, new = heapq.heappop(agenda)
        right = after[left]
        if symbols[left] != a or right >= n or symbols[right] != b:
            continue
        symbols[left], symbols[right] = new, -1
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
            enter(left, after[left])
        if before[left] >= 0:
            enter(before[left], left)
    return [s for s in symbols if s >= 0]


class PieceCodec:
    """Ids of units, kept in sorted arrays by a hash of their characters and forgotten all at once."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _units(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in a row, number of ids of each)."""
        v, size = self.v, end - start
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, symbols of each, all symbols
        outside = np.flatnonzero((size == 1) & (v.letter[codes[start]] == 0))
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n <= ROW_SYMBOLS:
                letters = v.letter[codes[start[rows, None] + np.arange(n)]]
                for of, symbols in merged_rows(letters, v):
                    done.append((rows[of], np.full(len(of), symbols.shape[1]), symbols.ravel()))
            else:
                for r in rows.tolist():
                    symbols = merged_unit(v.letter[codes[start[r] : end[r]]].tolist(), v)
                    done.append((np.array([r]), np.array([len(symbols)]), np.array(symbols)))
        unit = np.concatenate([np.repeat(a, b) for a, b, _ in done])
        symbol = np.concatenate([c for _, _, c in done])
        order = np.argsort(unit, kind="stable")
        unit, symbol = unit[order], symbol[order]
        each = v.symbol_size[symbol]
        count = A.totals(unit, len(size), each.astype(float)).astype(np.int64)
        other = [v.fallback(c) for c in codes[start[outside]].tolist()]
        count[outside] = [len(x) for x in other]
        begin = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[ragged(begin[outside], count[outside])] = [i for x in other for i in x]
        known = np.ones(len(size), bool)
        known[outside] = False
        ids[ragged(begin[known], count[known])] = v.symbol_ids[ragged(v.symbol_begin[symbol], each)]
        return ids, count

    def _check(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """The library must give the same ids for every new unit."""
        v = self.v
        text = codes.astype("<u4").tobytes().decode("utf-32-le")
        lead = len(v.library.encode(v.fence))
        encoded = v.library.encode([v.fence + text[s:e] for s, e in zip(start.tolist(), end.tolist())], num_threads=1)
        same = np.array([len(x) - lead for x in encoded]) == count
        if not same.all() or not np.array_equal(np.fromiter((i for x in encoded for i in x[lead:]), np.int32, int(count.sum())), ids):
            raise ValueError("the agenda and the sentencepiece library disagree")

    def _learn(self, keys, place, codes, start, end) -> None:
        ids, count = self._units(codes, start, end)
        self._check(codes, start, end, ids, count)
        base = len(self.keys)
        self.keys = np.insert(self.keys, place, keys)
        self.slots = np.insert(self.slots, place, np.arange(base, base + len(keys), dtype=np.int32))
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])

    def _block(self, codes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit, first code point of each unit) of a stretch of whole units."""
        start = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
        end = np.concatenate([start[1:], [len(codes)]])
        data = codes.astype("<u4").view(np.uint8)
        distinct, first, unit = np.unique(A.span_hashes(data, start * 4, end * 4), return_index=True, return_inverse=True)
        if len(self.keys) > HELD_UNITS:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            at = first[~known]
            self._learn(distinct[~known], place[~known], codes, start[at], end[at])
            place = np.searchsorted(self.keys, distinct)
        slot = self.slots[place][unit]
        count = np.diff(self.begin)[slot]
        return self.ids[ragged(self.begin[slot], count)], count, start

    def encode(self, texts: A.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). An empty text has none."""
        v = self.v
        whole = texts.data.tobytes().decode("utf-8").encode("utf-32-le")
        codes = np.frombuffer(whole, "<u4")
        points = np.concatenate([[0], np.cumsum(A.code_points(texts.data), dtype=np.int64)])[texts.offsets]
        filled = np.flatnonzero(np.diff(points))
        codes = np.insert(codes, points[filled], 32)
        codes[codes == 32] = ord(SPACE)
        size = np.diff(points)[filled] + 1
        stop = np.cumsum(size)
        ids, totals = [], np.zeros(len(texts.offsets) - 1, np.int64)
        at, limit = 0, BLOCK
        while at < len(codes):
            some = codes[at : at + limit]
            letter = v.letter[some].astype(np.int64)
            cut = np.ones(len(some), bool)
            cut[:-1] = ~v.joinable[letter[:-1] * v.width + letter[1:]]
            inner = stop[np.searchsorted(stop, at, side="right") : np.searchsorted(stop, at + len(some), side="right")] - at - 1
            cut[inner] = True
            if at + len(some) < len(codes):  # the last unit may go on
                ends = np.flatnonzero(cut[:-1])
                if not len(ends):
                    limit *= 2
                    continue
                some, cut = some[: ends[-1] + 1], cut[: ends[-1] + 1]
            found, count, start = self._block(some, cut)
            ids.append(found)
            np.add.at(totals, filled[np.searchsorted(stop, start + at, side="right")], count)
            at, limit = at + len(some), BLOCK
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), totals

    def _mixed(self, ids: list[int]) -> str:
        """Text of ids whose byte pieces do not form whole characters: each stray byte is one U+FFFD."""
        v, out, run = self.v, [], b""

        def close() -> None:
            nonlocal run
            while run:
                for k in range(1, 5):
                    try:
                        out.append(run[:k].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                run = run[k:]

        for i in ids:
            if v.is_byte[i]:
                run += v.piece_bytes[i]
                continue
            close()
            out.append(v.piece_bytes[i].decode("utf-8"))
        close()
        return "".join(out)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; the space before the first piece goes, byte pieces become characters."""
        v = self.v
        size = v.bytes_size[ids]
        data = v.bytes_data[ragged(v.bytes_begin[ids], size)].tobytes()
        ends = np.cumsum(counts)
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        rows = np.split(ids, ends[:-1]) if len(counts) else []
        out = []
        for k, row in enumerate(rows):
            try:
                text = self._mixed(row.tolist()) if v.is_control[row].any() else data[at[k] : at[k + 1]].decode("utf-8")
            except UnicodeDecodeError:
                text = self._mixed(row.tolist())
            first = row[v.bytes_size[row] > 0][:1]
            lead = len(first) and not v.is_byte[first[0]] and v.piece_bytes[first[0]].startswith(b" ") and first[0] != v.unknown
            out.append(text[1:] if lead else text)
        return out


@functools.lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids, pa.int32()))


def _encode(part: pa.RecordBatch, path: str) -> pa.RecordBatch:
    ids, counts = piece_codec(path).encode(A.texts_of(part.column(TEXT)))
    return pa.RecordBatch.from_arrays([part.column(ID), _lists(ids, counts)], ["id", PIECE_IDS])


def _texts(codec: PieceCodec, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Decoded rows; the library must give the same."""
    texts = codec.decode(ids, counts)
    plain = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    if codec.v.library.decode(plain, num_threads=1) != texts:
        raise ValueError("decoding and the sentencepiece library disagree")
    return pa.array(texts, pa.string())


def _both(part: pa.RecordBatch, path: str) -> pa.RecordBatch:
    codec = piece_codec(path)
    ids, counts = codec.encode(A.texts_of(part.column(TEXT)))
    return pa.RecordBatch.from_arrays([part.column(ID), _lists(ids, counts), _texts(codec, ids, counts)], ["id", PIECE_IDS, DECODED])


def _few(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` ids; a longer row stands alone."""
    for batch in batches:
        offsets = np.cumsum(np.concatenate([[0], pc.list_value_length(batch.column(PIECE_IDS)).to_numpy(zero_copy_only=False)]))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = piece_codec(path)
    for part in _few(batches, BLOCK):
        lists = part.column(PIECE_IDS)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(codec.v.piece_bytes)):
            raise ValueError("a piece id lies outside the vocabulary")
        yield pa.RecordBatch.from_arrays([part.column("id"), lists, _texts(codec, ids, counts)], ["id", PIECE_IDS, DECODED])


def encode_pieces(records: DataFrame, vocabulary: str) -> DataFrame:
    """Subword ids of the `raw_text` of source records, equal to the sentencepiece library's.

    `vocabulary` is a merge-type model file that every executor can read. Each text is cut where no
    piece holds the two characters side by side; each distinct unit then merges its adjacent symbol
    pairs from an agenda by score, the leftmost of equals first, until no pair is a piece. Characters
    outside the vocabulary become byte pieces. Every new unit of an Arrow batch is checked against the
    library; a difference is an error. No begin or end ids, no sampling.

    One row per record, in one pass without a shuffle: `source_record_id`, `piece_ids`. A null or empty
    text has no ids; repeated records each get their row; an empty table gives an empty result. Texts
    of any length are worked on in blocks of about a million characters.
    """
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    found = map_records(df, functools.partial(_encode, path=vocabulary), f"id {kind}, {PIECE_IDS} array<int>")
    return found.withColumnRenamed("id", ID)


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add `decoded_text` to rows of `source_record_id` and `piece_ids`, checked against the library.

    Stray byte pieces become U+FFFD, control ids nothing; null ids are left out, and no ids give an empty text. Further
    columns are dropped.
    """
    df = encoded.select(F.col(ID).alias("id"), F.coalesce(F.filter(F.col(PIECE_IDS).cast("array<int>"), lambda i: i.isNotNull()), F.array().cast("array<int>")).alias(PIECE_IDS))
    kind = df.schema["id"].dataType.simpleString()
    found = df.mapInArrow(functools.partial(_decode, path=vocabulary), f"id {kind}, {PIECE_IDS} array<int>, {DECODED} string")
    return found.withColumnRenamed("id", ID)


def encode_and_decode(records: DataFrame, vocabulary: str) -> DataFrame:
    """`encode_pieces` and `decode_pieces` in one pass: `source_record_id`, `piece_ids`, `decoded_text`."""
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    schema = f"id {kind}, {PIECE_IDS} array<int>, {DECODED} string"
    return map_records(df, functools.partial(_both, path=vocabulary), schema, ROUND_TRIP_BYTES).withColumnRenamed("id", ID)
