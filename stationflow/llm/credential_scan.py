"""Secrets in source records: fixed forms, and random strings that a tokenizer cannot compress."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from stationflow.llm.records import ID, TEXT, map_records, source_records
from stationflow.llm.spans import Span, digest, joined, rows_matching

KINDS = ("assign", "access", "hex", "random")
MAX_CHARS_PER_TOKEN = 1.9
MIN_RANDOM_CHARS = 20

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM_CHARS)

# Texts without these forms are not looked at again (linear-time patterns, never stricter).
_HAS_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[a-z0-9+/_.=-]{6}"
_HAS_ACCESS = r"AKIA[A-Z0-9]{16}"
_HAS_HEX = r"[0-9a-f]{24}"
_HAS_RUN = r"[A-Za-z0-9+/_=-]{%d}" % MIN_RANDOM_CHARS

# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PIECES = re.compile(r"[-_/+=]+")
_NUMBER = re.compile(r"(?:[0-9]+|[0-9]{8}T[0-9]{2,6}Z?|[vV][0-9]+)?")
_NAME = re.compile(r"([A-Za-z]+)[0-9]{0,4}")
_SHORT_NAME = 3  # letters


@functools.lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    """Byte-pair ranks of a vocabulary file, read once per worker."""
    import public_tokenizers

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_digest_or_identifier(run: str, tokens: Callable[[str], int], ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Digests, UUIDs, and names made of numbers and words.

    A word is known by its tokens, not by being made of letters: it has more than `ratio` characters
    for each, or three letters at most.
    """
    if len(run) in _DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    if _UUID.fullmatch(run):
        return True
    for piece in _PIECES.split(run):
        if _NUMBER.fullmatch(piece):
            continue
        name = _NAME.fullmatch(piece)
        if not name or not (len(name[1]) <= _SHORT_NAME or len(name[1]) > ratio * tokens(name[1])):
            return False
    return True


def base_spans(text: str, wanted: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    found: list[Span] = []
    if wanted[0]:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if wanted[1]:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if wanted[2]:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def random_spans(text: str, base: list[Span], tokens: Callable[[str], int], ratio: float) -> list[Span]:
    """Runs that need more than one token per `ratio` characters, outside the base spans.

    Runs and base spans are met side by side, each once, in order.
    """
    taken: list[tuple[int, int]] = []  # base spans, overlapping ones as one
    for start, _, end in sorted(base):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], end))
        else:
            taken.append((start, end))
    found, at = [], 0
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        if len(m[0]) <= ratio * tokens(m[0]) and not known_digest_or_identifier(m[0], tokens, ratio):
            found.append((m.start(), 3, m.end()))
    return found


def _found(column: pa.Array, vocabulary: str, ratio: float) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """(row, text, base spans, added spans) of each text that may have any."""
    has = [set(rows_matching(column, p).tolist()) for p in (_HAS_ASSIGN, _HAS_ACCESS, _HAS_HEX, _HAS_RUN)]
    for i in sorted(set().union(*has)):
        text = column[i].as_py()
        base = base_spans(text, tuple(i in h for h in has[:3]))
        more = []
        if i in has[3]:
            encoding = _encoding(vocabulary)
            more = random_spans(text, base, lambda run: len(encoding.encode_ordinary(run)), ratio)
        yield i, text, base, more


def _scan(part: pa.RecordBatch, vocabulary: str, ratio: float) -> pa.RecordBatch:
    rows: list[tuple] = [(0, 0, 0, "", "")] * part.num_rows
    for i, _, base, more in _found(part.column(TEXT), vocabulary, ratio):
        kinds = [k for _, k, _ in base]
        rows[i] = (*(kinds.count(k) for k in range(3)), joined(base, KINDS), joined(base + more, KINDS))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [part.column(ID), *(pa.array(c, pa.int64()) for c in columns[:3]),
         pa.array([digest(x) for x in columns[3]]), pa.array(columns[4], pa.string())],
        ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    )


def _redact(part: pa.RecordBatch, vocabulary: str, ratio: float, mark: str) -> pa.RecordBatch:
    texts = part.column(TEXT).to_pylist()
    for i, text, base, more in _found(part.column(TEXT), vocabulary, ratio):
        out, done = [], 0
        for start, _, end in sorted(base + more):
            if end > done:
                out += [text[done : max(start, done)], mark if start >= done else ""]
                done = end
        texts[i] = "".join(out) + text[done:]
    return pa.RecordBatch.from_arrays([part.column(ID), pa.array(texts, pa.string())], [ID, TEXT])


def _ranks(vocabulary: str | None) -> str:
    if vocabulary is not None:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def redacted_records(
    records: DataFrame,
    vocabulary: str | None = None,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    mark: str = "[secret]",
) -> DataFrame:
    """All source records (`source_record_id`, `raw_text`) with the spans of `find_secrets` replaced by `mark`."""
    df = source_records(records)
    fn = functools.partial(_redact, vocabulary=_ranks(vocabulary), ratio=max_chars_per_token, mark=mark)
    return map_records(df, fn, df.schema)


def find_secrets(
    records: DataFrame, vocabulary: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN
) -> DataFrame:
    """Credentials in the `raw_text` of source records, before an export is published.

    Fixed forms: an assignment to a secret's name with a value of 6 or more characters, an access key
    of 20 or more, a hexadecimal run of 24 or more; leftmost, non-overlapping per kind. Kind `random`
    adds runs of 20 or more characters of an encoded alphabet that the byte-pair `vocabulary` (a
    tiktoken file) needs many tokens for: at most `max_chars_per_token` characters each. Known
    digests, UUIDs and identifiers made of words and numbers are left out, and whatever overlaps
    a fixed form. A run of letters alone is judged like any other; a word is known by its few tokens.

    One row per record, in one pass without a shuffle: `source_record_id`, `n_assign`, `n_access`,
    `n_hex`, `base_sha256` (of the fixed forms), `spans` (`kind:start:end`, all kinds). A null or empty
    text has no spans; repeated records each get their row; an empty table gives an empty result.
    """
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    return map_records(
        df,
        functools.partial(_scan, vocabulary=_ranks(vocabulary), ratio=max_chars_per_token),
        f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    ).withColumnRenamed("id", ID)
