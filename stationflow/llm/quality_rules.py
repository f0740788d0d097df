"""Quality rules for source records: how much of a text repeats itself."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationflow.llm import arrays as A
from stationflow.llm.records import ID, TEXT, map_records, source_records

# Published limits for web pages, as the largest share of a text's characters that may
# lie in repeated n-grams of each length, and in repeated lines. A copy counts, its original does not.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
# Copies of fewer characters than this, about a sentence, are never too many: shares of short texts say little.
MIN_REPEATED_CHARS = 100

MIN_WORDS = 20
WINDOW_WORDS = 8
WINDOW_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DOC = np.uint64(0x9E3779B97F4A7C15)


def _again(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _copies(keys: np.ndarray) -> np.ndarray:
    """Places whose key occurs at an earlier place."""
    twice = np.flatnonzero(_again(keys))
    _, first = np.unique(keys[twice], return_index=True)
    return np.delete(twice, first)


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each word inside one of the n-word windows that begin at `starts`."""
    steps = np.zeros(size + 1, np.int32)
    steps[starts] += 1
    np.subtract.at(steps, starts + n, 1)
    return np.cumsum(steps[:-1]) > 0


def _lines(texts: A.Texts, words: A.Words) -> tuple[np.ndarray, ...]:
    """Line number of each word, then text, start and end of each line that has a word."""
    breaks = np.flatnonzero(texts.data == 10)
    above = np.searchsorted(breaks, words.start)
    first = np.ones(len(words.start), bool)
    first[1:] = (above[1:] != above[:-1]) | (words.doc[1:] != words.doc[:-1])
    doc, above = words.doc[first], above[first]
    start = np.maximum(np.concatenate([[-1], breaks])[above] + 1, texts.offsets[doc])
    end = np.minimum(np.concatenate([breaks, [len(texts.data)]])[above], texts.offsets[doc + 1])
    return np.cumsum(first) - 1, doc, start, end


def _measure(
    part: pa.RecordBatch, limits: tuple[tuple[int, float], ...], line_limit: float, least: int
) -> pa.RecordBatch:
    texts = A.texts_of(part.column(TEXT))
    words = A.words_of(texts)
    n_docs, n_words = part.num_rows, len(words.start)
    points = np.concatenate([[0], np.cumsum(A.code_points(texts.data), dtype=np.int64)])
    chars = points[words.end] - points[words.start]
    counts = A.totals(words.doc, n_docs)
    word_chars = A.totals(words.doc, n_docs, chars.astype(float)).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.data], dtype=np.int64)])

    hashes = A.word_hashes(texts, words)
    salt = A.mixed((words.doc.astype(np.uint64) + np.uint64(1)) * _DOC)
    lengths = dict(limits)
    worst = np.zeros(n_docs)
    repeat_words = np.zeros(n_docs, np.int64)

    def share(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's characters in the given words, as it is and as far as it counts."""
        found = A.totals(words.doc[inside], n_docs, chars[inside].astype(float))
        part_of = found / np.maximum(word_chars, 1)
        return part_of, np.where(found >= least, part_of, 0.0)

    for n, rolled in A.rolled(hashes, max([WINDOW_WORDS, *lengths])):
        if n != WINDOW_WORDS and n not in lengths:
            continue
        whole = np.flatnonzero(A.in_one(words.doc, n))
        keys = A.mixed(rolled[whole]) ^ salt[whole]
        if n == WINDOW_WORDS:
            inside = _covered(whole[_again(keys)], n, n_words)
            repeat_words = A.totals(words.doc[inside], n_docs)
        if n in lengths:
            worst = np.maximum(worst, share(_covered(whole[_copies(keys)], n, n_words))[1] / lengths[n])

    line_of, line_doc, start, end = _lines(texts, words)
    keys = A.span_hashes(texts.data, start, end) ^ A.mixed((line_doc.astype(np.uint64) + np.uint64(1)) * _DOC)
    copy = np.zeros(len(keys), bool)
    copy[_copies(keys)] = True
    dup_lines = A.totals(line_doc[copy], n_docs)
    in_lines, counted = share(copy[line_of] if n_words else np.zeros(0, bool))
    worst = np.maximum(worst, counted / line_limit)

    failed = (counts < MIN_WORDS) | (100 * repeat_words > WINDOW_PERCENT * counts)
    return pa.RecordBatch.from_arrays(
        [
            part.column(ID),
            *map(pa.array, (counts, word_chars, symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]])),
            *map(pa.array, (dup_lines, repeat_words, in_lines, worst, failed, ~failed & (worst <= 1))),
        ],
        ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "line_coverage", "worst_ratio", "base_failed", "kept"],
    )


def repetition_report(
    records: DataFrame,
    ngram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    min_repeated_chars: int = MIN_REPEATED_CHARS,
) -> DataFrame:
    """Measure repetition in the `raw_text` of each source record and decide whether to keep it.

    For every n of `ngram_limits`, rolling hashes of n words find the n-grams that occurred before in
    the text; the characters of all words inside these copies, divided by the characters of all words,
    may not exceed the limit. Longer n-grams cover no more than shorter ones, so limits fall with n
    for each length to decide of its own. The same holds for characters in lines that occurred before
    and `line_limit`. Copies of fewer than `min_repeated_chars` characters in all are not held against
    a text. `worst_ratio` is the largest share over its limit; the record is kept at 1 or less, unless
    it has under 20 words or over 30 % of its words in repeated 8-word windows (`base_failed`).

    One row per record, in one pass without a shuffle: `source_record_id`, `n_words`, `word_chars`,
    `n_symbols`, `n_dup_lines`, `n_repeat_words`, `line_coverage`, `worst_ratio`, `base_failed`,
    `kept`. A null or empty text has zero counts and fails. Repeated records each get their row; an
    empty table gives an empty result. Hashes have 64 bits.
    """
    limits = tuple(sorted((ngram_limits or NGRAM_LIMITS).items()))
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    return map_records(
        df,
        functools.partial(_measure, limits=limits, line_limit=line_limit, least=min_repeated_chars),
        "id " + kind + ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, line_coverage double, worst_ratio double, base_failed boolean, kept boolean",
    ).withColumnRenamed("id", ID)


def _good(part: pa.RecordBatch, **limits) -> pa.RecordBatch:
    return part.filter(_measure(part, **limits).column("kept"))


def good_records(
    records: DataFrame,
    ngram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    min_repeated_chars: int = MIN_REPEATED_CHARS,
) -> DataFrame:
    """The source records that `repetition_report` keeps, as `source_record_id` and `raw_text`, in one pass."""
    limits = tuple(sorted((ngram_limits or NGRAM_LIMITS).items()))
    df = source_records(records)
    return map_records(df, functools.partial(_good, limits=limits, line_limit=line_limit, least=min_repeated_chars), df.schema)
