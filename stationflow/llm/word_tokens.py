"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import functools
import os

import numpy as np

from stationflow.llm import arrays as A

MAX_WORDS = 700_000
LEARN_WORDS = 8192  # encoded at once

_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _parts(texts: A.Texts, words: A.Words) -> A.Words:
    """Words with their last punctuation marks apart, where a plain letter or digit precedes them.

    The tokenizer always divides there, and far fewer distinct words remain.
    """
    data, end = texts.data, words.end
    core = end.copy()
    rows = np.flatnonzero(_MARK[data[end - 1]]) if len(end) else np.zeros(0, np.int64)
    while len(rows):
        core[rows] -= 1
        rows = rows[core[rows] > words.start[rows]]
        rows = rows[_MARK[data[core[rows] - 1]]]
    cut = (core > words.start) & (core < end)
    cut[cut] = _PLAIN[data[core[cut] - 1]]
    start = np.concatenate([words.start, core[cut]])
    order = np.argsort(start, kind="stable")
    stop = np.concatenate([np.where(cut, core, end), end[cut]])
    return A.Words(start[order], stop[order], np.concatenate([words.doc, words.doc[cut]])[order])


class WordTokens:
    """Ids of words, kept by hash in sorted arrays; forgotten all at once beyond `MAX_WORDS`.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are its
    words' ids in order. Words are lower-cased first, as the tokenizer does, unless the texts may
    hold the name of a special token, which it finds before lower-casing.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, place: np.ndarray, words: list[str]) -> None:
        """Keep the ids of new words; `place` is where each of the sorted `keys` belongs."""
        base = len(self.keys)
        self.keys = np.insert(self.keys, place, keys)
        self.slots = np.insert(self.slots, place, np.arange(base, base + len(keys), dtype=np.int32))
        sizes, ids = [], [self.ids]
        for at in range(0, len(words), LEARN_WORDS):
            some = words[at : at + LEARN_WORDS]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            ids.append(np.fromiter((i for e in encoded for i in e), np.int32, int(sizes[-1].sum())))
        self.ids = np.concatenate(ids)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: A.Texts, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if b"<|" not in texts.data.tobytes():
            texts = A.lowered(texts)
        words = _parts(texts, A.words_of(texts))
        if not len(words.start):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        distinct, first, word = np.unique(A.word_hashes(texts, words), return_index=True, return_inverse=True)
        if len(self.keys) > MAX_WORDS:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = texts.data
            at = first[missing]
            spans = zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)
            new = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in spans]
            self._learn(distinct[missing], place[missing], new)
            place = np.searchsorted(self.keys, distinct)
        slot = self.slots[place][word]
        count = np.diff(self.begin)[slot]
        at = np.repeat(self.begin[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.ids[at], A.totals(words.doc, n_docs, count.astype(float)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
