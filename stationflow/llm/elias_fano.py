"""Elias-Fano lists of growing integers, kept in memory-mapped files and searched many keys at once."""

from __future__ import annotations

from pathlib import Path

import numpy as np

_ONE = np.uint64(1)
_WORD = 64


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the `rank`-th set bit (from 0) of each word, by halving."""
    place = np.zeros(len(word), np.int64)
    rank = rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rank >= ones
        rank = np.where(up, rank - ones, rank)
        place = np.where(up, place + width, place)
        word = np.where(up, word >> np.uint64(width), low)
    return place


class EliasFano:
    """A non-decreasing list: low bits packed side by side, high bits in unary, with a zero count per word."""

    def __init__(self, folder: Path, name: str):
        self.size, self.bits = np.load(folder / f"{name}.shape.npy").tolist()
        self.low = np.load(folder / f"{name}.low.npy", mmap_mode="r")
        self.high = np.load(folder / f"{name}.high.npy", mmap_mode="r")
        self.zeros = np.load(folder / f"{name}.zeros.npy", mmap_mode="r")
        self.ones = np.load(folder / f"{name}.ones.npy", mmap_mode="r")

    @classmethod
    def write(cls, values: np.ndarray, folder: Path, name: str) -> EliasFano:
        """Encode sorted unsigned 64-bit values into files of `folder`."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max((top // max(n, 1)).bit_length() - 1, 0)
        at = np.arange(n, dtype=np.int64)
        low = np.zeros(n * bits // _WORD + 2, np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            word, shift = at * bits // _WORD, (at * bits % _WORD).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(bits) > _WORD
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(_WORD) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + at
        high = np.zeros((n + (top >> bits) + 1) // _WORD + 1, np.uint64)
        np.bitwise_or.at(high, place // _WORD, _ONE << (place % _WORD).astype(np.uint64))
        ones = np.bitwise_count(high).astype(np.int64)
        for part, array in (
            ("shape", np.array([n, bits])), ("low", low), ("high", high),
            ("ones", np.concatenate([[0], np.cumsum(ones)])), ("zeros", np.concatenate([[0], np.cumsum(_WORD - ones)])),
        ):
            np.save(folder / f"{name}.{part}.npy", array)
        return cls(folder, name)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.uint64)
        at = index * self.bits
        word, shift = at // _WORD, (at % _WORD).astype(np.uint64)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > _WORD
        out[over] |= self.low[word[over] + 1] << (np.uint64(_WORD) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        word = np.searchsorted(self.ones, index, side="right") - 1
        place = word * _WORD + _select_in_word(self.high[word], index - self.ones[word])
        return ((place - index).astype(np.uint64) << np.uint64(self.bits)) | self._low(index)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Place of the `rank`-th zero among the high bits."""
        word = np.minimum(np.searchsorted(self.zeros, rank, side="right") - 1, len(self.high) - 1)
        return word * _WORD + _select_in_word(~self.high[word], rank - self.zeros[word])

    def first_not_below(self, values: np.ndarray) -> np.ndarray:
        """Place of the first entry not below each value: successor search inside one run of high bits."""
        if not self.size:
            return np.zeros(len(values), np.int64)
        bucket = (values >> np.uint64(self.bits)).astype(np.int64)
        inside = bucket < int(self.zeros[-1])
        known = np.where(inside, bucket, 0)
        end = self._zero(known) - known
        begin = np.where(known > 0, self._zero(np.maximum(known - 1, 0)) + 1 - known, 0)
        begin, end = np.where(inside, begin, self.size), np.where(inside, end, self.size)
        begin, end = np.minimum(begin, self.size), np.minimum(end, self.size)
        rest = values & np.uint64((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            middle = (begin[open_] + end[open_]) // 2
            below = self._low(middle) < rest[open_]
            begin[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]


def codes_of(log10: np.ndarray, lowest: float) -> np.ndarray:
    """Eight-bit codes 1 to 255 of values from `lowest` to 0, evenly spaced; 0 stands for absent."""
    return (1 + np.rint(254 * (1 - np.clip(log10, lowest, 0) / lowest))).astype(np.uint8)


def values_of(codes: np.ndarray, lowest: float) -> np.ndarray:
    """10 to the decoded value; 0 for code 0."""
    return np.where(codes == 0, 0.0, 10.0 ** (lowest * (1 - (codes.astype(float) - 1) / 254)))


class SuccessorTrie:
    """Two levels: contexts with monotone pointers, and their successors with quantised probabilities.

    A successor is stored relative to its context: the list holds context * 2**width + successor, which
    grows over the whole level, so one successor search finds it inside its context's range.
    """

    def __init__(self, folder: Path, width: int, lowest: float):
        self.width, self.lowest = np.uint64(width), lowest
        self.context = np.load(folder / "context.npy", mmap_mode="r")
        self.pointer = EliasFano(folder, "pointer")
        self.successor = EliasFano(folder, "successor")
        self.code = np.load(folder / "code.npy", mmap_mode="r")

    @classmethod
    def write(
        cls, folder: Path, context: np.ndarray, successor: np.ndarray, probability: np.ndarray, width: int, lowest: float
    ) -> SuccessorTrie:
        """From pairs sorted by context, then successor, without repetitions."""
        distinct, first = np.unique(context, return_index=True)
        if len(distinct) >= 1 << (64 - width):
            raise ValueError("too many contexts for one shard")
        np.save(folder / "context.npy", distinct)
        pointer = np.append(first, len(context)).astype(np.uint64)
        EliasFano.write(pointer, folder, "pointer")
        number = np.repeat(np.arange(len(distinct), dtype=np.uint64), np.diff(pointer).astype(np.int64))
        EliasFano.write((number << np.uint64(width)) | successor, folder, "successor")
        np.save(folder / "code.npy", codes_of(np.log10(probability), lowest))
        return cls(folder, width, lowest)

    def codes(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 where the trie has none."""
        out = np.zeros(len(context), np.uint8)
        if not len(self.context) or not len(context):
            return out
        number = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        known = np.flatnonzero(self.context[number] == context)
        number = number[known]
        wanted = (number.astype(np.uint64) << self.width) | successor[known]
        place = self.successor.first_not_below(wanted)
        inside = place < self.pointer[number + 1].astype(np.int64)
        hit = np.flatnonzero(inside)
        hit = hit[self.successor[place[hit]] == wanted[hit]]
        out[known[hit]] = self.code[place[hit]]
        return out
