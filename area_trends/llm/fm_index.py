"""An FM-index over numbered words: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 4


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Positions of `words` in the order of their suffixes, by prefix doubling.

    Zeros are ends of texts; they count as different from each other, the earlier as the
    smaller, so no comparison goes beyond the end of a text. The last word must be zero.
    Each round sorts only positions whose prefix still ties.
    """
    n = len(words)
    ends = words == 0
    code = words.astype(np.uint64) + np.uint64(int(ends.sum()))
    code[ends] = np.arange(int(ends.sum()), dtype=np.uint64)
    bits = max(1, int(code.max()).bit_length())
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key <<= np.uint64(bits)
        key[: max(n - k, 0)] |= code[k:]
    order = np.argsort(key)
    in_order = key[order]
    first = np.r_[True, in_order[1:] != in_order[:-1]]
    heads = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    tied = ~(first & np.r_[first[1:], True])
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        group = rank[at]
        key = (group << 32) | rank[np.minimum(at + depth, n - 1)]
        moved = np.argsort(key)
        at, key = at[moved], key[moved]
        order[slots] = at
        first = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(first)
        rank[at] = np.repeat(slots[heads], np.diff(np.r_[heads, len(slots)]))
        slots = slots[~(first & np.r_[first[1:], True])]
        depth *= 2
    return order


class Bits:
    """A bit vector with ranks: packed words and the count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = -(-len(bits) // 64) + 1
        self.words = np.zeros(words, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Finds word sequences in a shard of texts.

    `words` holds the texts one after another, numbered from 1, each closed by a zero.
    The last column of the sorted suffixes is kept as a wavelet matrix, whose ranks
    lead a backward search; every `SAMPLE`-th position and each start of a text is kept
    to locate what was found.
    """

    def __init__(self, words: np.ndarray, symbols: int):
        order = suffix_order(words)
        column = words[order - 1]
        column[order == 0] = 0
        counts = np.bincount(words, minlength=symbols + 1)
        self.first = np.r_[0, np.cumsum(counts)]
        sampled = (order % SAMPLE == 0) | (column == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]
        self.levels: list[tuple[Bits, int]] = []
        self.height = max(1, int(symbols).bit_length())
        for level in reversed(range(self.height)):
            ones = (column >> level) & 1 == 1
            self.levels.append((Bits(ones), len(column) - int(ones.sum())))
            column = np.concatenate([column[~ones], column[ones]])
        self.begin = self.walk(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Follows positions of the last column down the path of a symbol."""
        for i, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            one = (symbol >> (self.height - 1 - i)) & 1 == 1
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before a position of the last column."""
        return self.walk(symbol, at) - self.begin[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer (rows whose text goes on to the left)."""
        symbol, at = np.zeros(len(row), np.int64), row
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return self.first[symbol] + at - self.begin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (phrase number, position) pairs; phrases are rows of words, filled up with 0."""
        number = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        for step in range(phrases.shape[1]):
            left = lengths[number] > step
            symbol = phrases[number, np.maximum(lengths[number] - 1 - step, 0)]
            base = self.first[symbol]
            low = np.where(left, base + self.rank(symbol, low), low)
            high = np.where(left, base + self.rank(symbol, high), high)
            found = high > low
            number, low, high = number[found], low[found], high[found]
            if not len(number):
                break
        return self.locate(number, low, high)

    def locate(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = high - low
        owner = np.repeat(number, counts)
        row = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        position, steps = np.full(len(row), -1), 0
        open_ = np.arange(len(row))
        while len(open_):
            known = self.sampled.get(row[open_])
            done = open_[known]
            position[done] = self.positions[self.sampled.rank(row[done])] + steps
            open_ = open_[~known]
            row[open_] = self.back(row[open_])
            steps += 1
        return owner, position
