"""Byte-level merge vocabularies and rank-synchronous merging on ragged arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import regex

#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
NO_RANK = np.int32(2**31 - 1)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Parts:
    """Cuts a text into parts whose tokens do not depend on what stands beside them.

    A space without white space on both sides always starts a pre-token, so a text is cut
    there; a text with other runs of white space is cut into its pre-tokens. Special
    strings are parts of their own.
    """

    def __init__(self, special: Iterable[str] = ()):
        self.pattern = regex.compile(PRE_TOKENS)
        self.odd_space = re.compile(r"\s \s")
        self.special = set(special)
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first) or '(?!)'})")

    def of(self, text: str) -> list[str]:
        """The parts in order; joined they are the text."""
        if len(self.special) and (segments := self.cut.split(text))[1:]:
            return [p for s in segments for p in ([s] if s in self.special else self.plain(s))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.odd_space.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]


class Merges:
    """The merge rules of a `tokenizers` file as arrays.

    Pairs are packed as left * size + right in sorted order, with the rank and the
    resulting symbol beside them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        self.special = [t["content"] for t in held["added_tokens"]]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        packed = left * self.size + right
        self.rank_of = np.argsort(packed, kind="stable").astype(np.int32)
        self.packed = packed[self.rank_of]
        self.symbol_of_byte = np.zeros(256, np.int32)
        for shown, byte in printable_bytes().items():
            self.symbol_of_byte[byte] = vocab[shown]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, NO_RANK where they never merge."""
        packed = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.packed, packed), len(self.packed) - 1)
        return np.where(self.packed[at] == packed, self.rank_of[at], NO_RANK)


def count_symbols(pieces: Iterable[str], merges: Merges) -> np.ndarray:
    """How many symbols are left of each non-empty pre-token after all its merges.

    All pre-tokens are merged at the same time. In each round every sequence applies
    the lowest-ranked pair it holds, at all its places from the left without overlap
    (a merge only creates pairs of higher rank, so this equals merging one place at a
    time). Sequences without a pair left are counted and leave the arrays.
    """
    encoded = [p.encode("utf-8", "surrogatepass") for p in pieces]
    left_over = np.fromiter(map(len, encoded), np.int64, len(encoded))
    symbols = merges.symbol_of_byte[np.frombuffer(b"".join(encoded), np.uint8)]
    owner = np.repeat(np.arange(len(encoded)), left_over)
    counts = left_over.copy()
    rank = np.full(len(symbols), NO_RANK, np.int32)
    if len(symbols) > 1:
        within = np.flatnonzero(owner[1:] == owner[:-1])
        rank[within] = merges.ranks(symbols[within], symbols[within + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NO_RANK
        counts[owner[starts[done]]] = sizes[done]
        keep = np.repeat(~done, sizes)
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        if not len(symbols):
            break
        hit = rank == np.repeat(lowest[~done], sizes[~done])
        at = np.flatnonzero(hit)
        run_start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        offset = np.arange(len(at)) - np.repeat(run_start, np.diff(np.r_[run_start, len(at)]))
        # in a run such as a-a-a the places overlap: every second one merges, from the left
        at = at[(offset & 1) == 0]
        symbols[at] = merges.result[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at = moved[at]
        changed = np.unique(np.r_[at, at - 1])
        changed = changed[changed >= 0]
        rank[changed] = NO_RANK
        inner = changed[changed < len(symbols) - 1]
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[inner] = merges.ranks(symbols[inner], symbols[inner + 1])
    return counts
