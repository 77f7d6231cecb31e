"""Context-tree weighting over binary-decomposed bytes, learned from counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from area_trends.sources.tables import materialise

DEPTH = 5
EDGE = 255  # never occurs in UTF-8: stands before and after each text
HALF = math.log(0.5)
#: the nodes of contexts of so many bytes and more are made in tasks, by the last of these bytes
CUT = 3
#: windows that a task weighs at once; more, where that many end in the same CUT context bytes
WEIGHED = 400_000
#: slots of the table by which frequent windows are found
SLOT_BITS = 22


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2: Stirling's series after eight steps up."""
    up, product = x + 8, 1.0
    for k in range(8):
        product = product * (x + k)
    series = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi)
    series = series + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    return series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def shortened(keys, length: int):
    """The keys of the nodes (numbers or a column) whose contexts are the last `length` bytes."""
    whole = ((1 << (8 * length)) - 1) << 8 | 255
    return keys & whole if isinstance(keys, np.ndarray) else keys.bitwiseAND(whole)


@dataclass
class Nodes:
    """Tree nodes with contexts of one length, in key order; a key is the context, then the decision.

    A byte is eight binary decisions; one is named by the bits before it after a leading one bit (1 to
    255), and each has a tree whose nodes are contexts. `weighted` is the log of the
    weighted probability of the node's decisions, `share` the weight of its own estimate against what
    the longer contexts say. A node without counts says one half and leaves the others as they are.
    """

    keys: np.ndarray
    n: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    share: np.ndarray

    @classmethod
    def longest(cls, keys: np.ndarray, n: np.ndarray, ones: np.ndarray) -> Nodes:
        return cls(keys, n, ones, log_kt(n - ones, ones), np.ones(len(keys), np.float32))

    @classmethod
    def inner(cls, keys: np.ndarray, n: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Nodes:
        """Nodes of which `below` is the sum of `weighted` over the contexts one byte longer."""
        own = HALF + log_kt(n - ones, ones)
        weighted = np.logaddexp(own, HALF + below)
        return cls(keys, n, ones, weighted, np.exp(own - weighted).astype(np.float32))

    def parents(self, length: int) -> tuple[Nodes, np.ndarray]:
        """The nodes of contexts of `length` bytes, one less than here, and where each node's is."""
        keys, place = np.unique(shortened(self.keys, length), return_inverse=True)
        sums = (np.bincount(place, x, len(keys)) for x in (self.n, self.ones, self.weighted))
        return Nodes.inner(keys, *sums), place

    def chances(self, chance: np.ndarray | float, stay: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """The chance of a one by these and all shorter contexts, and the weight left to longer ones.

        Both are given as the shorter contexts of each node leave them.
        """
        odds = np.log((self.ones + 0.5) / (self.n - self.ones + 0.5)).astype(np.float32)
        share = self.share.astype(np.float64)
        return chance + stay * share / (1 + np.exp(-odds.astype(np.float64))), stay * (1 - share)


@dataclass
class Decisions:
    """One of the eight decisions of windows: the nodes of CUT to DEPTH bytes, longest first.

    `place` holds where the nodes of each length but the shortest have their parents, `leaf` the
    node of each window, and `one` what it decided.
    """

    levels: list[Nodes]
    place: list[np.ndarray]
    leaf: np.ndarray
    one: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray, n: np.ndarray, step: int) -> Decisions:
        byte = windows & 255
        one = ((byte >> (7 - step)) & 1).astype(bool)
        keys, leaf = np.unique((windows & ~255) | (1 << step) | (byte >> (8 - step)), return_inverse=True)
        ones = np.bincount(leaf, np.where(one, n, 0), len(keys))
        levels, place = [Nodes.longest(keys, np.bincount(leaf, n, len(keys)), ones)], []
        for length in range(DEPTH - 1, CUT - 1, -1):
            nodes, at = levels[-1].parents(length)
            levels.append(nodes)
            place.append(at)
        return cls(levels, place, leaf, one)

    def log10(self, roots: Roots) -> np.ndarray:
        """log10 of the probability of what each window decided."""
        chance, stay = roots.of(self.levels[-1].keys)
        chance, stay = self.levels[-1].chances(chance, stay)
        for nodes, at in zip(self.levels[-2::-1], self.place[::-1], strict=True):
            chance, stay = nodes.chances(chance[at], stay[at])
        chance = chance[self.leaf]
        return np.log10(np.where(self.one, chance, 1 - chance))


@dataclass
class Roots:
    """What the contexts of less than CUT bytes say: `Nodes.chances` by the keys of the longest."""

    keys: np.ndarray
    chance: np.ndarray
    stay: np.ndarray

    @classmethod
    def weigh(cls, nodes: Nodes) -> Roots:
        """From the nodes of CUT - 1 bytes."""
        levels, place = [nodes], []
        for length in range(CUT - 2, -1, -1):
            shorter, at = levels[-1].parents(length)
            levels.append(shorter)
            place.append(at)
        chance, stay = levels[-1].chances(0.0, 1.0)
        for longer, at in zip(levels[-2::-1], place[::-1], strict=True):
            chance, stay = longer.chances(chance[at], stay[at])
        return cls(nodes.keys, chance, stay)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, shortened(keys, CUT - 1))
        return self.chance[at], self.stay[at]


def whole_groups(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns (suffix, window, n, ...) of sorted batches, cut where the suffix changes."""
    held, rows, enough = [], 0, WEIGHED
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows < enough:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield tuple(c[:cut] for c in columns)
        held, rows = [[c[cut:].copy() for c in columns]], rows - cut
        enough = max(WEIGHED, 2 * rows)
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def upper_nodes(batches):
    """Rows (key, n, ones, weighted): the nodes of CUT bytes of each group of windows."""
    for _, windows, n, _ in whole_groups(batches):
        for step in range(8):
            top = Decisions.of(windows, n, step).levels[-1]
            columns = [pa.array(c) for c in (top.keys, top.n, top.ones, top.weighted)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "ones", "weighted"])


def window_logs(roots) -> Callable:
    """Rows (window, everywhere, log): the windows with log10 of the probability of their last byte."""

    def run(batches):
        for _, windows, n, everywhere in whole_groups(batches):
            logs = sum(Decisions.of(windows, n, step).log10(roots.value) for step in range(8))
            columns = [pa.array(c) for c in (windows, everywhere, logs)]
            yield pa.RecordBatch.from_arrays(columns, ["window", "everywhere", "log"])

    return run


def weigh(windows: DataFrame) -> DataFrame:
    """window, everywhere and log of byte windows (window, n, everywhere), which differ.

    A window is DEPTH context bytes and the byte after them, as one number. The trees hold
    n of each (0: not learned from); `log` is log10 of the probability of the last byte after the
    others. Windows are dealt out by the last CUT context bytes, so the nodes of as many bytes and
    more lie in one task. Those of fewer (at most 256 ** (CUT - 1) contexts) are sums over tasks and
    go over the driver.
    """
    suffix = F.shiftright("window", 8).bitwiseAND((1 << (8 * CUT)) - 1)
    dealt = windows.select(suffix.alias("suffix"), "window", "n", "everywhere")
    dealt = dealt.repartition("suffix").sortWithinPartitions("suffix")
    nodes = (
        dealt.mapInArrow(upper_nodes, "key long, n double, ones double, weighted double")
        .groupBy(shortened(F.col("key"), CUT - 1).alias("key"))
        .agg(F.sum("n"), F.sum("ones"), F.sum("weighted"))
        .toArrow()
        .sort_by("key")
    )
    roots = Roots.weigh(Nodes.inner(*(c.to_numpy() for c in nodes.columns)))
    logs = window_logs(windows.sparkSession.sparkContext.broadcast(roots))
    return materialise(dealt.mapInArrow(logs, "window long, everywhere long, log double"), "window_logs")


class Scorer:
    """Looks windows up in a part of them; `order` puts those first that others may hide."""

    def __init__(self, windows: np.ndarray, logs: np.ndarray, order: np.ndarray):
        self.windows = np.r_[windows, np.uint64(2**64 - 1)]
        self.logs = np.r_[logs, 0.0]
        self.slots = np.full(1 << SLOT_BITS, len(windows), np.int32)
        self.slots[self.slot(windows[order])] = order

    @staticmethod
    def slot(windows: np.ndarray) -> np.ndarray:
        return (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def log10(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs, 0 where a window is not in the part, and the places of these."""
        at = self.slots[self.slot(windows)]
        out = self.logs[at]
        other = np.flatnonzero(self.windows[at] != windows)
        place = np.searchsorted(self.windows, windows[other])
        missing = self.windows[place] != windows[other]
        out[other] = np.where(missing, 0.0, self.logs[place])
        return out, other[missing]


def windows_of(values: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts and how many each has: one per byte and one for its end."""
    edge = bytes([EDGE])
    text = np.frombuffer(b"".join(x for v in values for x in (edge * depth, v, edge)), np.uint8)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) + 1
    if not len(values):
        return np.empty(0, np.uint64), sizes
    code = np.zeros(len(text) - depth, np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= text[k : len(text) - depth + k]
    inside = np.ones(len(text), bool)
    last = np.cumsum(sizes + depth)
    for k in range(1, depth + 1):
        inside[last - k] = False
    return code[inside[: len(code)]], sizes


def window_parts(values: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `windows_of`, but a single text of more than `most` bytes comes in parts of so many."""
    if len(values) != 1 or len(values[0]) <= most:
        yield windows_of(values)
        return
    text = values[0]
    for start in range(0, len(text), most):
        before = min(start, DEPTH)
        windows, _ = windows_of([text[start - before : start + most]])
        windows = windows[before : None if start + most >= len(text) else -1]
        yield windows, np.array([len(windows)])
