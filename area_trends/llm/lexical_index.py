"""Inverted index of a shard of texts: postings in blocks, each with bounds of its impacts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from area_trends.llm.common import text_parts

BLOCK = 128
PART_BYTES = 1_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: columns of an index row beside the doc_ids, and their Spark types; what has a value per term, block
#: or posting is one value in bytes, as the JVM would hold every element of an array several times over
COLUMNS = {
    "lengths": "array<int>",
    "terms": "binary",
    "df": "binary",
    "first": "binary",
    "gap_bytes": "binary",
    "tf_bytes": "binary",
    "front": "binary",
    "front_tf": "binary",
    "front_length": "binary",
    "gaps": "binary",
    "tfs": "binary",
}
#: stands between the terms of a row; no term holds it
SPACE = b" "


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, A-Z in lower case, part by part."""
    for part in text_parts(text, BETWEEN, PART_BYTES):
        yield WORD.findall(part.lower())


def to_bytes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, in as many bytes each (1, 2, 4 or 8) as the largest needs; the first byte says how many."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def from_bytes(data) -> np.ndarray:
    """The numbers of `to_bytes`."""
    held = memoryview(data)
    return np.frombuffer(held[1:], f"<u{held[0]}").astype(np.int64)


def packed(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bytes a value (1, 2 or 4) of each block, and the values in so many bytes."""
    most = np.maximum.reduceat(values, starts) if len(starts) else values
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    each = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return width, each[np.arange(4) < np.repeat(width, sizes)[:, None]].tobytes()


def fronts(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that no other one of their block beats in both tf and length.

    A posting's impact grows with its tf and falls with its document's length, so a block's
    greatest impact is that of one of these, whatever the corpus statistics are.
    """
    order = np.lexsort((length, -tf, block))
    step = int(length.max(initial=0)) + 1
    level = (block.max(initial=0) - block[order]).astype(np.int64) * step
    level += length[order]
    below = np.minimum.accumulate(level)
    return order[np.append(True, level[1:] < below[:-1])[: len(order)]]


def build(texts: list[bytes]) -> tuple[list[int], dict]:
    """Places of the texts that hold a term, and the index columns over these texts."""
    number: dict[bytes, int] = {}
    held, ids = [], []
    for place, text in enumerate(texts):
        found = []
        for words in words_of(text):
            for word in set(words).difference(number):
                number[word] = len(number)
            found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        if sum(map(len, found)):
            held.append(place)
            ids.append(np.concatenate(found))
    lengths = np.array([len(x) for x in ids], np.int64)
    docs = max(len(held), 1)
    keys = np.concatenate([np.zeros(0, np.int32), *ids], dtype=np.int64)
    ids.clear()  # arrays of the shard's size go as soon as they are used
    keys *= docs
    keys += np.repeat(np.arange(len(held), dtype=np.int32), lengths)
    keys.sort()
    places = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    tf = np.diff(places, append=len(keys)).astype(np.int32)
    keys = keys[places]
    del places
    df = np.bincount(keys // docs, minlength=len(number))
    keys %= docs
    doc = keys.astype(np.int32)
    del keys
    opens = spread(df) % BLOCK == 0
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, len(doc)))
    gaps = np.where(opens, np.int32(0), np.diff(doc, prepend=np.int32(0)))
    gap_bytes, packed_gaps = packed(gaps, starts, sizes)
    del gaps
    tf_bytes, packed_tfs = packed(tf, starts, sizes)
    block = np.cumsum(opens, dtype=np.int32) - np.int32(1)
    best = fronts(block, tf, lengths.astype(np.int32)[doc])
    return held, {
        "lengths": lengths,
        "terms": list(number),
        "df": df,
        "first": doc[starts],
        "gap_bytes": gap_bytes,
        "tf_bytes": tf_bytes,
        "front": np.bincount(block[best], minlength=len(starts)),
        "front_tf": tf[best],
        "front_length": lengths[doc[best]],
        "gaps": packed_gaps,
        "tfs": packed_tfs,
    }


def spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def unpacked(data: np.ndarray, at: np.ndarray, width: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of blocks that begin at these bytes."""
    each = np.repeat(width, sizes)
    place = np.repeat(at, sizes) + spread(sizes) * each
    values = data[place].astype(np.int64)
    for k in (1, 2, 3):
        more = each > k
        if not more.any():
            break
        values[more] |= data[place[more] + k].astype(np.int64) << 8 * k
    return values


class Shard:
    """An index row opened for search: `penalty` is what the impact formula adds to a document's tf."""

    def __init__(self, row: dict, penalty):
        self.penalty = penalty(row["lengths"])
        self.df = row["df"]
        blocks = -(-self.df // BLOCK)
        self.begin = np.append(0, np.cumsum(blocks))
        self.sizes = np.full(self.begin[-1], BLOCK, np.int64)
        self.sizes[self.begin[1:] - 1] = self.df - (blocks - 1) * BLOCK
        self.first, self.gap_bytes, self.tf_bytes = row["first"], row["gap_bytes"], row["tf_bytes"]
        self.gaps, self.tfs = (np.frombuffer(row[c], np.uint8) for c in ("gaps", "tfs"))
        self.gap_at, self.tf_at = (np.cumsum(w * self.sizes) - w * self.sizes for w in (self.gap_bytes, self.tf_bytes))
        impact = self.impact(row["front_tf"], penalty(row["front_length"]))
        edges = np.cumsum(row["front"]) - row["front"]
        self.block_peak = np.maximum.reduceat(impact, edges) if len(edges) else impact
        self.peak = np.maximum.reduceat(self.block_peak, self.begin[:-1]) if len(self.df) else self.block_peak
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked_blocks = 0

    @staticmethod
    def impact(tf: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + penalty)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of blocks, in the order of the blocks."""
        self.unpacked_blocks += len(blocks)
        sizes = self.sizes[blocks]
        steps = np.cumsum(unpacked(self.gaps, self.gap_at[blocks], self.gap_bytes[blocks], sizes))
        begins = np.cumsum(sizes) - sizes
        docs = steps + np.repeat(self.first[blocks] - steps[begins], sizes)
        return docs, self.impact(unpacked(self.tfs, self.tf_at[blocks], self.tf_bytes[blocks], sizes), self.penalty[docs])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents and impacts of a term; kept for the next query."""
        if term not in self.open:
            self.open[term] = self.postings(np.arange(self.begin[term], self.begin[term + 1]))
        return self.open[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of `least` and more, and their scores.

        `rest` bounds what a list and all after it can add. Documents that are only in lists
        whose bounds add up to less than `least` are never looked at: the lists before these
        are the essential ones, and read whole. In the others, a candidate goes as soon
        as its score, the bound of the one block that can hold it, and the bounds of the
        lists to come stay below `least`; only blocks with candidates left are unpacked.
        """
        bounds = weights * self.peak[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        essential = int((rest[:-1] >= least).sum())
        total = np.zeros(len(self.penalty), np.int64)
        for term, weight in zip(terms[:essential].tolist(), weights[:essential].tolist(), strict=True):
            docs, impact = self.whole(term)
            total[docs] += weight * impact
        found = np.flatnonzero(total + rest[essential] >= least) if essential else np.zeros(0, np.int64)
        score = total[found]
        for i in range(essential, len(terms)):
            if not len(found):
                break
            term, weight, later = int(terms[i]), int(weights[i]), rest[i + 1]
            blocks = np.arange(self.begin[term], self.begin[term + 1])
            near = np.searchsorted(self.first[blocks], found, side="right") - 1
            bound = np.where(near < 0, 0, weight * self.block_peak[blocks[near]])
            kept = score + bound + later >= least
            found, score, near = found[kept], score[kept], near[kept]
            near = np.unique(near[near >= 0])
            if len(near):
                docs, impact = self.open[term] if term in self.open else self.postings(blocks[near])
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score = score + np.where(docs[at] == found, weight * impact[at], 0)
            kept = score + later >= least
            found, score = found[kept], score[kept]
        return found, score
