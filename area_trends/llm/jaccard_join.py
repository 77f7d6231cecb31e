"""N-gram Jaccard join by parity sketches: pigeonhole join per size band, then verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import forget_caches, numbered, place_of, restored, slices, texts, worker_cache
from area_trends.llm.graph import Verifier, components, link_members
from area_trends.operators.joins import lookup_join
from area_trends.sources.tables import materialise

SLICE_BYTES = 500_000
#: rows of keys that are filtered at once
SLICE_ROWS = 500
MAX_CACHED = 150_000
#: bits of the filter that tells scanning tasks which documents to take sets from
FILTER_BITS = 1 << 23
#: bits of the sketches that pairs within a key are told apart by
SHORT_BITS = 1024
#: bits of the filter of keys that several rows share
KEY_FILTER_BITS = 1 << 26


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the result."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles: A-Z in lower case, words between ASCII white space."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def sets(self, values: list[str]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text.

        A text of fewer words than a shingle has its whole sequence as the only one, a
        text without words has none.
        """
        split = [v.encode("utf-8", "replace").lower().split() for v in values]
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        for word in set().union(*split).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        look_up = self.known.__getitem__
        for words in split:
            hashes = np.fromiter(map(look_up, words), np.uint64, len(words))
            width = min(self.size, len(hashes))
            shingle = np.full(max(len(hashes) - width + 1, 0) if width else 0, width, np.uint64)
            for k in range(width):
                shingle = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(shingle)])
            yield np.unique(shingle)


class Bands:
    """Size bands for a similarity in hundredths, and how many parts each needs.

    Sets that reach the similarity lie in the same or in neighbouring bands, and differ
    in at most (100 - percent) / percent of the smaller set. Group k joins bands k and
    k + 1; its bound is that of the largest set of band k.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, -(-last * 100 // self.percent)))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def bound(self, group: int) -> int:
        """The most elements in which two linked sets of the group differ."""
        return (self.starts[group + 1] - 1) * (100 - self.percent) // self.percent


@cache
def spare_share(percent: int) -> float:
    """How many spare parts there are for each element in which linked sets may differ.

    The least share for which a set, also the smallest of its group, hardly ever has more empty parts than
    spare ones: 0.02 at 90 hundredths, 0.2 at 80. Fewer parts hold more elements each, and so
    give fewer keys that say more.
    """

    def suffices(share: float) -> bool:
        for least in (50, 200, 1000, 5000):
            bound = least * (100 / percent) * (100 - percent) / percent
            parts = 2 + bound * (1 + share)
            empty = parts * exp(-least / parts)
            if empty + 2 * sqrt(empty) > 1 + bound * share:
                return False
        return True

    return next((n / 100 for n in (2, *range(5, 500, 5)) if suffices(n / 100)), 5.0)


def part_keys(elements: np.ndarray, group: int, bound: int, percent: int) -> np.ndarray:
    """Join keys of a set in one group, so that two linked sets have one in common.

    The elements are dealt to bound + 1 + spare parts, so at least spare + 1 parts of two
    linked sets hold no difference. A part's key is the XOR of its elements. A set may leave
    out up to `spare` parts, as one that holds no difference is left: thin ones of less than two
    elements, which say little, or if these are too many the empty ones, or if these are too many none.
    """
    spare = 1 + int(bound * spare_share(percent))
    parts = bound + 1 + spare
    spread = mix(elements + np.uint64(0xD1B54A32D192ED03))
    part = ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    held = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(held, part, spread)
    size = np.bincount(part, minlength=parts)
    least = next((n for n in (2, 1) if (size < n).sum() <= spare), 0)
    salt = np.arange(parts, dtype=np.uint64) + np.uint64(group << 40)
    return mix(held ^ mix(salt + np.uint64(0x632BE59BD9B4E019)))[size >= least]


def all_keys(elements: np.ndarray, bands: Bands) -> np.ndarray:
    if not len(elements):
        return np.empty(0, np.uint64)
    band = bands.band(len(elements))
    groups = [(g, bands.bound(g)) for g in (band, band - 1) if g >= 0]
    return np.concatenate([np.empty(0, np.uint64), *[part_keys(elements, g, b, bands.percent) for g, b in groups if b > 0]])


def parity_sketch(elements: np.ndarray) -> bytes:
    """Bits toggled once per element, at least two for each; a power of two, at least 64.

    Two sketches of one width differ in at most as many bits as the sets in elements; a
    wider one is folded by XOR of its halves to compare it with a narrower one.
    """
    width = max(64, 1 << (2 * len(elements) - 1).bit_length()) if len(elements) else 64
    at = (mix(elements + np.uint64(0xA0761D6478BD642F)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def short_sketch(elements: np.ndarray) -> np.ndarray:
    """A parity sketch of `SHORT_BITS` bits for sets of any size, as numbers of 64 bits."""
    at = (mix(elements + np.uint64(0xA0761D6478BD642F)) & np.uint64(SHORT_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SHORT_BITS) & 1).astype(np.uint8)).view(np.uint64)


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def node_of(elements: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def list_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = signed(np.concatenate([np.empty(0, np.uint64), *arrays]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def keying(name: str, make: Callable, keys_of: Callable) -> Callable:
    def run(batches):
        maker = worker_cache(name, make)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = list(maker.sets(part.column("text").to_pylist()))
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    list_of([keys_of(s) for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "keys"])

    return run


def taking_sets(name: str, make: Callable, held) -> Callable:
    def run(batches):
        maker = worker_cache(name, make)
        for batch in batches:
            batch = batch.filter(pa.array(marked(held.value, batch.column("slot").to_numpy())))
            for part in slices(batch, "text", SLICE_BYTES):
                sets = list(maker.sets(part.column("text").to_pylist()))
                columns = [
                    part.column("doc_id"),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([parity_sketch(s) for s in sets], pa.binary()),
                    list_of([short_sketch(s) for s in sets]),
                    list_of(sets),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "sketch", "short", "elements"])

    return run


def close_sketches(percent: int) -> Callable:
    def run(batches):
        for batch in batches:
            sizes = np.minimum(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy())
            pairs = zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)
            far = np.array([sketch_distance(a, b) for a, b in pairs], np.int64)
            near = batch.filter(pa.array(far <= sizes * (100 - percent) // percent))
            yield near.select(["a", "b"])

    return run


def slot_filter(slots: DataFrame, bits: int) -> bytes:
    """A filter of a fixed number of bits, those of all rows (slot) set."""
    place = F.expr("shiftleft(1L, cast(slot & 31 as int))")
    words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(place).alias("bits")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[words.column("word").to_numpy().astype(np.int64)] = words.column("bits").to_numpy().astype("<u4")
    return out.tobytes()


def marked(held, slot: np.ndarray) -> np.ndarray:
    return (np.frombuffer(held, np.uint8)[slot >> 3] >> (slot & 7) & 1).astype(bool)


def keeping_keys(held) -> Callable:
    """Rows (node, key) of the keys that a filter lets pass."""

    def run(batches):
        forget_caches("key_filter")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                lists = part.column("keys")
                keys = lists.flatten().to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                kept = np.flatnonzero(marked(held.value, keys & (KEY_FILTER_BITS - 1)))
                owner = np.repeat(np.arange(part.num_rows), sizes)[kept]
                columns = [part.column("node").take(pa.array(owner)), pa.array(keys[kept])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "key"])

    return run


class SetVerifier(Verifier):
    """Compares sets: first by the distance of their sketches, then element by element."""

    def __init__(self, held: DataFrame, percent: int):
        super().__init__()
        self.held, self.percent = held, percent

    def side(self, name: str, **columns: Column) -> DataFrame:
        return self.held.select(F.col("node").alias(name), *[v.alias(f"{n}_{name}") for n, v in columns.items()])

    def features(self) -> DataFrame:
        size = F.size("elements").cast("long").alias("size")
        return self.held.select("node", F.struct(size, F.col("short").alias("bits")).alias("features"))

    def may_link(self, a: Column, b: Column) -> Column:
        """Bits in which short sketches differ are at most the elements in which linked sets do."""
        low, high = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
        bits = [F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseXOR(F.get(b["bits"], F.lit(i)))) for i in range(SHORT_BITS // 64)]
        apart = reduce(lambda x, y: x + y, bits)
        return (100 * low >= self.percent * high) & (apart * self.percent <= low * (100 - self.percent))

    def check(self, pairs: DataFrame) -> DataFrame:
        short = {"size": F.size("elements").cast("long"), "sketch": F.col("sketch")}
        close = materialise(
            pairs.join(self.side("a", **short), "a")
            .join(self.side("b", **short), "b")
            .mapInArrow(close_sketches(self.percent), "a long, b long"),
            "close_pairs",
        )
        whole = {"elements": F.col("elements")}
        shared = F.size(F.array_intersect("elements_a", "elements_b"))
        union = F.size("elements_a") + F.size("elements_b") - shared
        return (
            close.join(self.side("a", **whole), "a")
            .join(self.side("b", **whole), "b")
            .where(100 * shared.cast("long") >= self.percent * union.cast("long"))
            .select("a", "b")
        )


def set_components(docs: DataFrame, name: str, make: Callable, keys_of: Callable, percent: int) -> DataFrame:
    """doc_id, n_elements, component_id and n_links of documents joined by sets of hashes.

    `make` gives an object whose `sets` turns texts into sorted distinct hashes, and
    `keys_of` the join keys of a set: two linked sets must have one in common. Equal sets
    are compared once. Keys are counted with map-side combine; a filter of fixed size then
    keeps keys of single rows out of the join. Where it is full, the join sees all keys.
    """
    rows = texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = materialise(
        rows.mapInArrow(keying(name, make, keys_of), f"doc_id {kind}, n_elements long, node long, keys array<long>"),
        "set_keys",
    )
    spark = docs.sparkSession
    often = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    often = materialise(often.where("n > 1").select("key"), "shared_keys")
    held = often.select(F.col("key").bitwiseAND(KEY_FILTER_BITS - 1).alias("slot"))
    some = keyed.select("node", "keys").mapInArrow(
        keeping_keys(spark.sparkContext.broadcast(slot_filter(held, KEY_FILTER_BITS))), "node long, key long"
    )
    met = materialise(some.join(often, "key", "left_semi").distinct(), "met_keys")
    low = met.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = materialise(met.join(low.select("key", "low"), "key"), "key_members")

    nodes = members.select("node").distinct()
    chosen = materialise(
        keyed.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "chosen"
    )
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
    wanted = spark.sparkContext.broadcast(slot_filter(chosen.select(slot), FILTER_BITS))
    held = (
        rows.select("*", slot)
        .mapInArrow(
            taking_sets(name, make, wanted),
            f"doc_id {kind}, node long, sketch binary, short array<long>, elements array<long>",
        )
        .join(chosen.select("node", F.col("doc_id").alias("_chosen")), "node")
        .where(F.col("doc_id").eqNullSafe(F.col("_chosen")))
        .dropDuplicates(["node"])
        .select("node", "sketch", "short", "elements")
    )
    links = link_members(members, SetVerifier(materialise(held, "sets"), percent))
    lowest = (
        keyed.groupBy("node")
        .agg(F.min("doc_id").alias("lowest"))
        .where(F.col("node").isNotNull())
        .join(components(links), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    lowest = materialise(lowest, "lowest")
    heads = lowest.groupBy("component").agg(F.min("lowest").alias("component_id"))
    ends = links.select("a").union(links.select("b"))
    counts = ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    of_node = lowest.join(heads, "component").join(counts, "node", "left").select("node", "component_id", "n_links")
    return keyed.join(of_node, "node", "left").select(
        "doc_id",
        "n_elements",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each document.

    Two documents link when their sets of `size`-word shingles share at least `percent`
    hundredths of their union; component_id is the smallest doc_id reachable by links.
    n_links counts the links of a document's set to different sets that were verified.
    Sets are compared by 64-bit hashes of their shingles. Documents without words (null,
    empty) link with nothing. Repeated rows are equal sets; other columns are ignored.
    """
    bands = Bands(percent)
    found = set_components(
        docs, f"shingles {size}", lambda: Shingler(size), lambda s: all_keys(s, bands), percent
    )
    return found.withColumnRenamed("n_elements", "n_shingles")


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest doc_id.

    Groups are the components of `jaccard_components`; they are made of rows, which are numbered
    first, so of rows that repeat a doc_id or have none one stays too. A null doc_id comes last.
    Documents without words stay; all columns stay as they are.
    """
    rows = numbered(docs)
    read = [F.col(place_of(docs, name)) for name in ("doc_id", "text")]
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), read[1].alias("text")), size, percent)
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", read[0].alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    grouped = materialise(found.join(ids, "_row"), "near_groups")
    first = grouped.groupBy("component_id").agg(F.min(order)["_row"].alias("first"), F.count(F.lit(1)).alias("n"))
    several = materialise(first.where("n > 1").drop("n"), "near_copies")
    gone = materialise(lookup_join(grouped, several, "component_id").where("_row != first").select("_row"), "gone")
    return restored(docs, lookup_join(rows, gone, "_row", "left_anti"))
