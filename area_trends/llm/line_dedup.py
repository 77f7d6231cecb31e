"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import text_of
from area_trends.llm.graph import Verifier, components, link_members
from area_trends.operators.joins import lookup_join
from area_trends.sources.tables import materialise

THRESHOLD = 2
MIN_CHARS = 20


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and line of every line of every text."""
    split = F.posexplode(F.split(text_of(docs), "\n", -1)).alias("line_no", "line")
    return docs.select("doc_id", split)


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(characters shorter, segment number, shift) of each substring that a line probes."""
    return [
        (shorter, index, shift)
        for shorter in range(threshold + 1)
        for index in range(threshold + 1)
        for shift in range(
            max(-index, shorter - (threshold - index)), min(index, shorter + (threshold - index)) + 1
        )
    ]


def segment(length: Column, shorter: int, index: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of a line that is so many characters shorter."""
    cut = length - shorter
    size, first_longer = F.call_function("div", cut, F.lit(parts)).cast("int"), parts - cut % parts
    start = size * index + F.greatest(F.lit(index) - first_longer, F.lit(0))
    return start, size + (F.lit(index) >= first_longer).cast("int")


def with_segment_keys(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Adds `keys` to lines (line, length): hashes by which lines within `threshold` edits meet.

    A line is cut into threshold + 1 segments whose sizes differ by one at most, longer
    ones last, so one of them is left whole in any line within the threshold. Each line
    stands for its own segments, and probes the segments of lines that are up to
    `threshold` characters shorter: with substrings of the segment's size around its
    place, no further off than the edits before and after it allow. The key holds the
    shorter length, the segment's number and the substring; a line's own segments are
    among its probes for its own length.
    """
    parts = threshold + 1
    cuts = [segment(F.col("length"), s, i, parts) for s in range(parts) for i in range(parts)]
    names = [(f"_start{n}", f"_size{n}") for n in range(len(cuts))]

    def key(shorter: int, index: int, shift: int) -> Column:
        start, size = (F.col(name) for name in names[shorter * parts + index])
        inside = (start + shift >= 0) & (start + shift + size <= F.col("length"))
        part = F.substring("line", start + (shift + 1), size)
        return F.when(inside, F.xxhash64(part, F.col("length") - shorter, F.lit(index)))

    found = lines.withColumns({n: x for pair in zip(names, cuts, strict=True) for n, x in zip(*pair, strict=True)})
    found = found.withColumn("keys", F.array(*[key(*probe) for probe in probes(threshold)]))
    # in lines of two segments' sum and more, all substrings lie inside
    whole = F.col("length") >= threshold + parts
    found = found.withColumn("keys", F.when(whole, F.col("keys")).otherwise(F.array_compact("keys")))
    return found.drop(*[n for pair in names for n in pair])


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_start(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike (65,535 at most), by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])
    alike = lambda n, step: F.substring(a, n + 1, step) == F.substring(b, n + 1, step)
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(alike(n, step), step).otherwise(0))


def reversed_rest(pair: Column, least: int) -> Column:
    """A pair (a, b) without their common start, backwards; at least so many characters stay."""
    a, b = pair["a"], pair["b"]
    shorter = F.least(F.char_length(a), F.char_length(b))
    rest = lambda text, n: F.reverse(F.substring(text, n + 1, F.char_length(text)))
    return let(
        F.greatest(F.least(common_start(a, b), shorter - least), F.lit(0)),
        lambda n: F.struct(rest(a, n).alias("a"), rest(b, n).alias("b")),
    )


def edits_within(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """The edit distance of two texts if it is at most `threshold`, else a larger number.

    What both begin and end with alike is cut off first, which leaves the distance as it is.
    The lengths must not differ by more than the threshold and exceed it.
    """
    cut = lambda pair: reversed_rest(pair, threshold + 1)
    banded = lambda pair: banded_edits(pair["a"], pair["b"], threshold)
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda pair: let(cut(pair), lambda rest: let(cut(rest), banded)))


def banded_edits(a: Column, b: Column, threshold: int) -> Column:
    """As `edits_within`, of texts as they are.

    Works on the diagonal band of 2 * threshold + 1 cells as bits of one number: for each
    character of the shorter text the whole band moves on by a few bit operations.
    """
    a_longer = F.char_length(a) >= F.char_length(b)
    longer, shorter = F.when(a_longer, a).otherwise(b), F.when(a_longer, b).otherwise(a)
    characters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    band = 2 * threshold + 1
    mask, top = (1 << band) - 1, 1 << (band - 1)

    def moved(state: Column, zero: Column) -> Column:
        plus, minus, edits = (state["band"][name] for name in ("plus", "minus", "edits"))
        up = minus.bitwiseOR(F.lit(mask) - zero.bitwiseOR(plus))
        down, next_ = zero.bitwiseAND(plus), F.shiftrightunsigned(zero, 1)
        past = state["at"] - (F.size(state["chars"]) - threshold)  # columns since the band met the last row
        row = F.call_function("shiftright", F.lit(top), past + 1)
        on_diagonal = F.when(zero.bitwiseAND(top) == 0, 1).otherwise(0)
        on_row = F.when(up.bitwiseAND(row) != 0, 1).when(down.bitwiseAND(row) != 0, -1).otherwise(0)
        return F.struct(
            down.bitwiseOR(F.lit(mask) - next_.bitwiseOR(up)).alias("plus"),
            next_.bitwiseAND(up).alias("minus"),
            (edits + F.when(past < 0, on_diagonal).otherwise(on_row)).alias("edits"),
        )

    def step(state: Column, char: Column) -> Column:
        plus, minus = state["band"]["plus"], state["band"]["minus"]
        match = F.lit(0)
        for k in range(band):
            same = F.get(state["chars"], state["at"] + (k - threshold)) == char
            match = match.bitwiseOR(F.when(same, 1 << k).otherwise(0))
        zero = lambda m: (m.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(m).bitwiseOR(minus).bitwiseAND(mask)
        # once over, the last row can win back no more than the threshold
        over = state["band"]["edits"] > 2 * threshold
        next_ = let(match, lambda m: let(zero(m), lambda z: moved(state, z)))
        return F.struct(
            state["chars"].alias("chars"),
            (state["at"] + 1).alias("at"),
            F.when(over, state["band"]).otherwise(next_).alias("band"),
        )

    begin = F.struct(
        characters(longer).alias("chars"),
        F.lit(0).alias("at"),
        F.struct(
            F.lit(mask - ((1 << threshold) - 1)).alias("plus"),
            F.lit(0).alias("minus"),
            F.lit(threshold).alias("edits"),
        ).alias("band"),
    )
    return F.aggregate(characters(shorter), begin, step, lambda state: state["band"]["edits"])


def letter_counts(line: Column) -> Column:
    """How often each letter of the Latin alphabet occurs in a line, in either case."""
    low, size = F.lower(line), F.char_length(F.lower(line))
    return F.array(*[size - F.char_length(F.replace(low, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz"])


class LineVerifier(Verifier):
    """Compares lines (node, line) by their banded edit distance.

    An edit changes the counts of two letters by one at most, so lines whose counts are
    further apart are not compared character by character.
    """

    def __init__(self, lines: DataFrame, threshold: int):
        super().__init__()
        counted = lines.withColumn("length", F.char_length("line")).withColumn("counts", letter_counts(F.col("line")))
        self.lines, self.threshold = materialise(counted, "lines"), threshold

    def features(self) -> DataFrame:
        return self.lines.select("node", F.struct("length", "counts").alias("features"))

    def may_link(self, a: Column, b: Column) -> Column:
        apart = F.abs(a["length"] - b["length"])
        differ = F.zip_with(a["counts"], b["counts"], lambda x, y: F.abs(x - y))
        letters = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
        return (apart <= self.threshold) & (letters <= 2 * self.threshold)

    def check(self, pairs: DataFrame) -> DataFrame:
        def side(name: str, *columns: str) -> DataFrame:
            return self.lines.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

        like = materialise(
            pairs.join(side("a", "length", "counts"), "a")
            .join(side("b", "length", "counts"), "b")
            .where(
                self.may_link(
                    F.struct(F.col("length_a").alias("length"), F.col("counts_a").alias("counts")),
                    F.struct(F.col("length_b").alias("length"), F.col("counts_b").alias("counts")),
                )
            )
            .select("a", "b"),
            "like_pairs",
        )
        edits = edits_within(F.col("line_a"), F.col("line_b"), self.threshold)
        both = like.join(side("a", "line"), "a").join(side("b", "line"), "b")
        return both.where(edits <= self.threshold).select("a", "b")


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, node: lines of at least `min_chars` characters that repeat an earlier one.

    Lines within `threshold` edits of each other are linked; of each component, and of
    equal lines, all but the first line of the smallest doc_id are returned. `node` is
    the 64-bit hash of the line. Equal lines are one row in every join after the first
    aggregation of keys. Rows without doc_id take no part.
    """
    if threshold >= min_chars:
        raise ValueError("lines must be longer than the threshold")
    named = docs.where(F.col("doc_id").isNotNull())
    lines = lines_of(named).withColumn("length", F.char_length("line")).where(F.col("length") >= min_chars)
    lines = lines.withColumn("node", F.xxhash64("line"))
    keyed = with_segment_keys(lines, threshold).select("doc_id", "line_no", "node", "keys")
    keyed = materialise(keyed, "line_keys")
    exploded = keyed.select("node", F.explode("keys").alias("key"))
    low = exploded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = materialise(exploded.join(low.select("key", "low"), "key").distinct(), "key_members")
    wanted = materialise(members.select("node").distinct(), "wanted_lines")
    held = lookup_join(lines.select("node", "line"), wanted, "node", "left_semi").dropDuplicates(["node"])
    links = link_members(members, LineVerifier(held, threshold))

    at = keyed.select("doc_id", "line_no", "node")
    in_group = F.coalesce("component", "node").alias("group")
    at = materialise(at.join(components(links), "node", "left").select("doc_id", "line_no", "node", in_group), "line_groups")
    groups = at.groupBy("group").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    several = materialise(at.join(groups.where("n > 1").drop("n"), "group"), "repeated_groups")
    first = several.where("doc_id = first_doc").groupBy("group").agg(F.min("line_no").alias("first_line"))
    return (
        several.join(first, "group")
        .where("doc_id != first_doc OR line_no != first_line")
        .select("doc_id", "line_no", "node")
    )


def without_marked(lines: Column, marks: Column) -> Column:
    """Lines without those that a mark (line_no, node) names by place and hash: the runs between them."""
    held = lambda m: (m["line_no"] < F.size(lines)) & (F.xxhash64(F.get(lines, m["line_no"])) == m["node"])
    own = F.filter(marks, held)
    places = F.array_sort(F.transform(own, lambda m: m["line_no"]))
    bounds = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))

    def runs(at: Column) -> Column:
        number = F.sequence(F.lit(0), F.size(at) - 2)
        return F.flatten(
            F.transform(number, lambda i: F.slice(lines, F.get(at, i) + 2, F.get(at, i + 1) - F.get(at, i) - 1))
        )

    return let(bounds, runs)


def without_repeated_lines(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents with `_n_lines`, `_n_removed` and `_left`: the text without repeated lines.

    Blank and short lines stay. Null texts have no lines and stay null. Rows that repeat
    a doc_id count as the same place: a line first met there stays in all of them.
    """
    gone = repeated_lines(docs, threshold, min_chars)
    marks = gone.select(F.col("doc_id").alias("_id"), F.struct("line_no", "node").alias("mark"))
    marks = materialise(marks.groupBy("_id").agg(F.collect_set("mark").alias("_marks")), "removed_lines")
    held = lookup_join(docs.withColumn("_id", F.col("doc_id")), marks, "_id", "left").drop("_id")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("_marks").isNull(), lines).otherwise(let(lines, lambda x: without_marked(x, F.col("_marks"))))
    return (
        held.withColumn("_kept", kept)
        .withColumns(
            {
                "_n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
                "_n_removed": F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("long"),
                "_left": F.array_join("_kept", "\n"),
            }
        )
        .drop("_kept", "_marks")
    )


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left of each document.

    See `repeated_lines` for what goes. Null is read as the empty text.
    """
    plain = docs.select("doc_id", text_of(docs).alias("text"))
    found = without_repeated_lines(plain, threshold, min_chars)
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_left").alias("text"),
    )


def drop_repeated_lines(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents with their repeated lines cut out; those of which only blank lines are left go.

    Documents that lose no line stay as they are. n_chars, where there is such a column,
    follows the new text; other columns stay.
    """
    found = without_repeated_lines(docs, threshold, min_chars)
    cut = F.col("_n_removed") > 0
    out = []
    for name in docs.columns:
        value = F.col(f"`{name}`")
        if name == "text":
            value = F.when(cut, F.col("_left")).otherwise(value)
        elif name == "n_chars":
            value = F.when(cut, F.char_length("_left").cast(docs.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    return found.where(~cut | (F.trim(F.regexp_replace("_left", r"\s+", " ")) != "")).select(*out)
