"""Personal data: patterns, and terms that reveal them by co-occurrence; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from area_trends.llm.common import text_of
from area_trends.operators.joins import lookup_join
from area_trends.sources.tables import materialise

#: kinds in the order in which spans of the same start are listed; the last is the method's own
KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
#: Patterns of the base kinds. They match what the plain forms do, without trying starts
#: that cannot match: inside a run of local-part characters or digits, or in a digit
#: chain too short for a card. Possessive repeats keep Java's matcher from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERMS = r"\p{L}{3,}"
#: matches that are placed together
PIECE = 256
REACH = 100
MIN_CONTEXTS = 3
#: standard errors by which a share of few documents is taken lower (Wilson's bound)
ERRORS = 1.96
GENERALISE_AT = 0.75
REMOVE_AT = 0.95


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.char_length(digits) + 1 - place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.char_length(digits))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    size = F.char_length(digits_of(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def running(values: Column, begin: Column, step) -> Column:
    """step(at, value): the running state before and after each value, as a list that grows one by one."""
    none = F.array().cast("array<struct<from:int,to:int>>")

    def add(state: Column, value: Column) -> Column:
        to = step(state["at"], value)
        both = F.struct(state["at"].alias("from"), to.alias("to"))
        return F.struct(to.alias("at"), F.concat(state["out"], F.array(both)).alias("out"))

    return F.aggregate(values, F.struct(begin.alias("at"), none.alias("out")), add, lambda s: s["out"])


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and without overlap: start, end (code points), value.

    Matches are placed in pieces of `PIECE`, from the piece's own offset, so the work grows
    with their number and not with its square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    matches = F.zip_with(
        between,
        found,
        lambda b, v: F.struct(F.char_length(b).alias("gap"), F.char_length(v).alias("size"), v.alias("value")),
    )
    width = lambda m: m["gap"] + m["size"]

    def place(listed: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(listed) - 1) / PIECE).cast("int"))
        pieces = F.transform(number, lambda i: F.slice(listed, i * PIECE + 1, F.lit(PIECE)))
        sizes = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, m: n + width(m)))
        begins = running(sizes, F.lit(0), lambda at, n: at + n)

        def within(piece: Column, offset: Column) -> Column:
            ends = running(piece, offset["from"], lambda at, m: at + width(m))
            return F.zip_with(
                piece,
                ends,
                lambda m, e: F.struct(
                    (e["to"] - m["size"]).alias("start"), e["to"].alias("end"), m["value"].alias("value")
                ),
            )

        return F.flatten(F.zip_with(pieces, begins, within))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(matches), place), F.lit(0))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds by start, then kind: start, kind (number), end, value."""

    def of_kind(number: int, kind: str, pattern: str) -> Column:
        valid = F.filter(located(text, pattern), lambda s: holds(kind, s["value"]))
        number_ = F.lit(number).alias("kind")
        return F.transform(
            valid,
            lambda s: F.struct(s["start"].alias("start"), number_, s["end"].alias("end"), s["value"].alias("value")),
        )

    found = [of_kind(number, kind, pattern) for number, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*found))


def context_sides(text: Column, span: Column, reach: int) -> Column:
    """The text of the same line within reach before and after a span, and where it starts.

    Words that the reach cuts through are left out.
    """
    first = F.greatest(span["start"] - reach, F.lit(0))
    left = F.substring(text, first + 1, span["start"] - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    left = F.element_at(F.split(left, "\n", -1), -1)
    size = F.char_length(text)
    right = F.substring(text, span["end"] + 1, F.lit(reach))
    right = F.when(span["end"] + reach < size, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    right = F.get(F.split(right, "\n", -1), F.lit(0))
    side = lambda value, at: F.struct(value.alias("value"), at.alias("at"))
    return F.array(side(left, span["start"] - F.char_length(left)), side(right, span["end"]))


def outside(found: Column) -> Column:
    """Found words that no base span overlaps: start, end, term."""
    free = F.filter(found, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return F.transform(
        free, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("term"))
    )


def term_occurrences(found: DataFrame) -> DataFrame:
    """Terms near protected values: row, pair, entity, term, start, end, context."""
    near = found.select("row", "base", F.explode("contexts").alias("near")).select("row", "base", "near.*")
    sides = near.select(
        "row",
        "base",
        F.xxhash64("kind", "value").alias("entity"),
        F.xxhash64("sides").alias("context"),
        F.explode("sides").alias("side"),
    )
    words = sides.select("row", "base", "entity", "context", "side.at", F.explode(located(F.col("side.value"), TERMS)).alias("w"))
    placed = words.select(
        "row",
        "base",
        "entity",
        "context",
        F.lower("w.value").alias("term"),
        (F.col("at") + F.col("w.start")).alias("start"),
        (F.col("at") + F.col("w.end")).alias("end"),
    )
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return placed.where(~inside).drop("base").withColumn("pair", F.xxhash64("entity", "term"))


def disclosures(docs: DataFrame, occurrences: DataFrame, min_contexts: int, generalise_at: float) -> DataFrame:
    """entity, term, disclosure: how much of what there is to know of a value a term near it tells.

    Each occurrence of a term in the corpus is an event; it is near a value or not. The
    disclosure is the pointwise mutual information of term and value over the information
    of the value itself: 1 where the term is never met elsewhere. Pairs met in fewer than
    `min_contexts` different contexts, so copies of one, tell nothing.
    """
    once = occurrences.groupBy("pair", "entity", "term", "row", "start").agg(F.min("context").alias("context"))
    pairs = materialise(
        once.groupBy("pair", "entity", "term").agg(
            F.count(F.lit(1)).alias("together"), F.count_distinct("context").alias("contexts")
        ),
        "term_pairs",
    )
    values = pairs.groupBy("entity").agg(F.sum("together").alias("near_value"))
    kept = materialise(pairs.where(F.col("contexts") >= min_contexts), "supported_pairs")
    terms = kept.select("term").distinct()
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(docs)), F.lit(TERMS), F.lit(0))).alias("term"))
    known = lookup_join(words, terms.withColumn("known", F.lit(True)), "term", "left")
    counted = materialise(
        known.groupBy(F.when(F.col("known"), F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("n")), "term_counts"
    )
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    information = F.log2(F.lit(float(max(total, 1))) / F.col("near_value"))
    mutual = F.log2(F.col("together") * F.lit(float(max(total, 1))) / (F.col("n") * F.col("near_value")))
    return (
        kept.join(values, "entity")
        .join(counted.where(F.col("term").isNotNull()), "term")
        .select("entity", "term", F.when(information > 0, mutual / information).otherwise(0.0).alias("disclosure"))
        .where(F.col("disclosure") >= generalise_at)
    )


def least_share(hits: Column, tries: Column) -> Column:
    """The lower end of Wilson's interval of a share: 0.21 for one of one, 0.34 for two of two."""
    square, share = ERRORS**2, hits / tries
    spread = ERRORS * F.sqrt(share * (1 - share) / tries + square / (4 * tries * tries))
    return (share + square / (2 * tries) - spread) / (1 + square / tries)


def document_disclosures(docs: DataFrame, found: DataFrame, holders: DataFrame, generalise_at: float) -> DataFrame:
    """copy, term, disclosure: what a term anywhere in a text tells of the values that the text holds.

    As `disclosures`, over different texts: the information that holding the term gives of
    holding the value. There is no least count; the share of the term's texts that hold the
    value is taken at its lower bound instead, so a term met once or twice has to be rarer.
    Values of the same texts are judged as one. Terms of so many texts that they
    could reach `generalise_at` with no value of a text are left out before they are
    paired with its values; that changes no result.
    """
    copies = materialise(found.groupBy("copy").agg(F.count(F.lit(1)).alias("times")), "text_copies")
    total = float(max(copies.count(), 1))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(docs)), F.lit(TERMS), F.lit(0)))
    rows = docs.select(F.xxhash64(text_of(docs)).alias("copy"), words.alias("words"))
    rows = lookup_join(rows, copies.where("times > 1"), "copy", "left")
    share = 1 / F.coalesce("times", F.lit(1))
    counted = rows.select(share.alias("share"), F.explode("words").alias("term")).groupBy("term")
    counted = materialise(counted.agg(F.round(F.sum("share")).alias("with_term")), "term_texts")

    marks = F.bit_xor(F.xxhash64("copy"))
    values = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("with_value"), marks.alias("marks"))
    groups = lookup_join(holders, materialise(values, "value_counts"), "entity").select("copy", "with_value", F.xxhash64("marks", "with_value").alias("values"))
    groups = materialise(groups.distinct(), "value_texts")
    most = lambda with_value: total ** (1 - generalise_at) * with_value**generalise_at
    held = groups.groupBy("copy").agg(F.collect_list(F.struct("values", "with_value")).alias("held"))
    first = found.where(F.size("base") > 0).groupBy("copy").agg(F.min("row").alias("row")).select("row")
    terms = lookup_join(found.select("row", "copy", "words"), first, "row", "left_semi")
    terms = terms.select("copy", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    terms = materialise(terms, "value_text_terms")
    highest = groups.agg(F.coalesce(F.max("with_value"), F.lit(0))).first()[0]
    rare = counted.where(F.col("with_term") <= most(float(highest)) * 1.001)
    able = F.filter("held", lambda h: F.col("with_term") <= most(h["with_value"]) * 1.001)
    met = lookup_join(terms, rare, "term").join(held, "copy")
    met = met.select("copy", "term", "with_term", F.explode(able).alias("held"))
    met = materialise(met.select("copy", "term", "with_term", "held.*"), "met_terms")
    pairs = met.groupBy("values", "term").agg(
        F.count(F.lit(1)).alias("together"),
        F.first("with_value").alias("with_value"),
        F.first("with_term").alias("with_term"),
    )
    information = F.log2(F.lit(total) / F.col("with_value"))
    mutual = F.log2(least_share(F.col("together"), F.col("with_term")) * F.lit(total) / F.col("with_value"))
    told = (
        pairs.select("values", "term", F.when(information > 0, mutual / information).otherwise(0.0).alias("disclosure"))
        .where(F.col("disclosure") >= generalise_at)
    )
    return met.select("copy", "values", "term").join(told, ["values", "term"]).select("copy", "term", "disclosure")


def private_spans(
    docs: DataFrame,
    reach: int = REACH,
    min_contexts: int = MIN_CONTEXTS,
    generalise_at: float = GENERALISE_AT,
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, base and terms of each document, and its text if wanted.

    `base` holds the pattern spans (start, kind number, end, value), `terms` those of the
    terms that reveal a value of the document (start, kind, end, disclosure), both in order.
    """
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    contexts = F.transform(
        "base",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["value"].alias("value"), context_sides(F.col("text"), s, reach).alias("sides")
        ),
    )
    found = rows.withColumn("contexts", contexts).withColumn("row", F.monotonically_increasing_id())
    found = found.withColumn("copy", F.xxhash64("text"))
    found = found.withColumn("words", F.when(F.size("base") > 0, outside(located(F.col("text"), TERMS))))
    found = materialise(found if keep_text else found.drop("text"), "private_spans")
    occurrences = materialise(term_occurrences(found), "near_terms")
    holders = found.select("copy", F.explode("contexts").alias("near"))
    holders = materialise(holders.select("copy", F.xxhash64("near.kind", "near.value").alias("entity")).distinct(), "holders")
    near = materialise(disclosures(docs, occurrences, min_contexts, generalise_at), "disclosures")
    near = lookup_join(holders, near, "entity").select("copy", "term", "disclosure")
    told = near.union(document_disclosures(docs, found, holders, generalise_at))
    told = told.groupBy("copy", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("copy")
    told = told.agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))
    places = F.transform(
        "words",
        lambda w: F.struct(
            w["start"].alias("start"),
            F.lit(TERM).alias("kind"),
            w["end"].alias("end"),
            F.try_element_at(F.col("told"), w["term"]).alias("disclosure"),
        ),
    )
    terms = F.when(F.col("told").isNotNull(), F.filter(places, lambda s: s["disclosure"].isNotNull()))
    held = lookup_join(found.drop("contexts"), materialise(told, "told_terms"), "copy", "left")
    return held.withColumn("terms", terms).drop("words", "told", "row", "copy")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def all_spans() -> Column:
    terms = F.coalesce(bare(F.col("terms")), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return F.array_sort(F.concat(bare(F.col("base")), terms))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans of each document.

    Base kinds are found by pattern in whole texts (null: empty) and checked: address
    parts up to 255, card numbers of 12 to 19 digits by Luhn, phones of 9 to 15 digits.
    A term is a word of at least three letters whose disclosure of a value reaches
    GENERALISE_AT, by its places within REACH characters of the value, on its line
    (`disclosures`), or by the documents that hold both (`document_disclosures`). All its
    places in a document that holds the value are listed. Repeated rows are read one
    by one, their copies of a context count once; other columns are ignored.
    """
    found = private_spans(docs)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:TERM])]
    return found.select(
        "doc_id",
        *counts,
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
    )


def sanitise(docs: DataFrame, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id and the text with values and revealing terms replaced.

    Values become their kind in brackets, terms `[TERM]`; terms whose disclosure reaches
    `remove_at` go. Of overlapping spans the first one counts. Null is read as empty.
    """
    found = private_spans(docs, keep_text=True)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["kind"]).alias("put"))
    )
    put = lambda s: F.when(s["disclosure"] >= remove_at, "").otherwise("[TERM]")
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    spans = F.array_sort(F.concat(base, F.coalesce(terms, none)))

    def replace(state: Column, span: Column) -> Column:
        kept = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        free = span["start"] >= state["at"]
        return F.struct(
            F.when(free, span["end"]).otherwise(F.greatest(state["at"], span["end"])).alias("at"),
            F.when(free, F.concat(state["out"], kept, span["put"])).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text")))
    return found.select("doc_id", F.aggregate(spans, begin, replace, rest).alias("text"))
