"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from area_trends.llm.common import forget_caches, slices, texts

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SLICE_BYTES = 500_000
MAX_LABELS = 1000
#: most labelled rows of one language that training reads
ROWS_PER_LABEL = 500
#: share of a label's learned rows that may be rejected
REJECT_SHARE = 0.001
#: how far, in nats, the n-grams of a text may be rarer than those of the least familiar learned rows
MARGIN = 2.0
#: how fast the score falls where n-grams get rarer than that
STEEP = 4.0
LETTER = regex.compile(r"\p{L}")

#: bytes of a lower-case text: letters and bytes above ASCII stay, all else is a space
KEPT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def subword_buckets(values: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the byte n-gram at every position, and where texts start.

    n-grams lie within one word, with the spaces around it; other positions have the
    bucket BUCKETS, which is no feature. Each text starts with a space.
    """
    encoded = [b" " + v.lower().encode("utf-8", "replace").translate(KEPT) for v in values]
    starts = np.cumsum([0, *map(len, encoded)])[:-1]
    text = np.frombuffer(b"".join(encoded) + b" " * max(ORDERS), np.uint8)
    n = len(text) - max(ORDERS)
    space = text == 32
    code = text[:n].astype(np.uint32)
    inner = np.zeros(n, bool)
    out = []
    for order in range(2, max(ORDERS) + 1):
        code = (code << np.uint32(8)) | text[order - 1 : order - 1 + n]
        if order > 2:
            inner |= space[order - 2 : order - 2 + n]
        if order in ORDERS:
            mixed = (code ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            bucket = (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            empty = inner | (space[:n] & space[order - 1 : order - 1 + n])
            out.append(np.where(empty, BUCKETS, bucket).astype(np.int32))
    return out, starts


@dataclass
class Model:
    """Labels, the summed-up weight of each bucket per label, and the calibration.

    `familiar` is the log share of each bucket in the learned rows. `least_score` and
    `least_familiar` are, per label, what the rows learned from hardly ever fall below.
    """

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray
    least_score: np.ndarray
    least_familiar: np.ndarray

    def scores(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, one row per text, and how familiar its n-grams are on average."""
        found, starts = subword_buckets(values)
        total = np.zeros((len(values), len(self.labels)))
        known, size = np.zeros(len(values)), np.zeros(len(values))
        for buckets in found:
            total += np.add.reduceat(self.weights[buckets], starts, axis=0)
            known += np.add.reduceat(self.familiar[buckets], starts)
            size += np.add.reduceat(buckets != BUCKETS, starts, dtype=np.int64)
        size = np.maximum(size, 1)
        logits = (total / size[:, None] + self.bias) / self.temperature
        return softmax(logits), known / size


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


def train(
    features: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    labels: list[str],
    dimension: int = 16,
    epochs: int = 12,
    rate: float = 0.5,
    seed: int = 7,
) -> Model:
    """Fits embeddings and softmax by stochastic gradient descent over bucket counts.

    Every fifth row is kept from the descent for calibration: the temperature with the
    least log loss on them. A row's own label stands for (n + 1) / (n + 2) of it, n being the rows
    kept, and the other labels for the rest, so that rows without an error do not make the model certain.
    """
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, dimension))
    weights = np.zeros((dimension, len(labels)))
    bias = np.zeros(len(labels))
    rows = np.arange(len(targets))
    held = rows[rows % 5 == 4] if len(rows) >= 20 else rows
    fitted = rows[rows % 5 != 4] if len(rows) >= 20 else rows
    steps, step = epochs * len(fitted), 0
    means = [(i, (c / max(c.sum(), 1))[:, None]) for i, c in features]
    for _ in range(epochs):
        for row in rng.permutation(fitted):
            buckets, share = means[row]
            vector = (embedding[buckets] * share).sum(0)
            error = softmax(vector @ weights + bias)
            error[targets[row]] -= 1
            pace = rate * (1 - step / steps)
            back = weights @ error
            weights -= pace * np.outer(vector, error) * 4
            bias -= pace * error * 0.1
            embedding[buckets] -= pace * len(buckets) ** 0.5 * share * back
            step += 1
    table = np.vstack([embedding @ weights, np.zeros((1, len(labels)))]).astype(np.float32)
    logits = np.array([(table[i] * s).sum(0) + bias for i, s in (means[r] for r in held)])
    others = max(len(labels) - 1, 1)
    wanted = np.full((len(held), len(labels)), 1 / (len(held) + 2) / others)
    wanted[np.arange(len(held)), targets[held]] = (len(held) + 1) / (len(held) + 2)
    options = 2.0 ** np.arange(-10, 7, 0.25)
    loss = [-(wanted * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in options]
    best = int(np.argmin(loss))
    if len(labels) > 1 and best in (0, len(options) - 1):
        raise ValueError("the temperature lies at the edge of what was tried")
    counts = np.zeros(BUCKETS)
    for buckets, n in features:
        counts[buckets] += n
    familiar = np.append(np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)), 0.0)
    none = np.full(len(labels), -np.inf)
    return Model(labels, table, bias, float(options[best]), familiar, none, none)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Sets the limits of rejection from all learned rows (text, lang), scored in one pass.

    A label's least score is the one below which `REJECT_SHARE` of its rows lies, at most one
    half; its least familiarity likewise, less `MARGIN`: n-grams e^MARGIN times rarer than in the
    least familiar rows. Two numbers for each label reach the driver.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    scored = rows.select("text", "lang").mapInArrow(
        predicting(held, LETTER, False), "lang string, lang_pred string, score double, familiar double, rejected boolean"
    )
    share = lambda name: F.percentile_approx(name, REJECT_SHARE, 100_000).alias(name)
    limits = scored.where(F.col("lang_pred") != UNKNOWN).groupBy("lang").agg(share("score"), share("familiar")).collect()
    found = {r["lang"]: (min(r["score"], 0.5), r["familiar"] - MARGIN) for r in limits}
    least = np.array([found.get(label, (0.5, -np.inf)) for label in model.labels])
    return replace(model, least_score=least[:, 0], least_familiar=least[:, 1])


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_caches("language_id")
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            found, starts = subword_buckets(part.column("text").to_pylist())
            ends = np.r_[starts[1:], len(found[0])]
            counts = [
                np.unique(np.concatenate([b[s:e] for b in found]), return_counts=True)
                for s, e in zip(starts, ends, strict=True)
            ]
            counts = [(b[b != BUCKETS], c[b != BUCKETS]) for b, c in counts]
            columns = [part.column("lang"), part.column("_order")]
            columns += [pa.array([b for b, _ in counts], pa.list_(pa.int32()))]
            columns += [pa.array([c.astype(np.int32) for _, c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "_order", "buckets", "counts"])


def fit(rows: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model | None:
    """Trains on labelled rows (text, lang); None where there are none.

    Rejection is calibrated on all of these rows, training reads a sample. At most `rows_per_label` rows of each label are read, chosen by a hash of id and
    text; each comes to the driver as counts of at most BUCKETS buckets. More than
    MAX_LABELS labels are refused.
    """
    labelled = rows.where(F.col("lang").isNotNull() & (F.col("text") != ""))
    sizes = labelled.groupBy("lang").count().limit(MAX_LABELS + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], min(1.0, 2 * rows_per_label / row["count"])).otherwise(share)
    hashed = labelled.withColumn("_order", F.xxhash64("doc_id", "text"))
    some = hashed.where(F.pmod("_order", F.lit(1_000_003)) < share * 1_000_003)
    first = Window.partitionBy("lang").orderBy("_order")
    chosen = some.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows_per_label).drop("_n")
    found = (
        chosen.select("text", "lang", "_order")
        .mapInArrow(bucket_counts, "lang string, _order long, buckets array<int>, counts array<int>")
        .collect()
    )
    found.sort(key=lambda r: (r["_order"], r["lang"]))
    labels = sorted({r["lang"] for r in found})
    features = [(np.array(r["buckets"], np.int32), np.array(r["counts"], float)) for r in found]
    targets = np.array([labels.index(r["lang"]) for r in found])
    return calibrate(train(features, targets, labels), labelled)


def predicting(held, has_letter, keep_text: bool) -> Callable:
    def run(batches):
        forget_caches("language_id")
        model = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values = part.column("text").to_pylist()
                known = [model is not None and has_letter.search(v) is not None for v in values]
                if model is None:
                    best, familiar = np.zeros(len(values)), np.zeros(len(values))
                    label, reject = [UNKNOWN] * len(values), np.ones(len(values), bool)
                else:
                    scores, familiar = model.scores(values)
                    at = scores.argmax(axis=1)
                    reject = (scores.max(axis=1) < model.least_score[at]) | (familiar < model.least_familiar[at])
                    above = np.minimum(familiar - model.least_familiar[at], 100.0)
                    best = np.where(known, scores.max(axis=1) / (1 + np.exp(np.minimum(-STEEP * above, 700.0))), 0.0)
                    label = [model.labels[i] if k else UNKNOWN for i, k in zip(at, known, strict=True)]
                names = [n for n in part.schema.names if keep_text or n != "text"]
                columns = [part.column(n) for n in names]
                columns += [pa.array(label), pa.array(best), pa.array(familiar)]
                columns += [pa.array(reject | ~np.array(known, bool))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "familiar", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, *extra: str, keep_text: bool = False) -> DataFrame:
    """doc_id, text if wanted, further columns of `docs`, lang_pred, score, familiar and rejected.

    A text without a letter, or null, is `und` with score 0 and rejected; so is every
    text where there is no model. Others are rejected if the probability of the best label, or
    the mean familiarity of their n-grams, lies below what the label's learned rows reach; lang_pred then
    still names that label. score is the probability, lowered towards 0 where the n-grams are
    unfamiliar, as in scripts and languages that were not learned. The model
    is broadcast; it has BUCKETS rows and at most MAX_LABELS columns.
    """
    rows = texts(docs, *extra)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != "text"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        predicting(held, LETTER, keep_text),
        ", ".join([*kinds, "lang_pred string", "score double", "familiar double", "rejected boolean"]),
    )


def fold(docs: DataFrame, parts: int) -> Column:
    """The remainder of the CRC-32 of doc_id as text."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % parts


def learn(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model | None:
    """The model of all documents with doc_id and lang that are not held out."""
    learned = docs.where(docs["doc_id"].isNotNull() & (fold(docs, 3) != 1))
    return fit(texts(learned, "lang"), rows_per_label)


def language_id(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """doc_id, held_out, lang_pred, score, familiar and rejected of each document.

    Learns from the text and non-null lang of documents that are not held out (fold 1 of
    3 is; a null doc_id is neither held out nor learned from); predictions see the text
    alone. Empty tables give no rows.
    """
    held_out = F.coalesce(fold(docs, 3) == 1, F.lit(False))
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict(marked, learn(docs, rows_per_label), "held_out")


def keep_identified(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """The documents that are not rejected, with all their columns as they are.

    Those without a letter, null texts among them, go, and those that are rejected by the
    model learned from the documents.
    """
    model = learn(docs, rows_per_label)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    found = predict(held, model, *[f"c{i}" for i in range(len(others))], keep_text=True).where("NOT rejected")
    place = {c: f"c{i}" for i, c in enumerate(others)}
    return found.select(*[F.col(place.get(c, c)).alias(c) for c in docs.columns])
