"""A corpus pipeline: each stage works on the documents that the one before has kept.

The documents of a stage are the Parquet files its predecessor wrote. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from area_trends.llm.decontaminate import remove_contamination
from area_trends.llm.jaccard_join import keep_one_of_each
from area_trends.llm.language_id import keep_identified
from area_trends.llm.line_dedup import drop_repeated_lines
from area_trends.llm.pieces import MAX_CACHED, piece_ids
from area_trends.sources.tables import drop_scratch, materialise, scratch_paths

#: what the last stage wrote to scratch space for itself
_LEFT: list[str] = []


def stage(work):
    """A stage of the pipeline; what the one before wrote for itself goes, unless the documents still read it."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LEFT else []
        drop_scratch(spark, [p for p in _LEFT if not any(p.rpartition("/")[2] in file for file in read)])
        before = set(scratch_paths())
        found = work(spark, docs, sf_dir)
        _LEFT[:] = [path for path in scratch_paths() if path not in before]
        return found

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the identification rejects."""
    return keep_identified(docs)


@stage
def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out lines that repeat an earlier one, and drops documents of which nothing is left."""
    return drop_repeated_lines(docs)


@stage
def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares its five-word shingles to four fifths."""
    return keep_one_of_each(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what occurs in the benchmark."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the piece ids and the text decoded from them."""
    # a smaller store than by itself: the executors' memory has served four stages before
    found = piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"), max_cached=MAX_CACHED // 4)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", dedupe_lines),
    ("n-gram Jaccard join", dedupe_documents),
    ("benchmark decontamination", decontaminate),
    ("piece encoding and decoding", encode),
]

#: language identification learns by descent, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage_{i}")
    return docs
