"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from area_trends.llm.decontaminate import contamination
from area_trends.llm.exact_dedup import exact_dedup
from area_trends.llm.jaccard_join import jaccard_components
from area_trends.llm.language_id import language_id
from area_trends.llm.lexical_search import lexical_search
from area_trends.llm.line_dedup import line_dedup
from area_trends.llm.lm_score import lm_scores
from area_trends.llm.oracle import ORACLE
from area_trends.llm.pieces import piece_digests
from area_trends.llm.pii import personal_data
from area_trends.llm.resampling import resample
from area_trends.llm.spot_signatures import fingerprints
from area_trends.llm.token_counts import token_counts
from area_trends.llm.token_files import token_files
from corpus_pipeline import run as pipeline

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(documents(spark, sf_dir), BYTE_BPE)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language_id(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one."""
    return line_dedup(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents, beside a word unigram base."""
    return lm_scores(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share nine tenths of their three-word shingles."""
    return jaccard_components(documents(spark, sf_dir)).drop("n_links")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and terms that reveal them."""
    return personal_data(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents share with the benchmark."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts, and how alike they are."""
    return fingerprints(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in ORC files, described from what was written."""
    return token_files(documents(spark, sf_dir), BYTE_BPE)


def op10_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    return piece_digests(documents(spark, sf_dir), PIECES)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark texts, and the sample drawn."""
    return resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts differ in blanks and line ends at most."""
    return exact_dedup(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_personal_data": op6_personal_data,
    "op7_decontamination": op7_decontamination,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_files": op9_token_files,
    "op10_piece_coding": op10_piece_coding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}

__all__ = ["ORACLE", "QUERIES"]
