"""Corpus pipeline: from documents to packed training sequences.

Five stages, each over all that the stage before it kept. The first four return the columns
of ``documents``; the last returns a row for each packed piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.divergence import keep_good
from terrasift.llm.packing import pack
from terrasift.llm.repeats import drop_repeats
from terrasift.llm.similar import drop_similar
from terrasift.llm.tables import forget, keep
from terrasift.llm.templates import drop_leaks

# A passage of over 50 words has more bytes than this, if its words have three letters on average.
PASSAGE = 200

# Bytes of rows that a task hands to Python at once. Texts pass through four buffers on the way,
# beside the executor's heap; the session's own setting is 64 MB.
BATCH = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage with ``BATCH`` set; its rows are computed after it returns, so the setting stays."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the divergence rules reject."""
    return keep_good(docs)


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near copies: five-word shingles, a Jaccard of 0.8 or more."""
    return drop_similar(docs, words=5, fifths=4)


@small_batches
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of ``PASSAGE`` bytes that occur more than once out of the texts."""
    return drop_repeats(docs, window=PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@small_batches
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with its own or other values."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("leaks", leaks),
    ("packing", packing),
]

# Tokenizers, fingerprints and packing have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        after, written = keep(stage(spark, docs, sf_dir))
        if path:
            forget(spark, path)
        docs, path = after, written
    return docs
