"""The registered queries of this package and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrasift.llm.divergence import judge
from terrasift.llm.divergence_sql import judge_sql
from terrasift.llm.huffman import read_digests, write_documents
from terrasift.llm.interpolation import score
from terrasift.llm.packing import pack
from terrasift.llm.ranked import search, search_sql
from terrasift.llm.repeats import removal_digests
from terrasift.llm.role_repair import repair
from terrasift.llm.simhash import near_copies
from terrasift.llm.substrings import removal_digests as substring_digests
from terrasift.llm.substrings import removal_sql
from terrasift.llm.templates import find_leaks, find_leaks_sql
from terrasift.llm.token_counts import token_lengths
from terrasift.llm.url_rules import apply_rules, apply_rules_sql
from terrasift.llm.whitening import whiten
from terrasift.operators.lineage import shared_folder


# host, path, verdict
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("lang")


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/huffman-{uuid.uuid4().hex}"
    write_documents(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, path)


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), order=2)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return apply_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("part", "seg", "pos")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir), window=400)


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_form=False).drop("row")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "words", limit=2048)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir), bits=4, words=4, seed=42)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(documents(spark, sf_dir), window=20)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence,
    "op2_huffman": op2_huffman,
    "op3_interpolation": op3_interpolation,
    "op4_url_rules": op4_url_rules,
    "op5_role_repair": op5_role_repair,
    "op6_repeats": op6_repeats,
    "op7_templates": op7_templates,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_substrings": op11_substrings,
    "op12_ranked": op12_ranked,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_divergence": judge_sql(),
    "op4_url_rules": apply_rules_sql(URL_RULES),
    "op7_templates": find_leaks_sql(),
    "op11_substrings": removal_sql(20),
    "op12_ranked": search_sql(50),
}
