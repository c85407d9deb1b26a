"""Thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.chat import digests, format_chats
from gridloom.llm.decontaminate import contaminated
from gridloom.llm.fingerprints import compare_neighbours
from gridloom.llm.html_text import extract
from gridloom.llm.jaccard_join import jaccard_components
from gridloom.llm.language_id import identify, train
from gridloom.llm.mixing import placements
from gridloom.llm.scratch import bound_batches, bound_reads
from gridloom.llm.secrets import scan
from gridloom.llm.sharding import shard
from gridloom.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.unionByName(more)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)[0]


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    bound_reads(spark)
    docs = _table(spark, sf_dir, "documents")
    sized = dict(docs.dtypes).get("n_chars") in ("int", "bigint")
    return compare_neighbours(docs, text_size=F.col("n_chars") if sized else None)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("mix_size") * F.size("mix_shards")
    return placements(_table(spark, sf_dir, "documents")).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), "mix_shards")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents")).located("doc_id", "n_chars")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).drop("spans")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_ngram_jaccard_join, op3_document_fingerprints, op4_mixing, op5_secret_scans, op6_html_extraction, op7_substring_dedup, op8_sharding, op9_language_id, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {}
