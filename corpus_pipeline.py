"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Languages first, then near copies, benchmark passages, the mixture by source and the
shards.  Each stage takes (spark, docs, sf_dir) and works on all rows that it
is given; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate as contamination
from gridloom.llm.jaccard_join import jaccard_components
from gridloom.llm.language_id import identify, train
from gridloom.llm.mixing import mix
from gridloom.llm.scratch import bound_batches, mark, saved, settled
from gridloom.llm.sharding import shard

#: Documents whose language scores less are rejected, as are those without one.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without letters (``und``) or below LEAST_SCORE go."""
    bound_batches(spark)
    labelled = identify(docs, train(docs), keep=docs.columns)
    kept = labelled.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of least id.

    Rows that repeat an id are one document; the row of least text stays.  Rows
    with a null id, and texts without words, are linked with nothing and stay.
    """
    bound_batches(spark)
    components, _ = jaccard_components(docs, width=5, percent=80)
    dropped = saved(components.filter("doc_id is not null and component_id <> doc_id").select("doc_id").distinct(), "copies")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    again = saved(components.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.limit(1).count():
        twice = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
        order = F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit("")))
        first = twice.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), order).alias("row"))
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select("doc_id", "row.*").select(*docs.columns))
    return kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    bound_batches(spark)
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by weight: each document as often as it is taken, dealt to the drawn shards and shuffled within them."""
    return mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows in a compacted store, with the shard that holds each: all columns, shard, shard_rows, shard_bytes."""
    return shard(docs).located(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = mark()
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, before)  # the tables of the stage before go
    return docs
