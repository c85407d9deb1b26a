"""The sparse-matrix roles played by the order tables: customers as cells, parts or brands as genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.qc import flag_mt
from gridloom.sources.matrix import Matrix

#: Thresholds that suit these tables' sizes, and the prefix that plays the mitochondrial genes'.
MIN_GENES, MIN_CELLS, MAX_PCT_MT, MIN_MEAN = 20, 3, 15.0, 0.5
PREFIX = ("red",)
MAX_BLOCK = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_parts(spark: SparkSession, sf_dir: str) -> Matrix:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("int").alias("gene_id"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id"))
    # dealt by cell alone: the sums here, and sums and joins by cell later, then need no other exchange
    expr = lines.join(orders, "l_orderkey").repartition("cell_id").groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("barcode"), F.col("c_mktsegment").alias("cluster"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_brand").alias("gene_ref"))
    return Matrix(expr, cells, flag_mt(parts, PREFIX))


def customer_brands(spark: SparkSession, sf_dir: str) -> Matrix:
    """A small dense matrix: brands, numbered in order of name, as genes."""
    whole = customer_parts(spark, sf_dir)
    names = whole.genes.select(F.col("gene_ref").alias("gene_name")).distinct().coalesce(1)
    brands = names.orderBy("gene_name").select("gene_name", F.expr("cast(row_number() over (order by gene_name) - 1 as int)").alias("gene_id"))
    of = whole.genes.select(F.col("gene_id").alias("part"), F.col("gene_ref").alias("gene_name")).join(F.broadcast(brands), "gene_name").select("part", "gene_id")
    expr = whole.expr.withColumnRenamed("gene_id", "part").join(of, "part").groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
    return Matrix(expr, whole.cells, brands.select("gene_id", "gene_name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("pc"), F.col("label").alias("cluster"))
