"""Highly variable genes: dispersion normalised within bins of equal frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_TOP, N_BINS = 2000, 20


def gene_moments(log_expr: DataFrame, genes: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(gene_id, mean, variance) of expm1(value) over all cells, absent entries as 0; genes without entries have 0 for both.

    ``n_cells`` is a one-row, one-column table.  The variance is of the population.
    A NaN or infinite value, before or after expm1, raises when the table is computed.
    """
    x = F.expm1("value")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.when(bad, F.raise_error(F.concat(F.lit("the matrix has NaN or infinite values: gene "), F.col("gene_id").cast("string"))).cast("double")).otherwise(x)
    sums = log_expr.groupBy("gene_id").agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    full = genes.select("gene_id").join(sums, "gene_id", "left").crossJoin(F.broadcast(n_cells.toDF("n"))).withColumn("mean", F.coalesce("s1", F.lit(0.0)) / F.col("n"))
    return full.select("gene_id", "mean", (F.coalesce("s2", F.lit(0.0)) / F.col("n") - F.col("mean") * F.col("mean")).alias("variance"))


def dispersions(moments: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """(gene_id, log_mean, dispersion, bin, normalized): log dispersions, and their z-scores within bins.

    Undefined dispersions (no variance or mean) are null and left out of the bins' means and
    deviations; a bin without spread counts as deviation 1.  Bins are of equal frequency by
    rank of mean: min(n_bins * rank div n_genes, n_bins - 1).  Genes are few: ranks take one window.
    """
    defined = (F.col("mean") > 0) & (F.col("variance") > 0)
    base = moments.withColumn("log_mean", F.log1p("mean")).withColumn("dispersion", F.when(defined, F.log(F.col("variance") / F.col("mean"))))
    rank = F.row_number().over(Window.orderBy("log_mean", "gene_id")) - 1
    count = F.count("*").over(Window.partitionBy())
    binned = base.withColumn("bin", F.least(F.floor(F.lit(n_bins) * rank / count), F.lit(n_bins - 1)).cast("int"))
    own = Window.partitionBy("bin")
    spread = F.stddev_pop("dispersion").over(own)
    normal = (F.col("dispersion") - F.avg("dispersion").over(own)) / F.when(spread > 1e-12, spread).otherwise(1.0)
    return binned.select("gene_id", "log_mean", "dispersion", "bin", normal.alias("normalized"))


def top_genes(dispersion: DataFrame, n_top: int = N_TOP) -> DataFrame:
    """(gene_id, normalized) of the ``n_top`` most variable genes; undefined ones last, ties by gene_id."""
    return dispersion.select("gene_id", "normalized").orderBy(F.desc_nulls_last("normalized"), "gene_id").limit(n_top)
