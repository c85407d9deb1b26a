"""Quality control: per-cell and per-gene statistics, filters, dense ids, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.matrix import Matrix
from gridloom.sources.scratch import saved

# The default thresholds, and prefixes of mitochondrial genes' names.
MIN_GENES, MIN_CELLS, MAX_PCT_MT, MIN_MEAN = 500, 3, 5.0, 0.0027
MT_PREFIXES = ("MT-", "mt-")


def flag_mt(genes: DataFrame, prefixes: tuple[str, ...] = MT_PREFIXES) -> DataFrame:
    """``genes`` with mt: whether the name starts with one of ``prefixes`` (case counts)."""
    found: Column = F.lit(False)
    for p in prefixes:
        found = found | F.col("gene_name").startswith(p)
    return genes.withColumn("mt", found)


def cell_metrics(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, n_genes, total, mt_counts, pct_mt): stored entries, sums, and the flagged genes' share.

    ``genes`` has gene_id and mt.  Cells without entries have no row; pct_mt of a total of 0 is 0.
    """
    flagged = genes.filter("mt").select("gene_id").withColumn("mt", F.lit(True))
    per = expr.join(flagged, "gene_id", "left").groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"), F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0.0)).alias("mt_counts"))
    return per.withColumn("pct_mt", F.when(F.col("total") > 0, F.col("mt_counts") / F.col("total") * 100).otherwise(0.0))


def valid_cells(metrics: DataFrame, min_genes: int = MIN_GENES, max_pct_mt: float = MAX_PCT_MT) -> DataFrame:
    return metrics.filter((F.col("n_genes") >= min_genes) & (F.col("pct_mt") < max_pct_mt))


def gene_stats(expr: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(gene_id, n_cells, total, mean) over entries; ``n_cells`` is a one-row table whose first column counts all cells (absent entries are 0)."""
    count = n_cells.select(F.col(n_cells.columns[0]).alias("n_all"))
    per = expr.groupBy("gene_id").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))
    return per.crossJoin(F.broadcast(count)).select("gene_id", "n_cells", "total", (F.col("total") / F.col("n_all")).alias("mean"))


def kept_genes(stats: DataFrame, min_cells: int = MIN_CELLS, min_mean: float = MIN_MEAN) -> DataFrame:
    return stats.filter((F.col("n_cells") >= min_cells) & (F.col("mean") >= min_mean))


def dense_ids(genes: DataFrame) -> DataFrame:
    """(gene_id, new_id): kept genes renumbered 0, 1, ... in their order; genes are few, so one window holds them."""
    return genes.select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).cast("int").alias("new_id"))


def quality_control(matrix: Matrix, min_genes: int = MIN_GENES, min_cells: int = MIN_CELLS, max_pct_mt: float = MAX_PCT_MT, min_mean: float = MIN_MEAN) -> Matrix:
    """The filtered matrix: cells first, then genes judged over the kept cells.  No valid cell gives an empty matrix.

    The kept ids, which all three tables need, are written once.
    """
    cells = saved(valid_cells(cell_metrics(matrix.expr, matrix.genes), min_genes, max_pct_mt).select("cell_id"), "kept_cells")
    expr = matrix.expr.join(cells, "cell_id", "left_semi")
    genes = saved(kept_genes(gene_stats(expr, cells.agg(F.count("*"))), min_cells, min_mean).select("gene_id"), "kept_genes")
    return Matrix(expr.join(genes, "gene_id", "left_semi"), matrix.cells.join(cells, "cell_id", "left_semi"), matrix.genes.join(genes, "gene_id", "left_semi"))


def unique_names(genes: DataFrame) -> DataFrame:
    """(gene_id, gene_name, unique_name): the first of equal names stays; later ones get -1, -2, ...

    A number is skipped for all genes of a name where the suffixed name is another gene's own.
    """
    order = Window.partitionBy("gene_name").orderBy("gene_id")
    ranked = genes.select("gene_id", "gene_name", (F.row_number().over(order) - 1).alias("rank"))
    repeats = ranked.groupBy("gene_name").agg(F.max("rank").alias("most")).filter("most > 0")
    taken = genes.select(F.col("gene_name").alias("own")).distinct()
    # numbers up to the repeats plus the names of this form that exist are enough
    clash = taken.select(F.regexp_extract("own", r"^(.*)-(\d+)$", 1).alias("gene_name"), F.regexp_extract("own", r"^(.*)-(\d+)$", 2).alias("digits")).filter("digits <> '' and (digits = '0' or digits not like '0%')")
    clashes = clash.groupBy("gene_name").agg(F.collect_set(F.col("digits").cast("long")).alias("used"))
    free = repeats.join(clashes, "gene_name", "left").withColumn("used", F.coalesce("used", F.array().cast("array<long>")))
    free = free.select("gene_name", F.array_except(F.transform(F.sequence(F.lit(1), (F.col("most") + F.size("used")).cast("int")), lambda k: k.cast("long")), F.col("used")).alias("numbers"))
    joined = ranked.join(free, "gene_name", "left")
    return joined.select("gene_id", "gene_name", F.when(F.col("rank") == 0, F.col("gene_name")).otherwise(F.concat_ws("-", "gene_name", F.get("numbers", (F.col("rank") - 1).cast("int")))).alias("unique_name"))
