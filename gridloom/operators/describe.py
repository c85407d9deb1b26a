"""Descriptive statistics and the integrity validator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tolerances of the validator, and the verdicts of its reports.
INTEGER_TOLERANCE, MONOTONE_TOLERANCE, CENTRED_WITHIN, SMALL_LOSS, EXPECTED_PCS = 1e-6, 1e-6, 0.5, 0.01, 50
OK, WARNING, FAILURE = "OK", "AVISO", "FALHA"


def describe_cells(metrics: DataFrame) -> DataFrame:
    """One row: min, median, mean, max of genes per cell and of totals per cell."""
    out = []
    for c, name in (("n_genes", "genes"), ("total", "total")):
        out += [F.min(c).cast("double").alias(f"{name}_min"), F.median(c).alias(f"{name}_median"), F.avg(c).alias(f"{name}_mean"), F.max(c).cast("double").alias(f"{name}_max")]
    return metrics.agg(*out)


def describe_genes(expr: DataFrame, genes: DataFrame, few: int = 10, many: int = 1000) -> DataFrame:
    """One row: genes in no cell, in below ``few``, in above ``many``; and the median number of cells of a gene."""
    counts = genes.select("gene_id").join(expr.groupBy("gene_id").agg(F.count("*").alias("n")), "gene_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.count_if(F.col("n") == 0).alias("in_none"), F.count_if(F.col("n") < few).alias("in_few"), F.count_if(F.col("n") > many).alias("in_many"), F.median("n").alias("median_cells"))


def sparsity(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """One row: n_cells, n_genes, entries, density, sparsity."""
    sizes = expr.agg(F.count("*").alias("entries")).crossJoin(cells.agg(F.count("*").alias("n_cells"))).crossJoin(genes.agg(F.count("*").alias("n_genes")))
    density = F.when((F.col("n_cells") > 0) & (F.col("n_genes") > 0), F.col("entries") / (F.col("n_cells") * F.col("n_genes"))).otherwise(0.0)
    return sizes.select("n_cells", "n_genes", "entries", density.alias("density"), (1 - density).alias("sparsity"))


def quality_counts(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """One row: NaN, infinite, negative and fractional values; cells and genes that sum to 0; density.

    Entries of cells that ``cells`` lacks don't count.  The density of a matrix without cells or genes is 0 / 0, NaN.
    """
    v = F.col("value")
    counts = {"n_nan": F.isnan(v), "n_inf": F.abs(v) == float("inf"), "n_neg": (v < 0) & ~F.isnan(v), "n_frac": (F.abs(v - F.rint(v)) > INTEGER_TOLERANCE) & ~F.isnan(v) & (F.abs(v) < float("inf"))}

    def by(keys: DataFrame, key: str, *more) -> DataFrame:
        return keys.select(key).join(expr.groupBy(key).agg(F.sum("value").alias("s"), *more), key, "left")

    def empty(key: str):
        return F.count_if(F.coalesce("s", F.lit(0.0)) == 0).alias(f"zero_{key}"), F.count("*").alias(f"n_{key}")

    # one pass by cell gives the counts of all entries too, those of cells that are not listed left out
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    cell = by(cells, "cell_id", *[F.count_if(x).alias(c) for c, x in counts.items()], F.count("*").alias("entries"))
    row = cell.agg(*[total(c) for c in (*counts, "entries")], *empty("cells")).crossJoin(by(genes, "gene_id").agg(*empty("genes")))
    size = F.col("n_cells") * F.col("n_genes")
    return row.select("n_nan", "n_inf", "n_neg", "n_frac", F.col("zero_cells"), F.col("zero_genes"), F.when(size > 0, F.col("entries") / size).otherwise(float("nan")).alias("density"))


def _check(name: str, status, detail):
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))


def stage_report(stage: str, counts: DataFrame, whole_numbers: bool, negative_is_failure: bool = True) -> DataFrame:
    """(stage, check, status, detail) rows from ``quality_counts``."""
    c = F.col
    bad = (c("n_nan") > 0) | (c("n_inf") > 0)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])
    percent = F.when(F.isnan("density"), "-nan").otherwise(F.format_number(c("density") * 100, 3))  # 0 / 0 as the SQL prints it
    checks = [
        _check("nan_inf", F.when(bad, FAILURE).otherwise(OK), text("NaN=", (c("n_nan"),), ", Inf=", (c("n_inf"),))),
        _check("negative", F.when(c("n_neg") > 0, FAILURE if negative_is_failure else WARNING).otherwise(OK), text((c("n_neg"),), " negative")),
        _check("density", F.lit(OK), text((percent,), "% non-zero")),
        _check("zero_cells", F.when(c("zero_cells") > 0, WARNING).otherwise(OK), text((c("zero_cells"),), " cells")),
        _check("zero_genes", F.when(c("zero_genes") > 0, WARNING).otherwise(OK), text((c("zero_genes"),), " genes")),
    ]
    if whole_numbers:
        checks.insert(2, _check("integer", F.when(c("n_frac") > 0, WARNING).otherwise(OK), text((c("n_frac"),), " fractional")))
    return counts.select(F.lit(stage).alias("stage"), F.inline(F.array(*checks)))


def pc_statistics(scores: DataFrame) -> DataFrame:
    """(pc, variance, mean, n_bad) of each component, NaN left out of variance (ddof 0) and mean."""
    long = scores.select("cell_id", F.posexplode("pc").alias("pc", "x"))
    clean = F.when(F.isnan("x"), None).otherwise(F.col("x"))
    return long.groupBy("pc").agg(F.var_pop(clean).alias("variance"), F.avg(clean).alias("mean"), F.count_if(F.isnan("x") | (F.abs("x") == float("inf"))).alias("n_bad"))


def pca_report(stage: str, scores: DataFrame, expected: int = EXPECTED_PCS, n_components: int | None = None) -> DataFrame:
    """(stage, check, status, detail) rows of scores; ``n_components`` is the model's number, which scores without rows don't tell."""
    stats = pc_statistics(scores)
    if n_components is not None:
        components = scores.sparkSession.range(n_components).select(F.col("id").cast("int").alias("pc"))
        stats = components.join(stats, "pc", "left").fillna(0, ["n_bad"])
    step = stats.withColumn("step", F.col("variance") - F.lag("variance").over(Window.orderBy("pc")))  # one row a component
    one = step.agg(F.count("*").alias("n"), F.sum("n_bad").alias("bad"), F.coalesce(F.max("step"), F.lit(0.0)).alias("rise"), F.max(F.abs("mean")).alias("off"))
    dirty = F.col("bad") > 0
    checks = [
        _check("nan_inf", F.when(dirty, FAILURE).otherwise(OK), F.concat(F.col("bad").cast("string"), F.lit(" values"))),
        _check("n_components", F.when(F.col("n") == expected, OK).otherwise(WARNING), F.concat(F.col("n").cast("string"), F.lit(f" of {expected}"))),
        _check("decreasing_variance", F.when((F.col("rise") <= MONOTONE_TOLERANCE) & ~dirty, OK).otherwise(WARNING), F.lit("")),
        _check("centred", F.when((F.col("off") > CENTRED_WITHIN) | dirty, WARNING).otherwise(OK), F.lit("")),
    ]
    return one.select(F.lit(stage).alias("stage"), F.inline(F.array(*checks)))


def consistency_report(raw_cells: DataFrame, kept_cells: DataFrame, clustered_cells: DataFrame, normal_cells: DataFrame, score_cells: DataFrame, kept_genes: DataFrame, clustered_genes: DataFrame, normal_genes: DataFrame) -> DataFrame:
    """Checks across stages: counts, subsets of genes and barcodes, equal gene lists, repeated barcodes.

    Cell tables have cell_id and barcode, gene tables gene_id and gene_name.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = reduce(DataFrame.crossJoin, [n(raw_cells, "raw"), n(kept_cells, "kept"), n(clustered_cells, "clustered"), n(normal_cells, "normal"), n(score_cells, "scores")])
    outside = lambda a, b, key, name: a.join(b, key, "left_anti").agg(F.count("*").alias(name))
    row = row.crossJoin(outside(normal_genes, kept_genes, "gene_name", "new_genes")).crossJoin(outside(normal_cells, kept_cells, "barcode", "new_cells"))
    differ = kept_genes.alias("a").join(clustered_genes.alias("b"), F.col("a.gene_id") == F.col("b.gene_id"), "full").filter(~F.col("a.gene_name").eqNullSafe(F.col("b.gene_name")))
    row = row.crossJoin(n(differ, "moved_genes")).crossJoin(duplicate_keys(kept_cells, "barcode").select(F.col("n_duplicates").alias("twice")))
    c, loss = F.col, F.col("kept") - F.col("normal")
    verdict = lambda ok: F.when(ok, OK).otherwise(FAILURE)
    pair = lambda a, b: F.concat_ws(" ", c(a).cast("string"), F.lit("to"), c(b).cast("string"))
    number = lambda a: c(a).cast("string")
    checks = [
        _check("raw_to_kept", verdict(c("kept") <= c("raw")), pair("raw", "kept")),
        _check("kept_is_clustered", verdict(c("kept") == c("clustered")), pair("kept", "clustered")),
        _check("kept_to_normal", F.when(loss == 0, OK).when((loss > 0) & (loss < SMALL_LOSS * c("kept")), WARNING).otherwise(FAILURE), pair("kept", "normal")),
        _check("normal_is_scores", verdict(c("normal") == c("scores")), pair("normal", "scores")),
        _check("genes_equal", verdict(c("moved_genes") == 0), number("moved_genes")),
        _check("genes_subset", verdict(c("new_genes") == 0), number("new_genes")),
        _check("barcodes_subset", verdict(c("new_cells") == 0), number("new_cells")),
        _check("duplicate_barcodes", verdict(c("twice") == 0), number("twice")),
    ]
    return row.select(F.lit("pipeline").alias("stage"), F.inline(F.array(*checks)))


def labels_report(labels: DataFrame, n_scores: DataFrame, ks: tuple[int, ...] = ()) -> DataFrame:
    """For each k of (cell_id, k, cluster): whether there are as many labels as scores (a one-row, one-column table).

    Those of ``ks`` are reported even if no row has them.
    """
    counts = labels.groupBy("k").agg(F.count("*").alias("n"))
    if ks:
        listed = labels.sparkSession.createDataFrame([(k, 0) for k in ks], "k int, n long")
        counts = counts.unionByName(listed).groupBy("k").agg(F.sum("n").alias("n"))
    rows = counts.crossJoin(F.broadcast(n_scores.toDF("expected")))
    return rows.select(F.lit("labels").alias("stage"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("check"), F.when(F.col("n") == F.col("expected"), OK).otherwise(FAILURE).alias("status"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("expected").cast("string")).alias("detail"))


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """One row: rows less distinct keys."""
    return table.agg((F.count("*") - F.count_distinct(key)).alias("n_duplicates"))


def status_tally(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def raise_on_failure(report: DataFrame) -> None:
    """Raise if the report has a failure; warnings pass."""
    bad = report.filter(F.col("status") == FAILURE).limit(20).collect()
    if bad:
        raise RuntimeError("; ".join(f"{r.stage}: {r.check}: {r.detail}" for r in bad))


def stage_durations(spark: SparkSession, marks: DataFrame) -> DataFrame:
    """(position, stage, seconds): time since the mark before, from (position, stage, at) marks; the first counts from 0."""
    before = F.lag("at", 1, 0.0).over(Window.orderBy("position"))  # one row a stage
    return marks.select("position", "stage", (F.col("at") - before).alias("seconds"))
