"""All queries of the library's own operators, each beside its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import describe, features, kmeans, metrics, normalize, pca, qc
from gridloom.plans import domain as D
from gridloom.sources import arrays, matrix
from gridloom.sources.scratch import filesystem, saved, scratch_path
from gridloom.streaming.online_kmeans import OnlineKMeans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def with_sql(body: str, *names: str) -> str:
    """``body`` after the definitions of ``names`` and of what these need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in SQL:
                if other != name and f" {other} " in f" {SQL[name]} ".replace("\n", " ").replace(")", " ").replace("(", " ").replace(",", " "):
                    need(other)
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body


SQL = {
    "expr": "SELECT o_custkey AS cell_id, CAST(l_partkey AS INTEGER) AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "genes": "SELECT CAST(p_partkey AS INTEGER) AS gene_id, p_name AS gene_name, p_brand AS gene_ref, starts_with(p_name, 'red') AS mt FROM part",
    "cells": "SELECT c_custkey AS cell_id, c_name AS barcode, c_mktsegment AS cluster FROM customer",
    "metrics": "SELECT cell_id, count(*) AS n_genes, sum(value) AS total, sum(CASE WHEN mt THEN value ELSE 0 END) AS mt_counts, CASE WHEN sum(value) > 0 THEN sum(CASE WHEN mt THEN value ELSE 0 END) / sum(value) * 100 ELSE 0 END AS pct_mt FROM expr JOIN genes USING (gene_id) GROUP BY 1",
    "kept_cells": f"SELECT cell_id FROM metrics WHERE n_genes >= {D.MIN_GENES} AND pct_mt < {D.MAX_PCT_MT}",
    "kept_expr": "SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM kept_cells )",
    "gene_stats": "SELECT gene_id, count(*) AS n_cells, sum(value) AS total, sum(value) / (SELECT count(*) FROM kept_cells ) AS mean FROM kept_expr GROUP BY 1",
    "kept_genes": f"SELECT gene_id FROM gene_stats WHERE n_cells >= {D.MIN_CELLS} AND mean >= {D.MIN_MEAN}",
    "filtered": "SELECT * FROM kept_expr WHERE gene_id IN (SELECT gene_id FROM kept_genes )",
    "blocked": f"SELECT cell_id, cluster, CAST((row_number() OVER (PARTITION BY cluster ORDER BY cell_id) - 1) // {D.MAX_BLOCK} AS INTEGER) AS block FROM cells ",
    "libs": "SELECT b.cell_id, b.cluster, b.block, coalesce(l.lib, 0) AS lib FROM blocked b LEFT JOIN (SELECT cell_id, sum(value) AS lib FROM expr GROUP BY 1) l USING (cell_id)",
    "thetas": f"SELECT cell_id, cluster, block, greatest(lib / avg(lib) OVER (PARTITION BY cluster, block), {normalize.FLOOR}) AS theta FROM libs ",
    "pseudo": "SELECT cluster, block, gene_id, sum(value / theta) / any_value(n) AS value FROM expr JOIN thetas USING (cell_id) JOIN (SELECT cluster, block, count(*) AS n FROM thetas GROUP BY 1, 2) USING (cluster, block) GROUP BY 1, 2, 3",
    "reference": "SELECT gene_id, value AS ref FROM pseudo JOIN (SELECT cluster, block FROM thetas GROUP BY 1, 2 ORDER BY count(*) DESC, cluster, block LIMIT 1) USING (cluster, block)",
    "scales": "SELECT cluster, block, coalesce(median(CASE WHEN value > 0 AND ref > 0 THEN value / ref END), 1) AS scale FROM pseudo LEFT JOIN reference USING (gene_id) GROUP BY 1, 2",
    "factors": "SELECT cell_id, theta * scale / avg(theta * scale) OVER () AS size_factor FROM thetas JOIN scales USING (cluster, block)",
    "logs": "SELECT cell_id, gene_id, ln(1 + value / size_factor) AS value FROM expr JOIN factors USING (cell_id)",
    "moments": "SELECT gene_id, coalesce(s1, 0) / n AS mean, coalesce(s2, 0) / n - (coalesce(s1, 0) / n) * (coalesce(s1, 0) / n) AS variance FROM genes LEFT JOIN (SELECT gene_id, sum(exp(value) - 1) AS s1, sum((exp(value) - 1) * (exp(value) - 1)) AS s2 FROM logs GROUP BY 1) USING (gene_id) CROSS JOIN (SELECT count(*) AS n FROM cells ) c",
    "binned": "SELECT gene_id, ln(1 + mean) AS log_mean, CASE WHEN mean > 0 AND variance > 0 THEN ln(variance / mean) END AS dispersion, CAST(least(20 * (row_number() OVER (ORDER BY ln(1 + mean), gene_id) - 1) // count(*) OVER (), 19) AS INTEGER) AS bin FROM moments ",
    "dispersions": "SELECT gene_id, log_mean, dispersion, bin, (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / CASE WHEN stddev_pop(dispersion) OVER (PARTITION BY bin) > 1e-12 THEN stddev_pop(dispersion) OVER (PARTITION BY bin) ELSE 1 END AS normalized FROM binned ",
    "brands": "SELECT DISTINCT gene_ref AS gene_name, CAST(dense_rank() OVER (ORDER BY gene_ref) - 1 AS INTEGER) AS gene_id FROM genes ",
    "brand_expr": "SELECT e.cell_id, b.gene_id, sum(e.value) AS value FROM expr e JOIN genes g USING (gene_id) JOIN brands b ON g.gene_ref = b.gene_name GROUP BY 1, 2",
    "gram": "SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, sum(a.value * b.value) AS value FROM brand_expr a JOIN brand_expr b USING (cell_id) WHERE a.gene_id <= b.gene_id GROUP BY 1, 2",
    "brand_means": "SELECT gene_id, coalesce(s, 0) / n AS mean, n FROM brands LEFT JOIN (SELECT gene_id, sum(value) AS s FROM brand_expr GROUP BY 1) USING (gene_id) CROSS JOIN (SELECT count(*) AS n FROM cells ) c",
    "points": "SELECT vec_id AS cell_id, label AS cluster, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "part_centres": "SELECT dense_rank() OVER (ORDER BY cell_id) - 1 AS cluster, gene_id, value AS c FROM expr WHERE cell_id IN (SELECT cell_id FROM expr GROUP BY 1 ORDER BY 1 LIMIT 5)",
}


# ---- quality control


def _written(spark: SparkSession, sf_dir: str) -> matrix.Matrix:
    """The matrix with its entries summed once, for plans that read them several times."""
    m = D.customer_parts(spark, sf_dir)
    return matrix.Matrix(saved(m.expr, "expr"), m.cells, m.genes)


def _qc(spark: SparkSession, sf_dir: str) -> tuple[matrix.Matrix, DataFrame, DataFrame]:
    m = _written(spark, sf_dir)
    cells = qc.valid_cells(qc.cell_metrics(m.expr, m.genes), D.MIN_GENES, D.MAX_PCT_MT).select("cell_id")
    return m, cells, matrix.gather_cells(m.expr, cells)


def _filtered(spark: SparkSession, sf_dir: str) -> matrix.Matrix:
    return qc.quality_control(_written(spark, sf_dir), D.MIN_GENES, D.MIN_CELLS, D.MAX_PCT_MT, D.MIN_MEAN)


@query(with_sql("SELECT cell_id, n_genes, total, mt_counts, round(pct_mt, 6) AS pct_mt FROM metrics", "metrics"))
def qc_cell_metrics(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return rounded(qc.cell_metrics(m.expr, m.genes), "pct_mt")


@query(with_sql("SELECT cell_id, n_genes, total, round(pct_mt, 6) AS pct_mt FROM metrics WHERE cell_id IN (SELECT cell_id FROM kept_cells)", "metrics", "kept_cells"))
def qc_valid_cells(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return rounded(qc.valid_cells(qc.cell_metrics(m.expr, m.genes), D.MIN_GENES, D.MAX_PCT_MT).drop("mt_counts"), "pct_mt")


@query(with_sql("SELECT gene_id, n_cells, total, round(mean, 6) AS mean FROM gene_stats", "gene_stats"))
def qc_gene_stats(spark, sf_dir):
    _, cells, expr = _qc(spark, sf_dir)
    return rounded(qc.gene_stats(expr, cells.agg(F.count("*"))), "mean")


@query(with_sql("SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS new_id FROM kept_genes", "kept_genes"))
def qc_gene_mask(spark, sf_dir):
    _, cells, expr = _qc(spark, sf_dir)
    return qc.dense_ids(qc.kept_genes(qc.gene_stats(expr, cells.agg(F.count("*"))), D.MIN_CELLS, D.MIN_MEAN))


@query(with_sql("SELECT cell_id, gene_id, value FROM filtered", "filtered"))
def qc_filtered_matrix(spark, sf_dir):
    return _filtered(spark, sf_dir).expr.select("cell_id", "gene_id", "value")


@query(with_sql("SELECT cell_id, new_id, value FROM filtered JOIN (SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS new_id FROM kept_genes) USING (gene_id)", "filtered", "kept_genes"))
def qc_reindexed_matrix(spark, sf_dir):
    """The filtered entries under the kept genes' dense ids."""
    out = _filtered(spark, sf_dir)
    return out.expr.join(qc.dense_ids(out.genes), "gene_id").select("cell_id", "new_id", "value")


@query(with_sql("SELECT cell_id, barcode FROM cells WHERE cell_id IN (SELECT cell_id FROM kept_cells)", "cells", "kept_cells"))
def qc_kept_barcodes(spark, sf_dir):
    return _filtered(spark, sf_dir).cells.select("cell_id", "barcode")


@query(with_sql("SELECT count(*) AS entries, (SELECT max(n) FROM (SELECT count(*) AS n FROM filtered GROUP BY cell_id)) AS longest FROM filtered", "filtered"))
def qc_entry_bounds(spark, sf_dir):
    per = _filtered(spark, sf_dir).expr.groupBy("cell_id").agg(F.count("*").alias("n"))
    # no cell left: 0 entries, and no longest row
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.max("n").alias("longest"))


@query(with_sql("SELECT gene_id, gene_name, CASE WHEN rn = 1 THEN gene_name ELSE gene_name || '-' || (rn - 1) END AS unique_name FROM (SELECT gene_id, gene_name, row_number() OVER (PARTITION BY gene_name ORDER BY gene_id) AS rn FROM genes)", "genes"))
def gene_names_unique(spark, sf_dir):
    return qc.unique_names(D.customer_parts(spark, sf_dir).genes)


@query(with_sql("SELECT gene_id, gene_name, mt FROM genes", "genes"))
def gene_flags(spark, sf_dir):
    return D.customer_parts(spark, sf_dir).genes.select("gene_id", "gene_name", "mt")


@query(with_sql("SELECT (SELECT count(*) FROM (SELECT gene_id FROM filtered EXCEPT SELECT gene_id FROM kept_genes)) AS new_genes, (SELECT count(*) FROM (SELECT cell_id FROM filtered EXCEPT SELECT cell_id FROM kept_cells)) AS new_cells, (SELECT count(*) FROM (SELECT gene_id FROM genes EXCEPT SELECT gene_id FROM kept_genes)) AS dropped_genes", "filtered", "kept_genes", "kept_cells", "genes"))
def subset_tests(spark, sf_dir):
    m, out = D.customer_parts(spark, sf_dir), _filtered(spark, sf_dir)
    out = matrix.Matrix(saved(out.expr, "kept"), out.cells, out.genes)
    outside = lambda a, b, key, name: a.select(key).distinct().join(b, key, "left_anti").agg(F.count("*").alias(name))
    return outside(out.expr, out.genes, "gene_id", "new_genes").crossJoin(outside(out.expr, out.cells, "cell_id", "new_cells")).crossJoin(outside(m.genes, out.genes, "gene_id", "dropped_genes"))


@query(with_sql("SELECT cell_id, c_mktsegment AS cluster FROM (SELECT c_custkey AS cell_id, c_mktsegment FROM customer) UNION ALL SELECT cell_id, CAST(cell_id % 3 AS VARCHAR) FROM (SELECT DISTINCT cell_id FROM kept_expr)", "kept_expr"))
def label_strings(spark, sf_dir):
    """Clusters as text, of two tables put one after the other."""
    m, cells, _ = _qc(spark, sf_dir)
    return m.cells.select("cell_id", "cluster").unionByName(cells.select("cell_id", F.pmod("cell_id", F.lit(3)).cast("string").alias("cluster")))


# ---- sources


@query(with_sql("SELECT CAST(gene_id AS BIGINT) AS cell_id, cell_id AS gene_id, value FROM expr", "expr"))
def matrix_transpose(spark, sf_dir):
    return matrix.transpose(D.customer_parts(spark, sf_dir).expr)


@query(with_sql("SELECT * FROM expr WHERE cell_id >= 100 AND cell_id < 400", "expr"))
def matrix_cell_range(spark, sf_dir):
    return matrix.cell_range(D.customer_parts(spark, sf_dir).expr, 100, 400).select("cell_id", "gene_id", "value")


@query(with_sql("SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM cells WHERE cluster = 'BUILDING')", "expr", "cells"))
def matrix_row_gather(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return matrix.gather_cells(m.expr, m.cells.filter("cluster = 'BUILDING'")).select("cell_id", "gene_id", "value")


@query(with_sql("SELECT cell_id, CAST(len(list(gene_id)) AS BIGINT) AS n, sum(gene_id * value) AS checksum FROM expr GROUP BY 1", "expr"))
def matrix_packed_rows(spark, sf_dir):
    rows = matrix.packed(D.customer_parts(spark, sf_dir).expr)
    total = F.aggregate(F.zip_with("idx", "val", lambda i, v: i * v), F.lit(0.0), lambda s, x: s + x)
    return rows.select("cell_id", F.size("idx").cast("long").alias("n"), total.alias("checksum"))


@query(with_sql("SELECT cell_id, CAST(coalesce(sum(n) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_offset FROM (SELECT cell_id, count(*) AS n FROM filtered GROUP BY 1)", "filtered"))
def matrix_row_offsets(spark, sf_dir):
    """Exclusive prefix sums of entries by cell, in two levels: ranges of ids, then cells within a range."""
    per = _filtered(spark, sf_dir).expr.groupBy("cell_id").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("cell_id") / 1000))
    ranges = per.groupBy("range").agg(F.sum("n").alias("n"))
    starts = ranges.select("range", F.expr("coalesce(sum(n) over (order by range rows between unbounded preceding and 1 preceding), 0)").alias("start"))
    inner = F.expr("coalesce(sum(n) over (partition by range order by cell_id rows between unbounded preceding and 1 preceding), 0)")
    return per.withColumn("inner", inner).join(starts, "range").select("cell_id", (F.col("start") + F.col("inner")).alias("entry_offset"))


@query("SELECT vec_id AS cell_id, 3 AS k, CAST(vec_id % 3 AS INTEGER) AS cluster FROM embeddings")
def labels_partitioned(spark, sf_dir):
    """Labels written partitioned by k and one k read back: the filter prunes partitions."""
    rows = D.vectors(spark, sf_dir).select("cell_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).withColumn("cluster", F.pmod("cell_id", "k").cast("int"))
    path = scratch_path(spark, "labels")
    arrays.write_labels(rows, path)
    return spark.read.schema("cell_id long, cluster int, k int").parquet(path).filter("k = 3").select("cell_id", "k", "cluster")


# ---- descriptions and validation


@query(with_sql("SELECT CAST(min(n_genes) AS DOUBLE) AS genes_min, CAST(median(n_genes) AS DOUBLE) AS genes_median, round(avg(n_genes), 6) AS genes_mean, CAST(max(n_genes) AS DOUBLE) AS genes_max, min(total) AS total_min, median(total) AS total_median, round(avg(total), 6) AS total_mean, max(total) AS total_max FROM metrics", "metrics"))
def describe_cells(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return rounded(describe.describe_cells(qc.cell_metrics(m.expr, m.genes)), "genes_mean", "total_mean")


@query(with_sql("SELECT count(*) FILTER (n = 0) AS in_none, count(*) FILTER (n < 10) AS in_few, count(*) FILTER (n > 1000) AS in_many, CAST(median(n) AS DOUBLE) AS median_cells FROM (SELECT coalesce(c, 0) AS n FROM genes LEFT JOIN (SELECT gene_id, count(*) AS c FROM kept_expr GROUP BY 1) USING (gene_id))", "genes", "kept_expr"))
def describe_genes(spark, sf_dir):
    m, _, expr = _qc(spark, sf_dir)
    return describe.describe_genes(expr, m.genes)


@query(with_sql("SELECT n_cells, n_genes, entries, round(entries / (n_cells * n_genes), 9) AS density, round(1 - entries / (n_cells * n_genes), 9) AS sparsity FROM (SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM expr) AS entries)", "cells", "genes", "expr"))
def matrix_sparsity(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return rounded(describe.sparsity(m.expr, m.cells, m.genes), "density", "sparsity", digits=9)


QUALITY = "SELECT (SELECT count(*) FILTER (isnan(value)) FROM {x} ) AS n_nan, (SELECT count(*) FILTER (isinf(value)) FROM {x} ) AS n_inf, (SELECT count(*) FILTER (value < 0) FROM {x} ) AS n_neg, (SELECT count(*) FILTER (abs(value - round(value)) > 1e-6) FROM {x} ) AS n_frac, (SELECT count(*) FROM cells LEFT JOIN (SELECT cell_id, sum(value) AS s FROM {x} GROUP BY 1) USING (cell_id) WHERE coalesce(s, 0) = 0) AS zero_cells, (SELECT count(*) FROM genes LEFT JOIN (SELECT gene_id, sum(value) AS s FROM {x} GROUP BY 1) USING (gene_id) WHERE coalesce(s, 0) = 0) AS zero_genes, round((SELECT count(*) FROM {x} ) / ((SELECT count(*) FROM cells ) * (SELECT count(*) FROM genes )), 9) AS density"


@query(with_sql(QUALITY.format(x="kept_expr"), "kept_expr", "cells", "genes"))
def quality_counts(spark, sf_dir):
    m, _, expr = _qc(spark, sf_dir)
    return rounded(describe.quality_counts(expr, m.cells, m.genes), "density", digits=9)


@query(with_sql("SELECT * FROM (" + QUALITY.format(x="logs") + ")", "logs", "cells", "genes"))
def quality_counts_normalized(spark, sf_dir):
    m, logs = _logs(spark, sf_dir)
    return rounded(describe.quality_counts(logs, m.cells, m.genes), "density", digits=9)


# the stages over the matrix filtered by the default least mean of a gene, which leaves genes at any size: clusters of it, then factors and entries as above
SQL["r_genes"] = SQL["kept_genes"].replace(f"mean >= {D.MIN_MEAN}", f"mean >= {qc.MIN_MEAN}")
SQL["r_filtered"] = "SELECT * FROM kept_expr WHERE gene_id IN (SELECT gene_id FROM r_genes )"
SQL["s_centres"] = re.sub(r"\bexpr\b", "r_filtered", SQL["part_centres"])
SQL["s_labels"] = "SELECT cell_id, cluster, distance FROM (SELECT x.cell_id, n.cluster, greatest(x.xn - 2 * coalesce(d.dot, 0) + n.cn, 0) AS distance FROM (SELECT cell_id, sum(value * value) AS xn FROM r_filtered GROUP BY 1) x CROSS JOIN (SELECT cluster, sum(c * c) AS cn FROM s_centres GROUP BY 1) n LEFT JOIN (SELECT cell_id, cluster, sum(value * c) AS dot FROM r_filtered JOIN s_centres USING (gene_id) GROUP BY 1, 2) d ON d.cell_id = x.cell_id AND d.cluster = n.cluster) QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY distance, cluster) = 1"
SQL["s_cells"] = "SELECT c.cell_id, c.barcode, CAST(l.cluster AS VARCHAR) AS cluster FROM cells c JOIN s_labels l ON l.cell_id = c.cell_id"
_NORMAL = ("blocked", "libs", "thetas", "pseudo", "reference", "scales", "factors", "logs")
for _name in _NORMAL:
    _body = re.sub(r"\bexpr\b", "r_filtered", re.sub(r"\bcells\b", "s_cells", SQL[_name]))
    SQL[f"s_{_name}"] = re.sub(r"\b(" + "|".join(_NORMAL) + r")\b", r"s_\1", _body)


def _quality_sql(entries: str, cells: str, genes: str = "r_genes") -> str:
    return re.sub(r"\bcells\b", cells, re.sub(r"\bgenes\b", genes, QUALITY)).format(x=entries)


def _stage_sql(stage: str, table: str, whole: bool) -> str:
    checks = [
        ("nan_inf", "CASE WHEN n_nan + n_inf > 0 THEN 'FALHA' ELSE 'OK' END", "'NaN=' || n_nan || ', Inf=' || n_inf"),
        ("negative", "CASE WHEN n_neg > 0 THEN 'FALHA' ELSE 'OK' END", "n_neg || ' negative'"),
        *([("integer", "CASE WHEN n_frac > 0 THEN 'AVISO' ELSE 'OK' END", "n_frac || ' fractional'")] if whole else []),
        ("density", "'OK'", "format('{:.3f}', density * 100) || '% non-zero'"),
        ("zero_cells", "CASE WHEN zero_cells > 0 THEN 'AVISO' ELSE 'OK' END", "zero_cells || ' cells'"),
        ("zero_genes", "CASE WHEN zero_genes > 0 THEN 'AVISO' ELSE 'OK' END", "zero_genes || ' genes'"),
    ]
    return " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{name}' AS \"check\", {status} AS status, {detail} AS detail FROM {table}" for name, status, detail in checks)


LABEL_KS = (2, 4)
REPORT_PARTS = (
    ", q AS (" + _quality_sql("r_filtered", "kept_cells") + "), z AS (" + _quality_sql("s_logs", "s_cells") + "), r AS (SELECT (SELECT count(*) FROM cells) AS raw, (SELECT count(*) FROM kept_cells) AS kept, (SELECT count(*) FROM s_cells) AS clustered,"
    " (SELECT count(DISTINCT cell_id) FROM s_logs) AS normal, (SELECT count(*) FROM s_cells) AS scores, (SELECT count(*) FROM s_cells WHERE cell_id NOT IN (SELECT cell_id FROM kept_cells)) AS new_cells,"
    " (SELECT count(DISTINCT gene_id) FROM s_logs WHERE gene_id NOT IN (SELECT gene_id FROM r_genes)) AS new_genes, (SELECT count(*) - count(DISTINCT barcode) FROM cells WHERE cell_id IN (SELECT cell_id FROM kept_cells)) AS twice)\n"
)
REPORT = (
    _stage_sql("kept", "q", True) + " UNION ALL " + _stage_sql("normal", "z", False)
    # what holds of components by their definition
    + f" UNION ALL SELECT 'pca', unnest(['nan_inf', 'n_components', 'decreasing_variance', 'centred']), 'OK', unnest(['0 values', '{pca.N_PCS} of {pca.N_PCS}', '', ''])"
    " UNION ALL SELECT 'pipeline', unnest(['raw_to_kept', 'kept_is_clustered', 'kept_to_normal', 'normal_is_scores', 'genes_equal', 'genes_subset', 'barcodes_subset', 'duplicate_barcodes']),"
    " unnest([CASE WHEN kept <= raw THEN 'OK' ELSE 'FALHA' END, CASE WHEN kept = clustered THEN 'OK' ELSE 'FALHA' END, CASE WHEN normal = kept THEN 'OK' WHEN kept - normal < 0.01 * kept AND kept > normal THEN 'AVISO' ELSE 'FALHA' END,"
    " CASE WHEN normal = scores THEN 'OK' ELSE 'FALHA' END, 'OK', CASE WHEN new_genes = 0 THEN 'OK' ELSE 'FALHA' END, CASE WHEN new_cells = 0 THEN 'OK' ELSE 'FALHA' END, CASE WHEN twice = 0 THEN 'OK' ELSE 'FALHA' END]),"
    " unnest([raw || ' to ' || kept, kept || ' to ' || clustered, kept || ' to ' || normal, normal || ' to ' || scores, '0', new_genes || '', new_cells || '', twice || '']) FROM r"
    + "".join(f" UNION ALL SELECT 'labels', 'k{k}', CASE WHEN clustered = scores THEN 'OK' ELSE 'FALHA' END, clustered || ' of ' || scores FROM r" for k in LABEL_KS)
)
REPORT_NEEDS = ("cells", "kept_cells", "r_genes", "r_filtered", "s_cells", "s_logs")


def _report(spark, sf_dir) -> DataFrame:
    """The validator over stages that are each written and read back: filtered, clustered, normalised, scores, labels."""
    raw = _written(spark, sf_dir)
    path = scratch_path(spark, "kept")
    matrix.write_matrix(qc.quality_control(raw, D.MIN_GENES, D.MIN_CELLS, D.MAX_PCT_MT, qc.MIN_MEAN), path)
    kept = matrix.read_matrix(spark, path)
    labels = kmeans.sparse_assign(kept.expr, _first_cells(kept.expr, 5)).select("cell_id", F.col("cluster").cast("string").alias("cluster"))
    cells = saved(kept.cells.select("cell_id", "barcode").join(labels, "cell_id"), "clustered")
    clustered = matrix.Matrix(kept.expr, cells, saved(kept.genes, "genes"))
    logs = saved(_normalized(clustered), "logs")
    path = scratch_path(spark, "labels")
    if clustered.genes.isEmpty():
        # no gene reaches the least mean: no cell is left to be clustered, none has scores or labels, and there is nothing to fit
        scores, n_components = spark.createDataFrame([], "cell_id long, pc array<double>"), pca.N_PCS
        final = spark.createDataFrame([], "cell_id long, k int, cluster int")
    else:
        scores, components = _hvg_scores(clustered, logs)
        scores, n_components = saved(scores, "scores"), len(components.eigenvalues)
        fits = kmeans.lloyd(scores, {k: kmeans.lowest_ids(scores, k) for k in LABEL_KS}, 3, 0)
        each = [kmeans.assign(scores, fits[k].centroids).select("cell_id", F.lit(k).alias("k"), "cluster") for k in LABEL_KS]
        final = each[0].unionByName(each[1])
    arrays.write_labels(final, path)
    final = spark.read.schema("cell_id long, cluster int, k int").parquet(path)
    having = lambda table, key, of: table.join(of.select(key).distinct(), key, "left_semi")
    parts = [
        describe.stage_report("kept", describe.quality_counts(kept.expr, kept.cells, kept.genes), True),
        describe.stage_report("normal", describe.quality_counts(logs, cells, kept.genes), False),
        describe.pca_report("pca", scores, n_components=n_components),
        describe.consistency_report(raw.cells, kept.cells, cells, having(cells, "cell_id", logs), having(cells, "cell_id", scores), kept.genes, clustered.genes, having(raw.genes, "gene_id", logs)),
        describe.labels_report(final, scores.agg(F.count("*")), LABEL_KS),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _first_cells(expr: DataFrame, k: int) -> DataFrame:
    """The rows of the ``k`` lowest ids as sparse centroids."""
    first = expr.select("cell_id").distinct().orderBy("cell_id").limit(k).selectExpr("cell_id", "cast(row_number() over (order by cell_id) - 1 as int) as cluster")
    return expr.join(F.broadcast(first), "cell_id").select("cluster", "gene_id", "value")


@query(with_sql("", *REPORT_NEEDS).rstrip() + REPORT_PARTS + REPORT)
def integrity_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(with_sql("", "filtered", "kept_cells", "kept_genes").rstrip() + ", q AS (" + _quality_sql("filtered", "kept_cells", "kept_genes") + ") SELECT status, count(*) AS n FROM (" + _stage_sql("kept", "q", True) + ") GROUP BY 1")
def status_tally(spark, sf_dir):
    kept = _filtered(spark, sf_dir)
    return describe.status_tally(describe.stage_report("kept", describe.quality_counts(saved(kept.expr, "kept"), kept.cells, kept.genes), True))


@query("SELECT 'labels' AS stage, 'k' || k AS \"check\", CASE WHEN n = (SELECT count(*) FROM embeddings) THEN 'OK' ELSE 'FALHA' END AS status, n || ' of ' || (SELECT count(*) FROM embeddings) AS detail FROM (SELECT 2 AS k, count(*) AS n FROM embeddings UNION ALL SELECT 3, count(*) FILTER (vec_id > 5) FROM embeddings)")
def labels_report(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    labels = rows.select("cell_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k"), F.lit(0).alias("cluster")).filter("k = 2 or cell_id > 5")
    return describe.labels_report(labels, rows.agg(F.count("*")), (2, 3))


@query("SELECT count(*) - count(DISTINCT p_name) AS n_duplicates FROM part")
def duplicate_keys(spark, sf_dir):
    return describe.duplicate_keys(D.customer_parts(spark, sf_dir).genes, "gene_name")


@query(with_sql("SELECT dim AS pc, round(var_pop(x), 6) AS variance, round(avg(x), 6) AS mean, CAST(0 AS BIGINT) AS n_bad FROM points GROUP BY 1", "points").replace("dim AS pc", "CAST(dim AS INTEGER) AS pc"))
def pca_variance_check(spark, sf_dir):
    return rounded(describe.pc_statistics(D.vectors(spark, sf_dir)), "variance", "mean")


@query(with_sql("SELECT 'pca' AS stage, unnest(['nan_inf', 'n_components', 'decreasing_variance', 'centred']) AS \"check\", unnest(['OK', CASE WHEN n = 64 THEN 'OK' ELSE 'AVISO' END, CASE WHEN rise <= 1e-6 THEN 'OK' ELSE 'AVISO' END, CASE WHEN off > 0.5 THEN 'AVISO' ELSE 'OK' END]) AS status FROM (SELECT count(*) AS n, max(rise) AS rise, max(abs(mean)) AS off FROM (SELECT mean, v - lag(v) OVER (ORDER BY dim) AS rise FROM (SELECT dim, var_pop(x) AS v, avg(x) AS mean FROM points GROUP BY 1)))", "points"))
def pca_report(spark, sf_dir):
    return describe.pca_report("pca", D.vectors(spark, sf_dir), 64).select("stage", "check", "status")


@query(with_sql("SELECT CAST(dim AS INTEGER) AS pc, round(v, 6) AS variance, round(v / sum(v) OVER (), 6) AS share FROM (SELECT dim, var_pop(x) AS v FROM points GROUP BY 1)", "points"))
def pc_variance_shares(spark, sf_dir):
    return rounded(pca.variance_shares(D.vectors(spark, sf_dir)), "variance", "share")


@query("SELECT position, stage, made_at - coalesce(lag(made_at) OVER (ORDER BY position), 0) AS seconds FROM (VALUES (0, 'read', 1.5::DOUBLE), (1, 'filter', 4::DOUBLE), (2, 'write', 4.25::DOUBLE)) t(position, stage, made_at)")
def stage_durations(spark, sf_dir):
    return describe.stage_durations(spark, spark.createDataFrame([(0, "read", 1.5), (1, "filter", 4.0), (2, "write", 4.25)], "position int, stage string, at double"))


# ---- normalisation


def _blocked(spark, sf_dir):
    m = _written(spark, sf_dir)
    return m, normalize.blocks(m.cells, D.MAX_BLOCK)


def _normalized(m: matrix.Matrix) -> DataFrame:
    """Log-normalised entries by library sizes within blocks of the cells' clusters."""
    thetas = saved(normalize.library_factors(m.expr, normalize.blocks(m.cells, D.MAX_BLOCK)), "thetas")
    return normalize.log_normalize(m.expr, normalize.size_factors(thetas, normalize.block_scales(m.expr, thetas)))


def _logs(spark, sf_dir):
    m = _written(spark, sf_dir)
    return m, saved(_normalized(m), "logs")


@query(with_sql("SELECT cell_id, cluster, block FROM blocked", "blocked"))
def norm_blocks(spark, sf_dir):
    return _blocked(spark, sf_dir)[1]


@query(with_sql("SELECT cell_id, cluster, block, round(theta, 6) AS theta FROM thetas", "thetas"))
def libsize_factors(spark, sf_dir):
    m, blocked = _blocked(spark, sf_dir)
    return rounded(normalize.library_factors(m.expr, blocked), "theta")


@query(with_sql("SELECT cluster, block, round(scale, 6) AS scale FROM scales", "scales"))
def block_rescale(spark, sf_dir):
    m, blocked = _blocked(spark, sf_dir)
    return rounded(normalize.block_scales(m.expr, saved(normalize.library_factors(m.expr, blocked), "thetas")), "scale")


@query(with_sql("SELECT cluster, block, gene_id, round(value, 6) AS value FROM pseudo", "pseudo"))
def pseudo_cells(spark, sf_dir):
    m, blocked = _blocked(spark, sf_dir)
    return rounded(normalize.pseudo_cells(m.expr, saved(normalize.library_factors(m.expr, blocked), "thetas")), "value")


@query(with_sql("SELECT cell_id, gene_id, round(value, 6) AS value FROM logs", "logs"))
def log_normalized(spark, sf_dir):
    return rounded(_logs(spark, sf_dir)[1], "value")


POOL_WIDTHS = (1, 21, 26)


@query(
    with_sql(
        "SELECT cluster, CAST(block AS INTEGER) AS block, CAST(s AS INTEGER) AS start, CAST(width AS INTEGER) AS width, round(median(pooled / ref), 6) AS ratio FROM (SELECT r.cluster, r.block, p.pos AS s, w.width, g.gene_id, g.ref, coalesce(sum(v.z), 0) AS pooled FROM ring r JOIN ring p ON r.cluster = p.cluster AND r.block = p.block JOIN (VALUES (1), (21), (26)) w(width) ON ((r.pos - p.pos + r.nb) % r.nb) < w.width AND w.width <= r.nb JOIN refs g ON g.cluster = r.cluster AND g.block = r.block LEFT JOIN zs v ON v.cell_id = r.cell_id AND v.gene_id = g.gene_id GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4",
        "expr", "cells",
    ).replace(
        "\nSELECT cluster, CAST(block",
        ",\nsmall AS (SELECT cell_id, cluster, (row_number() OVER (PARTITION BY cluster ORDER BY cell_id) - 1) // 30 AS block FROM cells WHERE cell_id <= 150),\n"
        "ls AS (SELECT s.*, l.lib, l.lib / avg(l.lib) OVER (PARTITION BY cluster, block) AS t FROM small s JOIN (SELECT cell_id, sum(value) AS lib FROM brand GROUP BY 1) l USING (cell_id)),\n"
        "ring AS (SELECT *, row_number() OVER (PARTITION BY cluster, block ORDER BY lib, cell_id) - 1 AS pos, count(*) OVER (PARTITION BY cluster, block) AS nb FROM ls),\n"
        "zs AS (SELECT r.cluster, r.block, r.cell_id, b.gene_id, b.value / r.t AS z, r.nb FROM ring r JOIN brand b USING (cell_id)),\n"
        "refs AS (SELECT cluster, block, gene_id, sum(z) / any_value(nb) AS ref FROM zs GROUP BY 1, 2, 3 HAVING sum(z) / any_value(nb) >= 0.1)\nSELECT cluster, CAST(block",
    ).replace(",\nsmall AS", f",\ngenes AS ({SQL['genes']}),\nbrands AS ({SQL['brands']}),\nbrand AS ({SQL['brand_expr']}),\nsmall AS")
)
def pool_medians(spark, sf_dir):
    """A fixed small case of pool_medians_all that SQL can check: cells with ids up to 150 of the brand matrix, three widths."""
    m = D.customer_brands(spark, sf_dir)
    blocked = normalize.blocks(m.cells.filter("cell_id <= 150"), 30).join(m.expr.select("cell_id").distinct(), "cell_id", "left_semi")
    return rounded(normalize.pool_table(m.expr, blocked, POOL_WIDTHS), "ratio")


@query()
def pool_medians_all(spark, sf_dir):
    """Pools of all cells with entries, in the blocks and of the widths of deconv_size_factors."""
    m, blocked = _blocked(spark, sf_dir)
    return rounded(normalize.pool_table(m.expr, blocked, (1, *normalize.WIDTHS)), "ratio")


def _deconvolved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m, blocked = _blocked(spark, sf_dir)
    thetas = saved(normalize.deconvolution_factors(m.expr, blocked), "thetas")
    return thetas, normalize.size_factors(thetas, normalize.block_scales(m.expr, thetas))


@query()
def deconv_size_factors(spark, sf_dir):
    return _deconvolved(spark, sf_dir)[1]


@query(with_sql("SELECT cluster, block, count(*) AS n, round(CASE WHEN sum(lib) = 0 OR (count(*) >= 50 AND min(lib) > 0) THEN 1 ELSE avg(greatest(lib / m, 1e-8)) END, 6) AS mean_theta, 0 AS n_bad, 1.0::DOUBLE AS mean_factor FROM (SELECT *, avg(lib) OVER (PARTITION BY cluster, block) AS m FROM libs ) GROUP BY 1, 2", "libs"))
def deconv_invariants(spark, sf_dir):
    """What must hold of deconvolved factors: theta has mean 1 in each solved block, all factors are positive and their mean over all cells is 1."""
    thetas, factors = _deconvolved(spark, sf_dir)
    bad = (F.col("theta").isNull() | F.isnan("theta") | (F.col("theta") <= 0)).cast("int")
    by = thetas.groupBy("cluster", "block").agg(F.count("*").alias("n"), F.avg("theta").alias("mean_theta"), F.sum(bad).cast("int").alias("n_bad"))
    return rounded(by.crossJoin(F.broadcast(factors.agg(F.avg("size_factor").alias("mean_factor")))), "mean_theta", "mean_factor")


# ---- features and components


def _moments(spark, sf_dir):
    m, logs = _logs(spark, sf_dir)
    return features.gene_moments(logs, m.genes, m.cells.agg(F.count("*")))


@query(with_sql("SELECT gene_id, round(mean, 6) AS mean, round(variance, 5) AS variance FROM moments", "moments"))
def gene_moments(spark, sf_dir):
    return rounded(rounded(_moments(spark, sf_dir), "mean"), "variance", digits=5)


@query(with_sql("SELECT gene_id, round(log_mean, 6) AS log_mean, round(dispersion, 6) AS dispersion, bin, round(normalized, 5) AS normalized FROM dispersions", "dispersions"))
def hvg_dispersion(spark, sf_dir):
    return rounded(rounded(features.dispersions(_moments(spark, sf_dir)), "log_mean", "dispersion"), "normalized", digits=5)


@query(with_sql("SELECT gene_id, round(normalized, 5) AS normalized FROM dispersions ORDER BY normalized DESC NULLS LAST, gene_id LIMIT 100", "dispersions").replace("ORDER BY normalized", "ORDER BY dispersions.normalized"))
def hvg_top_n(spark, sf_dir):
    return rounded(features.top_genes(features.dispersions(_moments(spark, sf_dir)), 100), "normalized", digits=5)


@query(with_sql("SELECT cell_id, l.gene_id, round(value, 6) AS value FROM logs l JOIN (SELECT gene_id FROM dispersions ORDER BY normalized DESC NULLS LAST, gene_id LIMIT 100) USING (gene_id)", "logs", "dispersions"))
def hvg_matrix(spark, sf_dir):
    """Log-normalised entries of the 100 most variable genes: what PCA reads."""
    m, logs = _logs(spark, sf_dir)
    return rounded(_variable(m, logs)[0].select("cell_id", "gene_id", "value"), "value")


def _variable(m: matrix.Matrix, logs: DataFrame, n_top: int = 100) -> tuple[DataFrame, DataFrame]:
    """Entries of the ``n_top`` most variable genes, and these genes."""
    top = saved(features.top_genes(features.dispersions(features.gene_moments(logs, m.genes, m.cells.agg(F.count("*")))), n_top), "top")
    return matrix.select_genes(logs, top), top


def _packed_cells(m: matrix.Matrix, entries: DataFrame) -> DataFrame:
    """A row for each cell, those without entries too, for numeric kernels."""
    rows = m.cells.select("cell_id").join(matrix.packed(entries), "cell_id", "left")
    empty = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as array<{t}>)"))
    return rows.select("cell_id", empty("idx", "int").alias("idx"), empty("val", "double").alias("val"))


def _hvg_scores(m: matrix.Matrix, logs: DataFrame) -> tuple[DataFrame, pca.Components]:
    """Scores on the N_PCS components of the variable genes, in order of their empirical variance."""
    entries, top = _variable(m, logs)
    rows = saved(_packed_cells(m, entries), "packed")
    components = pca.fit(rows, top, pca.N_PCS)
    scores = saved(pca.project(rows, components), "scores")
    stats = {r.pc: r.variance for r in describe.pc_statistics(scores).collect()}  # a row a component
    return pca.reordered(scores, np.array([stats[k] for k in sorted(stats)])), components


@query()
def pca_hvg_scores(spark, sf_dir):
    return _hvg_scores(*_logs(spark, sf_dir))[0]


HVG_VARIANCE = "SELECT sum(s2 / n - (s1 / n) * (s1 / n)) * any_value(n) / (any_value(n) - 1) AS total FROM (SELECT gene_id, sum(value) AS s1, sum(value * value) AS s2, (SELECT count(*) FROM cells ) AS n FROM logs WHERE gene_id IN (SELECT gene_id FROM dispersions ORDER BY normalized DESC NULLS LAST, gene_id LIMIT 100) GROUP BY 1)"


@query(with_sql(f"SELECT CAST(k AS INTEGER) AS pc, round((SELECT total FROM ({HVG_VARIANCE})), 4) AS total_variance, TRUE AS is_eigenvalue, TRUE AS is_centred, TRUE AS is_uncorrelated FROM range({pca.N_PCS}) t(k)", "logs", "dispersions", "cells"))
def pca_hvg_invariants(spark, sf_dir):
    """What must hold of the variable genes' scores: variances are the eigenvalues in order, means 0, correlations 0; the trace is SQL's."""
    scores, c = _hvg_scores(*_logs(spark, sf_dir))
    return _score_invariants(spark, scores, c).withColumn("total_variance", F.lit(round(c.total, 4)))


@query(with_sql("SELECT gene_id, round(mean, 6) AS mean FROM brand_means", "brand_means"))
def column_means(spark, sf_dir):
    m = D.customer_brands(spark, sf_dir)
    return rounded(pca.column_means(m.expr, m.genes, m.cells.agg(F.count("*"))), "mean")


@query(with_sql("SELECT gene_a, gene_b, value FROM gram", "gram"))
def gramian(spark, sf_dir):
    return pca.gramian(D.customer_brands(spark, sf_dir).expr)


@query(with_sql("SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round((coalesce(g.value, 0) - a.n * a.mean * b.mean) / (a.n - 1), 5) AS value FROM brand_means a JOIN brand_means b ON a.gene_id <= b.gene_id LEFT JOIN gram g ON g.gene_a = a.gene_id AND g.gene_b = b.gene_id", "brand_means", "gram"))
def covariance_matrix(spark, sf_dir):
    m = D.customer_brands(spark, sf_dir)
    return rounded(pca.covariance(m.expr, m.genes, m.cells.agg(F.count("*"))), "value", digits=5)


def _components(spark, sf_dir, k=10):
    m = D.customer_brands(spark, sf_dir)
    rows = saved(_packed_cells(m, m.expr), "packed")
    return rows, pca.fit(rows, m.genes, k)


def _score_invariants(spark, scores: DataFrame, c: pca.Components) -> DataFrame:
    """(pc, is_eigenvalue, is_centred, is_uncorrelated) of scores, from sums of products of their components: k x k numbers."""
    k = len(c.eigenvalues)
    pairs = F.flatten(F.transform("pc", lambda x, i: F.transform("pc", lambda y, j: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("xy"), x.alias("x")))))
    sums = scores.select(F.inline(pairs)).groupBy("i", "j").agg(F.sum("xy").alias("xy"), F.avg("x").alias("mean"), F.count("*").alias("n")).collect()
    product, mean, n = np.zeros((k, k)), np.zeros(k), max(r.n for r in sums)
    for r in sums:
        product[r.i, r.j], mean[r.i] = r.xy, r.mean
    covariance = product / (n - 1)
    least = 1e-6 * c.eigenvalues[0]
    alone = np.abs(covariance - np.diag(np.diag(covariance))).max(axis=1) <= least
    rows = [(j, bool(abs(covariance[j, j] - c.eigenvalues[j]) <= least), bool(abs(mean[j]) <= 1e-6), bool(alone[j])) for j in range(k)]
    return spark.createDataFrame(rows, "pc int, is_eigenvalue boolean, is_centred boolean, is_uncorrelated boolean")


@query()
def pca_scores(spark, sf_dir):
    rows, c = _components(spark, sf_dir)
    return pca.project(rows, c)


@query("SELECT CAST(k AS INTEGER) AS pc, TRUE AS is_eigenvalue, TRUE AS is_centred, TRUE AS is_uncorrelated FROM range(10) t(k)")
def pca_score_invariants(spark, sf_dir):
    """What must hold of scores whatever the signs: their covariance is the diagonal of the eigenvalues, their means are 0."""
    rows, c = _components(spark, sf_dir)
    return _score_invariants(spark, pca.project(rows, c), c)


@query(with_sql("SELECT round(sum(CASE WHEN gene_a = gene_b THEN cov ELSE 0 END), 4) AS trace, round(sqrt(sum(CASE WHEN gene_a = gene_b THEN 1 ELSE 2 END * cov * cov)), 4) AS frobenius FROM (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, (coalesce(g.value, 0) - a.n * a.mean * b.mean) / (a.n - 1) AS cov FROM brand_means a JOIN brand_means b ON a.gene_id <= b.gene_id LEFT JOIN gram g ON g.gene_a = a.gene_id AND g.gene_b = b.gene_id)", "brand_means", "gram"))
def pca_spectrum(spark, sf_dir):
    """Sums of all eigenvalues and of their squares, against the covariance's trace and Frobenius norm."""
    _, c = _components(spark, sf_dir, 25)
    return spark.createDataFrame([(round(float(c.eigenvalues.sum()), 4), round(float(np.sqrt((c.eigenvalues**2).sum())), 4))], "trace double, frobenius double")


@query(with_sql("SELECT round(sum((coalesce(g.value, 0) - a.n * a.mean * a.mean) / (a.n - 1)), 4) AS total_variance FROM brand_means a LEFT JOIN gram g ON g.gene_a = a.gene_id AND g.gene_b = a.gene_id", "brand_means", "gram"))
def pca_total_variance(spark, sf_dir):
    """The sum of all eigenvalues, which is the trace of the covariance."""
    _, c = _components(spark, sf_dir, 25)
    return spark.createDataFrame([(round(float(c.eigenvalues.sum()), 4),)], "total_variance double")


@query()
def pca_explained(spark, sf_dir):
    _, c = _components(spark, sf_dir)
    return spark.createDataFrame(pca.explained(c), "pc int, eigenvalue double, share_of_kept double, share_of_all double")


# ---- clustering


def chain_sql(k: int, steps: int, name: str = "") -> str:
    """Lloyd's iteration from the k lowest ids, unrolled: tables a<i> (labels), c<i> (centroids)."""
    n = name
    parts = [f"{n}c0 AS (SELECT dense_rank() OVER (ORDER BY cell_id) - 1 AS cluster, dim, x AS c FROM points WHERE cell_id IN (SELECT DISTINCT cell_id FROM points ORDER BY 1 LIMIT {k}))"]
    for i in range(1, steps + 1):
        parts.append(f"{n}d{i} AS (SELECT cell_id, c.cluster, sum((x - c) * (x - c)) AS distance FROM points p JOIN {n}c{i - 1} c USING (dim) GROUP BY 1, 2)")
        parts.append(f"{n}a{i} AS (SELECT cell_id, cluster, distance FROM {n}d{i} QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY distance, cluster) = 1)")
        parts.append(f"{n}c{i} AS (SELECT o.cluster, o.dim, coalesce(m.c, o.c) AS c FROM {n}c{i - 1} o LEFT JOIN (SELECT a.cluster, p.dim, avg(p.x) AS c FROM {n}a{i} a JOIN points p USING (cell_id) GROUP BY 1, 2) m ON m.cluster = o.cluster AND m.dim = o.dim)")
    return ",\n" + ",\n".join(parts) + "\n"


def _points_sql(k: int, steps: int, body: str) -> str:
    return f"WITH points AS ({SQL['points']})" + chain_sql(k, steps) + body


def _table(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(c, d, float(x)) for c, row in enumerate(centroids) for d, x in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, dim int, x double")


CENTROIDS = "SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, round(c, 6) AS x FROM c{i}"


@query(_points_sql(5, 1, "SELECT cell_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM a1"))
def kmeans_assign(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(kmeans.assign(rows, kmeans.lowest_ids(rows, 5)), "distance")


@query(_points_sql(5, 1, "SELECT CAST(a.cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, round(sum(x), 6) AS total, count(*) AS n FROM a1 a JOIN points p USING (cell_id) GROUP BY 1, 2"))
def cluster_sums(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(kmeans.cluster_sums(rows.drop("cluster"), kmeans.assign(rows, kmeans.lowest_ids(rows, 5))), "total")


@query(with_sql("SELECT cell_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM (SELECT x.cell_id, n.cluster, greatest(x.xn - 2 * coalesce(d.dot, 0) + n.cn, 0) AS distance FROM (SELECT cell_id, sum(value * value) AS xn FROM expr GROUP BY 1) x CROSS JOIN (SELECT cluster, sum(c * c) AS cn FROM part_centres GROUP BY 1) n LEFT JOIN (SELECT cell_id, cluster, sum(value * c) AS dot FROM expr JOIN part_centres USING (gene_id) GROUP BY 1, 2) d ON d.cell_id = x.cell_id AND d.cluster = n.cluster) QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY distance, cluster) = 1", "expr", "part_centres"))
def sparse_kmeans_assign(spark, sf_dir):
    expr = _written(spark, sf_dir).expr
    return rounded(kmeans.sparse_assign(expr, _first_cells(expr, 5)), "distance")


@query(with_sql("SELECT cluster, gene_id, sum(value) AS total FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2", "expr", "cells"))
def sparse_cluster_sums(spark, sf_dir):
    m = D.customer_parts(spark, sf_dir)
    return kmeans.sparse_cluster_sums(m.expr, m.cells)


@query(with_sql("SELECT cell_id, sum(value * value) AS norm FROM expr GROUP BY 1", "expr"))
def squared_norms(spark, sf_dir):
    return kmeans.squared_norms(D.customer_parts(spark, sf_dir).expr)


@query(_points_sql(5, 1, CENTROIDS.format(i=1)))
def lloyd_step(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(_table(spark, kmeans.lloyd(rows, {0: kmeans.lowest_ids(rows, 5)}, 1, 0)[0].centroids), "x")


@query(_points_sql(5, 3, CENTROIDS.format(i=3)))
def lloyd_3_iters(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(_table(spark, kmeans.lloyd(rows, {0: kmeans.lowest_ids(rows, 5)}, 3, 0)[0].centroids), "x")


MULTI = (2, 4, 6, 8, 10)


@query(
    f"WITH points AS ({SQL['points']})"
    + "".join(chain_sql(k, 2, f"k{k}_").rstrip() for k in MULTI)
    + " "
    + " UNION ALL ".join(f"SELECT {k} AS k, round(sum(distance), 6) AS wcss, round(sum(distance) / count(*), 6) AS wcss_n FROM k{k}_a2" for k in MULTI)
)
def multi_k_wcss(spark, sf_dir):
    """Two Lloyd steps for several K at once, in the same passes; WCSS is that of the centroids before the last update."""
    rows = D.vectors(spark, sf_dir)
    seeds = kmeans.lowest_ids(rows, max(MULTI))
    fits = kmeans.lloyd(rows, {k: seeds[:k] for k in MULTI}, 2, 0)
    return spark.createDataFrame([(k, round(f.wcss, 6), round(f.wcss / f.n, 6)) for k, f in fits.items()], "k int, wcss double, wcss_n double")


@query(
    f"WITH points AS ({SQL['points']})" + chain_sql(4, 0).rstrip()
    + ", b1 AS (SELECT * FROM points WHERE cell_id % 2 = 0), m1 AS (SELECT a.cluster, p.dim, count(*) AS n, avg(x) AS m FROM (SELECT cell_id, c.cluster, sum((x - c) * (x - c)) AS distance FROM b1 JOIN c0 c USING (dim) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY sum((x - c) * (x - c)), c.cluster) = 1) a JOIN b1 p USING (cell_id) GROUP BY 1, 2),"
    " e1 AS (SELECT o.cluster, o.dim, coalesce(m.n, 0) AS v, o.c + coalesce(m.m - o.c, 0) AS c FROM c0 o LEFT JOIN m1 m ON m.cluster = o.cluster AND m.dim = o.dim),"
    " b2 AS (SELECT * FROM points WHERE cell_id % 2 = 1), m2 AS (SELECT a.cluster, p.dim, count(*) AS n, avg(x) AS m FROM (SELECT cell_id, c.cluster, sum((x - c) * (x - c)) AS distance FROM b2 JOIN e1 c USING (dim) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY sum((x - c) * (x - c)), c.cluster) = 1) a JOIN b2 p USING (cell_id) GROUP BY 1, 2)"
    " SELECT CAST(o.cluster AS INTEGER) AS cluster, CAST(o.dim AS INTEGER) AS dim, round(o.c + coalesce(m.n / (o.v + m.n) * (m.m - o.c), 0), 6) AS x FROM e1 o LEFT JOIN m2 m ON m.cluster = o.cluster AND m.dim = o.dim"
)
def minibatch_step(spark, sf_dir):
    """Two mini-batches: even ids, then odd ids."""
    rows = D.vectors(spark, sf_dir)
    model = kmeans.MiniBatch.start(kmeans.lowest_ids(rows, 4))
    for part in (0, 1):
        total, n, _ = kmeans._pass(rows.filter(F.pmod("cell_id", F.lit(2)) == part), {0: model.centroids})[0]
        model.update(total, n, 0.5)
    return rounded(_table(spark, model.centroids), "x")


@query(_points_sql(4, 1, CENTROIDS.format(i=1)))
def kmeans_streaming(spark, sf_dir):
    """The embeddings as a stream, a micro-batch for each file: after the only one, centroids are the means of their rows."""
    rows = D.vectors(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    fs, path = filesystem(spark, f"{sf_dir}/embeddings.parquet")
    reader = spark.readStream.schema(source)
    # a stream reads folders: the table's own, or that of its one file
    stream = reader.parquet(f"{sf_dir}/embeddings.parquet") if fs.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    stream = stream.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("pc"))
    model = OnlineKMeans(kmeans.lowest_ids(rows, 4))
    model.start(stream, scratch_path(spark, "stream")).awaitTermination()
    return rounded(_table(spark, model.model.centroids), "x")


@query()
def kmeans_gumbel_seeds(spark, sf_dir):
    return _table(spark, kmeans.gumbel_seeds(D.vectors(spark, sf_dir), 4))


@query()
def kmeans_sampled_seeds(spark, sf_dir):
    return _table(spark, kmeans.sampled_plus_plus(D.vectors(spark, sf_dir), 4))


@query("SELECT unnest(['gumbel', 'sampled']) AS seeds, 4 AS n, CAST(4 AS BIGINT) AS n_rows")
def kmeans_seed_invariants(spark, sf_dir):
    """What must hold of seeds: different rows of the table."""
    rows = D.vectors(spark, sf_dir).select("cell_id", "pc").persist()
    found = []
    for name, seeds in (("gumbel", kmeans.gumbel_seeds(rows, 4)), ("sampled", kmeans.sampled_plus_plus(rows, 4))):
        chosen = spark.createDataFrame([([float(x) for x in s],) for s in seeds], "pc array<double>").distinct()
        n_rows = rows.select("pc").distinct().join(F.broadcast(chosen), "pc", "left_semi").count()  # k rows
        found.append((name, len(seeds), n_rows))
    rows.unpersist()
    return spark.createDataFrame(found, "seeds string, n int, n_rows long")


@query()
def kmeans_minibatch_fit(spark, sf_dir):
    """The defaults of batch, steps and tolerance; a batch larger than the table is all of it."""
    return _table(spark, kmeans.fit_minibatch(D.vectors(spark, sf_dir), 4, max_iter=100)[0])


# The K of the sweep.
SWEEP = tuple(range(2, 31, 2))


def _swept(spark, sf_dir, n_init: int = kmeans.N_INIT) -> tuple[DataFrame, dict[int, kmeans.Fit]]:
    rows = D.vectors(spark, sf_dir).select("cell_id", "pc")
    return rows, kmeans.sweep(rows, list(SWEEP), n_init)


@query()
def kmeans_sweep(spark, sf_dir):
    """K, WCSS, silhouette and iterations of the best of N_INIT runs for each K of SWEEP."""
    rows, fits = _swept(spark, sf_dir)
    silhouettes = metrics.mean_silhouettes(rows, {k: f.centroids for k, f in fits.items()})
    table = [(k, f.wcss, f.wcss / f.n, silhouettes[k], f.n_iters) for k, f in fits.items()]
    return spark.createDataFrame(table, "k int, wcss double, wcss_n double, silhouette double, n_iters int")


@query("SELECT k, (SELECT count(*) FROM embeddings) AS n, TRUE AS is_settled, TRUE AS is_no_worse FROM (VALUES " + ", ".join(f"({k})" for k in SWEEP) + ") t(k)")
def kmeans_sweep_invariants(spark, sf_dir):
    """What must hold of each fit: labels for all rows, WCSS of its centroids no more than the recorded one, and not above one cluster's."""
    rows, fits = _swept(spark, sf_dir, 1)
    found = kmeans._pass(rows, {k: f.centroids for k, f in fits.items()})
    one = kmeans.lloyd(rows, {1: kmeans.lowest_ids(rows, 1)}, 2, 0)[1].wcss
    table = [(k, int(found[k][1].sum()), found[k][2] <= f.wcss * (1 + 1e-9), f.wcss <= one * (1 + 1e-9)) for k, f in fits.items()]
    return spark.createDataFrame(table, "k int, n long, is_settled boolean, is_no_worse boolean")


@query()
def kmeans_minibatch_sweep(spark, sf_dir):
    fits = kmeans.minibatch_sweep(D.vectors(spark, sf_dir), [1, 2, 4], max_iter=20)
    return spark.createDataFrame([(k, f.wcss, f.n_iters) for k, f in fits.items()], "k int, wcss double, n_iters int")


@query()
def uniform_sample(spark, sf_dir):
    return kmeans.uniform_sample(D.vectors(spark, sf_dir), 200).select("cell_id", "cluster")


@query("SELECT CAST(least(200, count(*)) AS BIGINT) AS n, CAST(least(200, count(*)) AS BIGINT) AS n_different, TRUE AS is_least FROM embeddings")
def uniform_sample_invariants(spark, sf_dir):
    """What must hold of the sample: rows of the table, without repeats, those of least hash."""
    rows = D.vectors(spark, sf_dir).select("cell_id", F.xxhash64(F.lit(kmeans.SEED), "cell_id").alias("hash"))
    drawn = kmeans.uniform_sample(D.vectors(spark, sf_dir), 200).select("cell_id")
    inside = rows.join(drawn, "cell_id").agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("n_different"), F.max("hash").alias("most"))
    outside = rows.join(drawn, "cell_id", "left_anti").agg(F.min("hash").alias("least"))
    return inside.crossJoin(F.broadcast(outside)).select("n", "n_different", F.coalesce(F.col("most") <= F.col("least"), F.lit(True)).alias("is_least"))


# ---- cluster metrics


@query(_points_sql(5, 1, "SELECT round(sum(distance), 6) AS wcss, round(sum(distance) / count(*), 6) AS wcss_n FROM a1"))
def wcss(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(metrics.wcss(kmeans.assign(rows, kmeans.lowest_ids(rows, 5))), "wcss", "wcss_n")


@query("SELECT c_mktsegment AS cluster, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return rounded(metrics.cluster_sizes(D.customer_parts(spark, sf_dir).cells), "pct")


@query(with_sql("SELECT cell_id, cluster, round(CASE WHEN b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM (SELECT cell_id, cluster, max(m) FILTER (other = cluster) AS a, min(m) FILTER (other <> cluster) AS b FROM (SELECT p.cell_id, p.cluster, o.cluster AS other, CASE WHEN o.cluster = p.cluster THEN CASE WHEN any_value(z.n) > 1 THEN sum(t) / (any_value(z.n) - 1) ELSE 0 END ELSE sum(t) / any_value(z.n) END AS m FROM (SELECT a.cell_id, a.cluster, b.cell_id AS b_id, sum((a.x - b.x) * (a.x - b.x)) AS t FROM points a JOIN points b USING (dim) GROUP BY 1, 2, 3) p JOIN (SELECT DISTINCT cell_id, cluster FROM points) o ON o.cell_id = p.b_id JOIN (SELECT cluster, count(DISTINCT cell_id) AS n FROM points GROUP BY 1) z ON z.cluster = o.cluster GROUP BY 1, 2, 3) GROUP BY 1, 2)", "points"))
def silhouette_sq(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    return rounded(metrics.silhouettes_squared(rows.drop("cluster"), rows), "s")


@query(with_sql("SELECT cell_id, cluster, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM (SELECT cell_id, cluster, max(m) FILTER (other = cluster) AS a, min(m) FILTER (other <> cluster) AS b FROM (SELECT cell_id, cluster, other, avg(sqrt(t)) AS m FROM (SELECT a.cell_id, a.cluster, b.cell_id AS b_id, b.cluster AS other, sum((a.x - b.x) * (a.x - b.x)) AS t FROM points a JOIN points b USING (dim) WHERE a.cell_id < 200 AND b.cell_id < 200 AND a.cell_id <> b.cell_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2)", "points"))
def silhouette_euclid_sample(spark, sf_dir):
    """A fixed small case of silhouette_euclid that SQL can check: ids below 200 alone."""
    rows = D.vectors(spark, sf_dir).filter("cell_id < 200")
    return rounded(metrics.silhouettes_euclidean(rows.drop("cluster"), rows), "s")


@query()
def silhouette_euclid(spark, sf_dir):
    """The Euclidean silhouette of the reference: pairs of a uniform sample of SILHOUETTE_ROWS rows (all, if fewer)."""
    rows = kmeans.uniform_sample(D.vectors(spark, sf_dir), metrics.SILHOUETTE_ROWS)
    return rounded(metrics.silhouettes_euclidean(rows.drop("cluster"), rows), "s")


SLOPE = "CASE WHEN lag({c}) OVER (ORDER BY k) IS NULL THEN lead({c}) OVER (ORDER BY k) - {c} WHEN lead({c}) OVER (ORDER BY k) IS NULL THEN {c} - lag({c}) OVER (ORDER BY k) ELSE (lead({c}) OVER (ORDER BY k) - lag({c}) OVER (ORDER BY k)) / 2 END"
CURVE_SQL = f"WITH points AS ({SQL['points']})" + "".join(chain_sql(k, 2, f"k{k}_").rstrip() for k in MULTI) + ", curve AS (" + " UNION ALL ".join(f"SELECT {k} AS k, round(sum(distance) / count(*), 6) AS wcss FROM k{k}_a2" for k in MULTI) + ")\n"


def _curve(spark, sf_dir) -> DataFrame:
    """(k, wcss): WCSS/n over K of the embeddings."""
    return multi_k_wcss(spark, sf_dir).select("k", F.col("wcss_n").alias("wcss"))


@query(CURVE_SQL + f"SELECT k, wcss, round({SLOPE.format(c='d')}, 5) AS bend FROM (SELECT k, wcss, {SLOPE.format(c='wcss')} AS d FROM curve)")
def second_differences(spark, sf_dir):
    return rounded(metrics.second_differences(_curve(spark, sf_dir)), "bend", digits=5)


@query(CURVE_SQL + f"SELECT k FROM (SELECT k, {SLOPE.format(c='d')} AS bend FROM (SELECT k, {SLOPE.format(c='wcss')} AS d FROM curve)) ORDER BY bend DESC, k LIMIT 1")
def elbow(spark, sf_dir):
    return metrics.elbow(_curve(spark, sf_dir))


SILHOUETTES_SQL = (
    f"WITH points AS ({SQL['points']})" + "".join(chain_sql(k, 1, f"k{k}_").rstrip() for k in MULTI)
    + ", apart AS (SELECT a.cell_id AS i, b.cell_id AS j, sum((a.x - b.x) * (a.x - b.x)) AS t FROM points a JOIN points b USING (dim) GROUP BY 1, 2), labelled AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, cell_id, cluster FROM k{k}_a1" for k in MULTI)
    + "), sizes AS (SELECT k, cluster, count(*) AS n FROM labelled GROUP BY 1, 2), sums AS (SELECT x.k, x.cell_id, x.cluster, y.cluster AS other, sum(t) AS t FROM apart JOIN labelled x ON x.cell_id = i JOIN labelled y ON y.cell_id = j AND y.k = x.k GROUP BY 1, 2, 3, 4),"
    " means AS (SELECT k, cell_id, s.cluster = other AS own, CASE WHEN s.cluster <> other THEN t / n WHEN n > 1 THEN t / (n - 1) ELSE 0 END AS m FROM sums s JOIN sizes USING (k) WHERE sizes.cluster = other),"
    " nearest AS (SELECT k, cell_id, max(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM means GROUP BY 1, 2),"
    " curve AS (SELECT k, round(avg(CASE WHEN b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM nearest GROUP BY 1)\n"
)


def _silhouettes(spark, sf_dir) -> DataFrame:
    """(k, silhouette): the mean squared silhouette over K of the embeddings, by the nearest of the first k rows."""
    rows = D.vectors(spark, sf_dir).drop("cluster")
    out = None
    for k in MULTI:
        each = metrics.silhouettes_squared(rows, kmeans.assign(rows, kmeans.lowest_ids(rows, k))).agg(F.avg("s").alias("silhouette")).select(F.lit(k).alias("k"), "silhouette")
        out = each if out is None else out.unionByName(each)
    return rounded(out, "silhouette")


@query(SILHOUETTES_SQL + "SELECT k, silhouette FROM curve")
def silhouette_curve(spark, sf_dir):
    return _silhouettes(spark, sf_dir)


@query(SILHOUETTES_SQL + "SELECT k FROM curve ORDER BY silhouette DESC, k LIMIT 1")
def best_silhouette_k(spark, sf_dir):
    return metrics.best_silhouette(_silhouettes(spark, sf_dir))


@query("SELECT bin_x, bin_y, cluster, n FROM (SELECT CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.05) AS BIGINT) AS bin_x, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.05) AS BIGINT) AS bin_y, label AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY bin_x, bin_y ORDER BY n DESC, cluster) = 1")
def cluster_mode_bins(spark, sf_dir):
    points = D.vectors(spark, sf_dir).select(F.element_at("pc", 1).alias("x"), F.element_at("pc", 2).alias("y"), "cluster")
    return metrics.majority_bins(points, 0.05)


HEX_WIDTH = 0.05
HEX_SQL = (
    f"WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) / {HEX_WIDTH} AS u, CAST(embedding[2] AS DOUBLE) / ({HEX_WIDTH} * sqrt(3)) AS v, label AS cluster FROM embeddings),"
    " near AS (SELECT *, floor(u + 0.5) AS a, floor(v + 0.5) AS b, floor(u) + 0.5 AS c, floor(v) + 0.5 AS d FROM p),"
    " bins AS (SELECT CASE WHEN (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - c) * (u - c) + 3 * (v - d) * (v - d) THEN a ELSE c END AS bin_x, CASE WHEN (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - c) * (u - c) + 3 * (v - d) * (v - d) THEN b ELSE d END AS bin_y, cluster FROM near)"
    " SELECT bin_x, bin_y, cluster, count(*) AS n FROM bins GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY bin_x, bin_y ORDER BY count(*) DESC, cluster) = 1"
)


@query(HEX_SQL)
def cluster_mode_hexagons(spark, sf_dir):
    points = D.vectors(spark, sf_dir).select(F.element_at("pc", 1).alias("x"), F.element_at("pc", 2).alias("y"), "cluster")
    return metrics.majority_hexagons(points, HEX_WIDTH)


@query("SELECT round(((((0.8 * 0.7 + 0.4 * 0.3) * 0.7) + 0.2 * 0.3) * 0.7) + 0.1 * 0.3, 9)::DOUBLE AS average")
def moving_average(spark, sf_dir):
    shifts = spark.createDataFrame([(0, 0.8), (1, 0.4), (2, 0.2), (3, 0.1)], "position int, shift double")
    return rounded(metrics.moving_average(shifts, 0.3), "average", digits=9)


@query(_points_sql(3, 1, "SELECT count(*) AS n, count(*) FILTER (a.cluster IS NULL) AS n_missing FROM (SELECT DISTINCT cell_id FROM points) p LEFT JOIN a1 a USING (cell_id)"))
def labels_match_scores(spark, sf_dir):
    rows = D.vectors(spark, sf_dir)
    joined = rows.select("cell_id").join(kmeans.assign(rows, kmeans.lowest_ids(rows, 3)), "cell_id", "left")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("cluster").isNull()).alias("n_missing"))
