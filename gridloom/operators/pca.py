"""Covariance PCA: dense partial Gram matrices by partition, one eigendecomposition on the driver.

The driver and each worker hold p x p numbers for p selected genes (32 MB for 2000), whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_PCS = 50
#: Cells that a worker makes dense at a time.
CHUNK = 2048
#: Rows of the Gram matrix in one output row.
BAND = 64


@dataclass(frozen=True)
class Components:
    """Selected genes, their means, loadings (genes x components), eigenvalues, and the trace of the covariance."""

    genes: np.ndarray
    means: np.ndarray
    loadings: np.ndarray
    eigenvalues: np.ndarray
    total: float


def column_means(expr: DataFrame, genes: DataFrame, n_cells: DataFrame) -> DataFrame:
    sums = genes.select("gene_id").join(expr.groupBy("gene_id").agg(F.sum("value").alias("s")), "gene_id", "left")
    return sums.crossJoin(F.broadcast(n_cells.toDF("n"))).select("gene_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


def gramian(expr: DataFrame) -> DataFrame:
    """(gene_a, gene_b, value), gene_a <= gene_b: sums of products over cells, by a self-join: for few genes."""
    a, b = expr.select("cell_id", F.col("gene_id").alias("gene_a"), F.col("value").alias("x")), expr.select("cell_id", F.col("gene_id").alias("gene_b"), F.col("value").alias("y"))
    return a.join(b, "cell_id").filter("gene_a <= gene_b").groupBy("gene_a", "gene_b").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def covariance(expr: DataFrame, genes: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(gene_a, gene_b, value) of all ordered pairs a <= b: (sum of products - n mean_a mean_b) / (n - 1)."""
    means = column_means(expr, genes, n_cells)
    pairs = means.select(F.col("gene_id").alias("gene_a"), F.col("mean").alias("ma")).join(means.select(F.col("gene_id").alias("gene_b"), F.col("mean").alias("mb")), F.col("gene_a") <= F.col("gene_b"))
    return pairs.join(gramian(expr), ["gene_a", "gene_b"], "left").crossJoin(F.broadcast(n_cells.toDF("n"))).select("gene_a", "gene_b", ((F.coalesce("value", F.lit(0.0)) - F.col("n") * F.col("ma") * F.col("mb")) / (F.col("n") - 1)).alias("value"))


def _dense(batch: pd.DataFrame, where: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells' ids and dense rows, CHUNK at a time; ``where`` has each gene's column, or -1."""
    for start in range(0, len(batch), CHUNK):
        part = batch.iloc[start : start + CHUNK]
        out = np.zeros((len(part), size))
        lengths = part["idx"].map(len).to_numpy()
        row = np.repeat(np.arange(len(part)), lengths)
        if len(row):
            gene, value = np.concatenate(part["idx"].to_numpy()), np.concatenate(part["val"].to_numpy())
            column = np.where(gene < len(where), where[np.minimum(gene, len(where) - 1)], -1)
            np.add.at(out, (row[column >= 0], column[column >= 0]), value[column >= 0])
        yield part["cell_id"].to_numpy(), out


def _columns(genes: np.ndarray) -> np.ndarray:
    where = np.full(int(genes.max()) + 1, -1, np.int64)
    where[genes] = np.arange(len(genes))
    return where


def fit(rows: DataFrame, genes: DataFrame, k: int = N_PCS, fix_signs: bool = True) -> Components:
    """Components of packed ``rows`` (cell_id, idx, val) over the genes given.

    NaN or infinite input raises.  Fewer than two cells or no genes raise.  With
    ``fix_signs`` the largest loading of each component is positive.
    """
    ids = np.array(sorted(r.gene_id for r in genes.select("gene_id").distinct().collect()), np.int64)
    if not len(ids):
        raise ValueError("no genes are selected")
    where, p = _columns(ids), len(ids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, total, n = np.zeros((p, p)), np.zeros(p), 0
        for batch in batches:
            for _, x in _dense(batch, where, p):
                gram += x.T @ x
                total += x.sum(axis=0)
                n += len(x)
        if n:
            for start in range(0, p, BAND):
                yield pd.DataFrame({"band": [start], "n": [n if start == 0 else 0], "gram": [gram[start : start + BAND].ravel()], "total": [total[start : start + BAND]]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for band, n, gram, total in zip(batch["band"], batch["n"], batch["gram"], batch["total"], strict=True):
                got = sums.setdefault(band, [0, 0.0, 0.0])
                sums[band] = [got[0] + n, got[1] + np.asarray(gram), got[2] + np.asarray(total)]
        for band, (n, gram, total) in sums.items():
            yield pd.DataFrame({"band": [band], "n": [n], "gram": [gram], "total": [total]})

    schema = "band int, n long, gram array<double>, total array<double>"
    bands = rows.select("cell_id", "idx", "val").mapInPandas(partial, schema).repartition("band").mapInPandas(merge, schema).collect()
    gram, total, n = np.zeros((p, p)), np.zeros(p), 0
    for r in bands:
        gram[r.band : r.band + BAND] = np.array(r.gram).reshape(-1, p)
        total[r.band : r.band + BAND] = r.total
        n += r.n
    if n < 2:
        raise ValueError("two cells are needed")
    if not np.isfinite(gram).all():
        raise ValueError("the matrix has NaN or infinite values")
    means = total / n
    scatter = gram - n * np.outer(means, means)
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    if fix_signs:
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Components(ids, means, vectors, values[order] / (n - 1), float(np.trace(scatter)) / (n - 1))


def project(rows: DataFrame, components: Components) -> DataFrame:
    """(cell_id, pc array<double>): centred scores of packed ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(components)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Components = shared.value
        where, offset = _columns(c.genes), c.means @ c.loadings
        for batch in batches:
            for ids, x in _dense(batch, where, len(c.genes)):
                yield pd.DataFrame({"cell_id": ids, "pc": list(x @ c.loadings - offset)})

    return rows.select("cell_id", "idx", "val").mapInPandas(run, "cell_id long, pc array<double>")


def reordered(scores: DataFrame, variances: np.ndarray) -> DataFrame:
    """Scores with components in descending order of their empirical ``variances``; equal ones keep their order."""
    order = np.argsort(-np.asarray(variances), kind="stable")
    return scores.select("cell_id", F.array(*[F.element_at("pc", int(i) + 1) for i in order]).alias("pc"))


def explained(components: Components) -> list[tuple[int, float, float, float]]:
    """(pc, eigenvalue, share of the kept components' variance, share of all variance), in order of eigenvalue."""
    kept = float(components.eigenvalues.sum())
    return [(k, float(v), float(v) / kept, float(v) / components.total) for k, v in enumerate(components.eigenvalues)]


def variance_shares(scores: DataFrame) -> DataFrame:
    """(pc, variance, share): population variance of each component and its share of all kept components'."""
    long = scores.select(F.posexplode("pc").alias("pc", "x")).groupBy("pc").agg(F.var_pop("x").alias("variance"))
    return long.crossJoin(F.broadcast(long.agg(F.sum("variance").alias("all")))).select("pc", "variance", (F.col("variance") / F.col("all")).alias("share"))
