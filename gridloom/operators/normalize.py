"""Size factors by pooling and deconvolution within blocks of a cluster, and log normalisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.scratch import saved

# Block size, pool widths, least mean of a gene, least cells of a block, floor of a factor.
MAX_BLOCK = 3000
WIDTHS = tuple(range(21, 102, 5))
MIN_MEAN = 0.1
MIN_CELLS = 50
FLOOR = 1e-8
#: Numbers of a block that are made dense at a time.
POOL_CELLS = 4 << 20


def blocks(cells: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(cell_id, cluster, block): each cluster's cells in order of id, cut every ``max_block``.

    The position comes from counts of ranges of ids, so no cluster, however large, is ordered in one task.
    """
    ranges = cells.select("cell_id", "cluster").withColumn("range", F.floor(F.col("cell_id") / max_block))
    sizes = ranges.groupBy("cluster", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cluster").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("cluster", "range", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("cluster", "range").orderBy("cell_id")) - 1
    return ranges.withColumn("inner", inner).join(starts, ["cluster", "range"]).select("cell_id", "cluster", F.floor((F.col("start") + F.col("inner")) / max_block).cast("int").alias("block"))


def library_sizes(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("value").alias("lib"))


def library_factors(expr: DataFrame, blocked: DataFrame) -> DataFrame:
    """(cell_id, cluster, block, theta): library size over the block's mean; cells without entries have size 0 and the floor."""
    sized = blocked.join(library_sizes(expr), "cell_id", "left").withColumn("lib", F.coalesce("lib", F.lit(0.0)))
    mean = sized.groupBy("cluster", "block").agg(F.avg("lib").alias("mean"))
    theta = F.greatest(F.when(F.col("mean") > 0, F.col("lib") / F.col("mean")).otherwise(1.0), F.lit(FLOOR))
    return sized.join(mean, ["cluster", "block"]).select("cell_id", "cluster", "block", theta.alias("theta"))


def solve_pools(ratios: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Least squares of all pool equations: row k of ``ratios`` has the pools of ``widths[k]`` cells from each start.

    The normal matrix is a sum of circulant ones, so discrete Fourier transforms diagonalise it.
    """
    n = ratios.shape[1]
    top, below = np.zeros(n, complex), np.zeros(n)
    for row, width in zip(ratios, widths, strict=True):
        window = np.zeros(n)
        window[:width] = 1
        spectrum = np.conj(np.fft.fft(window))  # pool s holds cells s, s + 1, ...
        top += np.conj(spectrum) * np.fft.fft(row)
        below += np.abs(spectrum) ** 2
    return np.fft.ifft(top / below).real


@dataclass(frozen=True)
class _Block:
    """Stored entries of a block, cells in order: row ``k`` has the entries ``start[k]:start[k + 1]``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n_genes: int

    def library(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), self.value, len(self.start) - 1)

    def dense(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), self.n_genes))
        count = self.start[cells + 1] - self.start[cells]
        row = np.repeat(np.arange(len(cells)), count)
        at = np.arange(len(row)) + np.repeat(self.start[cells] - np.cumsum(count) + count, count)
        np.add.at(out, (row, self.column[at]), self.value[at])
        return out


def _block(row: np.ndarray, column: np.ndarray, value: np.ndarray, n_cells: int, n_genes: int) -> _Block:
    order = np.argsort(row, kind="stable")
    return _Block(np.searchsorted(row[order], np.arange(n_cells + 1)), column[order], value[order].astype(np.float64), n_genes)


def _over_reference(block: _Block, lib: np.ndarray, min_mean: float) -> _Block:
    """The block's cells in order of the ring, values over t and over the reference, of the genes that reach ``min_mean`` alone."""
    t = lib / lib.mean()
    row = np.repeat(np.arange(len(lib)), np.diff(block.start))
    z = block.value / t[row]
    ref = np.bincount(block.column, z, block.n_genes) / len(lib)
    used = ref >= min_mean
    number = np.cumsum(used) - 1
    place = np.empty(len(lib), np.int64)
    place[np.argsort(lib, kind="stable")] = np.arange(len(lib))
    keep = used[block.column]
    column = block.column[keep]
    return _block(place[row[keep]], number[column], z[keep] / ref[column], len(lib), int(used.sum()))


def pool_ratios(block: _Block, widths: tuple[int, ...]) -> np.ndarray:
    """widths x starts: the median over genes of each circular pool's sum; ``block`` is ``_over_reference``.

    Some starts are made dense at a time, so memory follows POOL_CELLS, not the block.
    """
    n = len(block.start) - 1
    out = np.empty((len(widths), n))
    step = max(1, POOL_CELLS // max(1, block.n_genes) - max(widths))
    for a in range(0, n, step):
        some = min(step, n - a)
        total = np.zeros((some + max(widths), block.n_genes))
        np.cumsum(block.dense((a + np.arange(some + max(widths) - 1)) % n), axis=0, out=total[1:])
        for k, w in enumerate(widths):
            out[k, a : a + some] = np.median(total[w : w + some] - total[:some], axis=1)
    return out


def deconvolve(counts: np.ndarray, widths: tuple[int, ...] = WIDTHS, min_mean: float = MIN_MEAN) -> np.ndarray:
    """Size factors, mean 1, of one block (cells x genes).

    Falls back to library sizes where no gene is expressed enough or a cell has no counts.
    """
    row, column = np.nonzero(counts)
    return _deconvolve(_block(row, column, counts[row, column], *counts.shape), widths, min_mean)


def _deconvolve(block: _Block, widths: tuple[int, ...], min_mean: float) -> np.ndarray:
    lib = block.library()
    mean = lib.mean() if len(lib) else 0.0
    if not mean > 0:
        return np.ones(len(lib))
    t = lib / mean
    ring = _over_reference(block, lib, min_mean) if (lib > 0).all() else None
    if ring is None or not ring.n_genes:
        return np.maximum(t, FLOOR)
    order = np.argsort(lib, kind="stable")
    own = (1, *(w for w in widths if w <= len(lib)))
    theta = np.empty(len(lib))
    theta[order] = solve_pools(pool_ratios(ring, own), own) * t[order]
    theta = np.maximum(theta, FLOOR)
    return theta / theta.mean()


def deconvolution_factors(expr: DataFrame, blocked: DataFrame, widths: tuple[int, ...] = WIDTHS, min_mean: float = MIN_MEAN, min_cells: int = MIN_CELLS) -> DataFrame:
    """(cell_id, cluster, block, theta) of every cell of ``blocked``; a block, MAX_BLOCK cells at most, is one task's group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, row = np.unique(pdf["cell_id"], return_inverse=True)
        stored = pdf["gene_id"].notna().to_numpy()
        genes, column = np.unique(pdf["gene_id"][stored], return_inverse=True)
        block = _block(row[stored], column, pdf["value"].to_numpy()[stored], len(cells), len(genes))
        if len(cells) < min_cells:
            lib = block.library()
            theta = np.maximum(lib / lib.mean() if lib.sum() > 0 else np.ones(len(cells)), FLOOR)
        else:
            theta = _deconvolve(block, widths, min_mean)
        return pd.DataFrame({"cell_id": cells, "cluster": pdf["cluster"].iloc[0], "block": pdf["block"].iloc[0], "theta": theta})

    entries = blocked.join(expr, "cell_id", "left").select("cell_id", "cluster", "block", "gene_id", "value")
    return entries.groupBy("cluster", "block").applyInPandas(solve, "cell_id long, cluster string, block int, theta double")


def pseudo_cells(expr: DataFrame, factors: DataFrame) -> DataFrame:
    """(cluster, block, gene_id, value): mean over a block's cells of value / theta; absent entries are 0."""
    sizes = factors.groupBy("cluster", "block").agg(F.count("*").alias("n"))
    sums = expr.join(factors, "cell_id").groupBy("cluster", "block", "gene_id").agg(F.sum(F.col("value") / F.greatest("theta", F.lit(FLOOR))).alias("s"))
    return sums.join(sizes, ["cluster", "block"]).select("cluster", "block", "gene_id", (F.col("s") / F.col("n")).alias("value"))


def block_scales(expr: DataFrame, factors: DataFrame) -> DataFrame:
    """(cluster, block, scale): the median over genes of each block's pseudo-cell over that of the largest block.

    Of equally large blocks the first in order of the cluster's name, then the block, is the reference.
    ``factors`` is read several times: give a written table.
    """
    pseudo = saved(pseudo_cells(expr, factors), "pseudo")
    sizes = factors.groupBy("cluster", "block").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "cluster", "block").limit(1).select("cluster", "block")
    ref = pseudo.join(F.broadcast(largest), ["cluster", "block"]).select("gene_id", F.col("value").alias("ref"))
    ratios = pseudo.join(ref, "gene_id").filter("value > 0 and ref > 0")
    medians = ratios.groupBy("cluster", "block").agg(F.median(F.col("value") / F.col("ref")).alias("scale"))
    return sizes.select("cluster", "block").join(medians, ["cluster", "block"], "left").select("cluster", "block", F.coalesce("scale", F.lit(1.0)).alias("scale"))


def size_factors(factors: DataFrame, scales: DataFrame) -> DataFrame:
    """(cell_id, size_factor): thetas times their block's scale, mean 1 over all cells."""
    scaled = factors.join(scales, ["cluster", "block"]).select("cell_id", (F.col("theta") * F.col("scale")).alias("s"))
    return scaled.crossJoin(F.broadcast(scaled.agg(F.avg("s").alias("m")))).select("cell_id", (F.col("s") / F.col("m")).alias("size_factor"))


def log_normalize(expr: DataFrame, factors: DataFrame) -> DataFrame:
    """Entries with log1p(value / size_factor)."""
    return expr.join(factors, "cell_id").select("cell_id", "gene_id", F.log1p(F.col("value") / F.col("size_factor")).alias("value"))


def pool_table(expr: DataFrame, blocked: DataFrame, widths: tuple[int, ...], min_mean: float = MIN_MEAN) -> DataFrame:
    """(cluster, block, start, width, ratio): the pool medians themselves, for inspection; ties of library size go by cell_id."""

    def pools(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, row = np.unique(pdf["cell_id"], return_inverse=True)
        genes, column = np.unique(pdf["gene_id"], return_inverse=True)
        block = _block(row, column, pdf["value"].to_numpy(), len(cells), len(genes))
        ring = _over_reference(block, block.library(), min_mean)
        own = tuple(w for w in widths if w <= len(cells))
        if not own or not ring.n_genes:
            return pd.DataFrame({"cluster": [], "block": [], "start": [], "width": [], "ratio": []})
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "block": pdf["block"].iloc[0], "start": np.tile(np.arange(len(cells)), len(own)), "width": np.repeat(own, len(cells)), "ratio": pool_ratios(ring, own).ravel()})

    return blocked.join(expr, "cell_id").groupBy("cluster", "block").applyInPandas(pools, "cluster string, block int, start int, width int, ratio double")
