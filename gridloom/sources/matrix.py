"""Sparse matrices as long tables, and their sources.

A matrix is three tables: ``expr`` (cell_id, gene_id, value) holds the stored
entries, ``cells`` (cell_id, barcode, ...) and ``genes`` (gene_id, gene_name, ...)
the rows and columns.  An entry that isn't stored is 0; keys, not positions, tie them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPR = "cell_id long, gene_id int, value double"
CELLS = "cell_id long, barcode string"
GENES = "gene_id int, gene_name string, gene_ref string"


@dataclass(frozen=True)
class Matrix:
    expr: DataFrame
    cells: DataFrame
    genes: DataFrame


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """The lazy matrix of a folder with expr, cells and genes in Parquet."""
    return Matrix(*(spark.read.parquet(f"{path}/{t}") for t in ("expr", "cells", "genes")))


def write_matrix(matrix: Matrix, path: str, mode: str = "error") -> None:
    for t in ("expr", "cells", "genes"):
        getattr(matrix, t).write.mode(mode).parquet(f"{path}/{t}")


def cell_range(expr: DataFrame, start: int, end: int) -> DataFrame:
    """Entries of cells ``start`` to ``end - 1``; the filter reaches the scan."""
    return expr.filter((F.col("cell_id") >= start) & (F.col("cell_id") < end))


def gather_cells(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries of the given cells."""
    return expr.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")


def select_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """Entries of the given genes."""
    return expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def transpose(entries: DataFrame) -> DataFrame:
    """Rows and columns exchanged: (gene, cell) entries as (cell, gene) entries, or back."""
    return entries.select(F.col("gene_id").cast("long").alias("cell_id"), F.col("cell_id").alias("gene_id"), "value")


def packed(expr: DataFrame) -> DataFrame:
    """(cell_id, idx array<int>, val array<double>), entries in order of gene: one row a cell, for numeric kernels."""
    pairs = F.array_sort(F.collect_list(F.struct("gene_id", "value")))
    return expr.groupBy("cell_id").agg(pairs.alias("e")).select("cell_id", F.col("e.gene_id").alias("idx"), F.col("e.value").alias("val"))


class LayoutError(ValueError):
    """A container's layout is unknown, or more than one group could be meant."""


def probe_layout(groups: Mapping[str, Mapping], strict: bool = False) -> tuple[str, str, str]:
    """(group, path of gene names, path of gene ids) of a compressed-matrix container.

    The newer layout has a group ``matrix`` with ``features``; the older one a group named for its
    genome.  Of several groups the first that holds ``data`` counts, unless ``strict``, which refuses them.
    """
    if "matrix" in groups:
        return "matrix", "features/name", "features/id"
    if strict and len(groups) != 1:
        raise LayoutError(f"one top-level group is expected; there are {len(groups)}")
    for name, group in groups.items():
        if "data" in group:
            return name, "gene_names", "genes"
    raise LayoutError("no group holds data")


def from_compressed(spark: SparkSession, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, barcodes: list, names: list, refs: list, chunk: int = 100_000) -> Matrix:
    """A matrix from cell-compressed arrays in the driver's memory, made in chunks of cells."""
    text = lambda x: x.decode() if isinstance(x, bytes) else str(x)
    indptr = np.asarray(indptr, np.int64)
    expr = None
    for start in range(0, len(indptr) - 1, chunk):
        end = min(start + chunk, len(indptr) - 1)
        span = slice(indptr[start], indptr[end])
        part = pd.DataFrame({"cell_id": np.repeat(np.arange(start, end), np.diff(indptr[start : end + 1])), "gene_id": np.asarray(indices[span], np.int32), "value": np.asarray(data[span], np.float64)})
        made = spark.createDataFrame(part, EXPR)
        expr = made if expr is None else expr.unionByName(made)
    cells = spark.createDataFrame([(i, text(b)) for i, b in enumerate(barcodes)], CELLS)
    genes = spark.createDataFrame([(i, text(n), text(r)) for i, (n, r) in enumerate(zip(names, refs, strict=True))], GENES)
    return Matrix(spark.createDataFrame([], EXPR) if expr is None else expr, cells, genes)


def read_hdf5(spark: SparkSession, path: str, strict: bool = False, cells_per_task: int = 20_000) -> Matrix:
    """The matrix of an HDF5 container on a path that all executors see; each task reads its own range of cells.

    Needs the optional package h5py.
    """
    try:
        import h5py
    except ImportError as error:
        raise RuntimeError("reading HDF5 needs the package h5py") from error
    with h5py.File(path) as file:
        group, names, refs = probe_layout(file, strict)
        barcodes, names, refs = file[group]["barcodes"][:], file[group][names][:], file[group][refs][:]
    ranges = spark.range(0, len(barcodes), cells_per_task, max(1, -(-len(barcodes) // cells_per_task)))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with h5py.File(path) as file:
            source = file[group]
            for batch in batches:
                for start in batch["id"]:
                    ends = source["indptr"][start : start + cells_per_task + 1].astype(np.int64)
                    span = slice(ends[0], ends[-1])
                    yield pd.DataFrame({"cell_id": np.repeat(np.arange(start, start + len(ends) - 1), np.diff(ends)), "gene_id": source["indices"][span].astype(np.int32), "value": source["data"][span].astype(np.float64)})

    dims = from_compressed(spark, np.zeros(1, np.int64), np.zeros(0), np.zeros(0), list(barcodes), list(names), list(refs))
    return Matrix(ranges.mapInPandas(load, EXPR), dims.cells, dims.genes)
