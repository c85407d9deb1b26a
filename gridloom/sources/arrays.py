"""NumPy array files as tables, and report sinks."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of dense two-dimensional .npy files: (cell_id, pc array<double>), cell_id the row's position."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                for start in range(0, len(rows), 20_000):
                    part = rows[start : start + 20_000].astype(np.float64)
                    yield pd.DataFrame({"cell_id": np.arange(start, start + len(part)), "pc": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "cell_id long, pc array<double>")


def read_npz_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of an .npz file with arrays named k<K>: (cell_id, k, cluster)."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for key in arrays.files:
                        yield pd.DataFrame({"cell_id": np.arange(len(arrays[key])), "k": np.int32(key.lstrip("k")), "cluster": arrays[key].astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "cell_id long, k int, cluster int")


def write_labels(labels: DataFrame, path: str, mode: str = "error") -> None:
    """(cell_id, k, cluster) as Parquet partitioned by k."""
    labels.write.mode(mode).partitionBy("k").parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "error") -> None:
    scores.write.mode(mode).parquet(path)


def metrics_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A metrics table as JSON lines."""
    rows.write.mode(mode).json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def stage_report(durations: DataFrame) -> str:
    """A text table of (position, stage, seconds) rows and their total."""
    rows = durations.orderBy("position").collect()
    lines = [f"{r.stage:<32}{r.seconds:>12.3f} s" for r in rows]
    return "\n".join([*lines, f"{'total':<32}{sum(r.seconds for r in rows):>12.3f} s"])


def run_config(spark: SparkSession, name: str, **settings: object) -> DataFrame:
    """A one-row table (name, settings map<string,string>) of a run's configuration."""
    return spark.createDataFrame([(name, {k: str(v) for k, v in settings.items()})], "name string, settings map<string,string>")


def guarded(spark: SparkSession, stage: str, load) -> tuple[DataFrame | None, DataFrame]:
    """What ``load()`` gives, and a report row: OK, or FALHA with the reason instead of an exception."""
    schema = "stage string, check string, status string, detail string"
    try:
        got = load()
        if isinstance(got, DataFrame):
            got.schema  # noqa: B018  resolves the path
        return got, spark.createDataFrame([(stage, "load", "OK", "")], schema)
    except Exception as error:
        return None, spark.createDataFrame([(stage, "load", "FALHA", json.dumps(str(error).splitlines()[0][:200]))], schema)
