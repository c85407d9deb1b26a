"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when Python ends."""
    path = f"{scratch_root(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended; the other folders may be another one's
            continue


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables have been written so far."""
    return len(_made)


def settled(make: Callable[[], DataFrame], name: str, since: int | None = None) -> DataFrame:
    """What ``make`` returns, ``saved``; then the tables go that were written since it began, or since the ``mark`` given."""
    first = len(_made) if since is None else since
    out = saved(make(), name)
    for spark, path in _made[first:-1]:
        remove(spark, path)
    del _made[first:-1]
    return out
