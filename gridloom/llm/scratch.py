"""The shared folder's tables, the driver's small ones, and bounds on what is broadcast or sent to Python at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.sources.scratch import filesystem, mark, remove, saved, scratch_path, scratch_root, settled

__all__ = ["bound_batches", "bound_reads", "filesystem", "join_counted", "local_table", "mark", "near_members", "remove", "saved", "scratch_path", "scratch_root", "settled"]

#: A key of more rows than this, and than a HOT_KEYS-th of all, is hot: so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 100_000
#: Bytes of a batch of rows that goes to a Python worker, or one row.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a scan of Parquet decodes at once.
READ_ROWS = 256
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for this session's Python workers, unless it has a bound of its own.

    Spark's are of 64 MB: an executor holds one for each task, in buffers of up to twice that, and what it frees of these stays with it.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def bound_reads(spark: SparkSession) -> None:
    """READ_ROWS rows at once in this session's scans of Parquet, unless it has a number of its own.

    Spark's are 4096: texts fill arrays of up to twice their size, each grown from smaller ones, and the executor's heap widens for them.
    """
    if spark.conf.get(_READ) == "4096":
        spark.conf.set(_READ, str(READ_ROWS))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's ``rows`` by way of Arrow; as a list they would start Python workers on the executors."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds), T.StructType.fromDDL(schema))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``: a written table of one row a key, which has in ``count`` how many rows of ``left`` have that key.

    The hot keys, HOT_KEYS at most, are broadcast, so that no task gets all rows of one; the rest is joined as Spark likes.
    """
    rows, most = (x or 0 for x in right.agg(F.sum(count), F.max(count)).first())
    bound = max(HOT_ROWS, -(-rows // HOT_KEYS))
    if most <= bound:
        return left.join(right, keys, how)
    is_hot = F.col(count) > bound
    hot = right.filter(is_hot)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(~is_hot), keys, how)
    return cold.unionByName(left.join(F.broadcast(hot), keys))


def _bit(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def near_members(df: DataFrame, key: str, ids: DataFrame, count: int, max_bits: int = 24, others: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (all that are, and few others), without moving ``df``; or all ``others``.

    ``ids`` (one column) is folded into a bitmap of 16 bits an id, 2**max_bits at
    most: so at most 2**max_bits / 64 rows are broadcast, whatever the input.
    A full bitmap lets more rows through; callers join exactly afterwards.
    """
    bits = min(max_bits, max(12, (16 * max(1, count)).bit_length()))
    bit = _bit(F.col(ids.columns[0]), bits)
    bitmap = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("__mask"))
    hit = df.withColumn("__bit", _bit(F.col(key), bits)).join(F.broadcast(bitmap), F.shiftright("__bit", 6) == F.col("__word"), "left" if others else "inner")
    passed = F.expr("coalesce((shiftright(__mask, cast(__bit & 63 as int)) & 1) = 1, false)")
    return hit.filter(~passed if others else passed).drop("__bit", "__word", "__mask")
