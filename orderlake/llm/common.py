"""Helpers of the operators: durable intermediate tables, stable row numbers, batch slices."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/orderlake"


def durable_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = durable_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table._durable_path)
        _WRITTEN[:] = [w for w in _WRITTEN if w[1] != table._durable_path]


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns what this process has freed to the system; its allocators keep it otherwise, beside what other workers need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows anew where the files of a small table give fewer partitions than there are cores."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # counting would run it
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def fold(column: str = "doc_id", parts: int = 7) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def bounded_sample(df: DataFrame, bound: int, *keys: str, seed: int = 11) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of the keys, so every run picks the same; all rows when there are fewer.

    Rows of equal keys go together: give keys that tell rows apart.
    """
    n = df.count()
    if n <= bound:
        return df
    cut = int(bound / n * 2**31)
    return df.where(F.pmod(F.hash(*[F.col(k).cast("string") for k in keys], F.lit(seed)), F.lit(2**31 - 1)) < cut)


#: Up to so many keys (some 16 bytes each) are broadcast to pick rows without a shuffle of texts; more are joined by one.
BROADCAST_KEYS = 1 << 21


def text_tag(column: str = "text") -> F.Column:
    """A 64-bit hash that tells texts of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def few(keys: DataFrame) -> DataFrame:
    """A durable table of keys, to be broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text are in ``gone`` (doc_id, tag); null ids equal each other.

    The input row is kept in one struct, so its other columns clash with nothing.
    """
    gone = durable(gone.select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_tag().alias("own_tag"))
    return rows.join(few(gone), F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_tag") == F.col("gone_tag")), "left_anti").select("row.*")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``most`` bytes together, or one text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    part = (np.cumsum(size, dtype=np.int64) - size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups, some at a time, of batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            last = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
