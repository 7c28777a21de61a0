"""Feeds as streams: scoped subscriptions, deduplication, ordered application, token buckets, replicas.

State is one small row a key, kept by the state store and so recovered after a
loss; a stream replayed from its checkpoint gives the batch operators' result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.keys import in_prefix
from ..operators.cdc import ingest
from ..operators.cost import refill


def read_feed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, some a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def watch(feed: DataFrame, scope: str | None = None, exact: str | None = None) -> DataFrame:
    """Events of all keys, one key, or a prefix. Nothing is dropped when a reader is slow."""
    if exact is not None:
        return feed.where(F.col("key") == exact)
    return feed if scope is None else feed.where(in_prefix(F.col("key"), scope))


def dedupe(feed: DataFrame, by: str = "event_id", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each event once; with a time column, state is dropped after the watermark."""
    return feed.dropDuplicates([by]) if time is None else feed.withWatermark(time, late).dropDuplicatesWithinWatermark([by])


def windowed_counts(feed: DataFrame, time: str, width: str, late: str = "0 seconds") -> DataFrame:
    return feed.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def apply_ordered(feed: DataFrame) -> DataFrame:
    """stream, pos, seq, status of diffs (stream, pos, seq): Applied, Duplicate, Gap, and Blocked after a gap.

    The order within a trigger is that of pos; state is the next number and whether a gap was met.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, broken = state.get if state.exists else (0, False)
        # rows of one stream in one trigger, whose size the source bounds
        rows = pd.concat(list(batches)).sort_values("pos")
        out = []
        for seq in rows["seq"]:
            if broken:
                out.append("Blocked")
            elif seq > expected:
                out.append("Gap")
                broken = True
            elif seq < expected:
                out.append("Duplicate")
            else:
                out.append("Applied")
                expected += 1
        state.update((expected, broken))
        yield pd.DataFrame({"stream": key[0], "pos": rows["pos"], "seq": rows["seq"], "status": out})

    return feed.select("stream", "pos", "seq").groupBy("stream").applyInPandasWithState(run, "stream long, pos long, seq long, status string", "expected long, broken boolean", "append", GroupStateTimeout.NoTimeout)


def token_buckets(feed: DataFrame, capacity: int, rate: int) -> DataFrame:
    """key, id, at, cost, admitted of requests in order of time (then cost, then id) within a trigger."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, updated = state.get if state.exists else (capacity, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "cost", "id"])
        out = []
        for at, cost in zip(rows["at"], rows["cost"]):
            tokens, updated = refill(tokens, updated, int(at), capacity, rate)
            ok = tokens >= cost
            tokens -= int(cost) if ok else 0
            out.append(bool(ok))
        state.update((int(tokens), int(updated)))
        yield rows.assign(admitted=out)[["key", "id", "at", "cost", "admitted"]]

    return feed.select("key", "id", "at", "cost").groupBy("key").applyInPandasWithState(run, "key long, id long, at long, cost long, admitted boolean", "tokens long, updated long", "append", GroupStateTimeout.NoTimeout)


class Replica:
    """A table that follows a feed of (shard, key, key_version, value), newest version first.

    Each trigger writes a new copy beside the old one and then moves a pointer,
    so readers never see half of it and a repeated trigger changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _copies(self) -> list[str]:
        """Names of the complete copies, oldest first: a copy is renamed into place when all of it is written."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(n for s in files.listStatus(path) if (n := s.getPath().getName()).startswith("copy-")) if files.exists(path) else []

    def current(self) -> str | None:
        return max(self._copies(), default=None)

    def read(self) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        name, now = f"copy-{number:08d}", self.current()
        if now is not None and now >= name:
            return
        old = self.read()
        rows = batch.select("shard", "key", "key_version", "value")
        ingest(rows if old is None else old.unionByName(rows)).write.mode("overwrite").parquet(f"{self.folder}/_{name}")
        jvm = self.spark.sparkContext._jvm
        fresh, target = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}") for n in (f"_{name}", name))
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fresh, target)
        for old_name in self._copies()[:-2]:  # readers of the copy before this one go on
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old_name}"), True)
