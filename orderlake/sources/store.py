"""Writes as commits to a log, snapshots, and the byte format of exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import in_prefix


def commit(ops: DataFrame, version: int) -> DataFrame:
    """Log rows of one batch (pos, key, op set or delete, value): the last operation on a key wins; reading another operation fails."""
    won = ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "pos").alias("w"))
    value = F.when(F.col("w.op") == "set", F.col("w.value")).when(F.coalesce(F.col("w.op"), F.lit("")) != "delete", F.raise_error(F.lit("an operation is set or delete")).cast(ops.schema["value"].dataType))
    return won.select("key", F.lit(version).cast("long").alias("version"), value.alias("value"))


def delete_prefix(rows: DataFrame, prefix: str, version: int, below: str | None = None) -> DataFrame:
    """Log rows that delete a prefix, as far as an excluded cut."""
    hit = rows.where(in_prefix(F.col("key"), prefix))
    hit = hit if below is None else hit.where(F.col("key") < below)
    return hit.select("key", F.lit(version).cast("long").alias("version"), F.lit(None).cast("string").alias("value"))


def append_feed(feed: DataFrame, values: DataFrame) -> DataFrame:
    """New entries (pos, value) numbered on from the feed's last sequence number."""
    top = feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top")).first()["top"]
    return numbered(values, "pos").select((F.lit(top) + F.col("nth")).cast("long").alias("seq"), "value")


def numbered(rows: DataFrame, by: str, ranges: int = 128) -> DataFrame:
    """Adds nth, from 1 in the order of the number ``by``: ranks within ranges, after the counts of the ranges before.

    The ranges' bounds come from approximate quantiles; where they lie changes no rank.
    """
    bounds = sorted(set(rows.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.002)))
    part = sum(((F.col(by) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    dealt = rows.withColumn("range", F.coalesce(part, F.lit(-1)))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))  # at most ranges + 1 rows
    before = counts.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(by))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), F.col("range") == F.col("r")).withColumn("nth", F.col("before") + F.col("inside")).drop("range", "r", "before", "inside")


def prune_feed(feed: DataFrame, before: int) -> DataFrame:
    return feed.where(F.col("seq") >= before)


def compare_and_set(state: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each proposal (key, expected, new) against the current value: Applied, or Conflict with it. Null: absent."""
    now = state.select(F.col("key").alias("k"), F.col("value").alias("current"))
    out = proposals.join(now, F.col("key") == F.col("k"), "left")
    ok = F.col("expected").eqNullSafe(F.col("current"))
    return out.select("key", F.when(ok, "Applied").otherwise("Conflict").alias("outcome"), F.when(ok, F.col("new")).otherwise(F.col("current")).alias("value"))


def commit_checked(state: DataFrame, checks: DataFrame) -> DataFrame:
    """Transactions (tx, key, expected) whose every precondition holds: tx, committed, failed (how many don't)."""
    now = state.select(F.col("key").alias("k"), F.col("value").alias("current"))
    out = checks.join(now, F.col("key") == F.col("k"), "left")
    ok = F.col("expected").eqNullSafe(F.col("current"))
    return out.groupBy("tx").agg(F.bool_and(ok).alias("committed"), F.count_if(~ok).alias("failed"))


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """A read-only copy, ranged and sorted by key so that statistics prune reads."""
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def snapshot_pages(rows: DataFrame, page: int) -> DataFrame:
    """page, n, first_key, last_key, digest: pages of ``page`` rows by key, each with a digest of its rows."""
    number = F.row_number().over(Window.partitionBy("shard").orderBy("key")) - 1
    put = rows.select("shard", "key", F.floor(number / page).cast("long").alias("page"), F.sha2(F.concat_ws("\x1f", "key", F.col("value").cast("string")), 256).alias("h"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("key", "h"))), lambda x: x["h"])
    return put.groupBy("shard", "page").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sha2(F.concat_ws("", parts), 256).alias("digest"))


#: Fixed values of the export format.
MAGIC, FORMAT = b"OLKV", 1


def export(rows: DataFrame) -> DataFrame:
    """part, bytes: magic, version and length-prefixed records; parts in order are one stream, sorted by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            body = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<I", len(v)) + v for k, v in zip(b["key"].str.encode("utf-8"), b["value"].str.encode("utf-8")))
            if body:
                yield pd.DataFrame({"first_key": [b["key"].iloc[0]], "body": [body]})

    return rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").mapInPandas(run, "first_key string, body binary")


def export_header() -> bytes:
    return MAGIC + struct.pack("<I", FORMAT)


def read_export(spark: SparkSession, header: bytes, chunks: DataFrame) -> DataFrame:
    """The rows of an export; a wrong header or a torn record fails and nothing is loaded."""
    if header != export_header():
        raise ValueError("not an export of this format")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for body in b["body"]:
                at = 0
                while at < len(body):
                    parts = []
                    for _ in range(2):
                        (n,) = struct.unpack_from("<I", body, at)
                        if at + 4 + n > len(body):
                            raise ValueError("a record is torn")
                        parts.append(body[at + 4 : at + 4 + n].decode("utf-8"))
                        at += 4 + n
                    rows.append(tuple(parts))
            yield pd.DataFrame(rows, columns=["key", "value"])

    return chunks.mapInPandas(run, "key string, value string")


def export_stream(rows: DataFrame) -> DataFrame:
    """chunk, first_key, body: the header as chunk 0, then the records; bodies in order of (chunk, first_key) are one stream."""
    head = rows.sparkSession.createDataFrame([(0, None, bytearray(export_header()))], "chunk int, first_key string, body binary")
    return head.unionByName(export(rows).select(F.lit(1).alias("chunk"), "first_key", "body"))


def read_stream(chunks: DataFrame) -> DataFrame:
    """The rows of an exported stream, whose header is looked at first."""
    heads = chunks.where("chunk = 0").select("body").limit(2).collect()
    if len(heads) != 1:
        raise ValueError("a stream has one header")
    return read_export(chunks.sparkSession, bytes(heads[0]["body"]), chunks.where("chunk > 0"))


def load_stream(table, chunks: DataFrame, version: int, page_rows: int | None = None) -> int:
    """Commits an exported stream to a commit table: all at once, or a version a page of rows; the number of rows.

    All at once, a fault leaves the table as it was; by pages, earlier pages stay.
    """
    if page_rows is not None and page_rows < 1:
        raise ValueError("a page has at least one row")
    ops = lambda rows: rows.select(F.lit(0).alias("pos"), "key", F.lit("set").alias("op"), "value")
    rows = read_stream(chunks)
    if page_rows is None:
        return table.append(ops(rows), version)["rows"]
    parts = chunks.where("chunk > 0").select("first_key").orderBy("first_key").collect()  # a row a chunk
    total = 0
    for first in parts:
        # a chunk's rows are one writer's batch: a page never needs rows of two
        own = read_export(chunks.sparkSession, export_header(), chunks.where((F.col("chunk") > 0) & (F.col("first_key") == first["first_key"])))
        nth = numbered(own.withColumn("at", F.monotonically_increasing_id()), "at").drop("at")
        n = nth.count()
        for low in range(0, n, page_rows):
            page = nth.where((F.col("nth") > low) & (F.col("nth") <= low + page_rows))
            total += table.append(ops(page), version)["rows"]
            version += 1
    return total
