"""Ordered scans over (key, value) rows: points, ranges, prefixes, pages.

Bounds become plain comparisons, which reach the Parquet scan; limits with an
order become a top-k, never a global sort.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import in_prefix

#: Keys of a multi-get up to this number are broadcast.
BROADCAST_KEYS = 1 << 18


class ScanError(ValueError):
    """A request that no scan can answer."""


def get(rows: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col("key") == key)


def get_required(rows: DataFrame, key: str) -> DataFrame:
    """The row of a key; reading it fails when there is none."""
    found = get(rows, key).agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return found.select(F.lit(key).alias("key"), F.when(F.col("n") > 0, F.col("value")).otherwise(F.raise_error(F.lit(f"no such key: {key}"))).alias("value"))


def has(rows: DataFrame, key: str) -> DataFrame:
    """found: whether the key exists."""
    return get(rows, key).limit(1).agg((F.count("*") > 0).alias("found"))


def scan_range(rows: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, direction: str = "next", values: bool = True) -> DataFrame:
    """Rows between bounds, both included, in key order.

    ``prev`` goes down from ``start`` to ``end``, and is empty without a start.
    Inverted bounds give nothing; a limit of 0 gives nothing.
    """
    if direction not in ("next", "prev"):
        raise ScanError(f"no such direction: {direction}")
    low, high = (start, end) if direction == "next" else (end, start)
    out = rows if values else rows.select("key")
    if direction == "prev" and start is None:
        return out.where(F.lit(False))
    if low is not None:
        out = out.where(F.col("key") >= low)
    if high is not None:
        out = out.where(F.col("key") <= high)
    out = out.orderBy(F.asc("key") if direction == "next" else F.desc("key"))
    return out if limit is None else out.limit(limit)


def key_range(key: Column, lower: str | None, upper: str | None) -> Column:
    """Membership in an inclusive range with optional bounds."""
    if lower is not None and upper is not None and lower > upper:
        raise ScanError("the range is inverted")
    ok = F.lit(True)
    if lower is not None:
        ok = ok & (key >= lower)
    if upper is not None:
        ok = ok & (key <= upper)
    return ok


@dataclass(frozen=True)
class Page:
    """``rows``: one more than the page, so that ``next_key`` tells whether there is a next one."""

    rows: DataFrame
    limit: int

    def items(self) -> DataFrame:
        return self.rows.orderBy("key").limit(self.limit)

    def next_key(self) -> DataFrame:
        """next: the last key of the page if rows follow it, else null."""
        ranked = self.rows.orderBy("key").limit(self.limit + 1)
        keys = F.sort_array(F.collect_list("key"))
        return ranked.agg(keys.alias("keys")).select(F.when(F.size("keys") > self.limit, F.get("keys", F.lit(self.limit - 1))).alias("next"))


def scan_prefix(rows: DataFrame, prefix: str, after: str | None = None, limit: int = 100, values: bool = True, below: str | None = None) -> Page:
    """A page of a prefix after an excluded key, below an excluded cut."""
    out = rows.where(in_prefix(F.col("key"), prefix))
    if after is not None:
        out = out.where(F.col("key") > after)
    if below is not None:
        out = out.where(F.col("key") < below)
    return Page(out if values else out.select("key"), limit)


def count_prefix(rows: DataFrame, prefix: str, most: int) -> DataFrame:
    """n: rows of a prefix, counted up to ``most``."""
    return rows.where(in_prefix(F.col("key"), prefix)).limit(most).agg(F.count("*").alias("n"))


def get_many(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos, key, value in the order asked; repeats stay, missing values are null."""
    asked = rows.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
    asked = F.broadcast(asked) if len(keys) <= BROADCAST_KEYS else asked
    found = rows.join(asked.select("key").distinct(), "key", "left_semi")
    return asked.join(found, "key", "left").select("pos", "key", "value")


def page_by_bytes(rows: DataFrame, most_rows: int, most_bytes: int, after: str | None = None, direction: str = "next") -> DataFrame:
    """key, size, running: the rows of one page, bounded by rows and by bytes.

    A page holds at least one row; a single row above the byte bound fails when
    read, and a page of no rows is refused.
    """
    if most_rows < 1:
        raise ScanError("a page has at least one row")
    size = (F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))).cast("long")
    out = rows if after is None else rows.where(F.col("key") > after)
    # the window sees at most one page of rows
    order = F.asc("key") if direction == "next" else F.desc("key")
    out = out.select("key", size.alias("size")).orderBy(order).limit(most_rows)
    running = F.sum("size").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.select("key", "size", running.alias("running"))
    too_big = (F.col("running") == F.col("size")) & (F.col("size") > most_bytes)
    out = out.withColumn("size", F.when(too_big, F.raise_error(F.lit("a row is larger than the page")).cast("long")).otherwise(F.col("size")))
    return out.where((F.col("running") <= most_bytes) | (F.col("running") == F.col("size")))


@dataclass(frozen=True)
class Cursor:
    """Where a pinned scan goes on; a token of another pin or direction is refused."""

    version: int
    position: str | None
    direction: str

    def token(self) -> str:
        return json.dumps({"v": self.version, "p": self.position, "d": self.direction}, sort_keys=True)

    @staticmethod
    def read(token: str, version: int, direction: str) -> Cursor:
        try:
            got = json.loads(token)
            cursor = Cursor(int(got["v"]), got["p"], got["d"])
        except (ValueError, KeyError, TypeError) as e:
            raise ScanError("the cursor cannot be read") from e
        if (cursor.version, cursor.direction) != (version, direction):
            raise ScanError("the cursor belongs to another scan")
        return cursor


def scoped(rows: DataFrame, prefix: str) -> DataFrame:
    """The view below ``prefix/``, keys without it; an empty prefix is the whole."""
    if not prefix:
        return rows
    whole = f"{prefix}/"
    return rows.where(in_prefix(F.col("key"), whole)).withColumn("key", F.substring(F.col("key"), F.lit(len(whole) + 1), F.length("key")))


def route(rows: DataFrame, shards: DataFrame, key: str = "key") -> DataFrame:
    """Adds the shard of each key's table (the text before the first slash); null where none is assigned."""
    assigned = shards.select(F.col("table_name").alias("__t"), F.col("shard"))
    return rows.join(assigned, F.substring_index(F.col(key), "/", 1) == F.col("__t"), "left").drop("__t")


def shard_plan(prefixes: list[str], shards: DataFrame, max_shards: int) -> DataFrame:
    """shard, prefixes: a scope's prefixes by the shard of their table, in the order declared.

    A table of no shard or of two fails, as does a plan over more than ``max_shards``.
    """
    spark = shards.sparkSession
    asked = spark.createDataFrame(list(enumerate(prefixes)), "pos int, prefix string").withColumn("table_name", F.substring_index("prefix", "/", 1))
    owners = shards.groupBy("table_name").agg(F.first("shard").alias("shard"), F.count("*").alias("n"))
    both = F.broadcast(asked).join(owners, "table_name", "left")  # the prefixes of one declaration
    fault = F.when(F.col("n") > 1, "a table has two shards: ").when(F.col("n").isNull(), "a table has no shard: ")
    owner = F.when(F.col("n") == 1, F.col("shard")).otherwise(F.raise_error(F.concat(fault, F.col("table_name"))).cast(shards.schema["shard"].dataType))
    out = both.select(owner.alias("shard"), F.struct("pos", "prefix").alias("p")).groupBy("shard").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["prefix"]).alias("prefixes"))
    n = F.count("*").over(Window.partitionBy())  # one row a shard of the plan
    return out.withColumn("prefixes", F.when(n <= max_shards, F.col("prefixes")).otherwise(F.raise_error(F.lit("the plan has too many shards")).cast("array<string>")))


def feed_since(feed: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Entries after a sequence number, in order."""
    return feed.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


def events_since(feed: DataFrame, seq: int, retained: int = 1024) -> DataFrame:
    """Retained entries after ``seq`` and whether none between was lost (``complete``)."""
    top = feed.agg(F.max("seq").alias("top"))  # one row
    return feed.crossJoin(F.broadcast(top)).where((F.col("seq") > seq) & (F.col("seq") > F.col("top") - retained)).select("seq", "value", (F.lit(seq) >= F.col("top") - retained).alias("complete"))


def keep_prefixes(rows: DataFrame, prefixes: list[str], key: str = "key") -> DataFrame:
    """Rows whose key is in one of the prefixes."""
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | in_prefix(F.col(key), p)
    return rows.where(ok)


def empty_like(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.createDataFrame([], rows.schema)
