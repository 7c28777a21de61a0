"""The driver's tables as key-value rows, change logs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def padded(prefix: str, column: str) -> F.Column:
    """A key that sorts as its number does."""
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), 20, "0"))


def number_bounds(prefix: str, lower: str | None = None, upper: str | None = None) -> tuple[int | None, int | None]:
    """Numbers between which every key of ``padded`` from ``lower`` to ``upper`` lies; an empty range where none does."""

    def digits(bound: str, fill: str) -> int:
        tail = bound[len(prefix) :]
        own = tail[: len(tail) - len(tail.lstrip("0123456789"))][:20]
        return int(own.ljust(20, fill))

    low = high = None
    if lower is not None and lower[: len(prefix)] >= prefix:
        low = digits(lower, "0") if lower.startswith(prefix) else 10**18
    if upper is not None and not upper[: len(prefix)] > prefix:
        high = digits(upper, "9") if upper.startswith(prefix) else -1
    return low, high


def order_rows(spark: SparkSession, folder: str, lower: str | None = None, upper: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """key, value: orders as key-value rows, the value a JSON text.

    Bounds of the keys that are asked for, or the keys themselves, become bounds
    of the number behind the key, which the Parquet scan skips row groups by;
    the scan's own conditions still decide.
    """
    o = table(spark, folder, "orders")
    if keys is not None:
        asked = {number_bounds("orders/", k, k)[0] for k in keys}
        o = o.where(F.col("o_orderkey").isin(*[n for n in asked if n is not None and n < 2**63]))
    low, high = number_bounds("orders/", lower, upper)
    if low is not None:
        o = o.where(F.col("o_orderkey") >= F.lit(min(low, 2**63 - 1)))
    if high is not None:
        o = o.where(F.col("o_orderkey") <= F.lit(min(high, 2**63 - 1)))
    value = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    return o.select(padded("orders/", "o_orderkey").alias("key"), value.alias("value"))


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer and nation, as nested documents."""
    o, c, n = (table(spark, folder, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation has 25 rows
    return joined.select(
        padded("orders/", "o_orderkey").alias("key"),
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").alias("total"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
            F.col("c_mktsegment").alias("segment"),
            F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"),
            F.array("c_mktsegment", "n_name").alias("tags"),
            (F.col("c_acctbal") > 0).alias("solvent"),
        ).alias("doc"),
    )


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """shard, key, version, value (null: deleted): events as versions of a user's row."""
    e = table(spark, folder, "events")
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("shard"),
        padded("user/", "user_id").alias("key"),
        F.col("event_id").alias("version"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """shard, key, sequence (from 1 for each key), event_id, event_type, value."""
    e = table(spark, folder, "events")
    per_key = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("shard"),
        F.col("user_id").alias("key"),
        F.row_number().over(per_key).cast("long").alias("sequence"),
        "event_id",
        "event_type",
        "value",
    )


SHARDS = {"orders": "s0", "customer": "s0", "lineitem": "s1", "part": "s2", "supplier": "s2", "events": "s3"}


def shard_map(spark: SparkSession) -> DataFrame:
    """table_name, shard: a static assignment."""
    return spark.createDataFrame(sorted(SHARDS.items()), "table_name string, shard string")
