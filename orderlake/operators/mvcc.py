"""As-of reads of a versioned change log (shard, key, version, value; null value: deleted).

Newest-wins is one ``max_by`` a key, which combines before it shuffles; the
null of a deletion must reach it, so it is dropped only afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, pin: int | None = None, keys: tuple[str, ...] = ("shard", "key")) -> DataFrame:
    """The newest version up to the pin of every key; deleted keys are gone."""
    seen = log if pin is None else log.where(F.col("version") <= pin)
    won = seen.groupBy(*keys).agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    return won.where("value is not null").select(*keys, "version", "value")


def get_entry(log: DataFrame, key: str, pin: int) -> DataFrame:
    return latest(log.where(F.col("key") == key), pin)


def scan(log: DataFrame, pin: int, lower: str | None = None, upper: str | None = None, direction: str = "next", limit: int | None = None) -> DataFrame:
    """An as-of range scan, bounds included."""
    if lower is not None:
        log = log.where(F.col("key") >= lower)
    if upper is not None:
        log = log.where(F.col("key") <= upper)
    out = latest(log, pin).orderBy(F.asc("key") if direction == "next" else F.desc("key"))
    return out if limit is None else out.limit(limit)


def as_of_join(left: DataFrame, log: DataFrame, pin: str = "pin", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Each left row with the newest version of its key up to its own pin; no version: nulls.

    Both sides are dealt by key once and read in order of version, so a key
    with many versions and many left rows costs their sum, not their product.
    """
    whole = F.struct(*[F.col(c) for c in left.columns])
    asked = left.select(*keys, F.col(pin).cast("long").alias("__at"), F.lit(1).alias("__kind"), whole.alias("__left"), F.lit(None).alias("__entry"))
    entry = F.struct(F.col("version"), F.col("value"))
    known = log.select(*keys, F.col("version").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__left"), entry.alias("__entry"))
    asked = asked.withColumn("__entry", F.lit(None).cast(known.schema["__entry"].dataType))
    known = known.withColumn("__left", F.lit(None).cast(asked.schema["__left"].dataType))
    order = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.unionByName(asked).withColumn("__entry", F.last("__entry", ignorenulls=True).over(order))
    return seen.where("__kind = 1").select("__left.*", F.col("__entry.version").alias("version"), F.col("__entry.value").alias("value"))


def visible_at(rows: DataFrame, pin: dict[int, int]) -> DataFrame:
    """The newest row of each key under a pin of several shards; shards without a pin show nothing."""
    pins = F.create_map(*[F.lit(x) for kv in sorted(pin.items()) for x in kv]) if pin else None
    if pins is None:
        return latest(rows.where(F.lit(False)))
    return latest(rows.where(F.col("version") <= pins[F.col("shard")]))


def compact(log: DataFrame, pin: int) -> DataFrame:
    """A log that answers every pin from ``pin`` on like the old one, with fewer rows."""
    return latest(log, pin).select("shard", "key", "version", "value").unionByName(log.where(F.col("version") > pin).select("shard", "key", "version", "value"))


def entails(a: F.Column, b: F.Column) -> F.Column:
    """Whether version vector ``a`` is at least ``b`` in every shard of ``b``."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]) >= e["value"], F.lit(False)))


def merged(a: F.Column, b: F.Column) -> F.Column:
    """The least vector that entails both."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))
