"""Version lag, staleness bounds, read admission and session guarantees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mvcc import entails, merged


def version_lag(watermark: DataFrame, served: DataFrame) -> DataFrame:
    """version_lag: the most that a shard's served version is behind its watermark (unserved: from 0)."""
    both = watermark.select("shard", F.col("version").alias("w")).join(served.select("shard", F.col("version").alias("s")), "shard", "left")
    behind = F.greatest(F.col("w") - F.coalesce("s", F.lit(0)), F.lit(0))
    return both.agg(F.coalesce(F.max(behind), F.lit(0)).cast("long").alias("version_lag"))


def silence(now: Column, last_contact: Column) -> Column:
    """How long nothing was heard, never below 0."""
    return F.greatest(now - last_contact, F.lit(0)).cast("long")


def measure(served: Column, watermark: Column) -> Column:
    """The most that a version vector is behind the watermarks; a shard that serves nothing is at 0."""
    each = F.transform(F.map_entries(watermark), lambda w: F.greatest(w["value"] - F.coalesce(F.try_element_at(served, w["key"]), F.lit(0)), F.lit(0)))
    return F.coalesce(F.array_max(each), F.lit(0)).cast("long")


def fact_staleness(read_set: DataFrame, facts: DataFrame, watermarks: DataFrame, observed: DataFrame) -> DataFrame:
    """source, bound, distance, within: by source of the facts read, the tightest bound against how far it lags."""
    used = read_set.select("fact").distinct().join(facts.select("fact", "source", "bound"), "fact")
    by = used.groupBy("source").agg(F.min("bound").alias("bound"))
    both = by.join(watermarks.select("source", "watermark"), "source", "left").join(observed.select("source", "observed"), "source", "left")
    distance = F.greatest(F.coalesce("observed", "watermark", F.lit(0)) - F.coalesce("watermark", F.lit(0)), F.lit(0)).cast("long")
    return both.select("source", "bound", distance.alias("distance"), (distance <= F.col("bound")).alias("within"))


def authorize(reports: DataFrame, mode: str, deadline_reached: bool) -> DataFrame:
    """decision: Allow within all bounds; else Reject if strict or the deadline has passed, Queue otherwise."""
    worse = "Reject:stale_facts" if mode == "strict" else "Reject:queue_timeout" if deadline_reached else "Queue:projection_lagging"
    return reports.agg(F.when(F.coalesce(F.bool_and("within"), F.lit(True)), "Allow").otherwise(worse).alias("decision"))


def read_set(facts: DataFrame, wanted: list[str], max_facts: int, max_sources: int) -> DataFrame:
    """facts, sources, verdict of a read set against its caps."""
    out = facts.where(F.col("fact").isin(sorted(set(wanted)))).agg(F.count_distinct("fact").alias("facts"), F.count_distinct("source").alias("sources"))
    missing = F.lit(len(set(wanted))) > F.col("facts")
    return out.withColumn("verdict", F.when(missing, "UnknownFact").when(F.col("facts") > max_facts, "TooManyFacts").when(F.col("sources") > max_sources, "TooManySources").otherwise("Ok"))


def permits(lag: Column, silence: Column, max_lag: Column, max_silence: Column) -> Column:
    """Whether a bound allows the measured staleness; a null bound allows any."""
    return F.coalesce(lag <= max_lag, F.lit(True)) & F.coalesce(silence <= max_silence, F.lit(True))


def raise_session(minimum: Column, required: Column) -> Column:
    """A session's minimum after it has seen ``required``."""
    return merged(minimum, required)


def required_of(minimum: Column, pin: Column) -> Column:
    """A session's minimum on the pinned shards."""
    return F.map_filter(minimum, lambda k, v: F.map_contains_key(pin, k))


def admit_reads(reads: DataFrame) -> DataFrame:
    """read_id, outcome, served_lag of read requests, first rule that applies.

    reads: read_id, pin, minimum, applied, watermark (maps shard to version),
    pin_expired, hydrated, resident, needs_resident, read_your_writes, at_least,
    coverage, max_lag, max_silence, silence.
    """
    need = required_of(F.col("minimum"), F.col("pin"))
    exact = ~F.col("at_least")
    served = F.when(exact, F.col("pin")).otherwise(F.col("applied"))
    lags = F.transform(F.map_entries("watermark"), lambda e: F.greatest(e["value"] - F.coalesce(F.try_element_at(served, e["key"]), F.lit(0)), F.lit(0)))
    lag = F.coalesce(F.array_max(lags), F.lit(0)).cast("long")
    late = F.when(F.col("read_your_writes"), "Blocked").otherwise("BehindCommit")
    meets, full = entails(F.col("applied"), need), entails(F.col("applied"), F.col("pin"))
    ladder = (
        F.when(F.col("pin_expired"), "PinExpired")
        .when(~F.col("hydrated"), "NotHydrated")
        .when(F.col("needs_resident") & ~F.col("resident"), "NotResident")
        .when(F.col("read_your_writes") & ~meets, "Blocked")
        .when(exact & ~entails(F.col("pin"), need), "BehindCommit")
        .when(exact & ~full, late)
        .when(F.col("at_least") & ~meets, late)
        .when(F.col("at_least") & ~F.col("coverage") & ~full, late)
        .when(~permits(lag, F.col("silence"), F.col("max_lag"), F.col("max_silence")), "Stale")
        .otherwise("Served")
    )
    return reads.select("read_id", ladder.alias("outcome"), lag.alias("served_lag"))


def resume(cursor_version: Column, floor: Column, expires: Column, now: Column) -> Column:
    """How a session goes on: its cursor, a snapshot, or not at all."""
    return F.when(now >= expires, "Expired").when(cursor_version < floor, "Snapshot").otherwise("Resumed")
