"""Event logs: identities, consumers' reading, lag, retry, dead letters, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_id(*parts: Column) -> Column:
    """A deterministic identity of what caused an event and its place among that cause's events."""
    return F.sha2(F.concat_ws("\x1f", F.lit("event"), *[p.cast("string") for p in parts]), 256)


def emit(commits: DataFrame) -> DataFrame:
    """Events of committed writes (shard, key, version, rule, outcome, drafts): one a draft, by its index."""
    ok = commits.where("outcome = 'Committed'").select("shard", "key", "version", "rule", F.posexplode("drafts").alias("emission", "payload"))
    return ok.withColumn("event_id", event_id(*map(F.col, ("shard", "key", "version", "rule", "emission"))))


def dedupe(events: DataFrame, by: str = "event_id") -> DataFrame:
    """One row of each event; of different rows the first by content, so that runs agree."""
    rest = [c for c in events.columns if c != by]
    first = events.groupBy(by).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(by, *[F.col(f"r.{c}").alias(c) for c in rest])


def lag(log: DataFrame, cursor: DataFrame) -> DataFrame:
    """key, lag: highest sequence less the acknowledged one, at least 0."""
    top = log.groupBy("key").agg(F.max("sequence").alias("top"))
    both = top.join(cursor.select("key", "acked"), "key", "left")
    return both.select("key", F.greatest(F.col("top") - F.coalesce("acked", F.lit(0)), F.lit(0)).cast("long").alias("lag"))


def total_lag(log: DataFrame, cursor: DataFrame) -> DataFrame:
    return lag(log, cursor).agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("total_lag"))


def read(log: DataFrame, cursor: DataFrame, exactly: bool = True) -> DataFrame:
    """Events that a consumer gets next: the one after its cursor for each key, or all after it."""
    both = log.join(cursor.select("key", "acked"), "key", "left").withColumn("next", F.coalesce("acked", F.lit(0)) + 1)
    return both.where(F.col("sequence") == F.col("next") if exactly else F.col("sequence") >= F.col("next")).drop("acked", "next")


def poll(log: DataFrame, cursor: DataFrame, in_flight: DataFrame, credit: int, budget: int) -> DataFrame:
    """key, sequence, kind of one poll: due retries first, then new events of idle keys, up to the credit.

    Nothing is new while the whole lag exceeds the budget (the consumer is too slow).
    ``in_flight``: key, sequence, due.
    """
    due = in_flight.where("due").select("key", "sequence", F.lit("retry").alias("kind"), F.lit(0).alias("rank"))
    new = read(log, cursor).join(in_flight.select("key"), "key", "left_anti").select("key", "sequence", F.lit("new").alias("kind"), F.lit(1).alias("rank"))
    slow = total_lag(log, cursor)  # one row
    new = new.crossJoin(F.broadcast(slow)).where(F.col("total_lag") <= budget).drop("total_lag")
    return due.unionByName(new).orderBy("rank", "key", "sequence").limit(credit).select("key", "sequence", "kind")


def retention_gaps(cursor: DataFrame, floor: DataFrame) -> DataFrame:
    """key, acked, floor of the cursors whose next event is no longer retained."""
    both = cursor.join(floor.select("key", "floor"), "key")
    return both.where(F.col("acked") + 1 < F.col("floor")).select("key", "acked", "floor")


def backoff(attempt: Column, base: int, cap: int, jitter: Column | None = None, hint: Column | None = None) -> Column:
    """Milliseconds before the next try: doubled each attempt up to a cap, plus up to a quarter by the event's own byte."""
    exponent = F.least(F.greatest(attempt.cast("int") - 1, F.lit(0)), F.lit(40))
    delay = F.least(F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), exponent), F.lit(cap).cast("long"))
    if jitter is not None:
        delay = F.least(delay + F.pmod(jitter.cast("long"), F.call_function("div", delay, F.lit(4).cast("long")) + 1), F.lit(cap).cast("long"))
    return delay if hint is None else F.when(hint.isNull(), delay).otherwise(F.least(F.greatest(delay, hint.cast("long")), F.lit(cap).cast("long")))


def settle(attempts: DataFrame, max_attempts: int, deadline: int, base: int, cap: int) -> DataFrame:
    """key, sequence, result, retry_at of handled events (attempt, first_at, now, outcome).

    Success: Acked. Retryable: Retried, unless time (first) or attempts are
    used up. Permanent and panic: DeadLettered.
    """
    used = F.col("now") - F.col("first_at")
    late, spent = used >= deadline, F.col("attempt") >= max_attempts
    result = (
        F.when(F.col("outcome") == "success", "Acked")
        .when(F.col("outcome") == "permanent", "DeadLettered:PermanentFailure")
        .when(F.col("outcome") == "panic", "DeadLettered:Panic")
        .when(late, "DeadLettered:RetryTimeExhausted")
        .when(spent, "DeadLettered:RetryBudgetExhausted")
        .otherwise("Retried")
    )
    at = F.when(result == "Retried", F.col("now") + backoff(F.col("attempt"), base, cap))
    return attempts.select("key", "sequence", result.alias("result"), at.cast("long").alias("retry_at"))


def admission(events: DataFrame, budget: int) -> DataFrame:
    """key, sequence, outcome of the strict consumer, first rule that applies.

    events: key, sequence, pending (sequence in flight or null), retry_due,
    done, dead, acked, floor, in_flight (events pending in all), known_schema.
    """
    seq, acked = F.col("sequence"), F.coalesce("acked", F.lit(0))
    ladder = (
        F.when(F.col("pending").isNotNull() & (F.col("pending") != seq), "Blocked")
        .when(F.col("pending").isNotNull(), F.when(F.col("retry_due"), "Ready").otherwise("RetryNotDue"))
        .when(F.col("done"), "Duplicate:Completed")
        .when(F.col("dead"), "Duplicate:DeadLettered")
        .when(seq <= acked, "Duplicate:BehindCursor")
        .when((acked < F.col("floor")) | (seq < F.col("floor")), "CursorExpired")
        .when(seq > acked + 1, "SequenceGap")
        .when(F.col("in_flight") >= budget, "TooSlow")
        .when(~F.col("known_schema"), "DeadLettered:Poison")
        .otherwise("Ready")
    )
    return events.select("key", "sequence", ladder.alias("outcome"))


def begin(deliveries: DataFrame, cursors: DataFrame, pending: DataFrame, completed: DataFrame, dead: DataFrame, floor: int, schemas: list[str], budget: int, now: int) -> DataFrame:
    """key, sequence, outcome of deliveries (key, sequence, event_id, schema) against a consumer's tables.

    cursors: key, acked; pending: key, event_id, retry_at, one event a key; completed
    and dead: key, event_id. Each delivery is judged by itself on these tables.
    """
    flight = pending.select("key", F.col("event_id").alias("p_id"), "retry_at")
    n = F.broadcast(pending.agg(F.count("*").alias("in_flight")))  # one row
    mark = lambda rows, name: rows.select("key", "event_id").distinct().withColumn(name, F.lit(True))
    rows = deliveries.join(cursors.select("key", "acked"), "key", "left").join(flight, "key", "left")
    rows = rows.join(mark(completed, "done"), ["key", "event_id"], "left").join(mark(dead, "dead"), ["key", "event_id"], "left").crossJoin(n)
    # another event in flight stands for any other sequence
    held = F.when(F.col("p_id") == F.col("event_id"), F.col("sequence")).when(F.col("p_id").isNotNull(), F.lit(-1))
    flags = {"pending": held, "retry_due": F.coalesce(F.col("retry_at") <= now, F.lit(False)), "done": F.coalesce("done", F.lit(False)), "dead": F.coalesce("dead", F.lit(False)), "floor": F.lit(floor), "known_schema": F.coalesce(F.col("schema").isin(schemas), F.lit(False))}
    return admission(rows.withColumns(flags), budget)


def dead_letters(settled: DataFrame) -> DataFrame:
    return settled.where(F.col("result").startswith("DeadLettered")).select("key", "sequence", F.substring_index("result", ":", -1).alias("reason"))


def redrive(letters: DataFrame, outcomes: DataFrame, operator: str) -> DataFrame:
    """key, sequence, audit, result of a fresh attempt at each dead letter."""
    both = letters.join(outcomes, ["key", "sequence"], "left")
    result = F.when(F.col("outcome") == "success", "Acked").otherwise("DeadLettered")
    return both.select("key", "sequence", F.concat(F.lit(f"{operator}:redrive:"), F.col("reason")).alias("audit"), result.alias("result"))


def sequence_gaps(log: DataFrame) -> DataFrame:
    """key, after, missing: holes in the sequences of a key."""
    step = F.col("sequence") - F.lag("sequence").over(Window.partitionBy("key").orderBy("sequence"))
    return log.withColumn("step", step).where("step > 1").select("key", (F.col("sequence") - F.col("step")).alias("after"), (F.col("step") - 1).alias("missing"))


def operational(signals: DataFrame, kinds: list[str]) -> DataFrame:
    """Operational signals, which are kept apart from business events."""
    return signals.where(F.col("kind").isin(kinds))
