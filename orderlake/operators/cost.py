"""Cost plans, admission, quotas, token buckets, placement, warm-up, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: milliunits of a shard that is asked.
SHARD_COST = 1000
#: The order in which resources are checked.
RESOURCES = ("stored_bytes", "log_bytes", "in_flight_requests", "query_cost", "event_backlog", "replicas")


def keys_examined(term_probes: Column, posting_keys: Column) -> Column:
    return (term_probes + posting_keys).cast("long")


def plan(shards: DataFrame) -> DataFrame:
    """query, fanout, rows, tokens, keys, cost_milli of planned shards (query, term_probes, posting_keys, estimated_rows, token_count)."""
    keys = F.sum(keys_examined(F.col("term_probes"), F.col("posting_keys")))
    out = shards.groupBy("query").agg(F.count("*").alias("fanout"), F.sum("estimated_rows").cast("long").alias("rows"), F.sum("token_count").cast("long").alias("tokens"), keys.cast("long").alias("keys"))
    return out.withColumn("cost_milli", (F.col("fanout") * SHARD_COST + F.col("keys")).cast("long"))


def admit(plans: DataFrame, max_cost: int, max_fanout: int, max_tokens: int, token_budget: int) -> DataFrame:
    """query, verdict, errors (in the order fan-out, token, cost), remaining."""
    tokens = F.col("tokens")
    token = F.when(tokens > token_budget, "TokenBudgetExceeded").when(F.lit(token_budget) > max_tokens, "TokenBudgetExceeded").when(tokens > max_tokens, "TokenBudgetExceeded")
    errors = F.array_compact(F.array(F.when(F.col("fanout") > max_fanout, "FanoutExceeded"), token, F.when(F.col("cost_milli") > max_cost, "BudgetExceeded")))
    out = plans.withColumn("errors", errors)
    return out.select("query", "cost_milli", F.when(F.size("errors") == 0, "Admitted").otherwise("Rejected").alias("verdict"), F.array_join("errors", ",").alias("errors"), F.greatest(F.lit(max_cost) - F.col("cost_milli"), F.lit(0)).cast("long").alias("remaining_milli"))


def explain(plans: DataFrame) -> DataFrame:
    """query, record: a stable JSON text of a plan."""
    return plans.select("query", F.to_json(F.struct("cost_milli", "fanout", "keys", "query", "rows", "tokens")).alias("record"))


def pin_readable(pin: Column, oldest: Column) -> Column:
    """Whether every pinned version is still retained."""
    return F.forall(F.map_entries(pin), lambda e: e["value"] >= F.coalesce(F.try_element_at(oldest, e["key"]), F.lit(0)))


def quota(requests: DataFrame, limits: dict[str, int], reserve: dict[str, int] | None = None) -> DataFrame:
    """request_id, exceeded: the first resource whose use and request exceed its limit less the reserve, or empty."""
    out = F.lit(None).cast("string")
    for r in reversed([r for r in RESOURCES if r in limits]):
        limit = max(limits[r] - (reserve or {}).get(r, 0), 0)
        out = F.when(F.col(f"used_{r}") + F.col(f"want_{r}") > limit, r).otherwise(out)
    return requests.select("request_id", F.coalesce(out, F.lit("")).alias("exceeded"))


def refill(tokens: int, updated: int, now: int, capacity: int, rate: int) -> tuple[int, int]:
    """(tokens, time) of a bucket brought up to now; fractions of a token stay in the time."""
    if now <= updated or rate == 0:
        return tokens, updated
    if tokens >= capacity:
        return tokens, now
    added = (now - updated) * rate // 1000
    return (tokens, updated) if added == 0 else (min(tokens + added, capacity), updated + added * 1000 // rate)


def token_buckets(requests: DataFrame, capacity: int, rate: int) -> DataFrame:
    """key, at, cost, admitted of requests in order of time (then cost, then id): one full bucket a key from time 0.

    A bucket is sequential; rows stream through sorted partitions, and a
    bucket's state is two numbers, so no key is ever held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, updated = None, capacity, 0
        for b in batches:
            verdicts = []
            for k, at, cost in zip(b["key"], b["at"], b["cost"]):
                if k != key:
                    key, tokens, updated = k, capacity, 0
                tokens, updated = refill(tokens, updated, int(at), capacity, rate)
                ok = tokens >= cost
                tokens -= int(cost) if ok else 0
                verdicts.append(bool(ok))
            b["admitted"] = verdicts
            yield b

    rows = requests.select("key", "id", "at", "cost").where("key is not null").repartition("key").sortWithinPartitions("key", "at", "cost", "id")
    kind = requests.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, id long, at long, cost long, admitted boolean")


def place(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds tier: that of the first rule whose bounds all hold; ``min_`` and ``max_`` prefixed names bound columns."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        ok = F.lit(True)
        for name, bound in rule.items():
            if name.startswith("min_"):
                ok = ok & (F.col(name[4:]) >= bound)
            elif name.startswith("max_"):
                ok = ok & (F.col(name[4:]) <= bound)
            elif name != "tier":
                ok = ok & (F.col(name) == bound)
        out = F.when(F.coalesce(ok, F.lit(False)), rule["tier"]).otherwise(out)
    return facts.withColumn("tier", out)


def warm_up(items: DataFrame, budget: int) -> DataFrame:
    """group, idx, bytes, total: each group's items in order, ending before the one that crosses the budget."""
    total = F.sum("bytes").over(Window.partitionBy("group").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = items.withColumn("total", total.cast("long"))
    return rows.where(F.col("total") <= budget).select("group", "idx", "bytes", "total")


def slope_per_decade(start: Column, end: Column, decades: Column) -> Column:
    """Millionths of growth by decade, cut to whole numbers; null without a start or decades."""
    return F.when((start != 0) & (decades != 0), F.call_function("div", (end - start) * F.lit(1_000_000).cast("long"), start * decades))


def conflict_rate(receipts: DataFrame) -> DataFrame:
    """conflicts, settled, rate: conflicts among committed, rejected and conflicting writes; queued ones don't count."""
    out = receipts.agg(F.count_if(F.col("state") == "Conflict").alias("conflicts"), F.count_if(F.col("state") != "Queued").alias("settled"))
    return out.withColumn("rate", F.when(F.col("settled") > 0, F.col("conflicts") / F.col("settled")))


def percentiles(rows: DataFrame, column: str, quantiles: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))) -> DataFrame:
    """Exact quantiles of the non-null numbers, by default p50, p99 and p999; null without any.

    Rows are ranked by ranges, so no task holds all distinct values; a quantile
    between two rows is their weighted mean.
    """
    from ..sources.store import numbered

    known = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = known.count()
    ranked = numbered(known, "x")
    out = []
    for name, q in quantiles:
        at = q * max(n - 1, 0)
        low = int(at)
        value = lambda i: F.max(F.when(F.col("nth") == min(i, max(n - 1, 0)) + 1, F.col("x")))
        out.append((value(low) + (value(low + 1) - value(low)) * F.lit(at - low)).alias(name))
    return ranked.agg(*out)


def policy_cost(rows: DataFrame, column: str) -> DataFrame:
    """p99, median, ratio of the steps that policies took; no ratio where the median is 0."""
    out = percentiles(rows, column, (("p99", 0.99), ("median", 0.5)))
    return out.withColumn("ratio", F.when(F.col("median") > 0, F.col("p99") / F.col("median")))


def cold_start(rows: DataFrame) -> DataFrame:
    """cold, all, ratio of requests (cold: boolean) that found nothing warm."""
    out = rows.agg(F.count_if(F.col("cold")).alias("cold"), F.count("*").alias("all"))
    return out.withColumn("ratio", F.when(F.col("all") > 0, F.col("cold") / F.col("all")))


def counters(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """One count a kind of operation."""
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def store_stats(calls: DataFrame) -> DataFrame:
    """The twelve counters of a store from its calls (kind, items, bytes, failed).

    kind: get, has, set, put, delete, scan, commit or rollback; items: rows that a scan gave;
    bytes: of values that a read gave or a write took. Every call counts, whether it failed or not.
    """
    kind = F.col("kind")
    counted = {"gets": "get", "has": "has", "sets": "set", "puts": "put", "deletes": "delete", "scans": "scan", "tx_commits": "commit", "tx_rollbacks": "rollback"}
    total = lambda ok, column: F.coalesce(F.sum(F.when(ok, F.col(column))), F.lit(0)).cast("long")
    return calls.agg(
        *[F.count_if(kind == k).alias(name) for name, k in counted.items()],
        total(kind == "scan", "items").alias("scan_items"),
        total(kind.isin("get", "scan"), "bytes").alias("bytes_read"),
        total(kind.isin("set", "put"), "bytes").alias("bytes_written"),
        F.count_if(F.col("failed")).alias("errors"),
    )


def compaction_pass(shards: DataFrame, budget: int) -> DataFrame:
    """shard, action: Paused, Blocked by a pin, Idle, or Ran while the budget lasts, in order of shard."""
    ready = ~F.col("paused") & ~(F.col("pin") < F.col("target")) & (F.col("files") > 1)
    # one row a shard
    total = F.sum(F.when(ready, F.col("bytes")).otherwise(0)).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    action = F.when(F.col("paused"), "Paused").when(F.col("pin") < F.col("target"), "Blocked").when(F.col("files") <= 1, "Idle").when(total <= budget, "Ran").otherwise("Deferred")
    return shards.select("shard", action.alias("action"))
