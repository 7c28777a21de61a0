"""Scatter and gather: merging shard results into pages, exact or with coverage."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys of a page up to this number are broadcast.
MOST_KEPT = 1 << 16


class SearchRefusal(ValueError):
    """A cursor or request that belongs to another search."""


ORDERS = {"relevance": (("score", False), ("key", True)), "declared": (("sort_key", True), ("key", True))}


def ordering(order: str) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in ORDERS[order]]


def after_position(order: str, position: tuple) -> Column:
    """Rows that come strictly after a (score, key) or (sort key, key) position."""
    (first, up), (second, _) = ORDERS[order]
    a, b = position
    later = F.col(first) > F.lit(a) if up else F.col(first) < F.lit(a)
    return later | ((F.col(first) == F.lit(a)) & (F.col(second) > F.lit(b)))


def top(hits: DataFrame, limit: int, order: str = "relevance", after: tuple | None = None) -> DataFrame:
    rows = hits if after is None else hits.where(after_position(order, after))
    return rows.orderBy(*ordering(order)).limit(limit)


def page(hits: DataFrame, limit: int, order: str = "relevance", after: tuple | None = None) -> DataFrame:
    """The page's rows, with ``has_more``: whether rows follow it."""
    rows = top(hits, limit + 1, order, after)
    # the windows see one page and a row
    rank = F.row_number().over(Window.orderBy(*ordering(order)))
    n = F.count("*").over(Window.partitionBy())
    return rows.withColumn("rank", rank.cast("long")).withColumn("has_more", n > limit).where(F.col("rank") <= limit)


def total_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total_hits"))


def at_pin(hits: DataFrame, pin: dict[int, int]) -> DataFrame:
    """Hits of pinned shards that aren't newer than the shard's pin."""
    pins = F.create_map(*[F.lit(x) for kv in sorted(pin.items()) for x in kv])
    return hits.where(F.col("version") <= F.try_element_at(pins, F.col("shard")))


def coverage(pin: DataFrame, served: DataFrame, at_least: bool = False) -> DataFrame:
    """answered, missing: shards whose served version is the pinned one (or is at least that)."""
    both = pin.select("shard", F.col("version").alias("p")).join(served.select("shard", F.col("version").alias("s")), "shard", "left")
    ok = F.coalesce(F.col("s") >= F.col("p") if at_least else F.col("s") == F.col("p"), F.lit(False))
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("shard").cast("string")))), ",")
    return both.agg(listed(ok).alias("answered"), listed(~ok).alias("missing"), F.bool_and(ok).alias("complete"))


def budget(hits: DataFrame, limit: int) -> DataFrame:
    """shard, cost, running, within: hits charged by shard in order, against a bound."""
    cost = hits.groupBy("shard").agg(F.count("*").alias("cost"))
    # one row a shard
    running = F.sum("cost").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cost.select("shard", "cost", running.cast("long").alias("running"), (running <= limit).alias("within"))


def duplicate_keys(hits: DataFrame, order: str, limit: int) -> DataFrame:
    """Keys that stand side by side in the window of a page and the row after it: the strict merge refuses them."""
    rows = top(hits, limit + 1, order)
    before = F.lag("key").over(Window.orderBy(*ordering(order)))
    return rows.withColumn("__b", before).where(F.col("key") == F.col("__b")).select("key").distinct()


def unordered_shards(streams: DataFrame, order: str = "relevance") -> DataFrame:
    """Shards whose rows (with ``pos``) aren't in order: the strict merge refuses them."""
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(*ordering(order)))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("pos"))
    keys = [c for c, _ in ORDERS[order]]
    a = streams.select("shard", place.alias("at"), *[F.col(k).alias(f"a_{k}") for k in keys])
    b = streams.select("shard", rank.alias("at"), *keys)
    return a.join(b, ["shard", "at"]).where(" or ".join(f"a_{k} <> {k}" for k in keys)).select("shard").distinct()


def collapse(streams: DataFrame) -> DataFrame:
    """Rows of several shards with equal key, score and payload as one; ``conflict`` where a key has different contents."""
    one = streams.groupBy("key", "score", "payload").agg(F.count("*").alias("copies"))
    n = F.count("*").over(Window.partitionBy("key"))
    return one.select("key", "score", "payload", "copies", (n > 1).alias("conflict"))


def frontier(streams: DataFrame, limit: int) -> DataFrame:
    """shard, consumed: rows of each shard that a merged page of ``limit`` keys has used, collapsed copies included."""
    kept = top(streams.select("key", "score").distinct(), limit)
    kept = F.broadcast(kept) if limit <= MOST_KEPT else kept
    used = streams.join(kept, ["key", "score"], "left_semi").groupBy("shard").agg(F.count("*").alias("consumed"))
    return streams.select("shard").distinct().join(used, "shard", "left").select("shard", F.coalesce("consumed", F.lit(0)).cast("long").alias("consumed"))


@dataclass(frozen=True)
class SearchCursor:
    """Position in one search: bound to its pin, query and order."""

    fingerprint: str
    position: tuple
    order: str

    @staticmethod
    def fingerprint_of(query: str, scope: str, order: str, pin: dict) -> str:
        return hashlib.sha256(json.dumps([query, scope, order, sorted(pin.items())]).encode()).hexdigest()

    def token(self) -> str:
        return json.dumps({"f": self.fingerprint, "p": list(self.position), "o": self.order}, sort_keys=True)

    @staticmethod
    def read(token: str, fingerprint: str, order: str) -> SearchCursor:
        got = json.loads(token)
        if got["f"] != fingerprint or got["o"] != order:
            raise SearchRefusal("the cursor belongs to another search")
        return SearchCursor(got["f"], tuple(got["p"]), got["o"])


@dataclass(frozen=True)
class CostCursor:
    """What is left of a query's cost, and how many rows of each shard its pages have used."""

    remaining: int
    frontiers: tuple[tuple[str, int], ...] = ()

    def advance(self, cost: int, used: dict[str, int]) -> CostCursor:
        if cost > self.remaining:
            raise SearchRefusal(f"the page costs {cost}, and {self.remaining} are left")
        total = dict(self.frontiers)
        for shard, n in used.items():
            total[shard] = total.get(shard, 0) + n
        return CostCursor(self.remaining - cost, tuple(sorted(total.items())))

    def rest(self, streams: DataFrame, order: str = "relevance") -> DataFrame:
        """Rows of the streams that no page has used yet."""
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(*ordering(order)))
        used = F.lit(0)
        for shard, n in self.frontiers:
            used = F.when(F.col("shard").cast("string") == shard, n).otherwise(used)
        return streams.withColumn("__rank", rank).where(F.col("__rank") > used).drop("__rank")


def gather(rows: DataFrame, pin: DataFrame) -> DataFrame:
    """Rows of all pinned shards in order of shard and key, with ``status``: a key of two rows is a DuplicateKey."""
    own = rows.join(pin.select("shard"), "shard", "left_semi")
    n = F.count("*").over(Window.partitionBy("key"))
    return own.withColumn("status", F.when(n > 1, "DuplicateKey").otherwise("Ok")).orderBy("shard", "key")


def exact(hits: DataFrame, pin: DataFrame, served: DataFrame, limit: int) -> DataFrame:
    """The page of an exact search; reading it fails while a pinned shard is missing."""
    state = coverage(pin, served)
    checked = top(hits, limit).crossJoin(F.broadcast(state))  # one row
    fail = F.raise_error(F.concat(F.lit("shards are missing: "), F.col("missing")))
    return checked.select("shard", "key", F.when(F.col("complete"), F.col("score")).otherwise(fail.cast("long")).alias("score"))


@dataclass(frozen=True)
class Answer:
    """A page of a coordinated search: its rows, who answered, where it goes on, and what is left of the budget."""

    rows: DataFrame
    answered: tuple
    missing: tuple
    token: str | None
    budget: int | None


def execute(
    hits: DataFrame,
    served: DataFrame,
    targets: list[int],
    pin: dict[int, int],
    limit: int,
    order: str = "relevance",
    fanout: int = 64,
    coverage_mode: bool = False,
    query: str = "",
    token: str | None = None,
    budget: int | None = None,
    retained: dict[int, int] | None = None,
) -> Answer:
    """One page over the responses of shards: ``hits`` (shard, key, score or sort_key, version), ``served`` (shard, version, digest_ok).

    Refused: more targets than the fan-out, a cursor in coverage mode or of another
    search, a pin below the retained versions, hits beyond the budget, a key of two
    shards in the page. A target answers if it served just its pinned version with
    the expected index; exact mode fails on the first that doesn't, coverage mode
    lists it and gives no cursor. Hits newer than the pin are left out.
    """
    if len(targets) > fanout:
        raise SearchRefusal(f"{len(targets)} shards are asked, {fanout} may be")
    if coverage_mode and token is not None:
        raise SearchRefusal("a search with coverage has no cursor")
    fingerprint = SearchCursor.fingerprint_of(query, json.dumps(sorted(targets)), order, pin)
    after = SearchCursor.read(token, fingerprint, order).position if token else None
    for shard, version in pin.items():
        if version < (retained or {}).get(shard, 0):
            raise SearchRefusal(f"the pin of shard {shard} has expired")
    asked = served.where(F.col("shard").isin(targets))
    replies = {r["shard"]: r for r in asked.collect()}  # a row a target, of which the fan-out bounds the number
    answered, missing = [], []
    for shard in targets:
        reply = replies.get(shard)
        whole = shard in pin and reply is not None and reply["version"] == pin[shard]
        if whole and not reply["digest_ok"]:
            raise SearchRefusal(f"shard {shard} has another index")
        if not whole and not coverage_mode:
            raise SearchRefusal(f"shard {shard} has not answered at its pin")
        (answered if whole else missing).append(shard)
    own = at_pin(hits, {s: pin[s] for s in answered}) if answered else hits.where(F.lit(False))
    left = budget
    if budget is not None:
        cost = dict(own.groupBy("shard").agg(F.count("*").alias("n")).collect())  # a row a target
        for shard in answered:
            left -= cost.get(shard, 0)
            if left < 0:
                raise SearchRefusal(f"the budget ends at shard {shard}")
    if after is not None:
        own = own.where(after_position(order, after))
    if not duplicate_keys(own, order, limit).isEmpty():
        raise SearchRefusal("two shards hold one key")
    rows = page(own, limit, order)
    following = None
    if not coverage_mode:
        last = rows.where((F.col("rank") == limit) & F.col("has_more")).first()
        if last is not None:
            following = SearchCursor(fingerprint, tuple(last[c] for c, _ in ORDERS[order]), order).token()
    return Answer(rows, tuple(answered), tuple(missing), following, left)
