"""Writes: version checks, ladders, idempotency, receipts, scheduling, audit chains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policy import evaluate


def check_versions(mutations: DataFrame, current: DataFrame) -> DataFrame:
    """request, verdict: of a request's mutations (request, pos, key, base), the first that isn't Pass decides; of several at one pos, Rejected before Conflict; a null pos comes last."""
    now = current.select(F.col("key").alias("k"), F.col("version").alias("v"))
    both = mutations.join(now, F.col("key") == F.col("k"), "left").withColumn("v", F.coalesce("v", F.lit(0)))
    each = F.when(F.col("base") > F.col("v"), "Rejected").when(F.col("base") < F.col("v"), "Conflict")
    out = both.withColumn("bad", each).groupBy("request").agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.struct(F.col("pos").isNull(), "pos", F.col("bad") != "Rejected"))).alias("bad"))
    return out.select("request", F.coalesce("bad", F.lit("Pass")).alias("verdict"))


def submit(requests: DataFrame, current: DataFrame) -> DataFrame:
    """request, outcome of the write ladder, first rule that applies.

    requests: request, client, idempotency_key, body, shard_ok, rows, allowed,
    and mutations as an array of (pos, key, base). A repeated idempotency key
    replays the first receipt if the body is the same, and is refused otherwise.
    """
    by = Window.partitionBy("client", "idempotency_key").orderBy("request")
    seen = requests.withColumn("first_body", F.first("body").over(by)).withColumn("nth", F.row_number().over(by))
    flat = requests.select("request", F.explode("mutations").alias("m")).select("request", "m.pos", "m.key", "m.base")
    both = seen.join(check_versions(flat, current), "request", "left")
    ladder = (
        F.when((F.col("nth") > 1) & (F.col("body") == F.col("first_body")), "Replayed")
        .when(F.col("nth") > 1, "KeyReused")
        .when(F.col("rows") > 1024, "TooManyRows")
        .when(~F.col("shard_ok"), "CrossShard")
        .when(F.col("verdict") == "Rejected", "StaleBase")
        .when(F.col("verdict") == "Conflict", "Conflict")
        .when(~F.col("allowed"), "Denied")
        .otherwise("Committed")
    )
    return both.select("request", ladder.alias("outcome"))


def enforce(requests: DataFrame) -> DataFrame:
    """request, outcome of the enforcement ladder over prepared columns, first rule that applies."""
    ladder = (
        F.when(~F.col("authenticated"), "Rejected:Unauthenticated")
        .when(F.col("replayed"), "Replayed")
        .when(F.col("reused"), "Rejected:KeyReused")
        .when(F.col("rows") > 1024, "Rejected:TooManyRows")
        .when(F.col("shards") > 1, "Rejected:CrossShard")
        .when(F.col("writes_projection"), "Rejected:ProjectionWrite")
        .when(F.col("base").isNull(), "Rejected:MissingBase")
        .when(F.col("base") > F.col("version"), "Rejected:StaleBase")
        .when(F.col("base") < F.col("version"), "Conflict")
        .when(~F.col("checksum_ok"), "Rejected:ProjectionChecksum")
        .when(F.col("regressed"), "Rejected:WatermarkRegression")
        .when(F.col("over_bound") & F.col("strict"), "Rejected:StaleFacts")
        .when(F.col("over_bound"), "Queued")
        .when(~F.col("policy_ok"), "Rejected:Policy")
        .otherwise("Committed")
    )
    return requests.select("request", ladder.alias("outcome"))


def enforce_requests(requests: DataFrame, mutations: DataFrame, sessions: DataFrame, versions: DataFrame, projection: DataFrame, tree: object, shard: int, strict: bool, now: int, derived: str = "projection/") -> DataFrame:
    """request, outcome of requests at the enforcement point of one shard, judged on its tables.

    requests: request, token, idempotency_key, body; mutations: request, pos, key,
    shard, base, before, after; sessions: token, expires; versions: key, version
    (before the batch; unknown keys are at 0); projection: one row of digest, expected, watermark,
    previous, lag, bound; ``derived``: the keys that no client writes. The first
    request of an idempotency key whose outcome is kept answers later ones; refusals for
    want of a session or of a base are not kept.
    """
    known = sessions.where(F.col("expires") > now).select("token").distinct().withColumn("authenticated", F.lit(True))
    judged = evaluate(mutations, tree).join(versions.select("key", F.col("version").alias("v")), "key", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = judged.groupBy("request").agg(
        F.count("*").alias("rows"),
        any_(F.col("shard") != shard).alias("crosses"),
        any_(F.col("key").startswith(derived)).alias("writes_projection"),
        any_(F.col("base").isNull()).alias("unbased"),
        any_(F.col("base") > F.col("v")).alias("ahead"),
        any_(F.col("base") < F.col("v")).alias("behind"),
        any_(F.col("verdict") != "allow").alias("denied"),
    )
    flags = ("crosses", "writes_projection", "unbased", "ahead", "behind", "denied", "authenticated")
    rows = requests.join(known, "token", "left").join(each, "request", "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).withColumn("rows", F.coalesce("rows", F.lit(0)))
    refused = F.col("unbased") & ~F.col("crosses") & ~F.col("writes_projection") & (F.col("rows") <= 1024)
    kept = F.when(F.col("authenticated") & ~refused, F.struct("request", "body"))
    first = F.min(kept).over(Window.partitionBy("idempotency_key"))
    rows = rows.withColumn("first", first).withColumn("later", F.coalesce(F.col("request") > F.col("first.request"), F.lit(False)))
    state = F.broadcast(projection)  # one row
    base = F.when(F.col("unbased"), F.lit(None)).when(F.col("ahead"), 1).when(F.col("behind"), -1).otherwise(0)
    same = F.col("body") == F.col("first.body")
    return enforce(
        rows.crossJoin(state).select(
            "request", "authenticated", (F.col("later") & same).alias("replayed"), F.col("later").alias("reused"), "rows", F.when(F.col("crosses"), 2).otherwise(1).alias("shards"), "writes_projection", base.alias("base"), F.lit(0).alias("version"),
            (F.col("digest") == F.col("expected")).alias("checksum_ok"), (F.col("watermark") < F.col("previous")).alias("regressed"), (F.col("lag") > F.col("bound")).alias("over_bound"), F.lit(strict).alias("strict"), (~F.col("denied")).alias("policy_ok"),
        )
    )


def expire_queued(receipts: DataFrame, now: int) -> DataFrame:
    """Queued writes at their deadline become rejected."""
    return receipts.withColumn("state", F.when((F.col("state") == "Queued") & (F.col("deadline") <= now), "Rejected").otherwise(F.col("state")))


def receipts(ledger: DataFrame) -> DataFrame:
    """client, idempotency_key, n, status: one receipt a key; other bodies under a key are an error."""
    out = ledger.groupBy("client", "idempotency_key").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))
    return out.select("client", "idempotency_key", "n", F.when(F.col("bodies") > 1, "KeyReused").otherwise("Recorded").alias("status"))


def schedule(requests: DataFrame, per_shard: int) -> DataFrame:
    """request, reason of one round (shard, key, arrival, in_flight, deps_done, shard_blocked).

    The first waiting request of a key is ready if nothing of the key is in
    flight, its dependencies are done and its shard isn't blocked; each shard
    takes its first ``per_shard`` ready ones. Reasons of the others in their order.
    """
    waiting = F.row_number().over(Window.partitionBy("shard", "key").orderBy(F.col("in_flight").desc(), "arrival", "request"))
    busy = F.max(F.col("in_flight").cast("int")).over(Window.partitionBy("shard", "key")) == 1
    rows = requests.withColumn("nth", waiting).withColumn("busy", busy)
    base = (
        F.when(F.col("in_flight"), "InFlight")
        .when(F.col("shard_blocked"), "ShardBlocked")
        .when(F.col("busy") | (F.col("nth") > 1), "KeyBlocked")
        .when(~F.col("deps_done"), "DependencyBlocked")
    )
    rows = rows.withColumn("reason", base)
    # rows that have a reason are dealt one by one, so only ready ones are sorted by shard
    turn = F.row_number().over(Window.partitionBy("shard", F.when(F.col("reason").isNotNull(), F.col("request"))).orderBy("arrival", "request"))
    reason = F.coalesce("reason", F.when(turn > per_shard, "OutsideBudget"), F.lit("Selected"))
    return rows.select("request", reason.alias("reason"))


#: Positions of one scheduler round up to this number may be broadcast.
MOST_POSITIONS = 1 << 16


def decide(requests: DataFrame, shards: DataFrame, max_positions: int, max_edges: int, epoch: int = 0) -> DataFrame:
    """request, reason, position of one round over a graph of dependencies.

    requests: request, shard, key, arrival, state (Queued, InFlight or Terminal),
    deps (array of requests); shards: shard, blocked. A queued request is ready
    if it is the earliest unfinished one of its key, its dependencies are Terminal
    and its shard isn't blocked. Shards with ready requests take turns in order of
    shard, from the one that the epoch points at, one request each a turn, until
    the positions or the dependency edges are used up. Terminal requests are left
    out; the others that are not selected say why.
    """
    if not 0 <= max_positions <= MOST_POSITIONS:
        raise ValueError(f"a round has at most {MOST_POSITIONS} positions")
    deps = requests.where("state = 'Queued'").select("request", F.explode(F.array_distinct("deps")).alias("needs"))
    done = requests.where("state = 'Terminal'").select(F.col("request").alias("needs"))
    waits = deps.join(done, "needs", "left_anti").select("request").distinct().withColumn("waits", F.lit(True))
    edges = F.greatest(F.size(F.array_distinct(F.coalesce("deps", F.array().cast(requests.schema["deps"].dataType)))), F.lit(0))
    rows = requests.where("state <> 'Terminal'").select("request", "shard", "key", "arrival", "state", edges.alias("edges"))
    head = F.min(F.struct("arrival", "request")).over(Window.partitionBy("shard", "key"))
    rows = rows.withColumn("head", head["request"] == F.col("request")).join(shards.select("shard", "blocked"), "shard", "left").join(waits, "request", "left")
    held = (
        F.when(F.col("state") == "InFlight", "InFlight")
        .when(F.col("blocked"), "ShardBlocked")
        .when(~F.col("head"), "KeyBlocked")
        .when(F.col("waits"), "DependencyBlocked")
    )
    rows = rows.select("request", "shard", "arrival", "edges", held.alias("held"))
    ready = rows.where("held is null")
    # one row a shard with work
    turns = ready.select("shard").distinct().select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    turns = turns.select("shard", F.pmod(F.col("at") - F.lit(epoch), F.col("n")).alias("turn"))
    nth = F.row_number().over(Window.partitionBy("shard").orderBy("arrival", "request"))
    # a shard gives no more than all positions, which Spark cuts before the shuffle; then one page
    line = ready.withColumn("nth", nth).where(F.col("nth") <= max_positions).join(turns, "shard").orderBy("nth", "turn").limit(max_positions)
    order = Window.orderBy("nth", "turn")
    used = F.sum("edges").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    took = line.select("request", used.alias("used"), F.row_number().over(order).cast("long").alias("position")).where(F.col("used") <= max_edges).select("request", "position")
    out = rows.join(F.broadcast(took), "request", "left")
    reason = F.coalesce("held", F.when(F.col("position").isNull(), "OutsideBudget"), F.lit("Selected"))
    return out.select("request", reason.alias("reason"), "position")


def admit_requests(requests: DataFrame, max_fan_in: int, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """request, arrival, verdict of requests (request, shard, arrival, deps) that arrive one after the other.

    A request is refused if an earlier row has its id, if it has too many
    dependencies, or if one of them is itself, belongs to another shard, or
    isn't an admitted earlier request; the least dependency at fault decides. What a refusal
    takes along is found in rounds, one a step along the longest chain of refusals;
    ``keep`` writes a round's table, so that the plan doesn't grow.
    """
    first = F.row_number().over(Window.partitionBy("request").orderBy("arrival"))
    rows = requests.select("request", "shard", "arrival", F.array_distinct("deps").alias("deps"), first.alias("nth"))
    static = F.when(F.col("nth") > 1, "DuplicateRequest").when(F.size("deps") > max_fan_in, "FanInExceeded")
    rows = rows.select("request", "shard", "arrival", "nth", F.when(static.isNull(), F.col("deps")).alias("deps"), static.alias("verdict"))
    each = rows.select("request", "arrival", "shard", F.explode("deps").alias("needs"))
    owner = rows.where("nth = 1").select(F.col("request").alias("needs"), F.col("shard").alias("s"), F.col("arrival").alias("a"))
    edges = each.join(owner, "needs", "left").select("request", "arrival", "shard", "needs", "s", "a")
    own = F.when(F.col("needs") == F.col("request"), "Cycle").when(F.col("a").isNull() | (F.col("a") >= F.col("arrival")), "ForwardReference").when(F.col("s") != F.col("shard"), "CrossShardEdge")
    edges = keep(edges.select("request", "needs", own.alias("fault")), 0)
    refused = rows.where("nth = 1 and verdict is not null").select("request").unionByName(edges.where("fault is not null").select("request")).distinct()
    refused, n, round_ = keep(refused, 1), -1, 1
    while (now := refused.count()) != n:
        n, round_ = now, round_ + 1
        more = edges.join(refused.select(F.col("request").alias("needs")), "needs", "left_semi").select("request")
        refused = keep(refused.unionByName(more).distinct(), round_)
    gone = refused.select(F.col("request").alias("needs"), F.lit(True).alias("gone"))
    # an edge to a refused request leads to nothing, whatever else is wrong with it, unless it is the request itself
    fault = F.when(F.col("fault") == "Cycle", "Cycle").when(F.col("gone"), "ForwardReference").otherwise(F.col("fault"))
    worst = edges.join(gone, "needs", "left").select("request", "needs", fault.alias("fault")).where("fault is not null").groupBy("request").agg(F.min_by("fault", "needs").alias("fault"))
    out = rows.join(worst, "request", "left")
    return out.select("request", "arrival", F.coalesce("verdict", "fault", F.lit("Admitted")).alias("verdict"))


def outbox_claims(entries: DataFrame) -> DataFrame:
    """entry, claimed: queued entries that are first of their key while nothing of the key is in flight."""
    by = Window.partitionBy("key")
    busy = F.max((F.col("state") == "InFlight").cast("int")).over(by) == 1
    first = F.min(F.when(F.col("state") == "Queued", F.col("entry"))).over(by)
    return entries.select("entry", ((F.col("state") == "Queued") & ~busy & (F.col("entry") == first)).alias("claimed"))


def share_keys(entries: DataFrame) -> DataFrame:
    """entry, key, first, n: outbox entries (entry, keys) that touch a key of others, with the key's smallest entry and its number of entries.

    Two entries share a key where both have a row of it; a hot key costs its entries, not their pairs.
    """
    flat = entries.select("entry", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    each = flat.groupBy("key").agg(F.min("entry").alias("first"), F.count("*").alias("n")).where("n > 1")
    return flat.join(each, "key").select("entry", "key", "first", "n")


def link(previous: str, body: str) -> str:
    return hashlib.sha256(f"{previous}\x1f{body}".encode()).hexdigest()


def audit_chain(entries: DataFrame) -> DataFrame:
    """shard, seq, body, prev, hash: each entry's hash covers the one before it in its shard.

    Sequential in a shard; rows stream through sorted partitions with one hash held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, last = None, ""
        for b in batches:
            before, now = [], []
            for s, body in zip(b["shard"], b["body"]):
                if s != shard:
                    shard, last = s, ""
                before.append(last)
                last = link(last, body)
                now.append(last)
            b["prev"], b["hash"] = before, now
            yield b

    kind = entries.schema["shard"].dataType.simpleString()
    rows = entries.select("shard", F.col("seq").cast("long"), "body").repartition("shard").sortWithinPartitions("shard", "seq")
    return rows.mapInPandas(run, f"shard {kind}, seq long, body string, prev string, hash string")


def audit_verify(chain: DataFrame) -> DataFrame:
    """shard, seq, status of stored links: the sequence, the link to the entry before, and the entry's own hash."""
    by = Window.partitionBy("shard").orderBy("seq")
    gap = F.coalesce(F.col("seq") != F.lag("seq").over(by) + 1, F.lit(False))
    bad = F.col("prev") != F.coalesce(F.lag("hash").over(by), F.lit(""))
    own = F.col("hash") != F.sha2(F.concat(F.col("prev"), F.lit("\x1f"), F.col("body")), 256)
    return chain.select("shard", "seq", F.when(gap, "Gap").when(bad, "BrokenLink").when(own, "WrongHash").otherwise("Ok").alias("status"))


def changes(writes: DataFrame) -> DataFrame:
    """version, n, keys: what each commit changed."""
    keys = F.array_join(F.sort_array(F.collect_set("key")), ",")
    return writes.groupBy("version").agg(F.count("*").alias("n"), keys.alias("keys"))


def validated(writes: DataFrame, rules: dict[str, F.Column]) -> DataFrame:
    """Adds refused: names of the validators that don't hold, in order; a null result refuses."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return writes.withColumn("refused", F.array_join(names, ","))


def notify(writes: DataFrame, hooks: list[str]) -> DataFrame:
    """A row for each hook of each accepted write."""
    return writes.where("refused = ''").select("*", F.explode(F.array(*map(F.lit, hooks))).alias("hook"))


def rollout(operations: F.Column, most: F.Column, now: F.Column, expires: F.Column, automatic: F.Column) -> F.Column:
    """The step of a canary: too many operations abort it; once expired it is promoted, if its kind of change may be without approval."""
    return F.when(operations > most, "Aborted").when((now >= expires) & automatic, "Promoted").otherwise("Continue")


def rollout_tick(rollouts: DataFrame, operations: DataFrame, now: int) -> DataFrame:
    """cohort, operations, step, version: the rollouts (cohort, base, candidate, since, most, expires, automatic) against what their cohorts did (cohort, at).

    Operations from the start of a rollout to now count. An aborted one goes back
    to its base version, all others show the candidate.
    """
    seen = operations.join(rollouts.select("cohort", "since"), "cohort").where((F.col("at") >= F.col("since")) & (F.col("at") <= now)).groupBy("cohort").agg(F.count("*").alias("operations"))
    rows = rollouts.join(seen, "cohort", "left").withColumn("operations", F.coalesce("operations", F.lit(0)).cast("long"))
    rows = rows.withColumn("step", rollout(F.col("operations"), F.col("most"), F.lit(now), F.col("expires"), F.col("automatic")))
    return rows.select("cohort", "operations", "step", F.when(F.col("step") == "Aborted", F.col("base")).otherwise(F.col("candidate")).alias("version"))


def activations(requests: DataFrame, assigned: DataFrame, catalog: DataFrame) -> DataFrame:
    """request, outcome of activations (request, idempotency_key, cohort, base, candidate, role, author, approver).

    The first request of a key decides, later ones repeat its receipt. A cohort at
    another version than the base conflicts; versions that the catalog (version,
    compiles, breaking) doesn't hold or can't compile are refused, as are breaking ones that nobody
    but their author has approved.
    """
    nth = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("request"))
    first = requests.withColumn("nth", nth)
    one = first.where("nth = 1").join(assigned.select("cohort", F.col("version").alias("current")), "cohort", "left")
    known = catalog.select(F.col("version").alias("base"), F.lit(True).alias("known"))
    target = catalog.select(F.col("version").alias("candidate"), "compiles", "breaking")
    one = one.join(known, "base", "left").join(target, "candidate", "left")
    approved = F.col("approver").isNotNull() & (F.col("approver") != F.col("author"))
    outcome = (
        F.when(F.coalesce(F.col("current") != F.col("base"), F.lit(False)), "Conflict")
        .when(F.col("known").isNull(), "Rejected:UnknownBase")
        .when(~F.coalesce("compiles", F.lit(False)), "Rejected:Compile")
        .when(F.coalesce("breaking", F.lit(False)) & ~approved, "Rejected:Approval")
        .otherwise("Activated")
    )
    receipts = one.select("idempotency_key", outcome.alias("outcome"))
    return first.select("request", "idempotency_key", (F.col("nth") > 1).alias("repeated")).join(receipts, "idempotency_key").select("request", "outcome", "repeated")


def rollbacks(requests: DataFrame, assigned: DataFrame, catalog: DataFrame) -> DataFrame:
    """request, outcome of rollbacks (request, cohort, base, target) against assignments (cohort, version) and a catalog (version, generation, compiles).

    A cohort without an assignment or at another version conflicts, as does a target
    that isn't of an earlier generation; versions that the catalog lacks, and targets that don't compile, are refused.
    """
    own = requests.join(assigned.select("cohort", F.col("version").alias("current")), "cohort", "left")
    own = own.join(catalog.select(F.col("version").alias("target"), F.col("generation").alias("to_generation"), "compiles"), "target", "left")
    own = own.join(catalog.select(F.col("version").alias("base"), F.col("generation").alias("from_generation")), "base", "left")
    outcome = (
        F.when(F.col("current").isNull() | (F.col("current") != F.col("base")), "Conflict")
        .when(F.col("to_generation").isNull() | F.col("from_generation").isNull(), "Rejected:UnknownVersion")
        .when(F.col("to_generation") >= F.col("from_generation"), "Conflict")
        .when(~F.coalesce("compiles", F.lit(False)), "Rejected:Compile")
        .otherwise("RolledBack")
    )
    return own.select("request", outcome.alias("outcome"))


#: Pages of a backup whose digests are put together before those of all blocks are.
BLOCK_OF_PAGES = 4096


def backup_manifest(pages: DataFrame) -> DataFrame:
    """pages, bytes, digest of a backup image (page, body); pages are numbered, and their digests go into the whole's by blocks."""
    rows = pages.select("page", F.octet_length("body").alias("n"), F.sha2("body", 256).alias("h"))
    joined = lambda by: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]))
    blocks = rows.groupBy(F.floor(F.col("page") / BLOCK_OF_PAGES).alias("block")).agg(F.count("*").alias("pages"), F.sum("n").alias("bytes"), F.sha2(joined("page"), 256).alias("h"))
    return blocks.agg(F.sum("pages").cast("long").alias("pages"), F.sum("bytes").cast("long").alias("bytes"), F.sha2(joined("block"), 256).alias("digest"))


def restore_split(rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Rows to restore and rows that have expired."""
    alive = F.col("expires").isNull() | (F.col("expires") > now)
    return rows.where(alive), rows.where(~alive)
