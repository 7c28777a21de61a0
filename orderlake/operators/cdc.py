"""Change data capture: ordered idempotent application, intervals, membership, scopes, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mvcc import entails, latest

#: Prefixes of one scope.
MOST_PREFIXES = 1 << 14


def sequence_report(diffs: DataFrame, first: int = 0, whole: bool = False) -> DataFrame:
    """stream, pos, seq (``whole``: all columns) and status of each diff as it arrives in order of pos.

    Applied if it is the next one expected, Duplicate if it came before, Gap if
    it is beyond; a stream stops at its first gap, and what follows is Blocked.
    """
    arrived = Window.partitionBy("stream").orderBy("pos")
    before = F.coalesce(F.max("seq").over(arrived.rowsBetween(Window.unboundedPreceding, -1)), F.lit(first - 1))
    # up to a gap every number below the maximum has been seen, so the maximum tells what is expected
    rows = diffs.withColumn("next", before + 1).withColumn("jump", F.col("seq") > F.col("next"))
    broken = F.max(F.col("jump").cast("int")).over(arrived.rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(F.coalesce(broken, F.lit(0)) == 1, "Blocked").when(F.col("jump"), "Gap").when(F.col("seq") < F.col("next"), "Duplicate").otherwise("Applied")
    return rows.select(*diffs.columns if whole else ("stream", "pos", "seq"), status.alias("status"))


def apply_diffs(diffs: DataFrame) -> DataFrame:
    """stream, key, value after all applied diffs (stream, pos, seq, key, op put, delete or leave, value)."""
    rows = sequence_report(diffs, whole=True).where("status = 'Applied'")
    won = rows.groupBy("stream", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return won.where("w.op = 'put'").select("stream", "key", F.col("w.value").alias("value"))


def interval_report(intervals: DataFrame) -> DataFrame:
    """n, status of each interval (n, base, target): in order, from the target before it, never back.

    The interval before is found by a join on its number, so a long log is dealt to many tasks.
    """
    known = intervals.select((F.col("n") + 1).alias("n"), F.col("target").alias("before"), F.lit(True).alias("follows"))
    first = F.broadcast(intervals.agg(F.min("n").alias("first")))  # one row
    gap = F.col("follows").isNull() & (F.col("n") != F.col("first"))
    status = F.when(gap, "SequenceGap").when(F.coalesce(F.col("base") != F.col("before"), F.lit(False)), "BaseMismatch").when(F.col("target") < F.col("base"), "TargetRegressed").otherwise("Ok")
    return intervals.join(known, "n", "left").crossJoin(first).select("n", status.alias("status"))


def same_vector(a: Column, b: Column) -> Column:
    """Whether two version vectors hold the same shards at the same versions."""
    return entails(a, b) & entails(b, a)


def vector_interval_report(intervals: DataFrame, records: DataFrame) -> DataFrame:
    """n, status of intervals (n, base, target: maps of shard to version) with their records (n, key).

    They count from 1 and start from nothing; each starts from the target before
    it and never goes back in any shard; a key has one record an interval.
    """
    twice = records.groupBy("n", "key").agg(F.count("*").alias("c")).where("c > 1").select("n").distinct().withColumn("twice", F.lit(True))
    known = intervals.select((F.col("n") + 1).alias("n"), F.col("target").alias("before"))
    rows = intervals.join(known, "n", "left").join(twice, "n", "left")
    first = F.col("n") == 1
    fits = F.when(first, F.size("base") == 0).otherwise(same_vector(F.col("base"), F.col("before")))
    status = (
        F.when(~first & F.col("before").isNull(), "SequenceGap")
        .when(~fits, "BaseMismatch")
        .when(~entails(F.col("target"), F.col("base")), "TargetRegressed")
        .when(F.col("twice"), "DuplicateRecord")
        .otherwise("Ok")
    )
    return rows.select("n", status.alias("status"))


def read_at(reads: DataFrame, members: DataFrame, local: dict[str, int]) -> DataFrame:
    """read_id, key, state, key_version of local reads (read_id, key, pin: map of shard to version).

    Only the local pin is answered, Present or Absent; an older one is no longer
    resident, any other one not yet hydrated.
    """
    here = F.create_map(*[F.lit(x) for kv in sorted(local.items()) for x in kv]) if local else F.create_map().cast("map<string,bigint>")
    rows = reads.join(members.select("key", "key_version"), "key", "left")
    now = same_vector(here, F.col("pin"))
    state = F.when(now & F.col("key_version").isNotNull(), "Present").when(now, "Absent").when(entails(here, F.col("pin")), "NotResident").otherwise("NotHydrated")
    return rows.select("read_id", "key", state.alias("state"), F.when(now, F.col("key_version")).alias("key_version"))


def churn(records: DataFrame) -> DataFrame:
    """n, adds, removes, total of the records (n, key, op add or remove) of each interval."""
    return records.groupBy("n").agg(F.count_if(F.col("op") == "add").alias("adds"), F.count_if(F.col("op") == "remove").alias("removes"), F.count("*").alias("total"))


def membership_at(records: DataFrame, n: int) -> DataFrame:
    """key, key_version, byte_len of the members after interval ``n``."""
    won = records.where(F.col("n") <= n).groupBy("key").agg(F.max_by(F.struct("op", "key_version", "byte_len"), "n").alias("w"))
    return won.where("w.op = 'add'").select("key", F.col("w.key_version").alias("key_version"), F.col("w.byte_len").alias("byte_len"))


def unknown_removals(records: DataFrame) -> DataFrame:
    """n, key of the removals of a key that wasn't a member."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("n"))
    return records.withColumn("before", before).where("op = 'remove' and (before is null or before = 'remove')").select("n", "key")


def scope_stats(members: DataFrame) -> DataFrame:
    """members, bytes, shards of a scope (shard, key, byte_len)."""
    return members.agg(F.count("*").alias("members"), F.coalesce(F.sum("byte_len"), F.lit(0)).cast("long").alias("bytes"), F.count_distinct("shard").alias("shards"))


def evict_out_of_scope(pages: DataFrame, prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """Pages (page, lower, upper) that meet no prefix [lower, upper) and hold no member key.

    A range join, with the prefixes of one scope on the broadcast side; more of
    them than a scope may declare are refused.
    """
    if prefixes.limit(MOST_PREFIXES + 1).count() > MOST_PREFIXES:
        raise ValueError(f"a scope declares at most {MOST_PREFIXES} prefixes")
    p = F.broadcast(prefixes.select(F.col("lower").alias("pl"), F.col("upper").alias("pu")))
    out = pages.join(p, (F.col("pl") < F.col("upper")) & (F.col("lower") < F.col("pu")), "left_anti")
    held = members.select(F.col("page").alias("mp")).distinct()
    return out.join(held, F.col("page") == F.col("mp"), "left_anti")


def ingest(rows: DataFrame) -> DataFrame:
    """shard, key, key_version, value: the highest key version of each key wins, whatever the order."""
    won = rows.groupBy("shard", "key").agg(F.max_by("value", "key_version").alias("value"), F.max("key_version").alias("key_version"))
    return won.select("shard", "key", "key_version", "value")


def page_status(pages: DataFrame) -> DataFrame:
    """page, pos, status: a snapshot page of a commit that isn't newer than the one before it is a Duplicate."""
    before = F.max("commit_version").over(Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return pages.select("page", "pos", F.when(F.col("commit_version") <= before, "Duplicate").otherwise("Applied").alias("status"))


def verify_pages(pages: DataFrame) -> DataFrame:
    """page, status of transferred pages (page, body, crc): Verified, or Corrupt where the checksum differs."""
    return pages.select("page", F.when(F.crc32(F.col("body").cast("binary")) == F.col("crc"), "Verified").otherwise("Corrupt").alias("status"))


def left_to_transfer(pages: DataFrame, journal: DataFrame) -> DataFrame:
    """Pages of a snapshot that a journal (page, crc) doesn't yet hold as verified: where a hydration goes on."""
    done = journal.select(F.col("page").alias("p"), F.col("crc").alias("c"))
    return pages.join(done, (F.col("page") == F.col("p")) & (F.col("crc") == F.col("c")), "left_anti")


def evict_superseded(pages: DataFrame, applied: DataFrame) -> DataFrame:
    """Pages whose commit is not below the version applied to their shard."""
    a = applied.select("shard", F.col("version").alias("applied"))
    return pages.join(a, "shard", "left").where("applied is null or commit_version >= applied").drop("applied")


def project(declared: dict[str, list[str]], rows: DataFrame) -> DataFrame:
    """The declared fields of the scope's tables."""
    names = [f for fields in declared.values() for f in fields]
    return rows.select(*dict.fromkeys(names))


def scope(rows: DataFrame, prefixes: list[str], selector: Column | None, fields: list[str] | None) -> DataFrame:
    """A scope declaration as a view: prefixes, a row predicate, and fields."""
    from .scan import keep_prefixes

    out = keep_prefixes(rows, prefixes)
    out = out if selector is None else out.where(F.coalesce(selector, F.lit(False)))
    return out if fields is None else out.select("key", *[f for f in fields if f != "key"])


def admit_scope(rows: DataFrame, prefixes: list[str], forbidden: list[str], selector: Column) -> DataFrame:
    """key, verdict: admitted, or why a scope snapshot refuses the row."""
    from .policy import any_of

    inside = any_of([F.col("key").startswith(p) for p in prefixes])
    barred = any_of([F.col("key").startswith(p) for p in forbidden])
    verdict = F.when(F.col("key").startswith("\xff"), "SystemKey").when(barred, "ForbiddenNamespace").when(~inside, "OutOfScope").when(~F.coalesce(selector, F.lit(False)), "NotAdmitted").otherwise("Admitted")
    return rows.select("key", verdict.alias("verdict"))


def facts_at(snapshots: DataFrame) -> DataFrame:
    """source, fact, fact_version, value: the newest version of each fact."""
    return latest(snapshots.withColumnRenamed("fact_version", "version"), keys=("source", "fact")).withColumnRenamed("version", "fact_version")


def feed_report(feed: DataFrame) -> DataFrame:
    """source, pos, status of watermarks and epochs as they arrive: Regressed, WrongEpoch, Duplicate or Applied."""
    by = Window.partitionBy("source").orderBy("pos")
    mark, epoch, body = (F.lag(c).over(by) for c in ("watermark", "epoch", "digest"))
    status = F.when(F.col("epoch") != epoch, "WrongEpoch").when(F.col("watermark") < mark, "Regressed").when((F.col("watermark") == mark) & (F.col("digest") == body), "Duplicate").otherwise("Applied")
    return feed.select("source", "pos", status.alias("status"))


def resume(cursor: Column, low: Column, high: Column) -> Column:
    """How a feed goes on after a cursor: by diffs while they are retained, else from a snapshot."""
    return F.when(cursor > high, "Invalid").when(cursor + 1 < low, "Snapshot").when(cursor == high, "Current").otherwise("Diffs")


def invalidation(before: DataFrame, after: DataFrame, policy_cause: str | None = None) -> DataFrame:
    """cause: why a fact set (fact, type, owner, revoked, value) is no longer valid, null if it is.

    A set with other facts comes first; then the first fact that differs says
    revocation, type or owner, in this order; any other difference comes last.
    """
    a = before.select("fact", *[F.col(c).alias(f"a_{c}") for c in ("type", "owner", "revoked", "value")])
    b = after.select("fact", *[F.col(c).alias(f"b_{c}") for c in ("type", "owner", "revoked", "value")])
    both = a.join(b, "fact", "full")
    gone = F.col("a_type").isNull() | F.col("b_type").isNull()
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    strong = F.when(~same("revoked"), "Revocation").when(~same("type"), "SchemaChanged").when(~same("owner"), "OwnershipChanged")
    out = both.agg(F.bool_or(gone).alias("gone"), F.min_by(strong, F.when(strong.isNotNull(), F.col("fact"))).alias("strong"), F.bool_or(~same("value")).alias("other"))
    cause = F.when(F.col("gone"), "FactSetChanged").when(F.col("strong").isNotNull(), F.col("strong")).when(F.col("other"), "FactSetChanged").otherwise(F.lit(policy_cause).cast("string"))
    return out.select(cause.alias("cause"))
