"""Queries over the driver's tables: change capture, events, staleness, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import LOG, query
from .operators import cdc, events, index, mvcc, policy, search, staleness, write
from .shipping import ship
from .sources import store, tables

# ---------------------------------------------------------------- change capture
#: Events of a user as a stream of diffs: each seventh is sent again, each stream of users divisible by 5 lacks its fourth.
ARRIVED = """ar AS (SELECT user_id AS stream, event_id * 2 AS pos, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS seq, event_type, value FROM events),
df AS (SELECT * FROM ar WHERE NOT (stream % 5 = 0 AND seq = 3) UNION ALL SELECT stream, pos + 1, seq, event_type, value FROM ar WHERE seq % 7 = 0 AND NOT (stream % 5 = 0 AND seq = 3)),
nx AS (SELECT *, coalesce(max(seq) OVER w, -1) + 1 AS nxt FROM df WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
br AS (SELECT *, coalesce(max((seq > nxt)::INT) OVER w, 0) AS broken FROM nx WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rp AS (SELECT *, CASE WHEN broken = 1 THEN 'Blocked' WHEN seq > nxt THEN 'Gap' WHEN seq < nxt THEN 'Duplicate' ELSE 'Applied' END AS status FROM br)"""


def arrived(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    rows = e.select(F.col("user_id").alias("stream"), (F.col("event_id") * 2).alias("pos"), seq.alias("seq"), "event_type", "value").where("NOT (stream % 5 = 0 AND seq = 3)")
    rows = rows.unionByName(rows.where("seq % 7 = 0").withColumn("pos", F.col("pos") + 1))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return rows.select("stream", "pos", "seq", F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")).alias("key"), op.alias("op"), "value")


@query(f"WITH {ARRIVED} SELECT stream, pos, seq, status FROM rp")
def cdc_gap_detect(spark, d):
    return cdc.sequence_report(arrived(spark, d))


@query(f"WITH {ARRIVED}, w AS (SELECT stream, 'k' || seq % 3 AS key, arg_max(event_type, seq) AS t, arg_max(value, seq) AS value FROM rp WHERE status = 'Applied' GROUP BY ALL) SELECT stream, key, value FROM w WHERE t <> 'error'")
def cdc_apply(spark, d):
    return cdc.apply_diffs(arrived(spark, d))


@query("WITH i AS (SELECT user_id AS n, min(event_id) AS base, max(event_id) AS target FROM events WHERE user_id % 17 <> 3 GROUP BY 1), s AS (SELECT *, lag(n) OVER (ORDER BY n) AS pn, lag(target) OVER (ORDER BY n) AS pt FROM i) SELECT n, CASE WHEN n <> pn + 1 THEN 'SequenceGap' WHEN base <> pt THEN 'BaseMismatch' WHEN target < base THEN 'TargetRegressed' ELSE 'Ok' END AS status FROM s")
def cdc_intervals(spark, d):
    e = tables.table(spark, d, "events").where("user_id % 17 <> 3")
    return cdc.interval_report(e.groupBy(F.col("user_id").alias("n")).agg(F.min("event_id").alias("base"), F.max("event_id").alias("target")))


RECORDS = "rc AS (SELECT (event_id // 100)::BIGINT AS n, 'u' || user_id AS key, arg_max(event_type, event_id) AS t, max(event_id) AS key_version, (max(event_id) % 40)::BIGINT AS byte_len, (user_id % 4)::INTEGER AS shard FROM events GROUP BY ALL)"


def records(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    g = e.groupBy(F.expr("event_id div 100").alias("n"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), (F.col("user_id") % 4).cast("int").alias("shard"))
    g = g.agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("key_version"))
    return g.select("n", "key", "shard", F.when(F.col("t") == "error", "remove").otherwise("add").alias("op"), "key_version", (F.col("key_version") % 40).alias("byte_len"))


@query(f"WITH {RECORDS} SELECT n, count(*) FILTER (t <> 'error') AS adds, count(*) FILTER (t = 'error') AS removes, count(*) AS total FROM rc GROUP BY 1")
def cdc_churn(spark, d):
    return cdc.churn(records(spark, d))


@query(f"WITH {RECORDS}, w AS (SELECT key, arg_max(t, n) AS t, arg_max(key_version, n) AS key_version, arg_max(byte_len, n) AS byte_len FROM rc WHERE n <= 20 GROUP BY 1) SELECT key, key_version, byte_len FROM w WHERE t <> 'error'")
def membership_at(spark, d):
    return cdc.membership_at(records(spark, d), 20)


@query(f"WITH {RECORDS}, p AS (SELECT n, key, t, lag(t) OVER (PARTITION BY key ORDER BY n) AS b FROM rc) SELECT n, key FROM p WHERE t = 'error' AND (b IS NULL OR b = 'error')")
def membership_unknown_removals(spark, d):
    return cdc.unknown_removals(records(spark, d))


@query(f"WITH {RECORDS} SELECT count(*) AS members, sum(byte_len)::BIGINT AS bytes, count(DISTINCT shard) AS shards FROM rc WHERE t <> 'error' AND n = 5")
def scope_stats(spark, d):
    return cdc.scope_stats(records(spark, d).where("op = 'add' AND n = 5"))


@query("WITH p AS (SELECT p_partkey AS page, printf('k%06d', p_partkey * 10) AS lower, printf('k%06d', p_partkey * 10 + 10) AS upper FROM part), s(l, u) AS (VALUES ('k000100', 'k000400'), ('k001005', 'k001015')) SELECT page, lower, upper FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE l < upper AND lower < u) AND page % 3 <> 0")
def evict_out_of_scope(spark, d):
    p = tables.table(spark, d, "part")
    pages = p.select(F.col("p_partkey").alias("page"), F.format_string("k%06d", F.col("p_partkey") * 10).alias("lower"), F.format_string("k%06d", F.col("p_partkey") * 10 + 10).alias("upper"))
    prefixes = spark.createDataFrame([("k000100", "k000400"), ("k001005", "k001015")], "lower string, upper string")
    return cdc.evict_out_of_scope(pages, prefixes, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("page")))


@query(f"WITH {LOG} SELECT shard, key, max(version) AS key_version, arg_max_null(value, version) AS value FROM lg GROUP BY ALL")
def replica_ingest(spark, d):
    return cdc.ingest(tables.change_log(spark, d).withColumnRenamed("version", "key_version"))


@query("WITH p AS (SELECT user_id % 50 AS page, event_id AS pos, (event_id * 7) % 1000 AS cv FROM events) SELECT page, pos, CASE WHEN cv <= max(cv) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'Duplicate' ELSE 'Applied' END AS status FROM p")
def replica_page_status(spark, d):
    return cdc.page_status(tables.table(spark, d, "events").selectExpr("user_id % 50 AS page", "event_id AS pos", "(event_id * 7) % 1000 AS commit_version"))


@query("SELECT (o_orderkey % 4)::INTEGER AS shard, o_orderkey AS commit_version FROM orders WHERE (o_orderkey % 4 = 0 AND o_orderkey >= 500) OR (o_orderkey % 4 = 1 AND o_orderkey >= 900) OR o_orderkey % 4 > 1")
def replica_evict_superseded(spark, d):
    pages = tables.table(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("shard"), F.col("o_orderkey").alias("commit_version"))
    return cdc.evict_superseded(pages, spark.createDataFrame([(0, 500), (1, 900)], "shard int, version long")).select("shard", "commit_version")


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 0 THEN 'ForbiddenNamespace' WHEN NOT (n_regionkey IN (0, 1, 2)) THEN 'OutOfScope' WHEN n_nationkey % 2 = 1 THEN 'NotAdmitted' ELSE 'Admitted' END AS verdict FROM (SELECT 'r' || n_regionkey || '/' || n_name AS n_name, n_regionkey, n_nationkey FROM nation)")
def scope_snapshot_admission(spark, d):
    n = tables.table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name")).alias("key"), "n_nationkey")
    return cdc.admit_scope(n, ["r0/", "r1/", "r2/"], ["r0/"], F.col("n_nationkey") % 2 == 0)


FACTS = "fa AS (SELECT 's' || user_id % 5 AS source, 'f' || user_id AS fact, max(event_id) AS fact_version, arg_max_null(CASE WHEN event_type <> 'error' THEN value END, event_id) AS value FROM events GROUP BY ALL)"


@query(f"WITH {FACTS} SELECT source, fact, fact_version, value FROM fa WHERE value IS NOT NULL")
def facts_at(spark, d):
    e = tables.table(spark, d, "events")
    return cdc.facts_at(e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("fact"), F.col("event_id").alias("fact_version"), F.when(F.col("event_type") != "error", F.col("value")).alias("value")))


@query("WITH f AS (SELECT user_id % 6 AS source, event_id AS pos, event_id // 40 - (event_id % 13 = 0)::INT AS watermark, event_id // 700 AS epoch, 'd' || event_id // 80 AS digest FROM events), l AS (SELECT *, lag(watermark) OVER w AS m, lag(epoch) OVER w AS e, lag(digest) OVER w AS g FROM f WINDOW w AS (PARTITION BY source ORDER BY pos)) SELECT source, pos, CASE WHEN epoch <> e THEN 'WrongEpoch' WHEN watermark < m THEN 'Regressed' WHEN watermark = m AND digest = g THEN 'Duplicate' ELSE 'Applied' END AS status FROM l")
def projection_feed(spark, d):
    f = tables.table(spark, d, "events").selectExpr("user_id % 6 AS source", "event_id AS pos", "event_id div 40 - int(event_id % 13 = 0) AS watermark", "event_id div 700 AS epoch", "concat('d', event_id div 80) AS digest")
    return cdc.feed_report(f)


@query("SELECT n_nationkey AS c, CASE WHEN n_nationkey > 20 THEN 'Invalid' WHEN n_nationkey + 1 < 8 THEN 'Snapshot' WHEN n_nationkey = 20 THEN 'Current' ELSE 'Diffs' END AS how FROM nation")
def feed_resume(spark, d):
    return tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("c"), cdc.resume(F.col("n_nationkey"), F.lit(8), F.lit(20)).alias("how"))


@query("SELECT * FROM (VALUES (0, NULL), (1, 'SchemaChanged'), (2, 'OwnershipChanged'), (3, 'Revocation'), (4, 'FactSetChanged'), (5, 'FactSetChanged'), (6, 'PolicyChanged')) t(kind, cause) WHERE (SELECT count(*) FROM nation) > 0")
def invalidation_cause(spark, d):
    n = tables.table(spark, d, "nation").select(F.col("n_name").alias("fact"), F.lit("text").alias("type"), F.lit("a").alias("owner"), F.lit(False).alias("revoked"), F.col("n_regionkey").cast("string").alias("value"), "n_nationkey")
    at = lambda column, value: n.withColumn("value", F.lit("x")).withColumn(column, F.when(F.col("n_nationkey") == 12, F.lit(value)).otherwise(F.col(column)))
    changed = [n, at("type", "u64"), at("owner", "b"), at("revoked", True), n.withColumn("value", F.lit("x")), n.where("n_nationkey <> 3"), n]
    out = [cdc.invalidation(n, new, "PolicyChanged" if kind == 6 else None).select(F.lit(kind).alias("kind"), "cause") for kind, new in enumerate(changed)]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


# ---------------------------------------------------------------- events
EV = "ev AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_id, event_type, value FROM events)"
CU = "cu AS (SELECT user_id AS key, (count(*) // 2)::BIGINT AS acked FROM events WHERE user_id % 3 <> 0 GROUP BY 1)"


def cursors(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("key")).agg(F.expr("count(*) div 2").alias("acked"))


@query("SELECT event_id::BIGINT AS event_id, min(value) AS value FROM (SELECT event_id // 3 AS event_id, value FROM events) GROUP BY 1")
def event_dedupe(spark, d):
    return events.dedupe(tables.table(spark, d, "events").select(F.expr("event_id div 3").alias("event_id"), "value"))


@query(f"WITH {EV}, {CU} SELECT key, greatest(max(sequence) - coalesce(any_value(acked), 0), 0)::BIGINT AS lag FROM ev LEFT JOIN cu USING (key) GROUP BY 1")
def event_lag(spark, d):
    return events.lag(tables.event_log(spark, d), cursors(spark, d))


@query(f"WITH {EV}, {CU}, l AS (SELECT key, greatest(max(sequence) - coalesce(any_value(acked), 0), 0) AS lag FROM ev LEFT JOIN cu USING (key) GROUP BY 1) SELECT sum(lag)::BIGINT AS total_lag FROM l")
def event_total_lag(spark, d):
    return events.total_lag(tables.event_log(spark, d), cursors(spark, d))


@query(f"WITH {EV}, {CU} SELECT key, sequence, event_id FROM ev LEFT JOIN cu USING (key) WHERE sequence = coalesce(acked, 0) + 1")
def event_next_per_key(spark, d):
    return events.read(tables.event_log(spark, d), cursors(spark, d)).select("key", "sequence", "event_id")


@query(f"WITH {EV}, {CU} SELECT count(*) AS n FROM ev LEFT JOIN cu USING (key) WHERE sequence >= coalesce(acked, 0) + 1")
def event_read_compact(spark, d):
    return events.read(tables.event_log(spark, d), cursors(spark, d), exactly=False).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, {CU}, f AS (SELECT key, acked + 1 AS sequence, key % 2 = 1 AS due FROM cu WHERE key % 4 < 2), c AS (SELECT key, sequence, 'retry' AS kind, 0 AS rank FROM f WHERE due UNION ALL SELECT key, sequence, 'new', 1 FROM ev LEFT JOIN cu USING (key) WHERE sequence = coalesce(acked, 0) + 1 AND key NOT IN (SELECT key FROM f)) SELECT key, sequence, kind FROM c ORDER BY rank, key, sequence LIMIT 60")
def event_poll(spark, d):
    c = cursors(spark, d)
    flight = c.where("key % 4 < 2").select("key", (F.col("acked") + 1).alias("sequence"), (F.col("key") % 2 == 1).alias("due"))
    return events.poll(tables.event_log(spark, d), c, flight, 60, 1 << 40)


@query(f"WITH {CU}, f AS (SELECT user_id AS key, (count(*) * 3 // 4)::BIGINT AS floor FROM events GROUP BY 1) SELECT key, acked, floor FROM cu JOIN f USING (key) WHERE acked + 1 < floor")
def event_retention_gap(spark, d):
    floor = tables.table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.expr("count(*) * 3 div 4").alias("floor"))
    return events.retention_gaps(cursors(spark, d), floor)


@query("SELECT event_id, least(least(200 * (1::BIGINT << least(event_id % 12, 40)::INT), 60000) + event_id % (least(200 * (1::BIGINT << least(event_id % 12, 40)::INT), 60000) // 4 + 1), 60000)::BIGINT AS delay FROM events")
def event_backoff(spark, d):
    return tables.table(spark, d, "events").select("event_id", events.backoff(F.col("event_id") % 12 + 1, 200, 60_000, F.col("event_id")).alias("delay"))


SETTLE = "se AS (SELECT user_id AS key, event_id AS sequence, event_id % 6 + 1 AS attempt, 0 AS first_at, event_id * 10 AS now, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'permanent' WHEN 2 THEN 'panic' ELSE 'retryable' END AS outcome FROM events), sr AS (SELECT *, CASE outcome WHEN 'success' THEN 'Acked' WHEN 'permanent' THEN 'DeadLettered:PermanentFailure' WHEN 'panic' THEN 'DeadLettered:Panic' ELSE CASE WHEN now >= 5000 THEN 'DeadLettered:RetryTimeExhausted' WHEN attempt >= 5 THEN 'DeadLettered:RetryBudgetExhausted' ELSE 'Retried' END END AS result FROM se)"


def settled(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events").selectExpr("user_id AS key", "event_id AS sequence", "event_id % 6 + 1 AS attempt", "0L AS first_at", "event_id * 10 AS now", "CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'permanent' WHEN 2 THEN 'panic' ELSE 'retryable' END AS outcome")
    return events.settle(e, 5, 5000, 100, 3000)


@query(f"WITH {SETTLE} SELECT key, sequence, result, CASE WHEN result = 'Retried' THEN now + least(100 * (1::BIGINT << (attempt - 1)::INT), 3000) END::BIGINT AS retry_at FROM sr")
def event_settle(spark, d):
    return settled(spark, d)


@query(f"WITH {SETTLE} SELECT key, sequence, split_part(result, ':', 2) AS reason FROM sr WHERE result LIKE 'DeadLettered%'")
def event_dead_letters(spark, d):
    return events.dead_letters(settled(spark, d))


@query(f"WITH {SETTLE} SELECT key, sequence, 'ops:redrive:' || split_part(result, ':', 2) AS audit, CASE WHEN sequence % 4 = 1 THEN 'Acked' ELSE 'DeadLettered' END AS result FROM sr WHERE result LIKE 'DeadLettered%'")
def event_redrive(spark, d):
    letters = events.dead_letters(settled(spark, d))
    outcomes = letters.select("key", "sequence", F.when(F.col("sequence") % 4 == 1, "success").otherwise("permanent").alias("outcome"))
    return events.redrive(letters, outcomes, "ops")


ADMIT = "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, CASE WHEN user_id % 6 = 0 THEN 2 WHEN user_id % 6 = 1 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) END AS pending, event_id % 2 = 0 AS retry_due, event_id % 11 = 0 AS done, event_id % 13 = 0 AS dead, 2 AS acked, CASE WHEN user_id % 7 = 0 THEN 4 ELSE 0 END AS floor, user_id % 9 AS in_flight, event_id % 17 <> 0 AS known_schema FROM events"


@query(f"WITH a AS ({ADMIT}) SELECT key, sequence, CASE WHEN pending IS NOT NULL AND pending <> sequence THEN 'Blocked' WHEN pending IS NOT NULL AND NOT retry_due THEN 'RetryNotDue' WHEN pending IS NOT NULL THEN 'Ready' WHEN done THEN 'Duplicate:Completed' WHEN dead THEN 'Duplicate:DeadLettered' WHEN sequence <= acked THEN 'Duplicate:BehindCursor' WHEN acked < floor OR sequence < floor THEN 'CursorExpired' WHEN sequence > acked + 1 THEN 'SequenceGap' WHEN in_flight >= 7 THEN 'TooSlow' WHEN NOT known_schema THEN 'DeadLettered:Poison' ELSE 'Ready' END AS outcome FROM a")
def event_admission(spark, d):
    nth = "row_number() OVER (PARTITION BY user_id ORDER BY event_id)"
    rows = tables.table(spark, d, "events").selectExpr(
        "user_id AS key", f"bigint({nth}) AS sequence", f"CASE WHEN user_id % 6 = 0 THEN 2 WHEN user_id % 6 = 1 THEN {nth} END AS pending", "event_id % 2 = 0 AS retry_due", "event_id % 11 = 0 AS done",
        "event_id % 13 = 0 AS dead", "2 AS acked", "CASE WHEN user_id % 7 = 0 THEN 4 ELSE 0 END AS floor", "user_id % 9 AS in_flight", "event_id % 17 <> 0 AS known_schema",
    )
    return events.admission(rows, 7)


@query(f"WITH {EV}, {CU}, pd AS (SELECT ev.key, event_id, event_id * 10 AS retry_at FROM ev JOIN cu USING (key) WHERE sequence = acked + 1 AND key % 4 = 1) SELECT ev.key, sequence, CASE WHEN pd.event_id <> ev.event_id THEN 'Blocked' WHEN pd.event_id IS NOT NULL AND retry_at <= 4000 THEN 'Ready' WHEN pd.event_id IS NOT NULL THEN 'RetryNotDue' WHEN ev.event_id % 10 = 0 THEN 'Duplicate:Completed' WHEN ev.event_id % 13 = 0 THEN 'Duplicate:DeadLettered' WHEN sequence <= coalesce(acked, 0) THEN 'Duplicate:BehindCursor' WHEN coalesce(acked, 0) < 1 THEN 'CursorExpired' WHEN sequence > acked + 1 THEN 'SequenceGap' WHEN event_type = 'error' THEN 'DeadLettered:Poison' ELSE 'Ready' END AS outcome FROM ev LEFT JOIN cu ON cu.key = ev.key LEFT JOIN pd ON pd.key = ev.key")
def event_begin(spark, d):
    log, c = tables.event_log(spark, d), cursors(spark, d)
    flight = events.read(log, c).where("key % 4 = 1 AND key % 3 <> 0").select("key", "event_id", (F.col("event_id") * 10).alias("retry_at"))
    seen = lambda n: log.where(F.col("event_id") % n == 0).select("key", "event_id")
    return events.begin(log.withColumnRenamed("event_type", "schema"), c, flight, seen(10), seen(13), 1, ["click", "view", "purchase", "signup"], 1 << 30, 4000)


@query(f"WITH {EV}, l AS (SELECT key, sequence, sequence - lag(sequence) OVER (PARTITION BY key ORDER BY sequence) AS step FROM ev WHERE event_id % 10 <> 0) SELECT key, sequence - step AS after, step - 1 AS missing FROM l WHERE step > 1")
def event_sequence_gaps(spark, d):
    return events.sequence_gaps(tables.event_log(spark, d).where("event_id % 10 <> 0"))


@query("SELECT o_orderkey::VARCHAR AS key, emission::INTEGER AS emission, payload, sha256('event' || chr(31) || (o_orderkey % 4) || chr(31) || o_orderkey || chr(31) || 3 || chr(31) || 'r' || chr(31) || emission) AS event_id FROM (SELECT o_orderkey, unnest([0, 1]) AS emission, unnest([o_orderstatus, o_orderpriority]) AS payload FROM orders WHERE o_orderstatus <> 'P')")
def event_emit(spark, d):
    o = tables.table(spark, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "P", "Conflict").otherwise("Committed")
    commits = o.select((F.col("o_orderkey") % 4).alias("shard"), F.col("o_orderkey").cast("string").alias("key"), F.lit(3).alias("version"), F.lit("r").alias("rule"), outcome.alias("outcome"), F.array("o_orderstatus", "o_orderpriority").alias("drafts"))
    return events.emit(commits).select("key", F.col("emission").cast("int").alias("emission"), "payload", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def operational_feed(spark, d):
    return events.operational(tables.table(spark, d, "events").withColumnRenamed("event_type", "kind"), ["error"]).select("event_id")


# ---------------------------------------------------------------- staleness
@query("SELECT (SELECT max(event_id) FROM events) - 40 AS version_lag")
def version_lag(spark, d):
    top = tables.table(spark, d, "events").agg(F.max("event_id").alias("version")).select(F.lit(0).alias("shard"), "version").unionByName(spark.createDataFrame([(1, 30), (2, 5)], "shard int, version long"))
    return staleness.version_lag(top, spark.createDataFrame([(0, 40), (1, 60)], "shard int, version long"))


STALE = f"{FACTS}, fd AS (SELECT fact, source, fact_version % 30 + 100 AS bound FROM fa), wm AS (SELECT source, min(fact_version) AS watermark, max(fact_version) AS observed FROM fa GROUP BY 1), st AS (SELECT source, min(bound) AS bound FROM fd WHERE fact IN ('f1', 'f2', 'f7', 'f13') GROUP BY 1), sr AS (SELECT source, bound, greatest(observed - watermark, 0)::BIGINT AS distance, greatest(observed - watermark, 0) <= bound AS within FROM st LEFT JOIN wm USING (source))"


def fact_reports(spark: SparkSession, d: str) -> DataFrame:
    f = facts_raw(spark, d)
    facts = f.select("fact", "source", (F.col("fact_version") % 30 + 100).alias("bound"))
    marks = f.groupBy("source").agg(F.min("fact_version").alias("watermark"), F.max("fact_version").alias("observed"))
    wanted = spark.createDataFrame([("f1",), ("f2",), ("f7",), ("f13",), ("f7",)], "fact string")
    return staleness.fact_staleness(wanted, facts, marks.select("source", "watermark"), marks.select("source", "observed"))


def facts_raw(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    return e.groupBy(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("fact")).agg(F.max("event_id").alias("fact_version"))


@query(f"WITH {STALE} SELECT * FROM sr")
def fact_staleness(spark, d):
    return fact_reports(spark, d)


@query(f"WITH {STALE} SELECT CASE WHEN bool_and(within) THEN 'Allow' ELSE 'Queue:projection_lagging' END AS decision FROM sr")
def staleness_authorize(spark, d):
    return staleness.authorize(fact_reports(spark, d), "default", False)


CAPS = {"TooManySources": ["f1", "f2", "f3"], "TooManyFacts": ["f1", "f2", "f3", "f4", "f6", "f7"], "UnknownFact": ["f1", "none"], "Ok": ["f1", "f6", "f1"]}


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT count(DISTINCT fact) AS facts, count(DISTINCT source) AS sources, '{verdict}' AS verdict FROM fa WHERE fact IN ({', '.join(map(repr, wanted))})" for verdict, wanted in CAPS.items()))
def read_set_caps(spark, d):
    parts = [staleness.read_set(facts_raw(spark, d), wanted, 5, 2) for wanted in CAPS.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH r AS (SELECT event_id, event_id % 20 AS p0, event_id % 7 AS p1, event_id % 9 AS m0, event_id % 15 AS a0, event_id % 8 AS a1, event_id % 29 = 0 AS pin_expired, event_id % 31 <> 0 AS hydrated, event_id % 3 = 0 AS resident, event_id % 2 = 0 AS needs, event_id % 4 = 1 AS ryw, event_id % 5 < 2 AS at_least, event_id % 6 = 0 AS cov FROM events),
l AS (SELECT *, CASE WHEN at_least THEN greatest(25 - a0, 0) ELSE greatest(25 - p0, 0) END AS l0, CASE WHEN at_least THEN greatest(9 - a1, 0) ELSE greatest(9 - p1, 0) END AS l1, a0 >= m0 AS meets, a0 >= p0 AND a1 >= p1 AS full_ FROM r)
SELECT event_id AS read_id, CASE WHEN pin_expired THEN 'PinExpired' WHEN NOT hydrated THEN 'NotHydrated' WHEN needs AND NOT resident THEN 'NotResident' WHEN ryw AND NOT meets THEN 'Blocked' WHEN NOT at_least AND p0 < m0 THEN 'BehindCommit'
WHEN NOT at_least AND NOT full_ THEN CASE WHEN ryw THEN 'Blocked' ELSE 'BehindCommit' END WHEN at_least AND NOT meets THEN CASE WHEN ryw THEN 'Blocked' ELSE 'BehindCommit' END WHEN at_least AND NOT cov AND NOT full_ THEN CASE WHEN ryw THEN 'Blocked' ELSE 'BehindCommit' END
WHEN greatest(l0, l1) > 18 THEN 'Stale' ELSE 'Served' END AS outcome, greatest(l0, l1)::BIGINT AS served_lag FROM l""")
def read_admission(spark, d):
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, int) else x for x in kv])
    e = F.col("event_id")
    rows = tables.table(spark, d, "events").select(
        e.alias("read_id"), m(0, e % 20, 1, e % 7).alias("pin"), m(0, e % 9, 5, e % 3).alias("minimum"), m(0, e % 15, 1, e % 8).alias("applied"), F.create_map(F.lit(0), F.lit(25).cast("long"), F.lit(1), F.lit(9).cast("long")).alias("watermark"),
        (e % 29 == 0).alias("pin_expired"), (e % 31 != 0).alias("hydrated"), (e % 3 == 0).alias("resident"), (e % 2 == 0).alias("needs_resident"), (e % 4 == 1).alias("read_your_writes"), (e % 5 < 2).alias("at_least"), (e % 6 == 0).alias("coverage"),
        F.lit(18).alias("max_lag"), F.lit(None).cast("long").alias("max_silence"), F.lit(5).alias("silence"),
    )
    return staleness.admit_reads(rows)


@query("SELECT event_id, greatest(event_id % 5, event_id % 7) AS a, event_id % 3 AS b, event_id % 4 AS c FROM events")
def session_raise(spark, d):
    e = F.col("event_id")
    up = staleness.raise_session(F.create_map(F.lit("a"), e % 5, F.lit("b"), e % 3), F.create_map(F.lit("a"), e % 7, F.lit("c"), e % 4))
    return tables.table(spark, d, "events").select("event_id", up.alias("m")).select("event_id", F.col("m.a"), F.col("m.b"), F.col("m.c"))


@query("SELECT event_id, event_id % 5 >= event_id % 3 AND event_id % 7 >= event_id % 4 AS ok FROM events")
def vector_entails(spark, d):
    e = F.col("event_id")
    return tables.table(spark, d, "events").select("event_id", mvcc.entails(F.create_map(F.lit("a"), e % 5, F.lit("b"), e % 7), F.create_map(F.lit("a"), e % 3, F.lit("b"), e % 4)).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id >= 900 THEN 'Expired' WHEN event_id % 50 < 20 THEN 'Snapshot' ELSE 'Resumed' END AS how FROM events")
def session_resume(spark, d):
    return tables.table(spark, d, "events").select("event_id", staleness.resume(F.col("event_id") % 50, F.lit(20), F.lit(900), F.col("event_id")).alias("how"))


# ---------------------------------------------------------------- writes
PROPOSED = "pr AS (SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'x' END AS expected, 'new' AS new, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS current FROM customer)"


def proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = tables.table(spark, d, "customer")
    state = c.where("c_custkey % 6 <> 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    expected = F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 2, "x")
    return state, c.select(F.col("c_name").alias("key"), expected.alias("expected"), F.lit("new").alias("new"), (F.col("c_custkey") % 40).alias("tx"))


@query(f"WITH {PROPOSED} SELECT key, CASE WHEN expected IS NOT DISTINCT FROM current THEN 'Applied' ELSE 'Conflict' END AS outcome, CASE WHEN expected IS NOT DISTINCT FROM current THEN new ELSE current END AS value FROM pr")
def cas_apply(spark, d):
    state, p = proposals(spark, d)
    return store.compare_and_set(state, p)


@query("WITH p AS (SELECT c_custkey % 40 AS tx, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 3 = 2 THEN 'x' END IS NOT DISTINCT FROM CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS ok FROM customer) SELECT tx, bool_and(ok) AS committed, count(*) FILTER (NOT ok) AS failed FROM p GROUP BY 1")
def txcas_commit(spark, d):
    state, p = proposals(spark, d)
    return store.commit_checked(state, p)


MUT = "mu AS (SELECT l_orderkey AS request, l_linenumber AS pos, l_partkey AS key, l_orderkey % 3 AS base FROM lineitem), cv AS (SELECT p_partkey AS key, p_size % 3 AS version FROM part WHERE p_partkey % 10 <> 0), mb AS (SELECT request, pos, CASE WHEN base > coalesce(version, 0) THEN 'Rejected' WHEN base < coalesce(version, 0) THEN 'Conflict' END AS bad FROM mu LEFT JOIN cv USING (key))"


def mutations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = tables.table(spark, d, "lineitem")
    current = tables.table(spark, d, "part").where("p_partkey % 10 <> 0").selectExpr("p_partkey AS key", "p_size % 3 AS version")
    return l.selectExpr("l_orderkey AS request", "l_linenumber AS pos", "l_partkey AS key", "l_orderkey % 3 AS base"), current


@query(f"WITH {MUT} SELECT request, coalesce(arg_min(bad, 2 * pos + (bad <> 'Rejected')::INTEGER) FILTER (bad IS NOT NULL), 'Pass') AS verdict FROM mb GROUP BY 1")
def write_conflict_detect(spark, d):
    m, current = mutations(spark, d)
    return write.check_versions(m, current)


@query("SELECT o_custkey::VARCHAR AS client, o_orderpriority AS idempotency_key, count(*) AS n, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'KeyReused' ELSE 'Recorded' END AS status FROM orders GROUP BY ALL")
def receipts_idempotent(spark, d):
    return write.receipts(tables.table(spark, d, "orders").selectExpr("string(o_custkey) AS client", "o_orderpriority AS idempotency_key", "o_orderstatus AS body"))


SCHED = "sq AS (SELECT event_id AS request, (user_id % 4)::INTEGER AS shard, user_id AS key, event_id AS arrival, event_id % 50 = 0 AS in_flight, event_id % 3 <> 0 AS deps_done, user_id % 4 = 2 AS shard_blocked FROM events), sn AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY in_flight DESC, arrival, request) AS nth, max(in_flight::INT) OVER (PARTITION BY shard, key) = 1 AS busy FROM sq), sr AS (SELECT *, CASE WHEN in_flight THEN 'InFlight' WHEN shard_blocked THEN 'ShardBlocked' WHEN busy OR nth > 1 THEN 'KeyBlocked' WHEN NOT deps_done THEN 'DependencyBlocked' END AS reason FROM sn)"


@query(f"WITH {SCHED} SELECT request, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY shard, reason IS NULL ORDER BY arrival, request) > 5 THEN 'OutsideBudget' ELSE 'Selected' END) AS reason FROM sr")
def scheduler_ready(spark, d):
    q = tables.table(spark, d, "events").selectExpr("event_id AS request", "int(user_id % 4) AS shard", "user_id AS key", "event_id AS arrival", "event_id % 50 = 0 AS in_flight", "event_id % 3 <> 0 AS deps_done", "user_id % 4 = 2 AS shard_blocked")
    return write.schedule(q, 5)


@query("WITH e AS (SELECT event_id AS entry, user_id AS key, CASE WHEN event_id % 7 = 0 THEN 'InFlight' WHEN event_id % 2 = 0 THEN 'Queued' ELSE 'Done' END AS state FROM events) SELECT entry, state = 'Queued' AND NOT bool_or(state = 'InFlight') OVER (PARTITION BY key) AND entry = coalesce(min(entry) FILTER (state = 'Queued') OVER (PARTITION BY key), -1) AS claimed FROM e")
def outbox_claims(spark, d):
    e = tables.table(spark, d, "events").selectExpr("event_id AS entry", "user_id AS key", "CASE WHEN event_id % 7 = 0 THEN 'InFlight' WHEN event_id % 2 = 0 THEN 'Queued' ELSE 'Done' END AS state")
    return write.outbox_claims(e).select("entry", F.coalesce("claimed", F.lit(False)).alias("claimed"))


@query("WITH f AS (SELECT DISTINCT event_id AS entry, user_id AS key FROM events), s AS (SELECT *, min(entry) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS n FROM f) SELECT * FROM s WHERE n > 1")
def outbox_shared_keys(spark, d):
    return write.share_keys(tables.table(spark, d, "events").select(F.col("event_id").alias("entry"), F.array("user_id", "user_id").alias("keys")))


@query("SELECT event_id AS request, CASE WHEN event_id % 41 = 0 THEN 'Rejected:Unauthenticated' WHEN event_id % 37 = 0 THEN 'Replayed' WHEN event_id % 31 = 0 THEN 'Rejected:KeyReused' WHEN event_id % 29 = 0 THEN 'Rejected:TooManyRows' WHEN event_id % 23 = 0 THEN 'Rejected:CrossShard' WHEN event_id % 19 = 0 THEN 'Rejected:ProjectionWrite' WHEN event_id % 17 = 0 THEN 'Rejected:MissingBase' WHEN event_id % 4 > 2 THEN 'Rejected:StaleBase' WHEN event_id % 4 < 1 THEN 'Conflict' WHEN event_id % 13 = 0 THEN 'Rejected:ProjectionChecksum' WHEN event_id % 11 = 0 THEN 'Rejected:WatermarkRegression' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'Rejected:StaleFacts' WHEN event_id % 7 = 0 THEN 'Queued' WHEN event_id % 5 = 0 THEN 'Rejected:Policy' ELSE 'Committed' END AS outcome FROM (SELECT event_id, event_id % 4 AS v FROM events) WHERE v <> 1 OR true")
def enforcement_ladder(spark, d):
    rows = tables.table(spark, d, "events").selectExpr(
        "event_id AS request", "event_id % 41 <> 0 AS authenticated", "event_id % 37 = 0 AS replayed", "event_id % 31 = 0 AS reused", "IF(event_id % 29 = 0, 2000, 3) AS rows", "IF(event_id % 23 = 0, 2, 1) AS shards", "event_id % 19 = 0 AS writes_projection",
        "IF(event_id % 17 = 0, NULL, event_id % 4) AS base", "CASE WHEN event_id % 4 > 2 THEN 2 WHEN event_id % 4 < 1 THEN 1 ELSE event_id % 4 END AS version", "event_id % 13 <> 0 AS checksum_ok", "event_id % 11 = 0 AS regressed", "event_id % 7 = 0 AS over_bound", "event_id % 2 = 0 AS strict", "event_id % 5 <> 0 AS policy_ok",
    )
    return write.enforce(rows)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 100 <= 60 THEN 'Rejected' WHEN o_orderstatus = 'O' THEN 'Queued' ELSE 'Committed' END AS state FROM orders")
def expire_queued(spark, d):
    r = tables.table(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderstatus = 'O', 'Queued', 'Committed') AS state", "o_orderkey % 100 AS deadline")
    return write.expire_queued(r, 60).select("o_orderkey", "state")


@query("SELECT event_id // 100 AS version, count(*) AS n, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS keys FROM events GROUP BY 1")
def commit_summary(spark, d):
    return write.changes(tables.table(spark, d, "events").selectExpr("event_id div 100 AS version", "string(user_id) AS key"))


@query("SELECT (user_id % 4)::INTEGER AS shard, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq, CASE WHEN event_id % 100 = 7 THEN 'WrongHash' ELSE 'Ok' END AS status FROM events")
def audit_verify(spark, d):
    ship(spark)
    e = tables.table(spark, d, "events").selectExpr("int(user_id % 4) AS shard", "row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq", "string(event_id) AS body")
    chain = write.audit_chain(e)
    # a changed body does not fit its hash
    return write.audit_verify(chain.withColumn("body", F.when(F.col("body").cast("long") % 100 == 7, "changed").otherwise(F.col("body"))))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (o_totalprice > 1000) THEN 'price' END, CASE WHEN NOT (o_orderstatus <> 'P') THEN 'status' END) AS refused FROM orders")
def write_validators(spark, d):
    o = tables.table(spark, d, "orders")
    return write.validated(o, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"}).select("o_orderkey", "refused")


@query("SELECT o_orderkey, unnest(['log', 'feed']) AS hook FROM orders WHERE o_orderstatus <> 'P'")
def write_notify(spark, d):
    o = write.validated(tables.table(spark, d, "orders"), {"status": F.col("o_orderstatus") != "P"})
    return write.notify(o, ["log", "feed"]).select("o_orderkey", "hook")


@query("SELECT count(*) AS pages, sum(octet_length(n_name::BLOB))::BIGINT AS bytes, sha256(sha256(string_agg(sha256(n_name), '' ORDER BY n_nationkey))) AS digest FROM nation")
def backup_manifest(spark, d):
    return write.backup_manifest(tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("body")))


@query("SELECT count(*) FILTER (o_orderkey % 9 = 0 OR o_orderkey % 50 > 25) AS kept, count(*) FILTER (NOT (o_orderkey % 9 = 0 OR o_orderkey % 50 > 25)) AS expired FROM orders")
def restore_split(spark, d):
    rows = tables.table(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 9 = 0, NULL, o_orderkey % 50) AS expires")
    kept, gone = write.restore_split(rows, 25)
    return kept.agg(F.count("*").alias("kept")).crossJoin(gone.agg(F.count("*").alias("expired")))  # one row each


@query("WITH s AS (SELECT s_suppkey AS shard, s_nationkey % 5 = 0 AS paused, 10 AS target, CASE WHEN s_nationkey % 4 = 1 THEN 3 ELSE 12 END AS pin, s_suppkey % 3 AS files, 100 AS bytes FROM supplier), r AS (SELECT *, sum(CASE WHEN NOT paused AND NOT pin < target AND files > 1 THEN bytes ELSE 0 END) OVER (ORDER BY shard) AS total FROM s) SELECT shard, CASE WHEN paused THEN 'Paused' WHEN pin < target THEN 'Blocked' WHEN files <= 1 THEN 'Idle' WHEN total <= 900 THEN 'Ran' ELSE 'Deferred' END AS action FROM r")
def compaction_pass(spark, d):
    from .operators import cost

    s = tables.table(spark, d, "supplier").selectExpr("s_suppkey AS shard", "s_nationkey % 5 = 0 AS paused", "10 AS target", "IF(s_nationkey % 4 = 1, 3, 12) AS pin", "s_suppkey % 3 AS files", "100 AS bytes")
    return cost.compaction_pass(s, 900)


@query("WITH r AS (SELECT o_orderkey AS request, 'c' || o_custkey AS client, o_orderpriority AS ikey, o_orderstatus AS body, o_orderkey % 19 <> 0 AS shard_ok, CASE WHEN o_orderkey % 23 = 0 THEN 3000 ELSE 1 END AS rows, o_orderkey % 11 <> 0 AS allowed, (o_orderkey % 3)::BIGINT AS base, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 3 ELSE 0 END AS version FROM orders), s AS (SELECT *, first_value(body) OVER w AS first_body, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY client, ikey ORDER BY request)) SELECT request, CASE WHEN nth > 1 AND body = first_body THEN 'Replayed' WHEN nth > 1 THEN 'KeyReused' WHEN rows > 1024 THEN 'TooManyRows' WHEN NOT shard_ok THEN 'CrossShard' WHEN base > version THEN 'StaleBase' WHEN base < version THEN 'Conflict' WHEN NOT allowed THEN 'Denied' ELSE 'Committed' END AS outcome FROM s")
def write_submit(spark, d):
    o = tables.table(spark, d, "orders")
    requests = o.selectExpr("o_orderkey AS request", "concat('c', o_custkey) AS client", "o_orderpriority AS idempotency_key", "o_orderstatus AS body", "o_orderkey % 19 <> 0 AS shard_ok", "IF(o_orderkey % 23 = 0, 3000, 1) AS rows", "o_orderkey % 11 <> 0 AS allowed", "array(named_struct('pos', 0, 'key', o_custkey, 'base', o_orderkey % 3)) AS mutations")
    current = o.where("o_custkey % 10 <> 0").selectExpr("o_custkey AS key", "o_custkey % 3 AS version").distinct()
    return write.submit(requests, current)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT lower(w) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents))")
def index_vocabulary(spark, d):
    b = tables.table(spark, d, "documents")
    docs = b.select(F.lit(0).alias("shard"), F.col("doc_id").cast("string").alias("key"), F.lit(1).cast("long").alias("version"), F.lit("text").alias("field"), "text", F.lit(0).cast("long").alias("filter_flags"), F.lit(0).cast("long").alias("search_flags"))
    return index.postings(docs).select("term").distinct().agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- gates, pages, pins
@query("SELECT event_id AS read_id, event_id % 6 <> 0 AND event_type = 'click' AS allowed, CASE WHEN event_id % 6 = 0 THEN 'Unauthenticated' WHEN event_type = 'click' THEN '' ELSE 'False' END AS reason FROM events")
def read_gate(spark, d):
    row = F.struct(F.col("event_type").alias("kind"))
    reads = tables.table(spark, d, "events").select(F.col("event_id").alias("read_id"), row.alias("before"), row.alias("after"))
    tree = policy.Compare("eq", policy.Path("before", "kind"), policy.Literal("click"))
    return policy.gate_reads(reads, tree, F.col("read_id") % 6 != 0)


@query("SELECT (o_orderkey % 4)::INTEGER AS shard, printf('k%06d', o_orderkey // 2) AS key, CASE WHEN count(*) OVER (PARTITION BY o_orderkey // 2) > 1 THEN 'DuplicateKey' ELSE 'Ok' END AS status FROM orders WHERE o_orderkey % 4 IN (0, 1, 2)")
def scope_gather(spark, d):
    o = tables.table(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("shard"), F.format_string("k%06d", F.expr("o_orderkey div 2")).alias("key"))
    return search.gather(o, spark.createDataFrame([(0,), (1,), (2,)], "shard int"))


@query("WITH s AS (SELECT (o_orderkey % 4)::INTEGER AS shard, o_orderkey AS key, o_custkey % 50 AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, key) AS n FROM s) SELECT shard, key, score FROM r WHERE (shard = 0 AND n > 10) OR (shard = 2 AND n > 25) OR shard IN (1, 3)")
def cost_cursor_rest(spark, d):
    o = tables.table(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("shard"), F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 50).alias("score"))
    return search.CostCursor(100).advance(30, {"0": 10, "2": 20}).advance(5, {"2": 5}).rest(o)


@query("SELECT n_nationkey AS page, CASE WHEN n_nationkey % 7 = 3 THEN 'Corrupt' ELSE 'Verified' END AS status FROM nation")
def hydrate_verify(spark, d):
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("body"), (F.crc32(F.col("n_name").cast("binary")) + F.when(F.col("n_nationkey") % 7 == 3, 1).otherwise(0)).alias("crc"))
    return cdc.verify_pages(n)


@query("SELECT n_nationkey AS page FROM nation WHERE n_nationkey >= 12 OR n_nationkey % 5 = 0")
def hydrate_resume(spark, d):
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.crc32(F.col("n_name").cast("binary")).alias("crc"))
    journal = n.where("page < 12").withColumn("crc", F.when(F.col("page") % 5 == 0, 1).otherwise(F.col("crc")))
    return cdc.left_to_transfer(n, journal).select("page")


@query("SELECT event_id, event_id % 20 >= 5 AND event_id % 7 >= 2 AS ok FROM events")
def pin_retained(spark, d):
    from .operators import cost

    e = F.col("event_id")
    return tables.table(spark, d, "events").select("event_id", cost.pin_readable(F.create_map(F.lit("a"), e % 20, F.lit("b"), e % 7), F.create_map(F.lit("a"), F.lit(5).cast("long"), F.lit("b"), F.lit(2).cast("long"))).alias("ok"))
