"""Queries over the driver's tables: stored tables at a pin, the stored index, rounds of a scheduler, coordinated searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import FLAGS, KV, R1, WORDS, key, query, text_documents
from .engine import View
from .functions.keys import table_bounds
from .functions.text import unicode_words
from .operators import cdc, cost, index, policy, scan, search, staleness, write
from .shipping import ship
from .sources import store, tables
from .sources.commits import CommitTable
from .sources.hydrate import Hydration, page_crc
from .sources.migrate import Migration
from .sources.segments import SegmentIndex
from .sources.shared import scratch

_STORED: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, d: str, make):
    """Stored tables are written once an application and folder."""
    at = (spark.sparkContext.applicationId, name, d)
    if at not in _STORED:
        _STORED[at] = make(scratch(spark, name))
    return _STORED[at]


# ---------------------------------------------------------------- a stored table at a pin
#: Version 1 holds all orders, version 2 deletes each seventh and marks each fifth.
AT1 = f"{KV}, at1 AS (SELECT key, value FROM kv)"
AT2 = f"{KV}, at2 AS (SELECT key, CASE WHEN key[8:]::BIGINT % 5 = 0 THEN replace(value, '\"id\"', '\"marked\":true,\"id\"') ELSE value END AS value FROM kv WHERE key[8:]::BIGINT % 7 <> 0)"


def stored(spark: SparkSession, d: str) -> CommitTable:
    def make(folder: str) -> CommitTable:
        table = CommitTable(spark, folder)
        rows = tables.order_rows(spark, d).withColumn("pos", F.lit(0)).withColumn("n", F.substring("key", 8, 20).cast("long"))
        table.append(rows.select("pos", "key", F.lit("set").alias("op"), "value"), 1)
        marked = F.regexp_replace("value", '"id"', '"marked":true,"id"')
        op = F.when(F.col("n") % 7 == 0, "delete").otherwise("set")
        table.append(rows.where("n % 7 = 0 OR n % 5 = 0").select("pos", "key", op.alias("op"), marked.alias("value")), 2)
        return table

    return once(spark, "stored-orders", d, make)


@query(f"WITH {AT1}, {AT2[len(KV) + 2 :]} SELECT 1 AS pin, key, value FROM at1 WHERE key = '{key(35)}' UNION ALL SELECT 2, key, value FROM at2 WHERE key IN ('{key(5)}', '{key(35)}')")
def view_get(spark, d):
    old, new = View(stored(spark, d), 1), View(stored(spark, d))
    return old.get(key(35)).select(F.lit(1).alias("pin"), "*").unionByName(new.get(key(5)).unionByName(new.get(key(35))).select(F.lit(2).alias("pin"), "*"))


@query(f"WITH {AT2} SELECT * FROM at2 WHERE key BETWEEN '{key(100)}' AND '{key(2000)}' ORDER BY key LIMIT 40 OFFSET 40")
def view_page2(spark, d):
    view = View(stored(spark, d))
    one = view.page(40, 1 << 30, key(100), key(2000))
    return view.page(40, 1 << 30, key(100), key(2000), one.token).rows if one.token else one.rows.where(F.lit(False))


@query(f"WITH {AT2}, s AS (SELECT *, sum(octet_length(key::BLOB) + octet_length(value::BLOB)) OVER (ORDER BY key DESC) AS running FROM at2 WHERE key <= '{key(1000)}') SELECT key, value FROM s WHERE running <= 3000")
def view_page_bytes_prev(spark, d):
    return View(stored(spark, d)).page(500, 3000, None, key(1000), direction="prev").rows


@query(f"WITH {AT2} SELECT * FROM at2 WHERE key > '{key(50)}' AND contains(value, '\"marked\":true') AND contains(value, '\"status\":\"O\"') ORDER BY key LIMIT 25")
def view_gets_query(spark, d):
    return View(stored(spark, d)).gets(25, cursor=(key(50), None), query='marked:"true" AND status:"O"')


@query(f"WITH {AT1}, a(pos, key) AS (VALUES (0, '{key(7)}'), (1, '{key(3)}'), (2, 'nowhere')) SELECT pos::BIGINT AS pos, a.key, value FROM a LEFT JOIN at1 USING (key)")
def view_get_many(spark, d):
    return View(stored(spark, d), 1).get_many([key(7), key(3), "nowhere"])


@query(f"WITH {AT2} SELECT key[8:] AS key, value FROM at2")
def view_scoped(spark, d):
    return View(stored(spark, d)).scoped("orders").rows


@query(f"WITH {AT1} SELECT key FROM at1 WHERE key >= '{key(64)}' AND key <= '{key(640)}'")
def view_contains(spark, d):
    rows = View(stored(spark, d), 1).rows
    return rows.where(scan.key_range(F.col("key"), key(64), key(640))).select("key")


@query(f"WITH {AT2} SELECT key, value FROM at2 WHERE key BETWEEN '{key(100)}' AND '{key(900)}'")
def table_compacted(spark, d):
    def make(folder: str) -> CommitTable:
        table = CommitTable(spark, folder)
        for m, version in ((F.lit(True), 1), (F.col("key") > "", 2)):
            table.append(stored(spark, d).log(pin=version).where((F.col("version") == version) & m).select(F.lit(0).alias("pos"), "key", F.when(F.col("value").isNull(), "delete").otherwise("set").alias("op"), "value"), version)
        table.compact()
        return table

    return once(spark, "compacted-orders", d, make).read(2, key(100), key(900)).select("key", "value")


@query("SELECT n_name AS key, n_nationkey >= 5 AND n_nationkey < 15 AS inside FROM nation")
def key_bounds(spark, d):
    n = tables.table(spark, d, "nation")
    low, high = table_bounds("t")
    name = F.when(F.col("n_nationkey") < 5, "s").when(F.col("n_nationkey") < 15, "t").otherwise("u")
    encoded = F.concat(F.unhex(F.lit("01")), name.cast("binary"), F.unhex(F.lit("00")), F.col("n_name").cast("binary"))
    return n.select(F.col("n_name").alias("key"), ((encoded >= F.lit(low)) & (encoded < F.lit(high))).alias("inside"))


@query("SELECT 's0' AS shard, 'orders/1,customer/,orders/2' AS prefixes UNION ALL SELECT 's2', 'part/'")
def scope_shard_plan(spark, d):
    plan = scan.shard_plan(["orders/1", "part/", "customer/", "orders/2"], tables.shard_map(spark), 2)
    return plan.select("shard", F.array_join("prefixes", ",").alias("prefixes"))


@query(f"WITH {KV} SELECT key, CASE WHEN key[8:]::BIGINT % 6 = 1 THEN 'new' ELSE value END AS value FROM kv WHERE key[8:]::BIGINT % 6 <> 2")
def hydrated_with_tail(spark, d):
    def make(folder: str) -> Hydration:
        out = Hydration(spark, folder)
        rows = tables.order_rows(spark, d).withColumn("page", F.expr("bigint(substring(key, 8, 20)) div 100"))
        plan = page_crc(rows)
        # the first round brings one page of three torn, the second brings all again
        torn = rows.where("page % 3 <> 0 OR bigint(substring(key, 8, 20)) % 7 <> 0")
        out.receive(torn, plan, 0)
        out.receive(rows, plan, 1)
        out.publish(plan, 5)
        return out

    n = F.expr("bigint(substring(key, 8, 20))")
    tail = tables.order_rows(spark, d).where((n % 6 == 1) | (n % 6 == 2) | (n % 6 == 3))
    # those of 3 come before the snapshot, so they change nothing
    tail = tail.select("key", F.when(n % 6 == 3, 4).otherwise(6).cast("long").alias("version"), F.when(n % 6 == 2, "delete").otherwise("set").alias("op"), F.lit("new").alias("value"))
    return once(spark, "hydrated", d, make).read(tail)


@query(f"WITH {KV} SELECT key, value FROM kv")
def stream_round_trip(spark, d):
    ship(spark)
    return store.read_stream(store.export_stream(tables.order_rows(spark, d)))


@query(f"WITH {AT2} SELECT 'm/' || key AS key, value FROM at2 WHERE key BETWEEN '{key(10)}' AND '{key(300)}'")
def migrated_epoch(spark, d):
    def make(folder: str) -> Migration:
        out = Migration(spark, f"{folder}/pointer", stored(spark, d).folder, f"{folder}/epoch2", lambda rows: rows.select(F.concat(F.lit("m/"), "key").alias("key"), "value"))
        out.run()
        return out

    low, high = f"m/{key(10)}", f"m/{key(300)}"
    return once(spark, "migrated", d, make).current().read(None, low, high).select("key", "value")


CALLS = "cl AS (SELECT CASE event_id % 8 WHEN 0 THEN 'get' WHEN 1 THEN 'has' WHEN 2 THEN 'set' WHEN 3 THEN 'put' WHEN 4 THEN 'delete' WHEN 5 THEN 'scan' WHEN 6 THEN 'commit' ELSE 'rollback' END AS kind, event_id % 13 AS items, event_id % 101 AS bytes, event_type = 'error' AS failed FROM events)"


@query(f"WITH {CALLS} SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in (("gets", "get"), ("has", "has"), ("sets", "set"), ("puts", "put"), ("deletes", "delete"), ("scans", "scan"), ("tx_commits", "commit"), ("tx_rollbacks", "rollback"))) + ", sum(items) FILTER (kind = 'scan')::BIGINT AS scan_items, sum(bytes) FILTER (kind IN ('get', 'scan'))::BIGINT AS bytes_read, sum(bytes) FILTER (kind IN ('set', 'put'))::BIGINT AS bytes_written, count(*) FILTER (failed) AS errors FROM cl")
def store_stats(spark, d):
    kinds = F.array(*map(F.lit, ("get", "has", "set", "put", "delete", "scan", "commit", "rollback")))
    e = F.col("event_id")
    return cost.store_stats(tables.table(spark, d, "events").select(F.get(kinds, (e % 8).cast("int")).alias("kind"), (e % 13).alias("items"), (e % 101).alias("bytes"), (F.col("event_type") == "error").alias("failed")))


# ---------------------------------------------------------------- the stored index
#: Commit 1 holds all documents; commit 2 puts a short text in place of each fifth and deletes each ninth.
SEG = f"""d1 AS (SELECT doc_id, text, 1 AS version FROM documents), d2 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'the ' || source || ' the end' ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 5 = 0),
w AS MATERIALIZED (SELECT doc_id, version, {WORDS} AS w FROM d2), p AS (SELECT (doc_id % 4)::INTEGER AS shard, printf('doc/%08d', doc_id) AS key, version, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, version, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL)"""


def segments(spark: SparkSession, d: str) -> SegmentIndex:
    def make(folder: str) -> SegmentIndex:
        out = SegmentIndex(spark, folder, ["text", "title"], flags=3)
        docs = text_documents(spark, d).withColumn("id", F.substring("key", 5, 8).cast("long"))
        columns = ["shard", "key", "field", "text", "filter_flags", "search_flags"]
        out.commit(1, docs.select(*columns))
        source = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
        fresh = docs.where("id % 5 = 0").join(source, "id").withColumn("text", F.concat(F.lit("the "), "source", F.lit(" the end")))
        out.commit(2, fresh.select(*columns), docs.where("id % 9 = 0").select("shard", "key"))
        return out

    return once(spark, "stored-index", d, make)


@query(f"WITH {SEG} SELECT shard, key, version, sum({R1.format(b=0)})::BIGINT AS score, string_agg(term || ':' || tf, ',' ORDER BY term) AS matches FROM p WHERE term IN ('the', 'end', 'web') GROUP BY ALL")
def segment_search(spark, d):
    hits = segments(spark, d).search("The web, the END")
    return hits.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["term"], m["tf"].cast("string"))), ","))


@query(f"WITH {SEG}, a AS (SELECT shard, key, version, sum({R1.format(b=0)})::BIGINT AS score FROM p WHERE term IN ('the', 'of') GROUP BY ALL HAVING count(*) = 2) SELECT * FROM a")
def segment_search_all(spark, d):
    return segments(spark, d).search("of the", "all", fields=["text"]).drop("matches")


@query(f"WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT printf('doc/%08d', doc_id) AS key, term, count(*) AS tf, any_value(n) AS length, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w) GROUP BY ALL) SELECT key, term, tf, positions FROM p WHERE term = 'of'")
def segment_positions_old_pin(spark, d):
    hits = segments(spark, d).search("of", pin=1).select("key", F.explode("matches").alias("m"))
    return hits.select("key", "m.term", "m.tf", F.array_join(F.transform("m.positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"WITH {SEG}, {FLAGS} SELECT (doc_id % 4)::INTEGER AS shard, printf('doc/%08d', doc_id) AS key, version, 0::BIGINT AS score FROM d2 JOIN f USING (doc_id) WHERE flags & 1 = 1")
def segment_flags_only(spark, d):
    return segments(spark, d).search("", filter_flags=index.flag_bits(["quality"], ["quality", "toxic"])).drop("matches")


@query(f"WITH {SEG} SELECT count(*) AS n FROM p WHERE term = 'with'")
def segment_df(spark, d):
    return segments(spark, d).document_frequency("text", "with")


@query(f"WITH {SEG} SELECT shard, key, version, tf, length::BIGINT AS length FROM p WHERE term = 'the'")
def segment_compacted(spark, d):
    def make(folder: str) -> SegmentIndex:
        out = SegmentIndex(spark, folder, ["text"], flags=3)
        docs, own = text_documents(spark, d), segments(spark, d)
        shown = own.visible()
        texts = docs.join(shown.where("version = 1").select("shard", "key"), ["shard", "key"], "left_semi")
        columns = ["shard", "key", "field", "text", "filter_flags", "search_flags"]
        out.commit(1, docs.select(*columns))
        source = tables.table(spark, d, "documents").select(F.format_string("doc/%08d", "doc_id").alias("key"), "source")
        fresh = docs.join(shown.where("version = 2").select("shard", "key"), ["shard", "key"], "left_semi").join(source, "key")
        gone = docs.select("shard", "key").join(texts.select("shard", "key"), ["shard", "key"], "left_anti")
        out.commit(2, fresh.withColumn("text", F.concat(F.lit("the "), "source", F.lit(" the end"))).select(*columns), gone)
        out.compact()
        out.verify()
        return out

    return once(spark, "compacted-index", d, make).postings(["the"]).select("shard", "key", "version", "tf", "length")


POSTING_BYTES = f"w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL)"


@query(f"WITH {POSTING_BYTES} SELECT sum(octet_length(term::BLOB) + 8 * tf + 24)::BIGINT AS bytes FROM p")
def index_overhead(spark, d):
    return index.overhead(index.postings(text_documents(spark, d)))


@query(f"WITH {SEG} SELECT shard, key, version FROM (SELECT (doc_id % 4)::INTEGER AS shard, printf('doc/%08d', doc_id) AS key, version FROM d2)")
def index_compact(spark, d):
    docs = text_documents(spark, d).withColumn("id", F.substring("key", 5, 8).cast("long"))
    two = F.lit(2).cast("long")
    fresh = docs.where("id % 5 = 0").withColumn("version", two)
    gone = docs.where("id % 9 = 0 AND id % 5 <> 0").withColumn("version", two).withColumn("text", F.lit(None).cast("string"))
    return index.compact(docs.unionByName(fresh).unionByName(gone).drop("id"), 2).select("shard", "key", "version")


@query(None)
def tok_unicode_tokens(spark, d):
    ship(spark)
    return tables.table(spark, d, "documents").select("doc_id", unicode_words(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- coordinated searches
HITS = "h AS (SELECT (o_orderkey % 4)::INTEGER AS shard, printf('k%08d', o_orderkey) AS key, (o_custkey % 50)::BIGINT AS score, (o_orderkey % 9)::BIGINT AS version FROM orders)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 4).cast("int").alias("shard"), F.format_string("k%08d", "o_orderkey").alias("key"), (F.col("o_custkey") % 50).alias("score"), (F.col("o_orderkey") % 9).alias("version"))


def served(spark: SparkSession, versions: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(s, v, True) for s, v in versions.items()], "shard int, version long, digest_ok boolean")


@query(f"WITH {HITS} SELECT shard, key, score FROM h WHERE (shard = 0 AND version <= 5) OR (shard = 1 AND version <= 7) OR (shard = 3 AND version <= 2) ORDER BY score DESC, key LIMIT 30 OFFSET 30")
def search_execute_page2(spark, d):
    pin = {0: 5, 1: 7, 3: 2}
    ask = lambda token: search.execute(hits(spark, d), served(spark, pin), [0, 1, 3], pin, 30, token=token, query="q")
    return ask(ask(None).token).rows.select("shard", "key", "score")


@query(f"WITH {HITS}, c AS (SELECT count(*) AS n FROM h WHERE (shard = 0 AND version <= 5) OR (shard = 1 AND version <= 7)) SELECT shard, key, score, '0,1' AS answered, '2,3' AS missing, 10000000 - n AS budget FROM h, c WHERE (shard = 0 AND version <= 5) OR (shard = 1 AND version <= 7) ORDER BY score DESC, key LIMIT 20")
def search_execute_coverage(spark, d):
    got = search.execute(hits(spark, d), served(spark, {0: 5, 1: 7, 3: 1}), [0, 1, 2, 3], {0: 5, 1: 7, 2: 4, 3: 2}, 20, coverage_mode=True, budget=10_000_000)
    listed = lambda shards: F.lit(",".join(map(str, shards)))
    return got.rows.select("shard", "key", "score", listed(got.answered).alias("answered"), listed(got.missing).alias("missing"), F.lit(got.budget).cast("long").alias("budget"))


# ---------------------------------------------------------------- scheduling and rollouts
#: Requests of a shard depend on the two before them in it; the oldest are done.
ROUND = """rq AS (SELECT event_id AS request, (user_id % 5)::INTEGER AS shard, user_id AS key, event_id AS arrival, CASE WHEN event_id % 3 = 0 OR event_id < 200 THEN 'Terminal' WHEN event_id % 50 = 1 THEN 'InFlight' ELSE 'Queued' END AS state, lag(event_id, 1) OVER w AS d1, lag(event_id, 2) OVER w AS d2 FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id)),
dp AS (SELECT DISTINCT request, needs FROM (SELECT request, d1 AS needs FROM rq WHERE request % 4 <> 0 UNION ALL SELECT request, d2 FROM rq WHERE request % 4 = 1) WHERE needs IS NOT NULL),
wt AS (SELECT DISTINCT dp.request FROM dp JOIN rq q ON q.request = dp.needs WHERE q.state <> 'Terminal'),
ec AS (SELECT request, count(*) AS edges FROM dp GROUP BY 1),
hd AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY arrival) = 1 AS head FROM rq WHERE state <> 'Terminal'),
hl AS (SELECT hd.request, shard, arrival, coalesce(edges, 0) AS edges, CASE WHEN state = 'InFlight' THEN 'InFlight' WHEN shard = 3 THEN 'ShardBlocked' WHEN NOT head THEN 'KeyBlocked' WHEN hd.request IN (SELECT wt.request FROM wt) THEN 'DependencyBlocked' END AS held FROM hd LEFT JOIN ec USING (request)),
tn AS (SELECT shard, (row_number() OVER (ORDER BY shard) - 1 - 7) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT shard FROM hl WHERE held IS NULL)),
ln AS (SELECT request, edges, row_number() OVER (PARTITION BY shard ORDER BY arrival) AS nth, ((place % n) + n) % n AS turn FROM hl JOIN tn USING (shard) WHERE held IS NULL),
us AS (SELECT request, row_number() OVER (ORDER BY nth, turn) AS position, sum(edges) OVER (ORDER BY nth, turn) AS used FROM ln),
sl AS (SELECT request, position FROM us WHERE position <= 24 AND used <= 20)"""


def scheduled(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    by = Window.partitionBy("shard").orderBy("request")
    rows = e.select(F.col("event_id").alias("request"), (F.col("user_id") % 5).cast("int").alias("shard"), F.col("user_id").alias("key"), F.col("event_id").alias("arrival"))
    one, two = F.lag("request", 1).over(by), F.lag("request", 2).over(by)
    n = F.col("request")
    state = F.when((n % 3 == 0) | (n < 200), "Terminal").when(n % 50 == 1, "InFlight").otherwise("Queued")
    return rows.withColumn("state", state).withColumn("deps", F.array_compact(F.array(F.when(n % 4 != 0, one), F.when(n % 4 == 1, two))))


@query(f"WITH {ROUND} SELECT hl.request, coalesce(held, CASE WHEN position IS NULL THEN 'OutsideBudget' ELSE 'Selected' END) AS reason, position FROM hl LEFT JOIN sl USING (request)")
def scheduler_round(spark, d):
    shards = spark.createDataFrame([(s, s == 3) for s in range(5)], "shard int, blocked boolean")
    return write.decide(scheduled(spark, d), shards, 24, 20, epoch=7)


ADMITTED = """rq AS (SELECT o_orderkey AS request, (o_custkey % 3)::INTEGER AS shard, row_number() OVER (ORDER BY o_orderkey) AS arrival, CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey WHEN o_orderkey % 50 = 7 THEN o_orderkey + 1 WHEN o_orderkey % 5 = 1 THEN lag(o_orderkey, 3) OVER (ORDER BY o_orderkey) WHEN o_orderkey % 5 = 2 THEN lag(o_orderkey, 1) OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) END AS needs, o_orderkey % 41 = 0 AS wide FROM orders)"""


@query(f"WITH RECURSIVE {ADMITTED}, st AS (SELECT r.request, r.shard, r.arrival, r.needs, CASE WHEN r.wide THEN 'FanInExceeded' WHEN r.needs IS NULL THEN 'Admitted' WHEN r.needs = r.request THEN 'Cycle' WHEN o.request IS NULL OR o.arrival >= r.arrival THEN 'ForwardReference' WHEN o.shard <> r.shard THEN 'CrossShardEdge' END AS v FROM rq r LEFT JOIN rq o ON o.request = r.needs), bad(request) AS (SELECT request FROM st WHERE v IS NOT NULL AND v <> 'Admitted' UNION SELECT st.request FROM st JOIN bad ON st.needs = bad.request) SELECT st.request, st.arrival, CASE WHEN v IN ('FanInExceeded', 'Cycle', 'Admitted') THEN v WHEN needs IN (SELECT request FROM bad) THEN 'ForwardReference' ELSE coalesce(v, 'Admitted') END AS verdict FROM st")
def scheduler_admission(spark, d):
    o = tables.table(spark, d, "orders")
    k = F.col("o_orderkey")
    # numbering all arrivals is how the query makes its input
    arrival = F.row_number().over(Window.orderBy("o_orderkey")).cast("long")
    back = F.lag("o_orderkey", 3).over(Window.orderBy("o_orderkey"))
    own = F.lag("o_orderkey", 1).over(Window.partitionBy(F.col("o_custkey") % 3).orderBy("o_orderkey"))
    needs = F.when(k % 50 == 3, k).when(k % 50 == 7, k + 1).when(k % 5 == 1, back).when(k % 5 == 2, own)
    wide = F.when(k % 41 == 0, F.sequence(k - 40, k - 1)).otherwise(F.array_compact(F.array("needs")))
    rows = o.select(k, "o_custkey", arrival.alias("arrival"), needs.alias("needs"))
    rows = rows.select(k.alias("request"), (F.col("o_custkey") % 3).cast("int").alias("shard"), "arrival", wide.alias("deps"))

    def keep(table: DataFrame, n: int) -> DataFrame:
        path = scratch(spark, f"admission-{n}")
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    return write.admit_requests(rows, 16, keep)


@query("WITH r AS (SELECT DISTINCT user_id % 20 AS cohort FROM events), o AS (SELECT user_id % 20 AS cohort, count(*) AS operations FROM events WHERE event_id >= 100 + user_id % 20 AND event_id <= 900 GROUP BY 1), s AS (SELECT cohort, coalesce(operations, 0) AS operations, CASE WHEN coalesce(operations, 0) > 30 + cohort THEN 'Aborted' WHEN 900 >= 850 + cohort * 5 AND cohort % 2 = 0 THEN 'Promoted' ELSE 'Continue' END AS step FROM r LEFT JOIN o USING (cohort)) SELECT cohort, operations, step, CASE WHEN step = 'Aborted' THEN 1 ELSE 2 END AS version FROM s")
def rollout_steps(spark, d):
    e = tables.table(spark, d, "events")
    c = F.col("cohort")
    done = e.select((F.col("user_id") % 20).alias("cohort"), F.col("event_id").alias("at"))
    plans = done.select("cohort").distinct().select("cohort", F.lit(1).alias("base"), F.lit(2).alias("candidate"), (c + 100).alias("since"), (c + 30).alias("most"), (c * 5 + 850).alias("expires"), (c % 2 == 0).alias("automatic"))
    return write.rollout_tick(plans, done, 900)


@query("WITH r AS (SELECT o_orderkey AS request, 'i' || o_orderkey // 2 AS ik, 'c' || o_custkey % 30 AS cohort, o_custkey % 30 AS c, o_orderkey % 4 AS base, o_orderkey % 6 AS candidate, o_orderkey % 3 = 0 AS seen FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY ik ORDER BY request) AS nth FROM r), o AS (SELECT ik, CASE WHEN c < 20 AND c % 4 <> base THEN 'Conflict' WHEN base = 3 THEN 'Rejected:UnknownBase' WHEN candidate IN (3, 5) OR candidate = 4 THEN 'Rejected:Compile' WHEN candidate = 2 AND NOT seen THEN 'Rejected:Approval' ELSE 'Activated' END AS outcome FROM f WHERE nth = 1) SELECT request, outcome, nth > 1 AS repeated FROM f JOIN o USING (ik)")
def rule_activation(spark, d):
    o = tables.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 30
    cohort = lambda x: F.concat(F.lit("c"), x.cast("string"))
    requests = o.select(k.alias("request"), F.concat(F.lit("i"), F.expr("o_orderkey div 2").cast("string")).alias("idempotency_key"), cohort(c).alias("cohort"), (k % 4).alias("base"), (k % 6).alias("candidate"), F.lit("ann").alias("author"), F.when(k % 3 == 0, "ben").when(k % 3 == 1, "ann").alias("approver"))
    assigned = spark.range(20).select(cohort(F.col("id")).alias("cohort"), (F.col("id") % 4).alias("version"))
    catalog = spark.createDataFrame([(0, True, False), (1, True, False), (2, True, True), (4, False, False)], "version long, compiles boolean, breaking boolean")
    return write.activations(requests, assigned, catalog)


MUTATED = """mt AS (SELECT l_orderkey AS request, l_partkey % 41 = 0 AS crosses, l_partkey % 97 = 0 AS derived, CASE WHEN l_partkey % 31 <> 0 THEN l_partkey % 3 + CASE WHEN l_quantity > 48 THEN 1 WHEN l_quantity < 3 THEN -1 ELSE 0 END END AS base, CASE WHEN l_partkey % 97 <> 0 THEN l_partkey % 3 ELSE 0 END AS v, l_quantity > 44 AS denied FROM lineitem),
fl AS (SELECT request, bool_or(crosses) AS crosses, bool_or(derived) AS derived, bool_or(base IS NULL) AS unbased, bool_or(base > v) AS ahead, bool_or(base < v) AS behind, bool_or(denied) AS denied FROM mt GROUP BY 1),
rq AS (SELECT o_orderkey AS request, o_orderkey // 2 AS ik, o_orderstatus AS body, o_custkey % 10 < 8 AS known, coalesce(crosses, false) AS crosses, coalesce(derived, false) AS derived, coalesce(unbased, false) AS unbased, coalesce(ahead, false) AS ahead, coalesce(behind, false) AS behind, coalesce(denied, false) AS denied FROM orders LEFT JOIN fl ON request = o_orderkey),
fs AS (SELECT ik, min(request) AS first, arg_min(body, request) AS first_body FROM rq WHERE known AND NOT (unbased AND NOT crosses AND NOT derived) GROUP BY 1)"""


@query(f"WITH {MUTATED} SELECT request, CASE WHEN NOT known THEN 'Rejected:Unauthenticated' WHEN request > first AND body = first_body THEN 'Replayed' WHEN request > first THEN 'Rejected:KeyReused' WHEN crosses THEN 'Rejected:CrossShard' WHEN derived THEN 'Rejected:ProjectionWrite' WHEN unbased THEN 'Rejected:MissingBase' WHEN ahead THEN 'Rejected:StaleBase' WHEN behind THEN 'Conflict' WHEN denied THEN 'Rejected:Policy' ELSE 'Committed' END AS outcome FROM rq LEFT JOIN fs USING (ik)")
def enforcement_commit(spark, d):
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    requests = o.select(F.col("o_orderkey").alias("request"), F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("token"), F.expr("o_orderkey div 2").alias("idempotency_key"), F.col("o_orderstatus").alias("body"))
    part, amount = F.col("l_partkey"), F.col("l_quantity")
    name = F.when(part % 97 == 0, "projection/x").otherwise(F.concat(F.lit("p/"), part.cast("string")))
    base = F.when(part % 31 != 0, part % 3 + F.when(amount > 48, 1).when(amount < 3, -1).otherwise(0))
    row = F.struct(F.ceil(amount).cast("long").alias("amount"))
    mutations = line.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("pos"), name.alias("key"), F.when(part % 41 == 0, 1).otherwise(0).alias("shard"), base.alias("base"), row.alias("before"), row.alias("after"))
    sessions = spark.createDataFrame([(f"t{i}", 5 if i == 8 else 100) for i in range(9)], "token string, expires int")
    versions = tables.table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_partkey") % 3).alias("version"))
    projection = spark.createDataFrame([("d", "d", 9, 9, 2, 5)], "digest string, expected string, watermark int, previous int, lag int, bound int")
    tree = policy.Compare("le", policy.Path("after", "amount"), policy.Literal(44))
    return write.enforce_requests(requests, mutations, sessions, versions, projection, tree, 0, True, 10)


@query("SELECT o_orderkey AS request, CASE WHEN o_custkey % 30 >= 20 OR o_custkey % 30 % 4 <> o_orderkey % 4 THEN 'Conflict' WHEN o_orderkey % 6 IN (3, 5) OR o_orderkey % 4 = 3 THEN 'Rejected:UnknownVersion' WHEN o_orderkey % 6 >= o_orderkey % 4 THEN 'Conflict' WHEN o_orderkey % 6 = 1 THEN 'Rejected:Compile' ELSE 'RolledBack' END AS outcome FROM orders")
def rule_rollback(spark, d):
    o = tables.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 30
    requests = o.select(k.alias("request"), c.alias("cohort"), (k % 4).alias("base"), (k % 6).alias("target"))
    assigned = spark.range(20).select(F.col("id").alias("cohort"), (F.col("id") % 4).alias("version"))
    catalog = spark.createDataFrame([(0, 10, True), (1, 11, False), (2, 12, True), (4, 14, True)], "version long, generation int, compiles boolean")
    return write.rollbacks(requests, assigned, catalog)


# ---------------------------------------------------------------- vectors
@query("WITH v AS (SELECT n_nationkey + 1 AS n, n_nationkey // 2 AS a, (n_nationkey + 1) // 2 AS b FROM nation WHERE n_nationkey <> 17) SELECT n::BIGINT AS n, CASE WHEN n = 19 THEN 'SequenceGap' WHEN n % 8 = 5 THEN 'BaseMismatch' WHEN n % 6 = 4 THEN 'TargetRegressed' WHEN n > 5 AND (n - 1) % 6 = 4 THEN 'BaseMismatch' WHEN n % 7 = 0 THEN 'DuplicateRecord' ELSE 'Ok' END AS status FROM v")
def scope_vector_intervals(spark, d):
    n = F.col("n_nationkey").cast("long")
    vector = lambda x: F.map_filter(F.create_map(F.lit("a"), F.floor(x / 2), F.lit("b"), F.floor((x + 1) / 2)), lambda k, v: v > 0)
    rows = tables.table(spark, d, "nation").where("n_nationkey <> 17")
    # one base of eight is of another time, one target of six goes back
    base = F.when((n + 1) % 8 == 5, vector(n + 1)).otherwise(vector(n))
    target = F.when((n + 1) % 6 == 4, vector(n - 2)).otherwise(vector(n + 1))
    intervals = rows.select((n + 1).alias("n"), base.alias("base"), target.alias("target"))
    records = rows.select((n + 1).alias("n"), F.explode(F.when((n + 1) % 7 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))).alias("key"))
    return cdc.vector_interval_report(intervals, records)


@query("WITH m AS (SELECT c_custkey, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) SELECT c.c_custkey AS read_id, 'c' || c.c_custkey AS key, CASE WHEN c.c_custkey % 4 = 0 THEN 'NotResident' WHEN c.c_custkey % 4 = 1 THEN 'NotHydrated' WHEN m.v IS NULL THEN 'Absent' ELSE 'Present' END AS state, CASE WHEN c.c_custkey % 4 > 1 THEN m.v END AS key_version FROM customer c LEFT JOIN m USING (c_custkey)")
def scope_read_at(spark, d):
    c = tables.table(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k.cast("string")).alias("key")
    pin = F.create_map(F.lit("a"), F.when(k % 4 == 0, 3).otherwise(4).cast("long"), F.lit("b"), F.when(k % 4 == 1, 9).otherwise(7).cast("long"))
    members = c.where("c_custkey % 3 <> 0").select(name, F.col("c_nationkey").alias("key_version"))
    return cdc.read_at(c.select(k.alias("read_id"), name, pin.alias("pin")), members, {"a": 4, "b": 7})


@query("SELECT event_id, greatest(event_id % 9 - event_id % 5, event_id % 4, 0)::BIGINT AS lag, greatest(500 - event_id, 0)::BIGINT AS silence FROM events")
def staleness_measure(spark, d):
    e = F.col("event_id")
    served_ = F.create_map(F.lit("a"), e % 5, F.lit("z"), e)
    marks = F.create_map(F.lit("a"), e % 9, F.lit("b"), e % 4)
    return tables.table(spark, d, "events").select("event_id", staleness.measure(served_, marks).alias("lag"), staleness.silence(F.lit(500), e).alias("silence"))


@query("SELECT quantile_cont(k, 0.99) AS p99, quantile_cont(k, 0.5) AS median, quantile_cont(k, 0.99) / quantile_cont(k, 0.5) AS ratio FROM (SELECT (event_id % 97 + 1)::DOUBLE AS k FROM events)")
def falsifier_policy_cost(spark, d):
    return cost.policy_cost(tables.table(spark, d, "events").select((F.col("event_id") % 97 + 1).cast("double").alias("steps")), "steps")


@query("SELECT count(*) FILTER (event_type = 'error') AS cold, count(*) AS \"all\", count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM events")
def falsifier_cold_start(spark, d):
    return cost.cold_start(tables.table(spark, d, "events").select((F.col("event_type") == "error").alias("cold")))


@query("SELECT (c_custkey % 4)::INTEGER AS shard, 'c/' || c_name AS key, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0")
def scope_declared(spark, d):
    c = tables.table(spark, d, "customer").select((F.col("c_custkey") % 4).cast("int").alias("shard"), F.concat(F.lit("c/"), "c_name").alias("key"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return cdc.scope(c, ["c/"], F.col("c_acctbal") > 0, ["shard", "segment"]).select("shard", "key", "segment")
