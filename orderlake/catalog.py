"""Queries over the driver's tables, each beside its SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query by its function's name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- scans
from .functions import keys as K  # noqa: E402
from .functions import text as TX  # noqa: E402
from .operators import cdc, cost, events, index, mvcc, policy, scan, search, staleness, write  # noqa: E402
from .plans import filter as LF  # noqa: E402
from .shipping import ship  # noqa: E402
from .sources import store, tables  # noqa: E402

KEY = "'orders/' || lpad(o_orderkey::VARCHAR, 20, '0')"
KV = f"""kv AS (SELECT {KEY} AS key, '{{"id":' || o_orderkey || ',"cust":' || o_custkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}' AS value FROM orders)"""


def key(n: int) -> str:
    return f"orders/{n:020d}"


@query(f"WITH {KV} SELECT key, value FROM kv WHERE key = '{key(7)}'")
def kv_point_get(spark, d):
    return scan.get(tables.order_rows(spark, d, key(7), key(7)), key(7))


@query(f"WITH {KV} SELECT value, key FROM kv WHERE key = '{key(32)}'")
def kv_get_required(spark, d):
    return scan.get_required(tables.order_rows(spark, d, key(32), key(32)), key(32))


@query(f"WITH {KV}, a(key) AS (VALUES ('{key(999999999)}'), ('{key(32)}')) SELECT a.key, count(kv.key) > 0 AS found FROM a LEFT JOIN kv USING (key) GROUP BY 1")
def kv_has(spark, d):
    asked = [scan.has(tables.order_rows(spark, d, k, k), k).select(F.lit(k).alias("key"), "found") for k in (key(999999999), key(32))]
    return asked[0].unionByName(asked[1])


@query(f"WITH {KV}, a(pos, key) AS (VALUES (0, '{key(5)}'), (1, '{key(1)}'), (2, '{key(99999999)}'), (3, '{key(5)}')) SELECT pos::BIGINT AS pos, a.key, value FROM a LEFT JOIN kv USING (key)")
def kv_multi_get(spark, d):
    keys = [key(5), key(1), key(99999999), key(5)]
    return scan.get_many(tables.order_rows(spark, d, keys=keys), keys)


@query(f"WITH {KV} SELECT * FROM kv WHERE key BETWEEN '{key(10)}' AND '{key(900)}' ORDER BY key LIMIT 50")
def kv_range_next(spark, d):
    return scan.scan_range(tables.order_rows(spark, d, key(10), key(900)), key(10), key(900), 50)


@query(f"WITH {KV} SELECT * FROM kv WHERE key BETWEEN '{key(10)}' AND '{key(900)}' ORDER BY key DESC LIMIT 50")
def kv_range_prev(spark, d):
    return scan.scan_range(tables.order_rows(spark, d, key(10), key(900)), key(900), key(10), 50, "prev")


@query(f"WITH {KV} SELECT * FROM kv WHERE false")
def kv_prev_no_start(spark, d):
    return scan.scan_range(tables.order_rows(spark, d), None, key(10), 50, "prev")


@query(f"WITH {KV} SELECT key FROM kv WHERE key >= '{key(100)}' ORDER BY key LIMIT 25")
def kv_keys_only(spark, d):
    return scan.scan_range(tables.order_rows(spark, d, key(100)), key(100), None, 25, values=False)


@query(f"WITH {KV} SELECT * FROM kv WHERE starts_with(key, 'orders/') ORDER BY key LIMIT 20")
def kv_prefix_page1(spark, d):
    return scan.scan_prefix(tables.order_rows(spark, d), "orders/", None, 20).items()


@query(f"WITH {KV} SELECT key FROM kv WHERE starts_with(key, 'orders/') AND key > '{key(20)}' ORDER BY key LIMIT 20")
def kv_prefix_page2(spark, d):
    return scan.scan_prefix(tables.order_rows(spark, d, key(20)), "orders/", key(20), 20, values=False).items()


@query(f"WITH {KV}, p AS (SELECT key, row_number() OVER (ORDER BY key) AS n FROM kv WHERE starts_with(key, 'orders/0') ORDER BY key LIMIT 21) SELECT CASE WHEN max(n) > 20 THEN max(key) FILTER (n = 20) END AS next FROM p")
def kv_prefix_next(spark, d):
    return scan.scan_prefix(tables.order_rows(spark, d), "orders/0", None, 20).next_key()


@query(f"WITH {KV} SELECT key FROM kv WHERE starts_with(key, 'orders/') AND key < '{key(64)}' ORDER BY key LIMIT 100")
def kv_older_than(spark, d):
    return scan.scan_prefix(tables.order_rows(spark, d, upper=key(64)), "orders/", None, 100, values=False, below=key(64)).items()


@query(f"WITH {KV} SELECT least(count(*), 777) AS n FROM kv WHERE starts_with(key, 'orders/')")
def kv_count_prefix_capped(spark, d):
    return scan.count_prefix(tables.order_rows(spark, d), "orders/", 777)


@query(f"WITH {KV}, s AS (SELECT key, (octet_length(key::BLOB) + octet_length(value::BLOB))::BIGINT AS size FROM kv ORDER BY key LIMIT 60), r AS (SELECT *, sum(size) OVER (ORDER BY key)::BIGINT AS running FROM s) SELECT * FROM r WHERE running <= 4000 OR running = size")
def kv_page_bytes_budget(spark, d):
    return scan.page_by_bytes(tables.order_rows(spark, d), 60, 4000)


@query(f"WITH {KV} SELECT substr(key, 8) AS key, value FROM kv WHERE starts_with(key, 'orders/')")
def kv_scoped_view(spark, d):
    return scan.scoped(tables.order_rows(spark, d), "orders")


@query(f"WITH {KV} SELECT 's0' AS shard, count(*) AS n FROM kv")
def kv_route(spark, d):
    return scan.route(tables.order_rows(spark, d), tables.shard_map(spark)).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"WITH {KV} SELECT count(*) AS n FROM kv WHERE starts_with(key, 'orders/0000000000000000001') OR starts_with(key, 'orders/0000000000000000002')")
def kv_prefix_list(spark, d):
    return scan.keep_prefixes(tables.order_rows(spark, d), ["orders/0000000000000000001", "orders/0000000000000000002"]).agg(F.count("*").alias("n"))


@query("SELECT hex(('\\x01'::BLOB || encode('t') || '\\x00'::BLOB || '\\x10'::BLOB || encode(n_name) || '\\x00\\x00'::BLOB)) || '21' || printf('%016X', CASE WHEN n_nationkey >= 0 THEN n_nationkey::HUGEINT + 9223372036854775808 END::UBIGINT) || '30' || CASE WHEN n_regionkey > 1 THEN '01' ELSE '00' END AS k, n_name FROM nation")
def key_encode(spark, d):
    n = tables.table(spark, d, "nation")
    return n.select(F.hex(K.encode_key("t", ("text", F.col("n_name")), ("i64", F.col("n_nationkey")), ("bool", F.col("n_regionkey") > 1))).alias("k"), "n_name")


@query("SELECT event_id AS seq, value FROM events WHERE event_id > 120 ORDER BY 1 LIMIT 40")
def feed_since(spark, d):
    return scan.feed_since(tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), 120, 40)


@query("WITH t AS (SELECT max(event_id) AS top FROM events) SELECT event_id AS seq, value, (100 >= top - 1024) AS complete FROM events, t WHERE event_id > 100 AND event_id > top - 1024")
def feed_replay(spark, d):
    return scan.events_since(tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), 100)


@query("WITH v AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_name FROM customer) SELECT n + (SELECT max(event_id) FROM events) AS seq, c_name AS value FROM v")
def feed_append(spark, d):
    feed = tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    values = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("value"))
    return store.append_feed(feed, values)


@query("SELECT count(*) AS n, min(event_id) AS low FROM events WHERE event_id >= 300")
def feed_prune(spark, d):
    return store.prune_feed(tables.table(spark, d, "events").select(F.col("event_id").alias("seq")), 300).agg(F.count("*").alias("n"), F.min("seq").alias("low"))


@query(f"WITH {KV} SELECT key, 9::BIGINT AS version FROM kv WHERE key < '{key(200)}'")
def delete_prefix_chunked(spark, d):
    return store.delete_prefix(tables.order_rows(spark, d, upper=key(200)), "orders/", 9, below=key(200)).select("key", "version")


@query("SELECT 'user/' || lpad(user_id::VARCHAR, 20, '0') AS key, 7::BIGINT AS version, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(value, event_id) END AS value FROM events GROUP BY user_id")
def write_batch(spark, d):
    e = tables.table(spark, d, "events")
    ops = e.select(F.col("event_id").alias("pos"), tables.padded("user/", "user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "value")
    return store.commit(ops, 7)


@query(f"WITH {KV}, r AS (SELECT key, value, 'p' || (row_number() OVER (ORDER BY key) - 1) // 500 AS page FROM kv) SELECT 0 AS shard, page[2:]::BIGINT AS page, count(*) AS n, min(key) AS first_key, max(key) AS last_key, sha256(string_agg(sha256(key || chr(31) || value), '' ORDER BY key)) AS digest FROM r GROUP BY page")
def snapshot_pages(spark, d):
    return store.snapshot_pages(tables.order_rows(spark, d).withColumn("shard", F.lit(0)), 500)


@query(f"WITH {KV} SELECT * FROM kv")
def export_import(spark, d):
    ship(spark)
    return store.read_export(spark, store.export_header(), store.export(tables.order_rows(spark, d)))


# ---------------------------------------------------------------- versions
LOG = "lg AS (SELECT (user_id % 4)::INTEGER AS shard, 'user/' || lpad(user_id::VARCHAR, 20, '0') AS key, event_id AS version, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
NEWEST = "w AS (SELECT shard, key, max(version) AS version, arg_max_null(value, version) AS value FROM lg {} GROUP BY ALL), n AS (SELECT * FROM w WHERE value IS NOT NULL)"


@query(f"WITH {LOG}, {NEWEST.format('')} SELECT shard, key, version, value FROM n")
def mvcc_latest(spark, d):
    return mvcc.latest(tables.change_log(spark, d))


@query(f"WITH {LOG}, {NEWEST.format('WHERE version <= 500')} SELECT shard, key, version, value FROM n")
def mvcc_asof_pin(spark, d):
    return mvcc.latest(tables.change_log(spark, d), 500)


@query(f"WITH {LOG}, {NEWEST.format('WHERE version <= 500')} SELECT shard, key, version, value FROM n WHERE key = 'user/{7:020d}'")
def mvcc_get_entry(spark, d):
    return mvcc.get_entry(tables.change_log(spark, d), f"user/{7:020d}", 500)


@query(f"WITH {LOG}, {NEWEST.format('WHERE version <= 800')} SELECT shard, key, version, value FROM n WHERE key >= 'user/{10:020d}' AND key <= 'user/{90:020d}' ORDER BY key DESC LIMIT 25")
def mvcc_scan_desc(spark, d):
    return mvcc.scan(tables.change_log(spark, d), 800, f"user/{10:020d}", f"user/{90:020d}", "prev", 25)


@query(f"""WITH {LOG}, l AS (SELECT event_id AS row, 'user/' || lpad(user_id::VARCHAR, 20, '0') AS key, event_id - 50 AS pin FROM events)
SELECT l.row, l.key, l.pin, max(lg.version) AS version, arg_max_null(lg.value, lg.version) AS value FROM l LEFT JOIN lg ON l.key = lg.key AND lg.version <= l.pin GROUP BY ALL""")
def mvcc_asof_join(spark, d):
    left = tables.table(spark, d, "events").select(F.col("event_id").alias("row"), tables.padded("user/", "user_id").alias("key"), (F.col("event_id") - 50).alias("pin"))
    return mvcc.as_of_join(left, tables.change_log(spark, d))


@query(f"WITH {LOG}, {NEWEST.format('WHERE (shard = 0 AND version <= 300) OR (shard = 1 AND version <= 700) OR (shard = 3 AND version <= 100)')} SELECT shard, key, version, value FROM n")
def mvcc_vector_pin(spark, d):
    return mvcc.visible_at(tables.change_log(spark, d), {0: 300, 1: 700, 3: 100})


@query(f"WITH {LOG}, {NEWEST.format('WHERE version <= 600')} SELECT shard, key, version, value FROM n UNION ALL SELECT shard, key, version, value FROM lg WHERE version > 600")
def mvcc_compact(spark, d):
    return mvcc.compact(tables.change_log(spark, d), 600)


# ---------------------------------------------------------------- filter language
DOCS = f"""dc AS (SELECT {KEY} AS key, o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, o_orderdate AS created, c_mktsegment AS segment, n_name AS nation, n_regionkey AS region, c_acctbal > 0 AS solvent
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
FUZZY = "len(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda x: x <> '' AND levenshtein('{1}', x) <= {2})) > 0"


def lucene(name: str, text: str, condition: str) -> None:
    """A filter over the order documents: its keys."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = tables.order_documents(spark, d)
        return docs.where(LF.lower(LF.parse(text), LF.TypedDocuments(docs.schema["doc"].dataType, F.col("doc")))).select("key")

    run.__name__ = name
    query(f"WITH {DOCS} SELECT key FROM dc WHERE {condition}")(run)


lucene("lucene_term_fuzzy", "segment:buildin", FUZZY.format("segment", "buildin", 2))
lucene("lucene_slop1", "nation.name:NATION_1~9", FUZZY.format("nation", "nation_1", 9))
lucene("lucene_slop0_upper_trap", "status:F~0", "false")
lucene("lucene_short_term_trap", "status:F", FUZZY.format("status", "f", 2))
lucene("lucene_phrase", 'segment:"uild"', "contains(lower(segment), 'uild')")
lucene("lucene_phrase_status", 'status:"F"', "contains(lower(status), 'f')")
lucene("lucene_glob", "priority:?-*h*", "regexp_full_match(lower(priority), '.-.*h.*')")
lucene("lucene_regex", "priority:/^[12]-/", "regexp_matches(priority, '^[12]-')")
lucene("lucene_regex_invalid", "priority:/(/", "false")
lucene("lucene_num_range_inc", "total:[1000 TO 50000.5]", "total BETWEEN 1000 AND 50000.5")
lucene("lucene_num_range_exc", "id:{7 TO 39}", "id > 7 AND id < 39")
lucene("lucene_mixed_never", "total:[* TO 5]", "false")
lucene("lucene_four_digit_trap", "id:[1000 TO 9999]", "false")
lucene("lucene_text_range", "segment:[B TO G]", "segment >= 'B' AND segment <= 'G'")
lucene("lucene_number_term", "id:32", "id = 32")
lucene("lucene_bool_term", 'solvent:"true"', "solvent")
lucene("lucene_date_month", "created:1996-03", "created >= TIMESTAMP '1996-03-01' AND created < TIMESTAMP '1996-04-01'")
lucene("lucene_date_range", "created:[1995 TO 1996-06]", "created >= TIMESTAMP '1995-01-01' AND created < TIMESTAMP '1996-07-01'")
lucene("lucene_date_exclusive", "created:{1995-03-01 TO 1995-03-20}", "created >= TIMESTAMP '1995-03-02' AND created < TIMESTAMP '1995-03-20'")
lucene("lucene_bool_mixed", 'status:"F" total:[1000 TO 90000.5] OR nation.region:3', "(contains(lower(status), 'f') AND total BETWEEN 1000 AND 90000.5) OR region = 3")
lucene("lucene_occurrence", '+segment:"BUILDING" -status:"O" nation.region:1 nation.region:2', "contains(lower(segment), 'building') AND NOT contains(lower(status), 'o') AND (region = 1 OR region = 2)")
lucene("lucene_not", 'NOT status:"O" AND priority:/URGENT/', "NOT contains(lower(status), 'o') AND regexp_matches(priority, 'URGENT')")
lucene("lucene_nested_group", 'nation:(name:/1$/ OR region:4) && (status:"P" || total:{200000.5 TO 900000.5})', "(regexp_matches(nation, '1$') OR region = 4) AND (contains(lower(status), 'p') OR (total > 200000.5 AND total < 900000.5))")
lucene("lucene_array_fanout", 'tags:"house"', "contains(lower(segment), 'house') OR contains(lower(nation), 'house')")
lucene("lucene_unscoped", '"machinery"', "contains(lower(segment), 'machinery') OR contains(lower(priority), 'machinery') OR contains(lower(nation), 'machinery')")


@query(f"WITH {DOCS} SELECT key, status, total, created FROM dc WHERE contains(lower(status), 'f') AND total BETWEEN 100000 AND 200000 AND created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '1997-01-01' ORDER BY key LIMIT 100")
def lucene_flagship(spark, d):
    docs = tables.order_documents(spark, d)
    tree = LF.parse('status:"F" AND total:[100000 TO 200000] AND created:[1996-01 TO 1996-12]')
    hit = docs.where(LF.lower(tree, LF.TypedDocuments(docs.schema["doc"].dataType, F.col("doc"))))
    return hit.orderBy("key").limit(100).select("key", "doc.status", "doc.total", F.to_timestamp("doc.created").cast("timestamp_ntz").alias("created"))


@query("SELECT event_id, props FROM events WHERE (props->>'k')::DOUBLE BETWEEN 10 AND 19")
def lucene_json_dynamic(spark, d):
    return LF.where_json(tables.table(spark, d, "events").select("event_id", "props"), "k:[10 TO 19]", "props")


@query(f"WITH {KV} SELECT key, value FROM kv WHERE key > '{key(100)}' AND regexp_matches(value, '\"status\":\"F\"') AND regexp_matches(value, '\"priority\":\"1-URGENT\"') ORDER BY key LIMIT 30")
def lucene_page_after_cursor(spark, d):
    rows = scan.scan_prefix(tables.order_rows(spark, d, key(100)), "orders/", key(100), 1 << 30).rows
    return LF.where_json(rows, 'status:/^F$/ AND priority:"1-URGENT"').orderBy("key").limit(30)


# ---------------------------------------------------------------- text and index
SEARCHED = "documents"
WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w))"


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as members of an index: flags from the labels, quality bit 0, toxic bit 1."""
    t, l = tables.table(spark, d, "documents"), tables.table(spark, d, "labels")
    flags = l.groupBy(F.col("doc_id").alias("l")).agg((F.max("quality") + 2 * F.max("toxic")).cast("long").alias("flags"))
    rows = t.join(flags, F.col("doc_id") == F.col("l"), "left")
    return rows.select(
        (F.col("doc_id") % 4).cast("int").alias("shard"),
        F.format_string("doc/%08d", "doc_id").alias("key"),
        F.lit(1).cast("long").alias("version"),
        F.lit("text").alias("field"),
        "text",
        F.coalesce("flags", F.lit(0)).cast("long").alias("filter_flags"),
        F.lit(1).cast("long").alias("search_flags"),
    )


@query(f"SELECT doc_id, len({WORDS})::INTEGER AS n, array_to_string(list_slice({WORDS}, 1, 5), ' ') AS head FROM documents")
def tok_ascii(spark, d):
    w = TX.ascii_words(F.col("text"))
    return tables.table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INTEGER AS n FROM documents")
def tok_replica(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.size(TX.replica_words(F.col("text"))).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{Pc}][\\p{L}\\p{M}\\p{N}\\p{Pc}]*'))::INTEGER AS n FROM documents")
def tok_unicode(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.size(TX.unicode_words(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, len({WORDS}) <= 256 AND coalesce(list_max(list_transform({WORDS}, lambda w: len(w))), 0) <= 64 AS ok FROM documents")
def tok_budget_report(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", TX.within_budget(TX.ascii_words(F.col("text"))).alias("ok"))


POST = f"w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM {SEARCHED}), p AS (SELECT (doc_id % 4)::INTEGER AS shard, printf('doc/%08d', doc_id) AS key, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL)"


@query(f"WITH {POST} SELECT shard, key, term, tf, length::BIGINT AS length FROM p")
def postings_build(spark, d):
    return index.postings(text_documents(spark, d)).select("shard", "key", "term", "tf", "length")


@query(f"WITH {POST} SELECT count(*) AS n FROM p WHERE term = 'with'")
def term_df(spark, d):
    docs = text_documents(spark, d)
    return index.document_frequency(index.postings(docs), index.visible(docs), "text", "with")


R1 = "(tf * 2200 * 1000000) // (tf * 1000000 + 1200 * (1000 - {b} + ({b} * length) // 8))"


@query(f"WITH {POST} SELECT shard, key, 1::BIGINT AS version, sum({R1.format(b=0)})::BIGINT AS score FROM p WHERE term IN ('the', 'thand') GROUP BY ALL")
def search_any(spark, d):
    return index.search(text_documents(spark, d), ["the", "thand", "the"])


@query(f"WITH {POST} SELECT shard, key, 1::BIGINT AS version, sum({R1.format(b=750)})::BIGINT AS score FROM p WHERE term IN ('the', 'with', 'for') GROUP BY ALL HAVING count(*) = 3")
def search_all(spark, d):
    return index.search(text_documents(spark, d), ["the", "with", "for"], "all", scorer=lambda tf, n: index.term_score(tf, n, b=750))


@query(f"WITH {POST}, s AS (SELECT shard, key, sum({R1.format(b=750)})::BIGINT AS score FROM p WHERE term IN ('the', 'thand') GROUP BY ALL) SELECT shard, key, score FROM s ORDER BY score DESC, key LIMIT 20")
def search_top(spark, d):
    return search.top(index.search(text_documents(spark, d), ["the", "thand"], scorer=lambda tf, n: index.term_score(tf, n, b=750)), 20).select("shard", "key", "score")


@query("WITH p AS (SELECT printf('doc/%08d', doc_id) AS key, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) AS term FROM documents) GROUP BY ALL) SELECT key, sum((tf * 8000) // (8 + length))::BIGINT AS score FROM p WHERE term IN ('the', 'and') GROUP BY ALL")
def search_replica_score(spark, d):
    return index.search(text_documents(spark, d), ["the", "and"], scorer=index.replica_score, tokenizer="replica").select("key", "score")


FLAGS = "f AS (SELECT doc_id, max(quality) + 2 * max(toxic) AS flags FROM labels GROUP BY 1)"


@query(f"WITH {FLAGS} SELECT (doc_id % 4)::INTEGER AS shard, printf('doc/%08d', doc_id) AS key, 1::BIGINT AS version, 0::BIGINT AS score FROM documents JOIN f USING (doc_id) WHERE flags & 2 = 2")
def search_empty_query_flags(spark, d):
    return index.search(text_documents(spark, d), [], filter_flags=index.flag_bits(["toxic"], ["quality", "toxic"]))


@query(f"WITH {POST}, s AS (SELECT key, sum({R1.format(b=0)})::BIGINT AS score FROM p WHERE term IN ('the', 'of') GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS n FROM s), c AS (SELECT score AS cs, key AS ck FROM r WHERE n = 30) SELECT key, score FROM s, c WHERE score < cs OR (score = cs AND key > ck) ORDER BY score DESC, key LIMIT 30")
def search_page2(spark, d):
    hits = index.search(text_documents(spark, d), ["the", "of"]).select("key", "score")
    last = search.top(hits, 30).orderBy(F.asc("score"), F.desc("key")).first()  # the cursor of page one
    return search.top(hits, 30, after=(last["score"], last["key"])) if last else search.top(hits, 30)


@query(f"WITH {POST} SELECT count(DISTINCT key) AS total_hits FROM p WHERE term IN ('the', 'of')")
def search_total_hits(spark, d):
    return search.total_hits(index.search(text_documents(spark, d), ["the", "of"]))


@query(f"WITH {POST}, s AS (SELECT key, sum({R1.format(b=0)})::BIGINT AS score, string_agg(term || ':' || tf, ',' ORDER BY term) AS matches FROM p WHERE term IN ('by', 'of') GROUP BY ALL) SELECT * FROM s")
def search_matches(spark, d):
    docs = text_documents(spark, d)
    hits = index.search_postings(index.postings(docs), index.visible(docs), ["by", "of"])
    return hits.select("key", "score", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["term"], m["tf"].cast("string"))), ",").alias("matches"))


@query(f"WITH {POST} SELECT key, term, tf FROM p WHERE starts_with(key, 'doc/')")
def index_derive(spark, d):
    return index.derive(text_documents(spark, d), "doc/").select("key", "term", "tf")


# ---------------------------------------------------------------- merging
STREAMS = "st AS (SELECT (o_orderkey % 4)::INTEGER AS shard, printf('k%08d', o_orderkey) AS key, (o_custkey % 50)::BIGINT AS score, o_orderkey % 9 AS version, o_orderpriority AS payload FROM orders UNION ALL SELECT ((o_orderkey + 1) % 4)::INTEGER, printf('k%08d', o_orderkey), (o_custkey % 50)::BIGINT, o_orderkey % 9, CASE WHEN o_orderkey % 14 = 0 THEN 'other' ELSE o_orderpriority END FROM orders WHERE o_orderkey % 7 = 0)"


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Results of four shards; every seventh key comes from two, some with other contents."""
    o = tables.table(spark, d, "orders")
    k, score, v = F.format_string("k%08d", "o_orderkey").alias("key"), (F.col("o_custkey") % 50).alias("score"), (F.col("o_orderkey") % 9).alias("version")
    a = o.select((F.col("o_orderkey") % 4).cast("int").alias("shard"), k, score, v, F.col("o_orderpriority").alias("payload"))
    b = o.where("o_orderkey % 7 = 0").select(((F.col("o_orderkey") + 1) % 4).cast("int").alias("shard"), k, score, v, F.when(F.col("o_orderkey") % 14 == 0, "other").otherwise(F.col("o_orderpriority")).alias("payload"))
    return a.unionByName(b)


@query(f"WITH {STREAMS}, u AS (SELECT DISTINCT key, score FROM st), r AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank, count(*) OVER () > 40 AS has_more FROM u) SELECT * FROM r WHERE rank <= 40")
def merge_exact(spark, d):
    return search.page(streams(spark, d).select("key", "score").distinct(), 40)


@query(f"WITH {STREAMS}, u AS (SELECT DISTINCT key, key[3:] AS sort_key FROM st) SELECT * FROM u ORDER BY sort_key, key LIMIT 15")
def merge_declared(spark, d):
    return search.top(streams(spark, d).select("key", F.expr("substring(key, 3)").alias("sort_key")).distinct(), 15, "declared")


@query("WITH p AS (SELECT n_nationkey AS shard, n_nationkey % 4 AS p, n_regionkey AS s FROM nation WHERE n_nationkey < 20), c AS (SELECT shard, coalesce(s, -1) >= p AS ok, s = p AS eq FROM p), u AS (SELECT true AS at_least, shard, ok FROM c UNION ALL SELECT false, shard, eq FROM c) SELECT at_least, coalesce(string_agg(shard::VARCHAR, ',' ORDER BY shard::VARCHAR) FILTER (ok), '') AS answered, coalesce(string_agg(shard::VARCHAR, ',' ORDER BY shard::VARCHAR) FILTER (NOT ok), '') AS missing, bool_and(ok) AS complete FROM u GROUP BY 1")
def merge_coverage(spark, d):
    n = tables.table(spark, d, "nation")
    pin = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("shard"), (F.col("n_nationkey") % 4).cast("long").alias("version"))
    served = n.select(F.col("n_nationkey").alias("shard"), F.col("n_regionkey").cast("long").alias("version"))
    least, same = search.coverage(pin, served, at_least=True), search.coverage(pin, served)
    return least.withColumn("at_least", F.lit(True)).unionByName(same.withColumn("at_least", F.lit(False)))


@query(f"WITH {STREAMS}, k AS (SELECT DISTINCT key, score FROM st ORDER BY score DESC, key LIMIT 40), u AS (SELECT shard, count(*) AS c FROM st JOIN k USING (key, score) GROUP BY 1) SELECT shard, coalesce(c, 0) AS consumed FROM (SELECT DISTINCT shard FROM st) LEFT JOIN u USING (shard)")
def merge_frontier(spark, d):
    return search.frontier(streams(spark, d), 40)


@query(f"WITH {STREAMS}, o AS (SELECT key, score, payload, count(*) AS copies FROM st GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY key) > 1 AS conflict FROM o")
def merge_dup_collapse(spark, d):
    return search.collapse(streams(spark, d))


@query(f"WITH {STREAMS}, t AS (SELECT key, score FROM st ORDER BY score DESC, key LIMIT 101) SELECT key FROM t GROUP BY key HAVING count(*) > 1")
def merge_duplicates_in_window(spark, d):
    return search.duplicate_keys(streams(spark, d).select("key", "score"), "relevance", 100)


@query(f"WITH {STREAMS} SELECT shard, key, score, version FROM st WHERE (shard = 0 AND version <= 4) OR (shard = 2 AND version <= 6)")
def merge_at_pin(spark, d):
    return search.at_pin(streams(spark, d), {0: 4, 2: 6}).select("shard", "key", "score", "version")


@query(f"WITH {STREAMS}, c AS (SELECT shard, count(*) AS cost FROM st GROUP BY 1) SELECT shard, cost, sum(cost) OVER (ORDER BY shard)::BIGINT AS running, sum(cost) OVER (ORDER BY shard) <= 9000 AS within FROM c")
def merge_budget(spark, d):
    return search.budget(streams(spark, d), 9000)


@query("SELECT 1::INTEGER AS shard WHERE (SELECT count(*) FROM orders) > 3")
def merge_unordered_shards(spark, d):
    rows = [(0, 0, "a", 9), (0, 1, "b", 9), (0, 2, "a", 3), (1, 0, "x", 1), (1, 1, "y", 5)]
    return search.unordered_shards(spark.createDataFrame(rows, "shard int, pos int, key string, score long"))


# ---------------------------------------------------------------- cost
PLAN = "pl AS (SELECT o_custkey % 100 AS query, count(*) AS fanout, sum(o_orderkey % 50)::BIGINT AS rows, sum(o_orderkey % 7)::BIGINT AS tokens, sum(o_orderkey % 3 + o_orderkey % 11)::BIGINT AS keys FROM orders GROUP BY 1), pc AS (SELECT *, fanout * 1000 + keys AS cost_milli FROM pl)"


def planned(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    return cost.plan(o.selectExpr("o_custkey % 100 AS query", "o_orderkey % 3 AS term_probes", "o_orderkey % 11 AS posting_keys", "o_orderkey % 50 AS estimated_rows", "o_orderkey % 7 AS token_count"))


@query(f"WITH {PLAN} SELECT * FROM pc")
def cost_plan(spark, d):
    return planned(spark, d)


@query(f"WITH {PLAN}, e AS (SELECT *, list_filter([CASE WHEN fanout > 30 THEN 'FanoutExceeded' END, CASE WHEN tokens > 90 THEN 'TokenBudgetExceeded' END, CASE WHEN cost_milli > 30000 THEN 'BudgetExceeded' END], lambda x: x IS NOT NULL) AS e FROM pc) SELECT query, cost_milli, CASE WHEN len(e) = 0 THEN 'Admitted' ELSE 'Rejected' END AS verdict, coalesce(array_to_string(e, ','), '') AS errors, greatest(30000 - cost_milli, 0) AS remaining_milli FROM e")
def cost_admission(spark, d):
    return cost.admit(planned(spark, d), 30_000, 30, 100, 90)


@query(f"WITH {PLAN} SELECT query, '{{\"cost_milli\":' || cost_milli || ',\"fanout\":' || fanout || ',\"keys\":' || keys || ',\"query\":' || query || ',\"rows\":' || rows || ',\"tokens\":' || tokens || '}}' AS record FROM pc")
def explain_record(spark, d):
    return cost.explain(planned(spark, d))


@query("SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 97 + o_custkey % 13 > 90 THEN 'stored_bytes' WHEN o_orderkey % 31 + 1 > 25 THEN 'in_flight_requests' ELSE '' END AS exceeded FROM orders")
def quota_check(spark, d):
    o = tables.table(spark, d, "orders").selectExpr("o_orderkey AS request_id", "o_orderkey % 97 AS used_stored_bytes", "o_custkey % 13 AS want_stored_bytes", "o_orderkey % 31 AS used_in_flight_requests", "1 AS want_in_flight_requests")
    return cost.quota(o, {"in_flight_requests": 30, "stored_bytes": 90}, {"in_flight_requests": 5})


@query("SELECT p_partkey, CASE WHEN p_size <= 10 AND p_retailprice >= 1200 THEN 'hot' WHEN p_size <= 25 THEN 'warm' WHEN p_retailprice <= 1000 THEN 'cold' END AS tier FROM part")
def placement_first_match(spark, d):
    p = tables.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    rules = [{"max_p_size": 10, "min_p_retailprice": 1200, "tier": "hot"}, {"max_p_size": 25, "tier": "warm"}, {"max_p_retailprice": 1000, "tier": "cold"}]
    return cost.place(p, rules).select("p_partkey", "tier")


@query("SELECT * FROM (SELECT o_custkey AS \"group\", o_orderkey AS idx, o_totalprice::BIGINT AS bytes, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS total FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS o_totalprice FROM orders)) WHERE total <= 600000")
def warmup_prefix_budget(spark, d):
    items = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").alias("bytes"))
    return cost.warm_up(items, 600_000)


RECEIPTS = "rc AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Committed' WHEN 'O' THEN 'Conflict' ELSE 'Queued' END AS state FROM orders)"


@query(f"WITH {RECEIPTS} SELECT count(*) FILTER (state = 'Conflict') AS conflicts, count(*) FILTER (state <> 'Queued') AS settled, count(*) FILTER (state = 'Conflict') / count(*) FILTER (state <> 'Queued') AS rate FROM rc")
def conflict_rate(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "Committed").when(F.col("o_orderstatus") == "O", "Conflict").otherwise("Queued")
    return cost.conflict_rate(tables.table(spark, d, "orders").select(state.alias("state")))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN sign(s_suppkey * 7 - s_nationkey * 50)::BIGINT * ((abs(s_suppkey * 7 - s_nationkey * 50) * 1000000) // (s_nationkey * 100)) END::BIGINT AS slope FROM supplier")
def slope_per_decade(spark, d):
    s = tables.table(spark, d, "supplier")
    return s.select("s_suppkey", cost.slope_per_decade(F.col("s_nationkey").cast("long") * 50, F.col("s_suppkey") * 7, F.lit(2).cast("long")).alias("slope"))


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999 FROM events")
def latency_percentiles(spark, d):
    return cost.percentiles(tables.table(spark, d, "events"), "value")


@query("SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events")
def store_counters(spark, d):
    return cost.counters(tables.table(spark, d, "events").select(F.col("event_type").alias("kind")), ["click", "error", "view"])


BUCKET = """RECURSIVE q AS (SELECT user_id AS key, event_id AS id, event_id * 137 AS "at", event_id % 4 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 137, event_id % 4, event_id) AS n FROM events),
s(key, n, tokens, updated, id, "at", cost, admitted) AS (SELECT DISTINCT key, 0::BIGINT, 5::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM q
UNION ALL SELECT key, n, t - CASE WHEN t >= cost THEN cost ELSE 0 END, u, id, "at", cost, t >= cost FROM (SELECT q.key, q.n, q.id, q."at", q.cost, CASE WHEN q."at" <= s.updated OR s.tokens >= 5 THEN s.tokens ELSE least(s.tokens + (q."at" - s.updated) * 2 // 1000, 5) END AS t, CASE WHEN q."at" <= s.updated THEN s.updated WHEN s.tokens >= 5 THEN q."at" ELSE s.updated + ((q."at" - s.updated) * 2 // 1000) * 1000 // 2 END AS u FROM s JOIN q ON q.key = s.key AND q.n = s.n + 1))"""


@query(f'WITH {BUCKET} SELECT key, id, "at", cost, admitted FROM s WHERE n > 0')
def token_bucket(spark, d):
    ship(spark)
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.col("event_id") * 137).alias("at"), (F.col("event_id") % 4).alias("cost"))
    return cost.token_buckets(e, 5, 2)


# ---------------------------------------------------------------- policies
ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


def policy_rows(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), (F.col("o_custkey") % 2 == 0).alias("even"))
    return o.select("o_orderkey", "o_custkey", row.alias("before"), row.alias("after"))


P = policy.Path
READ = policy.And(policy.Compare("ne", P("after", "status"), policy.Literal("P")), policy.Or(P("after", "even"), policy.In(P("after", "priority"), ("1-URGENT", "2-HIGH"))))
STRICT = policy.And(policy.Compare("eq", P("after", "status"), policy.Literal("F")), policy.Not(P("after", "even")))
BROKEN = policy.Compare("lt", P("after", "id"), policy.Literal("7"))
PRIO = "o_orderkey % 5 <> 0"


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'deny' WHEN o_custkey % 2 = 0 THEN 'allow' WHEN {PRIO} AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'allow' ELSE 'deny' END AS verdict, CASE WHEN o_orderstatus = 'P' THEN 'False' WHEN o_custkey % 2 = 0 THEN '' WHEN NOT ({PRIO}) THEN 'UnknownField' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '' ELSE 'False' END AS reason FROM orders")
def policy_read(spark, d):
    return policy.evaluate(policy_rows(spark, d), READ).select("o_orderkey", "verdict", "reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (2, 39) THEN 'allow' ELSE 'deny' END AS verdict FROM orders")
def policy_in_kinds(spark, d):
    return policy.evaluate(policy_rows(spark, d), policy.In(P("after", "id"), (2, "7", "x", 39, None))).select("o_orderkey", "verdict")


@query("SELECT o_orderkey, (11 + CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_custkey % 2 = 0 THEN 6 ELSE 32 END)::BIGINT AS steps FROM orders")
def policy_steps(spark, d):
    return policy.evaluate(policy_rows(spark, d), READ).select("o_orderkey", "steps")


STOPPED = "SELECT o_orderkey, '{name}' AS budget, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 0 THEN 'allow' ELSE 'deny' END AS verdict, CASE WHEN o_orderstatus = 'P' THEN 'False' WHEN o_custkey % 2 = 0 THEN '' ELSE '{name}' END AS reason, CASE WHEN o_orderstatus = 'P' THEN 11 ELSE 17 END::BIGINT AS steps FROM orders"


@query(f"{STOPPED.format(name='StepBudget')} UNION ALL {STOPPED.format(name='MemoryBudget')} UNION ALL SELECT o_orderkey, 'DepthBudget', 'deny', CASE WHEN o_orderstatus = 'P' THEN 'False' WHEN o_custkey % 2 = 0 THEN '' ELSE 'DepthBudget' END, CASE WHEN o_orderstatus = 'P' THEN 11 WHEN o_custkey % 2 = 0 THEN 17 ELSE 34 END FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'DepthBudget', 'allow', '', 17 FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 2 = 0")
def policy_budgets(spark, d):
    rows = policy_rows(spark, d)
    budgets = {"StepBudget": {"max_steps": 20}, "MemoryBudget": {"max_steps": 40, "max_arena": 20}, "DepthBudget": {"max_depth": 2}}
    parts = [policy.evaluate(rows, READ, **b).select("o_orderkey", F.lit(name).alias("budget"), "verdict", "reason", "steps") for name, b in budgets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, 'deny' AS verdict, 'NotTotal' AS reason FROM orders")
def policy_cross_type(spark, d):
    return policy.evaluate(policy_rows(spark, d), BROKEN).select("o_orderkey", "verdict", "reason")


@query("WITH p AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, CASE WHEN before IS NULL THEN 'deny' WHEN (value * 100)::BIGINT >= (before * 100)::BIGINT THEN 'allow' ELSE 'deny' END AS verdict FROM p")
def policy_write_before_after(spark, d):
    from pyspark.sql import Window

    e = tables.table(spark, d, "events")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    cents = lambda c: F.round(c * 100).cast("long").alias("v")
    rows = e.withColumn("b", before).select("event_id", F.struct(cents(F.col("b"))).alias("before"), F.struct(cents(F.col("value"))).alias("after"))
    return policy.evaluate(rows, policy.Compare("ge", P("after", "v"), P("before", "v"))).select("event_id", "verdict")


@query(f"WITH v AS (SELECT o_custkey, o_orderstatus <> 'P' AND (o_custkey % 2 = 0 OR ({PRIO} AND o_orderpriority IN ('1-URGENT', '2-HIGH'))) AS ok FROM orders) SELECT o_custkey, CASE WHEN bool_and(ok) THEN 'allow' ELSE 'deny' END AS verdict, count(*) FILTER (NOT ok) AS denied FROM v GROUP BY 1")
def policy_batch_and(spark, d):
    return policy.evaluate_batch(policy_rows(spark, d), READ, "o_custkey")


@query(f"WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' AND (o_custkey % 2 = 0 OR ({PRIO} AND o_orderpriority IN ('1-URGENT', '2-HIGH'))) THEN 'allow' ELSE 'deny' END AS a, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 <> 0 THEN 'allow' ELSE 'deny' END AS b FROM orders) SELECT o_custkey, o_orderkey, a AS from_verdict, b AS to_verdict FROM v WHERE a <> b")
def policy_dry_run_flips(spark, d):
    return policy.dry_run(policy_rows(spark, d), READ, STRICT, ["o_custkey", "o_orderkey"])


@query("WITH a AS (SELECT 'r' || n_nationkey AS rule_id, n_name AS body FROM nation WHERE n_nationkey < 20), b AS (SELECT 'r' || n_nationkey AS rule_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '!' ELSE n_name END AS body FROM nation WHERE n_nationkey > 4) SELECT rule_id, CASE WHEN a.body IS NULL THEN 'added' WHEN b.body IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (rule_id) WHERE a.body IS NULL OR b.body IS NULL OR a.body <> b.body")
def policy_structural_diff(spark, d):
    n = tables.table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.col("n_name").alias("body"), "n_nationkey")
    new = n.where("n_nationkey > 4").withColumn("body", F.when(F.col("n_nationkey") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return policy.structural_diff(n.where("n_nationkey < 20"), new)
