"""Small fixtures for what the tables don't show."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlake.functions import keys, text
from orderlake.operators import cdc, cost, events, index, mvcc, policy, scan, search, staleness, write
from orderlake.sources import store


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(6)], "key string, value string")


def test_bounds():
    assert keys.upper_bound("ab") == "ac"
    assert keys.upper_bound("a\U0010ffff") == "b"
    assert keys.upper_bound("\U0010ffff") is None
    assert keys.upper_bound("\ud7ff") == "\ue000"
    assert keys.table_bounds("t") == (b"\x01t\x00", b"\x01t\x01")
    with pytest.raises(scan.ScanError):
        scan.key_range(F, "b", "a")


def test_scans(spark, kv):
    assert rows(scan.scan_range(kv, "k4", "k2", 10)) == []
    assert rows(scan.scan_range(kv, None, None, 0)) == []
    assert [r.key for r in scan.scan_range(kv, "k4", "k2", None, "prev").collect()] == ["k4", "k3", "k2"]
    assert scan.scan_prefix(kv, "k", None, 6).next_key().first()[0] is None
    assert scan.scan_prefix(kv, "k", None, 5).next_key().first()[0] == "k4"
    with pytest.raises(PySparkException):
        scan.get_required(kv, "no").collect()
    with pytest.raises(PySparkException):
        scan.page_by_bytes(kv, 5, 3).collect()
    with pytest.raises(scan.ScanError):
        scan.page_by_bytes(kv, 0, 3)
    token = scan.Cursor(3, "k1", "next").token()
    assert scan.Cursor.read(token, 3, "next").position == "k1"
    with pytest.raises(scan.ScanError):
        scan.Cursor.read(token, 4, "next")


def test_key_encoding_keeps_order(spark):
    values = [("a", -5), ("a", 3), ("a\0", -1), ("a\0b", 2), ("ab", 0), ("b", -(2**63))]
    frame = spark.createDataFrame(values, "s string, n long")
    coded = frame.select("s", "n", keys.encode_key("t", ("text", F.col("s")), ("i64", F.col("n"))).alias("k")).orderBy("k").collect()
    assert [(r.s, r.n) for r in coded] == sorted(values)


LOG = [(1, "a", "1"), (1, "b", "1"), (2, "a", None), (2, "c", "2"), (3, "a", "3"), (4, "b", None), (5, "f", "5"), (5, "c", "5")]


@pytest.mark.parametrize("pin", range(6))
def test_newest_wins_two_ways(spark, pin):
    log = spark.createDataFrame([(0, k, v, x) for v, k, x in LOG], "shard int, key string, version long, value string")
    by = Window.partitionBy("shard", "key").orderBy(F.desc("version"))
    other = log.where(F.col("version") <= pin).withColumn("n", F.row_number().over(by)).where("n = 1 and value is not null").select("shard", "key", "version", "value")
    assert rows(mvcc.latest(log, pin)) == rows(other)
    assert rows(mvcc.latest(mvcc.compact(log, 3), 5)) == rows(mvcc.latest(log, 5))


def test_tokenizers(spark):
    frame = spark.createDataFrame([("Hello, WORLD! foo_bar café a-b_c",)], "t string")
    got = frame.select(text.ascii_words(F.col("t")), text.replica_words(F.col("t"))).first()
    assert got[0] == ["hello", "world", "foo_bar", "caf", "a", "b_c"]
    assert got[1] == ["hello", "world", "foo", "bar", "caf", "a", "b", "c"]
    assert text.fold_words("Straße cafe\u0301 a-b_c \u0301x") == ["strasse", "caf\u00e9", "a", "b_c", "x"]
    with pytest.raises(PySparkException):
        frame.select(text.checked(text.ascii_words(F.col("t")), 2)).collect()


def test_scores(spark):
    frame = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "tf long, n long")
    assert [r[0] for r in frame.select(index.term_score(F.col("tf"), F.col("n"))).collect()] == [0, 1000, 1375]
    with pytest.raises(index.IndexRefusal):
        index.term_score(F.col("tf"), F.col("n"), b=1001)
    assert index.flag_bits(["b", "a"], ["a", "b"]) == 3


def test_pinned_search(spark):
    docs = [(0, "d1", 1, "f", "one two", 1, 0), (0, "d1", 2, "f", "two", 1, 0), (0, "d2", 1, "f", "one one", 0, 0), (0, "d3", 3, "f", None, 0, 0), (0, "d3", 1, "f", "one", 0, 0)]
    frame = spark.createDataFrame(docs, "shard int, key string, version long, field string, text string, filter_flags long, search_flags long")
    hit = lambda *a, **k: sorted(r.key for r in index.search(frame, *a, **k).collect())
    assert hit(["one"]) == ["d2"]
    assert hit(["one"], pin=1) == ["d1", "d2", "d3"]
    assert hit(["one", "two"], mode="all", pin=1) == ["d1"]
    assert hit([], filter_flags=1) == ["d1"]
    with pytest.raises(index.IndexRefusal):
        index.visible(frame, 1, oldest=2)
    own = index.derive(frame.where("text is not null"), "d")
    assert rows(index.document_frequency(own, index.visible(frame, 1), "f", "one")) == [(3,)]
    with pytest.raises(PySparkException):
        index.derive(frame.where("key = 'd2'").unionByName(frame.where("key = 'd2'")), "d").collect()
    assert rows(index.digest(own)) == rows(index.digest(own.repartition(3)))


def test_merging(spark):
    hits = spark.createDataFrame([(s, k, 5) for s, k in ((0, "b"), (1, "a"), (2, "c"))], "shard int, key string, score long")
    assert [r.key for r in search.top(hits, 3).collect()] == ["a", "b", "c"]
    assert [r.key for r in search.top(hits, 3, after=(5, "a")).collect()] == ["b", "c"]
    assert all(r.has_more for r in search.page(hits, 2).collect())
    cursor = search.SearchCursor("f", (5, "a"), "relevance")
    assert search.SearchCursor.read(cursor.token(), "f", "relevance") == cursor
    with pytest.raises(search.SearchRefusal):
        search.SearchCursor.read(cursor.token(), "g", "relevance")
    pin = spark.createDataFrame([(0, 1), (1, 1)], "shard int, version long")
    assert search.exact(hits, pin, pin, 2).count() == 2
    with pytest.raises(PySparkException):
        search.exact(hits, pin, pin.where("shard = 0"), 2).collect()


def test_policy_budget_and_paths(spark):
    frame = spark.createDataFrame([((1, True), (2, None))], "before struct<n:long,b:boolean>, after struct<n:long,b:boolean>")
    P, L = policy.Path, policy.Literal
    tree = policy.Or(policy.Compare("gt", P("after", "n"), P("before", "n")), policy.Exists(P("after", "b")))
    one = lambda t, **k: tuple(policy.evaluate(frame, t, **k).select("verdict", "reason").first())
    assert one(tree) == ("allow", "")
    assert one(tree, max_steps=2) == ("deny", policy.STEPS)
    assert one(tree, max_depth=1) == ("deny", policy.DEPTH)
    assert one(policy.Compare("lt", P("before", "b"), L(True))) == ("deny", policy.PARTIAL)
    assert one(policy.And(L(False), P("after", "b"))) == ("deny", "False")
    assert one(policy.And(L(True), P("after", "b"))) == ("deny", policy.UNKNOWN)
    assert one(policy.Not(L(5))) == ("deny", policy.PARTIAL)
    with pytest.raises(policy.PolicyError):
        policy.validate(P("after", "x"), frame.schema)
    with pytest.raises(policy.PolicyError):
        policy.measure("text")
    # or 1, greater 1, a name of one letter 2 each: the budget ends before the name that it can't pay
    spent = lambda t, **k: tuple(policy.evaluate(frame, t, **k).select("reason", "steps").first())
    assert spent(tree) == ("", 6)
    assert spent(tree, max_steps=5) == (policy.STEPS, 4)
    assert spent(tree, max_arena=3) == (policy.MEMORY, 2)
    assert spent(tree, max_steps=3, max_arena=3) == (policy.STEPS, 2)
    # a fault that comes first ends it first
    assert spent(policy.And(P("after", "b"), L("long text")), max_steps=4) == (policy.UNKNOWN, 3)
    assert spent(policy.In(P("after", "n"), ("two", 2))) == ("", 9)
    assert policy.measure(policy.In(P("after", "n"), ("two", 2))) == (4, 2)
    deep = tree
    for _ in range(130):
        deep = policy.Not(deep)
    with pytest.raises(policy.PolicyError):
        policy.evaluate(frame, deep)
    assert policy.path_diff([P("before", "n")], [tree]) == (["after.b", "after.n"], [])


def test_backoff_and_bucket(spark):
    frame = spark.createDataFrame([(1,), (2,), (9,), (70,)], "a int")
    assert [r[0] for r in frame.select(events.backoff(F.col("a"), 100, 5000)).collect()] == [100, 200, 5000, 5000]
    assert frame.select(events.backoff(F.col("a"), 100, 5000, hint=F.lit(700))).first()[0] == 700
    assert cost.refill(0, 0, 1499, 10, 2) == (2, 1000)
    assert cost.refill(10, 5, 9, 10, 2) == (10, 9)
    assert cost.refill(0, 5, 6, 10, 2) == (0, 5)


def test_token_buckets_match_a_loop(spark):
    data = [(k, i, i * 300 + k, 1 + i % 3) for k in range(3) for i in range(40)]
    got = {(r.key, r.id): r.admitted for r in cost.token_buckets(spark.createDataFrame(data, "key long, id long, at long, cost long"), 4, 3).collect()}
    want = {}
    for k in range(3):
        tokens, at = 4, 0
        for _, i, now, c in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[3], x[1])):
            tokens, at = cost.refill(tokens, at, now, 4, 3)
            want[k, i] = tokens >= c
            tokens -= c if tokens >= c else 0
    assert got == want


def test_plan_golden(spark):
    shards = spark.createDataFrame([("q", 2, 100, 10, 3), ("q", 3, 200, 20, 3)], "query string, term_probes long, posting_keys long, estimated_rows long, token_count long")
    assert cost.plan(shards).first().cost_milli == 2305


def test_verdict_of_repeated_places(spark):
    current = spark.createDataFrame([(1, 1)], "key int, version int")
    bad = [(1, 0), (1, 2)]  # a conflict, a stale base
    got = []
    for turn in (bad, bad[::-1]):
        same = [(r, 1, k, b) for r in (1, 2) for k, b in turn]
        rest = [(2, 0, 1, 0), (3, None, 1, 0), (4, None, 1, 2), (4, 5, 1, 0), (5, 1, 1, 1), (5, 1, 1, 1)]
        m = spark.createDataFrame(same + rest, "request int, pos int, key int, base int").coalesce(1)
        got.append(rows(write.check_versions(m, current)))
    want = [(1, "Rejected"), (2, "Conflict"), (3, "Conflict"), (4, "Conflict"), (5, "Pass")]
    assert got == [want, want]


def test_audit_chain(spark):
    chain = write.audit_chain(spark.createDataFrame([(0, i, f"e{i}") for i in range(5)], "shard int, seq long, body string"))
    assert {r.status for r in write.audit_verify(chain).collect()} == {"Ok"}
    torn = write.audit_verify(chain.where("seq <> 2")).collect()
    assert [r.status for r in sorted(torn, key=lambda r: r.seq)] == ["Ok", "Ok", "Gap", "Ok"]


def test_export_round_trip_and_refusals(spark, kv):
    assert rows(store.read_export(spark, store.export_header(), store.export(kv))) == rows(kv)
    with pytest.raises(ValueError):
        store.read_export(spark, b"other", store.export(kv))
    torn = store.export(kv).withColumn("body", F.expr("substring(body, 1, length(body) - 1)"))
    with pytest.raises(PySparkException):
        store.read_export(spark, store.export_header(), torn).collect()


def test_snapshot_is_read_only(spark, kv, tmp_path):
    path = str(tmp_path / "s")
    assert rows(store.snapshot(kv, path)) == rows(kv)
    with pytest.raises(PySparkException):
        store.snapshot(kv, path)


def test_empty_inputs(spark, kv):
    none = kv.limit(0)
    assert scan.count_prefix(none, "k", 5).first().n == 0
    assert scan.has(none, "k").first().found is False
    assert staleness.version_lag(spark.createDataFrame([], "shard int, version long"), spark.createDataFrame([], "shard int, version long")).first()[0] == 0
    assert cdc.invalidation(*[spark.createDataFrame([], "fact string, type string, owner string, revoked boolean, value string")] * 2, "RuleChanged").first()[0] == "RuleChanged"


def test_options_of_another_kind_equal_nothing(spark):
    rows = spark.createDataFrame([((2, "2", True),), ((3, "x", False),)], "after struct<n: long, t: string, b: boolean>").withColumn("before", F.col("after"))
    seen = lambda name, options: [r.verdict for r in policy.evaluate(rows, policy.In(policy.Path("after", name), options)).orderBy("after.n").collect()]
    assert seen("n", ("2", "x")) == ["deny", "deny"]
    assert seen("n", ("x", 2)) == ["allow", "deny"]
    assert seen("t", (2, "x")) == ["deny", "allow"]
    assert seen("b", (1, "true")) == ["deny", "deny"]


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "pos long").repartition(5)
    got = store.numbered(rows, "pos", 8).collect()
    assert sorted((r.pos, r.nth) for r in got) == [(i, i + 1) for i in range(1000)]
    assert store.append_feed(spark.createDataFrame([], "seq long"), spark.createDataFrame([(5, "a")], "pos long, value string")).collect()[0].seq == 1
