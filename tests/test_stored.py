"""Stored tables and indexes at a pin, refusals, and the rounds of a scheduler on small rows."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orderlake import catalog3
from orderlake.engine import View
from orderlake.functions.text import fold_words
from orderlake.operators import cdc, cost, events, policy, scan, search, write
from orderlake.operators.index import IndexRefusal
from orderlake.operators.search import SearchRefusal
from orderlake.sources import store
from orderlake.sources.commits import CommitError, CommitTable
from orderlake.sources.hydrate import Hydration, page_crc
from orderlake.sources.migrate import STEPS, Migration, MigrationError
from orderlake.sources.segments import SegmentIndex
from orderlake.sources.shared import scratch

PUTS = "shard int, key string, field string, text string, filter_flags long, search_flags long"


@pytest.fixture()
def table(spark):
    t = CommitTable(spark, scratch(spark, "views"))
    t.append(spark.createDataFrame([(0, f"k{i}", "set", f"v{i}") for i in range(9)], "pos int, key string, op string, value string"), 1)
    t.append(spark.createDataFrame([(0, "k3", "delete", None), (0, "k4", "set", "new")], "pos int, key string, op string, value string"), 2)
    return t


def keys(df):
    return [r.key for r in df.collect()]


def test_views_keep_their_pin(spark, table):
    old, new = View(table, 1), View(table)
    assert old.has("k3") and not new.has("k3")
    assert [r.value for r in old.get("k4").collect()] == ["v4"] and [r.value for r in new.get("k4").collect()] == ["new"]
    table.append(spark.createDataFrame([(0, "k5", "delete", None)], "pos int, key string, op string, value string"), 3)
    assert new.has("k5") and not View(table).has("k5")
    with pytest.raises(CommitError):
        View(table, 4)
    table.compact()
    with pytest.raises(CommitError):
        View(table, 1)


def test_pages_meet_all_rows_once(table):
    for direction, want in (("next", [f"k{i}" for i in range(9) if i != 3]), ("prev", [f"k{i}" for i in range(8, -1, -1) if i != 3])):
        view, got, token = View(table), [], None
        for _ in range(9):
            page = view.page(3, 1 << 20, token=token, direction=direction)
            got += keys(page.rows)
            if (token := page.token) is None:
                break
        assert got == want


def test_pages_refuse(table):
    view = View(table)
    token = view.page(2, 1 << 20).token
    with pytest.raises(scan.ScanError):
        View(table, 1).page(2, 1 << 20, token=token)
    with pytest.raises(scan.ScanError):
        view.page(2, 1 << 20, token=token, direction="prev")
    with pytest.raises(scan.ScanError):
        view.page(2, 1 << 20, "b", "a")
    with pytest.raises(scan.ScanError):
        view.page(0, 1 << 20)
    with pytest.raises(PySparkException):
        view.page(2, 1)
    assert view.page(2, 1 << 20, "x", "z").token is None


def test_unknown_operations_fail(spark, table):
    with pytest.raises(PySparkException):
        table.append(spark.createDataFrame([(0, "k1", "put", "x")], "pos int, key string, op string, value string"), 9)
    assert table.version() == 2


@pytest.fixture()
def segments(spark):
    out = SegmentIndex(spark, scratch(spark, "segments"), ["body", "title"], flags=1, buckets=4)
    out.commit(1, spark.createDataFrame([(0, "a", "body", "red fish red", 1, 0), (0, "a", "title", "fish", 1, 0), (0, "b", "body", "blue fish", 0, 0), (1, "c", "body", "", 0, 0), (1, "d", "body", None, 0, 0)], PUTS))
    out.commit(2, spark.createDataFrame([(0, "b", "body", "red", 0, 0)], PUTS), spark.createDataFrame([(0, "a"), (0, "b")], "shard int, key string"))
    return out


def found(df):
    return sorted(r.key for r in df.collect())


def test_index_shows_its_pin(segments):
    assert found(segments.search("red")) == ["b"]
    assert found(segments.search("RED, fish!", pin=1)) == ["a", "b"]
    assert found(segments.search("red fish", "all", pin=1)) == ["a"]
    assert found(segments.search("fish", pin=1, fields=["title"])) == ["a"]
    assert found(segments.search("fish", pin=1, filter_flags=1)) == ["a"]
    assert found(segments.search("")) == ["b", "c", "d"]
    assert found(segments.search("none of these")) == []
    match = segments.search("red", pin=1).first().matches
    assert [(m.field, m.term, m.tf, m.positions) for m in match] == [("body", "red", 2, [0, 2])]
    assert segments.document_frequency("body", "fish", 1).first().n == 2


def test_index_refuses(spark, segments):
    for call in (
        lambda: segments.search("red", pin=3),
        lambda: segments.search("red", fields=["other"]),
        lambda: segments.search("red", filter_flags=2),
        lambda: segments.search("red", "some"),
        lambda: segments.commit(2, spark.createDataFrame([], PUTS)),
        lambda: SegmentIndex(spark, segments.folder, ["body"], tokenizer="none"),
    ):
        with pytest.raises(IndexRefusal):
            call()
    with pytest.raises(PySparkException):
        segments.commit(3, spark.createDataFrame([(0, "a", "other", "x", 0, 0)], PUTS))
    small = SegmentIndex(spark, segments.folder, ["body"], budget=segments.bytes() + 5)
    with pytest.raises(IndexRefusal):
        small.commit(3, spark.createDataFrame([(0, "a", "body", "many other words", 0, 0)], PUTS))
    assert segments.version() == 2 and found(segments.search("red")) == ["b"]


def test_index_notices_changed_postings(segments):
    entries = segments.manifest()
    entries[1]["digests"] = {b: "1:1" for b in entries[1]["digests"]}
    segments._publish(entries)
    with pytest.raises(IndexRefusal):
        segments.search("red")
    assert found(segments.search("red", pin=1)) == ["a"]


def test_index_compacts_and_opens_few_buckets(spark, segments):
    segments.compact()
    segments.verify()
    assert len(segments.manifest()) == 1 and found(segments.search("")) == ["b", "c", "d"] and found(segments.search("red")) == ["b"]
    with pytest.raises(IndexRefusal):
        segments.search("red", pin=1)
    segments.commit(3, spark.createDataFrame([(0, "e", "body", "red", 0, 0)], PUTS))
    assert found(segments.search("red", pin=2)) == ["b"] and found(segments.search("red")) == ["b", "e"]
    plan = segments.postings(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_index(spark):
    out = SegmentIndex(spark, scratch(spark, "none"), ["body"])
    assert found(out.search("red")) == [] and found(out.search("")) == []
    out.commit(1, spark.createDataFrame([], PUTS))
    assert found(out.search("red")) == []
    out.compact()


def test_unicode_tokens_against_plain(spark, folder):
    got = {r.doc_id: r.tokens for r in catalog3.tok_unicode_tokens(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: fold_words(r.text) for r in texts}


REQUESTS = "request int, shard int, key string, arrival int, state string, deps array<int>"


def reasons(spark, rows, positions, edges, epoch=0, blocked=()):
    shards = spark.createDataFrame([(s, s in blocked) for s in sorted({r[1] for r in rows})], "shard int, blocked boolean")
    out = write.decide(spark.createDataFrame(rows, REQUESTS), shards, positions, edges, epoch).collect()
    picked = [r.request for r in sorted((r for r in out if r.position), key=lambda r: r.position)]
    return picked, {r.request: r.reason for r in out}


def test_scheduler_takes_turns(spark):
    rows = [(s * 10 + i, s, f"k{i}", i, "Queued", []) for s in (0, 1, 2) for i in range(3)]
    assert reasons(spark, rows, 5, 9)[0] == [0, 10, 20, 1, 11]
    assert reasons(spark, rows, 4, 9, epoch=4)[0] == [10, 20, 0, 11]
    assert reasons(spark, rows, 4, 9, epoch=4, blocked=(1,))[0] == [0, 20, 1, 21]
    assert reasons(spark, rows, 0, 9) == ([], {r[0]: "OutsideBudget" for r in rows})


def test_scheduler_says_why(spark):
    rows = [
        (1, 0, "a", 0, "Terminal", []),
        (2, 0, "a", 1, "InFlight", []),
        (3, 0, "a", 2, "Queued", []),
        (4, 0, "b", 3, "Queued", [3]),
        (5, 0, "c", 4, "Queued", [1, 1]),
        (6, 0, "d", 5, "Queued", [1]),
        (7, 1, "e", 0, "Queued", None),
    ]
    picked, why = reasons(spark, rows, 9, 1)
    assert picked == [5, 7]
    assert why == {2: "InFlight", 3: "KeyBlocked", 4: "DependencyBlocked", 5: "Selected", 6: "OutsideBudget", 7: "Selected"}


def test_admission(spark):
    rows = [(1, 0, 0, []), (2, 0, 1, [1]), (3, 0, 2, [3]), (4, 0, 3, [3]), (5, 0, 4, [4]), (6, 1, 5, [1]), (7, 0, 6, [9]), (8, 0, 7, [1, 2, 6]), (1, 0, 8, []), (10, 0, 9, [1, 2])]
    df = spark.createDataFrame(rows, "request int, shard int, arrival int, deps array<int>")

    def keep(t, n):
        path = scratch(spark, "admit")
        t.write.parquet(path)
        return spark.read.schema(t.schema).parquet(path)

    got = {r.arrival: r.verdict for r in write.admit_requests(df, 2, keep).collect()}
    assert [got[i] for i in range(10)] == ["Admitted", "Admitted", "Cycle", "ForwardReference", "ForwardReference", "CrossShardEdge", "ForwardReference", "FanInExceeded", "DuplicateRequest", "Admitted"]


def test_plans_of_scopes_refuse(spark):
    shards = spark.createDataFrame([("t", 0), ("u", 1), ("v", 0), ("v", 1)], "table_name string, shard int")
    assert sorted((r.shard, r.prefixes) for r in scan.shard_plan(["u/2", "t/", "u/1"], shards, 2).collect()) == [(0, ["t/"]), (1, ["u/2", "u/1"])]
    for prefixes, most in ((["w/"], 9), (["v/"], 9), (["t/", "u/"], 1)):
        with pytest.raises(PySparkException):
            scan.shard_plan(prefixes, shards, most).collect()


def test_coordinator_refuses(spark):
    hits = spark.createDataFrame([(0, "a", 5, 1), (0, "b", 4, 3), (1, "c", 3, 1), (1, "d", 2, 1)], "shard int, key string, score long, version long")
    served = spark.createDataFrame([(0, 2, True), (1, 2, True), (2, 2, False), (3, 1, True)], "shard int, version long, digest_ok boolean")
    ask = lambda targets, **more: search.execute(hits, served, targets, {t: 2 for t in targets}, 2, **more)
    first = ask([0, 1])
    assert keys(first.rows.orderBy("rank")) == ["a", "c"] and first.answered == (0, 1)
    assert keys(ask([0, 1], token=first.token).rows) == ["d"]
    assert ask([0, 1], budget=5).budget == 2
    assert ask([0, 3], coverage_mode=True).missing == (3,)
    for targets, more in (
        ([0, 3], {}),
        ([0, 2], {}),
        ([0, 9], {}),
        ([0, 1], {"fanout": 1}),
        ([0, 1], {"budget": 2}),
        ([0, 1], {"retained": {1: 3}}),
        ([0, 1], {"token": first.token, "query": "other"}),
        ([0, 1], {"token": first.token, "coverage_mode": True}),
    ):
        with pytest.raises(SearchRefusal):
            ask(targets, **more)
    twice = hits.unionByName(spark.createDataFrame([(1, "a", 5, 1)], hits.schema))
    with pytest.raises(SearchRefusal):
        search.execute(twice, served, [0, 1], {0: 2, 1: 2}, 2)


def test_local_reads_without_a_pin(spark):
    reads = spark.createDataFrame([(1, "a", {"s": 1}), (2, "a", {})], "read_id int, key string, pin map<string,bigint>")
    members = spark.createDataFrame([("a", 7)], "key string, key_version long")
    assert {r.read_id: r.state for r in cdc.read_at(reads, members, {}).collect()} == {1: "NotHydrated", 2: "Present"}


def test_rollouts_abort_before_they_promote(spark):
    plans = spark.createDataFrame([("a", 1, 2, 0, 1, 5, True), ("b", 1, 2, 0, 9, 5, True), ("c", 1, 2, 0, 9, 5, False), ("d", 1, 2, 3, 1, 99, True)], "cohort string, base int, candidate int, since int, most int, expires int, automatic boolean")
    done = spark.createDataFrame([("a", 1), ("a", 2), ("d", 1), ("d", 4), ("d", 11)], "cohort string, at int")
    got = {r.cohort: (r.operations, r.step, r.version) for r in write.rollout_tick(plans, done, 10).collect()}
    assert got == {"a": (2, "Aborted", 1), "b": (0, "Promoted", 2), "c": (0, "Continue", 2), "d": (1, "Continue", 2)}


def test_streams_load_at_once_or_by_pages(spark):
    rows = spark.createDataFrame([(f"k{i:02d}", f"ü{i}") for i in range(23)], "key string, value string")
    chunks = store.export_stream(rows)
    for page, commits in ((None, 1), (4, 6)):
        t = CommitTable(spark, scratch(spark, "loaded"))
        assert store.load_stream(t, chunks.where("first_key IS NULL").unionByName(chunks.where("first_key IS NOT NULL")), 1, page) == 23
        assert sorted(map(tuple, t.read().select("key", "value").collect())) == sorted(map(tuple, rows.collect()))
        assert len(t.manifest()) >= commits
    torn = chunks.withColumn("body", F.expr("IF(chunk = 1, substring(body, 1, length(body) - 1), body)"))
    t = CommitTable(spark, scratch(spark, "torn"))
    with pytest.raises(PySparkException):
        store.load_stream(t, torn, 1)
    assert t.version() == 0
    with pytest.raises(ValueError):
        store.load_stream(t, chunks.where("chunk = 1"), 1)
    with pytest.raises(ValueError):
        store.load_stream(t, chunks, 1, 0)


def test_hydration_shows_nothing_before_it_is_whole(spark):
    rows = spark.createDataFrame([(i // 2, f"k{i}", None if i == 3 else f"v{i}") for i in range(6)], "page long, key string, value string")
    plan = page_crc(rows)
    h = Hydration(spark, scratch(spark, "hydration"))
    assert h.receive(rows.where("key <> 'k1'"), plan, 0) == 1
    with pytest.raises(CommitError):
        h.publish(plan, 4)
    with pytest.raises(CommitError):
        h.read()
    # the round that brings the rest also brings pages that are there
    assert h.receive(rows, plan, 1) == 0
    h.publish(plan, 4)
    assert sorted(r.key for r in h.read().collect()) == [f"k{i}" for i in range(6)]
    diffs = spark.createDataFrame([("k0", 4, "set", "old"), ("k1", 5, "delete", None), ("k9", 5, "set", "x")], "key string, version long, op string, value string")
    got = {r.key: r.value for r in h.read(diffs).collect()}
    assert got["k0"] == "v0" and got["k9"] == "x" and "k1" not in got and got["k3"] is None


def test_quantiles_between_rows(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(1, 8)] + [(None,)], "x double")
    assert tuple(cost.percentiles(frame, "x", (("a", 0.5), ("b", 0.25), ("c", 0.0), ("d", 1.0))).first()) == (4.0, 2.5, 1.0, 7.0)
    assert tuple(cost.percentiles(frame.where("x IS NULL"), "x").first()) == (None, None, None)


def test_migration_goes_on_and_back(spark, table):
    mine = lambda: Migration(spark, f"{table.folder}/pointer", table.folder, f"{table.folder}/epoch2", lambda rows: rows.withColumn("value", F.upper("value")))
    assert mine().step() == STEPS[0] and not mine().admits_writes()
    with pytest.raises(MigrationError):
        mine().step(unfinished=2)
    # each step by a driver of its own
    assert [mine().step() for _ in range(3)] == list(STEPS[1:4])
    assert mine().current().folder == table.folder
    assert mine().step() == STEPS[4] and mine().step() is None and mine().admits_writes()
    got = {r.key: r.value for r in mine().current().read().collect()}
    assert got["k4"] == "NEW" and "k3" not in got and len(got) == 8
    mine().rollback()
    assert mine().current().folder == table.folder and mine().done() == []
    mine().run()
    mine().target.append(spark.createDataFrame([(0, "k1", "set", "x")], "pos int, key string, op string, value string"), 9)
    with pytest.raises(MigrationError):
        mine().rollback()


def test_migration_notices_other_rows(spark, table):
    m = Migration(spark, f"{table.folder}/pointer", table.folder, f"{table.folder}/epoch2")
    for _ in range(3):
        m.step()
    table.append(spark.createDataFrame([(0, "k1", "delete", None)], "pos int, key string, op string, value string"), 3)
    with pytest.raises(MigrationError):
        m.step()


def test_scopes_of_too_many_prefixes(spark):
    pages = spark.createDataFrame([(1, "a", "b")], "page long, lower string, upper string")
    many = spark.range(cdc.MOST_PREFIXES + 1).selectExpr("string(id) AS lower", "string(id + 1) AS upper")
    with pytest.raises(ValueError):
        cdc.evict_out_of_scope(pages, many, spark.createDataFrame([], "page long"))


def test_begin_looks_at_what_is_in_flight_first(spark):
    deliveries = spark.createDataFrame([("a", 2, "a2", "s"), ("a", 3, "a3", "s"), ("b", 1, "b1", "s"), ("c", 1, "c1", "s"), ("c", 2, "c2", "s"), ("d", 1, "d1", "other")], "key string, sequence long, event_id string, schema string")
    cursors = spark.createDataFrame([("a", 1), ("c", 0)], "key string, acked long")
    pending = spark.createDataFrame([("a", "a2", 5), ("b", "b1", 99)], "key string, event_id string, retry_at long")
    done = spark.createDataFrame([("a", "a2")], "key string, event_id string")
    dead = spark.createDataFrame([], done.schema)
    ask = lambda budget: {(r.key, r.sequence): r.outcome for r in events.begin(deliveries, cursors, pending, done, dead, 0, ["s"], budget, 10).collect()}
    want = {("a", 2): "Ready", ("a", 3): "Blocked", ("b", 1): "RetryNotDue", ("c", 1): "Ready", ("c", 2): "SequenceGap", ("d", 1): "DeadLettered:Poison"}
    assert ask(3) == want
    assert ask(2) == want | {("c", 1): "TooSlow", ("d", 1): "TooSlow"}


def test_enforcement_waits_or_refuses_stale_facts(spark):
    requests = spark.createDataFrame([(1, "t", "i", "x"), (2, "t", "i", "x"), (3, "t", "i", "y"), (4, "u", "j", "x"), (5, "t", "j", "x"), (6, "t", "k", "x")], "request int, token string, idempotency_key string, body string")
    row = "struct<n:long>"
    mutations = spark.createDataFrame([(1, 0, "a", 0, 0, (1,), (1,)), (5, 0, "a", 0, None, (1,), (1,)), (6, 0, "b", 0, 3, (1,), (9,))], f"request int, pos int, key string, shard int, base int, before {row}, after {row}")
    sessions = spark.createDataFrame([("t", 9)], "token string, expires int")
    versions = spark.createDataFrame([("b", 3)], "key string, version int")
    tree = policy.Compare("lt", policy.Path("after", "n"), policy.Literal(5))

    def outcomes(lag, strict, digest="d"):
        state = spark.createDataFrame([(digest, "d", 2, 1, lag, 4)], "digest string, expected string, watermark int, previous int, lag int, bound int")
        return {r.request: r.outcome for r in write.enforce_requests(requests, mutations, sessions, versions, state, tree, 0, strict, 1).collect()}

    first = {2: "Replayed", 3: "Rejected:KeyReused", 4: "Rejected:Unauthenticated", 5: "Rejected:MissingBase"}
    assert outcomes(1, True) == first | {1: "Committed", 6: "Rejected:Policy"}
    assert outcomes(5, True) == first | {1: "Rejected:StaleFacts", 6: "Rejected:StaleFacts"}
    assert outcomes(5, False) == first | {1: "Queued", 6: "Queued"}
    assert outcomes(1, True, "e")[1] == "Rejected:ProjectionChecksum"
