"""A replayed stream gives the batch result."""

from __future__ import annotations

import random

import pytest

from orderlake.operators import cdc, cost
from orderlake.streaming import feeds


def split(frame, folder, column, parts=3):
    """Files in order of ``column``."""
    data = frame.orderBy(column).collect()
    for i in range(parts):
        own = data[i * len(data) // parts : (i + 1) * len(data) // parts]
        frame.sparkSession.createDataFrame(own, frame.schema).coalesce(1).write.mode("append").parquet(str(folder))


def drain(stream, name, folder, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


def test_ordered_application(spark, tmp_path):
    random.seed(4)
    data, pos = [], 0
    for s in range(4):
        for seq in [0, 1, 1, 2, 3, 0, 4, 6, 5, 7] if s % 2 else range(8):
            data.append((s, pos := pos + 1, seq))
    frame = spark.createDataFrame(data, "stream long, pos long, seq long")
    split(frame, tmp_path / "in", "pos")
    got = drain(feeds.apply_ordered(feeds.read_feed(spark, str(tmp_path / "in"), frame.schema, 10)), "applied", tmp_path / "c")
    assert got == sorted(map(tuple, cdc.sequence_report(frame).collect()))


def test_token_bucket(spark, tmp_path):
    frame = spark.createDataFrame([(i % 3, i, i * 250, 1 + i % 4) for i in range(60)], "key long, id long, at long, cost long")
    split(frame, tmp_path / "in", "at", 1)
    got = drain(feeds.token_buckets(feeds.read_feed(spark, str(tmp_path / "in"), frame.schema, 10), 5, 3), "bucket", tmp_path / "c")
    assert got == sorted(map(tuple, cost.token_buckets(frame, 5, 3).collect()))


def test_dedupe_and_scope(spark, tmp_path):
    frame = spark.createDataFrame([(f"a/{i % 5}", i % 7) for i in range(30)] + [("b/1", 99)], "key string, event_id long")
    split(frame, tmp_path / "in", "event_id")
    got = drain(feeds.dedupe(feeds.watch(feeds.read_feed(spark, str(tmp_path / "in"), frame.schema), "a/")), "once", tmp_path / "c")
    assert sorted(x[1] for x in got) == list(range(7))


def test_replica(spark, tmp_path):
    frame = spark.createDataFrame([(0, f"k{i % 4}", i, f"v{i}" if i % 5 else None) for i in range(20)], "shard int, key string, key_version long, value string")
    split(frame, tmp_path / "in", "key_version")
    replica = feeds.Replica(spark, str(tmp_path / "out"))
    q = feeds.read_feed(spark, str(tmp_path / "in"), frame.schema).writeStream.foreachBatch(replica.apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sorted(map(tuple, cdc.ingest(frame).collect()), key=repr)
    assert sorted(map(tuple, replica.read().collect()), key=repr) == want
    replica.apply(frame.limit(1), 0)  # a repeated trigger
    assert sorted(map(tuple, replica.read().collect()), key=repr) == want


@pytest.mark.parametrize("exact", ["a/1", "zzz"])
def test_watch_one_key(spark, exact):
    frame = spark.createDataFrame([("a/1", 1), ("a/2", 2)], "key string, event_id long")
    assert feeds.watch(frame, exact=exact).count() == (exact == "a/1")


def test_effect_consumer(spark, tmp_path):
    from orderlake.streaming.consumer import Retry, consume, settle

    def handler(key, sequence, attempt):
        kind = (key * 7 + sequence) % 5
        return "success" if kind < 2 or (kind == 2 and attempt == 3) else "permanent" if kind == 3 else "panic" if kind == 4 and key % 2 else "retryable"

    data = [(k, s, s * 1000) for k in range(3) for s in (1, 2, 2, 3, 5, 4)]
    frame = spark.createDataFrame(data, "key long, sequence long, at long")
    (tmp_path / "in").mkdir()
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drain(consume(feeds.read_feed(spark, str(tmp_path / "in"), frame.schema), handler, Retry(max_attempts=4)), "effects", tmp_path / "c")
    want = []
    for k in range(3):
        for s in (1, 2, 3, 4, 5):
            want.append((k, s, *settle(handler, Retry(max_attempts=4), k, s, s * 1000)))
        want.append((k, 2, "Duplicate", 0, 2000))
    assert got == sorted(want)
    assert {r for _, _, r, _, _ in got} >= {"Acked", "Duplicate", "DeadLettered:PermanentFailure", "DeadLettered:RetryBudgetExhausted"}
    assert settle(lambda *_: "retryable", Retry(deadline=250), 0, 1, 0) == ("DeadLettered:RetryTimeExhausted", 2, 250)
