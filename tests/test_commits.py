"""Commits, followers, mirrors, and the facade."""

from __future__ import annotations

import json

import pytest

from orderlake.engine import Engine
from orderlake.sources.commits import CommitError, CommitTable, Follower, Mirror, observed


def ops(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, key string, op string, value string")


def test_commits(spark, tmp_path):
    table = CommitTable(spark, f"file://{tmp_path}/t")
    assert table.read().count() == 0
    table.append(ops(spark, ("a", "set", "1"), ("b", "set", "1"), ("a", "set", "2")), 1)
    follower, mirror = Follower(table), Mirror(table, warm=True)
    table.append(ops(spark, ("b", "delete", None), ("z", "set", "9")), 5)
    with pytest.raises(CommitError):
        table.append(ops(spark, ("q", "set", "1")), 5)
    state = lambda f: {r.key: r.value for r in f.collect()}
    assert state(table.read()) == {"a": "2", "z": "9"}
    assert state(table.read(pin=1)) == state(follower.read()) == {"a": "2", "b": "1"}
    assert mirror.stale() and state(mirror.read()) == {"a": "2", "z": "9"} and not mirror.stale()
    assert follower.refresh() and not follower.refresh() and state(follower.read()) == {"a": "2", "z": "9"}
    assert state(table.read(lower="b", upper="y")) == {}
    assert [m["version"] for m in table.manifest()] == [1, 5]
    assert len(table.log(lower="x").inputFiles()) >= 1 and all("v0" in f for f in table.log(lower="x").inputFiles())
    table.compact()
    assert state(table.read()) == {"a": "2", "z": "9"} and len(table.manifest()) == 1
    table.append(ops(spark, ("a", "delete", None)), 6)
    assert state(table.read()) == {"z": "9"} and state(table.read(pin=5)) == {"a": "2", "z": "9"}


def test_observed(spark):
    rows, seen = observed(spark.createDataFrame([("k", "vv")], "key string, value string"), "reads")
    rows.collect()
    assert seen.get == {"rows": 1, "bytes": 3}


def test_facade(spark):
    rows = spark.createDataFrame([(f"d/{i}", json.dumps({"n": i})) for i in range(8)] + [("x", "not json")], "key string, value string")
    engine = Engine(rows)
    keys = lambda f: [r.key for r in f.collect()]
    assert keys(engine.gets(2, cursor=("d/3", None))) == ["d/3", "d/4"]
    assert keys(engine.gets(2, cursor=("d/3", None), query="n:[0 TO 100]")) == ["d/4", "d/5"]
    assert keys(engine.gets(None, "prev", ("d/3", "d/1"), "n:[0 TO 100]")) == ["d/2", "d/1"]
    assert keys(engine.gets(query="n:5")) == ["d/5"]
    assert engine.has("x") and not engine.has("y")
    assert engine.count_prefix("d/", 5) == 5
    assert keys(engine.scoped("d").gets(1)) == ["0"]
    assert keys(engine.prefix("d/", "d/5").items()) == ["d/6", "d/7"]
    assert engine.get("d/1").count() == 1 and engine.get_many(["x", "x"]).count() == 2


def test_a_commit_that_ends_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = CommitTable(spark, f"file://{tmp_path}/u")
    table.append(ops(spark, ("a", "set", "1")), 1)
    files = table._files

    def broken(path):
        if "_manifests/" in path:
            raise OSError("the writer dies before it publishes")
        return files(path)

    monkeypatch.setattr(table, "_files", broken)
    with pytest.raises(OSError):
        table.append(ops(spark, ("a", "set", "2")), 2)
    monkeypatch.undo()
    assert [m["version"] for m in table.manifest()] == [1]
    assert [r.value for r in table.read().collect()] == ["1"]
    table.append(ops(spark, ("a", "set", "2")), 2)
    assert table.version() == 2 and len(table._manifests()) == 2
