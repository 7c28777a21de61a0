"""Every query against its SQL, and the driver's entry points."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from orderlake import catalog, catalog2, catalog3  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.12g}") if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, folder, duck, name):
    got = catalog.QUERIES[name](spark, folder)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


KEYED = ["kv_point_get", "kv_get_required", "kv_has", "kv_multi_get", "kv_range_next", "kv_range_prev", "kv_keys_only", "kv_prefix_page2", "kv_older_than", "delete_prefix_chunked", "lucene_page_after_cursor"]


@pytest.mark.parametrize("name", KEYED)
def test_key_bounds_reach_the_scan(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    pushed = [x.split("PushedFilters: [", 1)[1].split("]")[0] for x in plan.split("\n") if "PushedFilters" in x]
    assert pushed and all("Than" in p or "EqualTo" in p or "In(o_orderkey" in p for p in pushed)


@pytest.mark.parametrize(
    "lower,upper,want",
    [
        (None, None, (None, None)),
        ("orders/" + "7".zfill(20), "orders/" + "9".zfill(20), (7, 9)),
        ("a", "z", (None, None)),
        ("z", None, (10**18, None)),
        (None, "a", (None, -1)),
        ("orders/", "orders/", (0, 10**20 - 1)),
        ("orders/0000000000000000001x", "orders/0000000000000000001x", (10, 19)),
    ],
)
def test_number_bounds(lower, upper, want):
    from orderlake.sources import tables

    assert tables.number_bounds("orders/", lower, upper) == want
