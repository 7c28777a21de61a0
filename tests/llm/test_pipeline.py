"""The pipeline and the registered queries."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlake.llm import decontaminate, jaccard, langid, mixing, registry, toxicity


def test_stages_follow_from_the_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    state, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, folder).cache()
        state[name] = (before, now)
    before, after = state["language_id"]
    assert ids(after) == ids(langid.identify(before).where("lang_pred <> 'und'"))
    before, after = state["toxicity"]
    assert ids(after) == ids(toxicity.toxicity(before, labels).where("predicted = 0"))
    before, after = state["near_duplicates"]
    classes = jaccard.jaccard_classes(before)
    assert ids(after) == {r.class_id for r in classes.collect()}
    before, after = state["decontamination"]
    assert ids(after) == ids(before) - ids(decontaminate.contained(before, bench))
    assert all(s[1].columns == docs.columns for n, s in state.items() if n != "mixing")
    before, after = state["mixing"]
    assert sorted((r.doc_id, r.taken) for r in after.collect()) == sorted((r.doc_id, r.taken) for r in mixing.mix(before).collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, after.collect()))


def test_odd_rows_pass_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "the of and to in is", "en", None, 1), (77777, None, None, None, None), (77778, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns[-1] == "extra", name
    assert docs.where("doc_id in (77777, 77778)").count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(registry.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    got = registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    clean = lambda v: float(f"{v:.12g}") if isinstance(v, float) and not math.isnan(v) else v
    order = [d[0] for d in want.description]
    table = sorted((tuple(clean(r[order.index(k)]) for k in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(clean(r[k]) for k in columns) for r in got.collect()), key=repr) == table


def test_registered():
    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted(f"op{k}" for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "mixing"]


def test_extra_columns_of_any_name_stay(spark, folder):
    names = ["l", "y", "d", "t", "h", "id", "row", "tag", "own_id", "own_tag", "gone_id", "gone_tag", "twice_id", "label_id", "bad_id", "__tag", "wanted_d", "score", "held_out", "key", "rep"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert all(r[c] == c for r in after.collect() for c in names), name
