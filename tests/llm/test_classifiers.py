"""Language, quality and toxicity: held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderlake.llm import langid, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "the and of", "en", "s", 1), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "123 --- 456", "en", "s", 0), (10**9 + 3, "word " * 40000, "en", "s", 0), (10**9 + 3, "word " * 40000, "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return d.unionByName(spark.createDataFrame(ODD, SCHEMA)).withColumn("score", F.lit(7)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language(docs):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 10**9]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 10**9}
    assert odd[10**9].lang_pred == odd[10**9 + 1].lang_pred == odd[10**9 + 2].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_ignores_the_label_of_a_prediction(spark, docs):
    own = docs.where("doc_id < 300")
    got = {r.doc_id: r.lang_pred for r in langid.identify(own).collect()}
    blind = own.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(blind).collect()} == got


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "some text", None, "s", 1)], SCHEMA)
    assert langid.identify(frame).first().lang_pred == "und"
    assert langid.keep_known(frame).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.identify(none).count() == quality.quality(none, lab).count() == toxicity.toxicity(none, lab).count() == 0
    one = toxicity.toxicity(frame, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).first()
    assert 0 <= one.score <= 1


def test_backoff_shortens():
    counts = (["^t", "th", "he", "t", "h", "x"], np.array([[9.0, 1.0]] * 3 + [[5.0, 5.0], [5.0, 5.0], [0.0, 9.0]]))
    model = langid.LanguageModel(["a", "b"], np.array([1.0, 1.0]), (["known"], np.array([[0.0, 9.0]])), counts, np.array([9.0, 9.0]), np.full((3, 2), 100.0), 2)
    longer, shorter, nothing = model.fallback([b"the", b"xq", b"qqq"])
    assert longer[0] > longer[1] and shorter[1] > shorter[0] and not nothing.any()
    top, _ = model.predict(pa.array(["known", "the"]))
    assert [model.langs[k] for k in top] == ["b", "a"]


def scored(frame, labels, name):
    y = {r.doc_id: r[name] for r in labels.collect()}
    got = frame.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    return [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y], got


def test_quality(docs, labels):
    held, got = scored(quality.quality(docs, labels), labels, "quality")
    assert len(got) == docs.count()
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.RandomState(0)
    x = rng.rand(400, len(quality.STATISTICS))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(int)
    rules = quality.fit(x, y, trees=8)
    margin = rules.margin(x)
    assert ((margin >= 0) == y).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], quality.STATISTICS)
    got = [r[0] for r in frame.select(rules.column()).collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["AB cd cd!", "", None, "a"])).T))
    assert s["n_words"].tolist() == [3, 0, 0, 1]
    assert s["upper_words"][0] == pytest.approx(1 / 3)
    assert s["distinct_words"].tolist() == pytest.approx([1, 0, 0, 1])
    assert s["n_bytes"].tolist() == [9, 0, 0, 1]
    assert all(np.isfinite(v).all() for v in s.values())


def test_toxicity(docs, labels):
    held, got = scored(toxicity.toxicity(docs, labels), labels, "toxic")
    assert len(got) == docs.count()
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    toxic = [p for p, y in held if y]
    assert 2 * sum(toxic) > len(toxic)
    bad = toxicity.keep_clean(docs, labels)
    assert bad.columns == docs.columns and 0.7 * docs.count() < bad.count() < docs.count()


def test_pairs_beyond_single_terms():
    """An insult or a group alone is harmless; both together are not."""
    rng = random.Random(2)
    texts, y = [], []
    for i in range(1600):
        a, b = i % 2 == 0, i % 4 < 2
        words = [f"w{rng.randrange(50)}" for _ in range(8)] + ["insultword"] * a + ["groupword"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(a and b))
    doc, bucket = toxicity.terms(pa.array(texts))
    model = toxicity.fit(doc, bucket, np.array(y))
    assert ((model.score(pa.array(texts)) >= 0.5) == y).mean() > 0.99
    one = model.score(pa.array(["insultword w1 w2", "groupword w1 w2", "insultword w1 groupword"]))
    assert one[0] < 0.5 and one[1] < 0.5 and one[2] >= 0.5


def test_machine_is_the_formula():
    rng = np.random.RandomState(1)
    m = toxicity.Machine(np.arange(5), 0.3, rng.randn(5), rng.randn(5, 3))
    got = m.margin(np.array([0, 0, 0, 1]), np.array([0, 2, 4, 1]), 3)
    pair = sum(m.factor[a] @ m.factor[b] for a, b in ((0, 2), (0, 4), (2, 4)))
    assert got == pytest.approx([0.3 + m.weight[[0, 2, 4]].sum() + pair, 0.3 + m.weight[1], 0.3])
    assert math.isclose(m.score(pa.array([None]))[0], 1 / (1 + math.exp(-0.3)))


def test_a_rejected_text_takes_no_other_of_its_id(docs, labels):
    texts = {r.doc_id: r.text for r in docs.collect()}
    flag = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    known = {r.doc_id for r in langid.keep_known(docs).collect()}
    clean = next(texts[i] for i in sorted(known - {None}) if not flag[i])
    toxic = next(texts[i] for i in sorted(set(flag) - {None}) if flag[i])
    rows = [(i, x, "en", "s", 1, 7) for i in (None, -7) for x in (clean, toxic, "12 - 34")]
    more = docs.unionByName(docs.sparkSession.createDataFrame(rows, docs.schema))
    mine = lambda f: {(r.doc_id, r.text) for r in f.where("doc_id is null or doc_id = -7").collect()}
    assert {(None, clean), (-7, clean)} <= mine(langid.keep_known(more)) <= mine(more) - {(None, "12 - 34"), (-7, "12 - 34")}
    assert {(None, clean), (-7, clean)} <= mine(toxicity.keep_clean(more, labels)) <= mine(more) - {(None, toxic), (-7, toxic)}


def test_language_tables_have_few_files(spark, folder, monkeypatch):
    files = {}
    plain = langid.durable

    def seen(df, name):
        out = plain(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(langid, "durable", seen)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(map(tuple, langid.identify(docs).collect()), key=repr)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, langid.identify(docs).collect()), key=repr)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == want and set(files) == {"langid-words", "langid-grams"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism
