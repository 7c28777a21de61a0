"""LM scoring against a plain trie, SQL counts, and odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orderlake.llm import ppm


def plain_score(train, texts, order, least):
    """The automaton's definition, spelled out: contexts with enough symbols, method D, exclusion."""
    own = ppm.AdaptivePpm(order)
    for t in train:
        seq = ppm.symbols(pa.array([t]))[0].tolist()
        for at in range(len(seq)):
            own.learn(seq, at)
    own.trie = {c: n for c, n in own.trie.items() if not c or sum(n.values()) >= least}
    out = []
    for t in texts:
        seq = ppm.symbols(pa.array([t]))[0].tolist()
        out.append(sum(own.log10(seq, at) for at in range(len(seq))))
    return out


def levels_of(train, order, least):
    seq, first, _ = ppm.symbols(pa.array(train))
    keys, n = np.unique(ppm.grams(seq, first, order), return_counts=True)
    out = {}
    for k in range(order + 1):
        sub = keys & ((1 << (9 * (k + 1))) - 1)
        ok = (sub >> 9 >> (9 * (k - 1)) > 0) if k else np.ones(len(sub), bool)
        counts = Counter()
        for x, c in zip(sub[ok].tolist(), n[ok].tolist()):
            counts[x] += c
        total = Counter()
        for x, c in counts.items():
            total[x >> 9] += c
        rows = [(x >> 9, x & 511, c) for x, c in sorted(counts.items()) if k == 0 or total[x >> 9] >= least]
        out[k] = tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))
    return out


TRAIN = ["the cat sat on the mat", "the dog  sat", "a cat, a mat; THE end", "été à la plage", "the the the the"]


@pytest.mark.parametrize("order,least", [(0, 1), (2, 1), (3, 2), (5, 4)])
def test_automaton_is_the_trie(order, least):
    texts = ["the cat", "", "zzz unseen \x01 bytes", "The Mat\n\nsat on à", *TRAIN]
    model = ppm.build(order, levels_of(TRAIN, order, least))
    seq, first, _ = ppm.symbols(pa.array(texts))
    got = model.score(seq, first, stretch=7)
    assert got == pytest.approx(plain_score(TRAIN, texts, order, least), rel=1e-5)


def test_probabilities_sum_to_one():
    model = ppm.build(3, levels_of(TRAIN, 3, 2))
    seen = int((model.code[1:] < model.next.shape[1] - 1).sum()) if (model.code[1:] == model.next.shape[1] - 1).any() else 257
    share = np.ones(model.next.shape[1])
    share[-1] = max(1, 257 - seen)
    assert (10.0 ** model.logp.astype(float)) @ share == pytest.approx(np.ones(len(model.next)), rel=1e-3)


def test_no_training_text():
    model = ppm.build(3, {k: (np.zeros(0, np.int64),) * 3 for k in range(4)})
    seq, first, _ = ppm.symbols(pa.array(["ab", ""]))
    assert model.score(seq, first) == pytest.approx([-3 * math.log10(257), -math.log10(257)], rel=1e-5)


def test_against_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and", "en", "x", 1), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900002, "", "en", "s", 0), (900003, "the " * 30000, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumnRenamed("n_chars", "score")  # a clashing extra column
    got = ppm.lm_score(docs, order=3).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: [w for w in bytes(t, "utf-8").lower().split() if w]
    seen = Counter()
    for i, t in texts:
        if not held(i):
            seen.update([*split(t), b"\0end"])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in texts:
        words = [*split(t), b"\0end"]
        want.append((str(i), held(i), len(words), sum(seen[w] > 0 for w in words), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words), 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_rare_words_are_joined(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(50)
    whole = sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in ppm.lm_score(docs, order=2).collect())
    monkeypatch.setattr(ppm, "HEAVY", 50)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in ppm.lm_score(docs, order=2).collect()) == whole


@pytest.mark.parametrize("order,most,chunk", [(3, 40, 1 << 21), (5, 40, 1), (5, 400, 5000)])
def test_rare_contexts_are_joined(spark, folder, order, most, chunk):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(12)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "zzz unseen \x01 bytes"), (-1, None), (-2, "q")], "doc_id long, text string"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    # every context of the training texts counts, however few of them are sent
    want = sorted(zip([i for i, _ in texts], plain_score(train, [t for _, t in texts], order, 1)))
    got = sorted((r.doc_id, r.score) for r in ppm.lm_score(docs, order=order, max_contexts=most, chunk=chunk).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-5)


def test_empty_table_and_adaptive(spark):
    schema = "doc_id long, text string"
    assert ppm.lm_score(spark.createDataFrame([], schema)).count() == 0
    got = {r.doc_id: r.score for r in ppm.adaptive_score(spark.createDataFrame([(1, "ab" * 40), (2, "ab"), (3, None)], schema), 3).collect()}
    assert got[3] == pytest.approx(-math.log10(257))
    assert got[1] / 81 > got[2] / 3  # a repeating text costs less by symbol


def test_tables_are_built_with_little_beside_them():
    import tracemalloc

    rng = np.random.RandomState(3)
    seq = rng.randint(1, 60, 100_000)
    grams, n = np.unique(ppm.grams(seq, np.array([0, len(seq)]), 4), return_counts=True)
    levels = {}
    for k in range(5):
        own = ppm.level(grams, n, k, None)
        levels[k] = own.pairs >> ppm.BITS, (own.pairs & ppm._mask(1)).astype(np.int16), own.n.astype(np.float32)
    tracemalloc.start()
    model = ppm.build(4, levels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.depth) > 50_000 and peak < 2.5 * (model.next.nbytes + model.logp.nbytes)


def test_distinct_places():
    for keys in (np.zeros(0, np.int64), np.array([7, -1, 7, 2**62, -1, 0])):
        asked, at = ppm.distinct_places(keys)
        assert asked.tolist() == sorted(set(keys.tolist())) and asked[at].tolist() == keys.tolist()
