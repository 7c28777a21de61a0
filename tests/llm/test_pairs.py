"""Near duplicates, decontamination and mixing against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from orderlake.llm import common, decontaminate, jaccard, mixing
from orderlake.llm.components import connected
from orderlake.llm.textcode import shingle_hashes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    h, first = shingle_hashes(words_of(pa.array([text])))
    return set(h.tolist())


def corpus(seed=1, groups=12, size=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((n, " ".join(text), "en", "s", 1))
            n += 1
    return out


def brute(rows, t=0.8):
    """doc_id to (class, links)."""
    sets = [(i, shingle_set(x or "")) for i, x, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = {i: 0 for i, _ in sets}
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= t * len(x | y):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (find(i), links[i]) for i, _ in sets}


def test_bands():
    bands, rows = jaccard.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


@pytest.mark.parametrize("block", [1024, 3])
def test_classes_and_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = corpus() + [(1000 + i, "same text of the copies, all of it here", "en", "s", 1) for i in range(15)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "one two", "en", "s", 0), (2003, "ONE, two!", "en", "s", 0), (2004, "!!!", "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "rep")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(frame).collect()}
    want = brute(rows)
    # the stated recall is 0.999 for a pair at the threshold; these hashes find all pairs here
    assert got == want


def test_one_of_each(spark):
    rows = corpus(2)
    rows += [(5000, "a b c d e f g", "en", "s", 1), (5000, "a b c d e f g", "en", "s", 1), (5001, "a b c d e f g", "en", "s", 1), (5002, "", "en", "s", 1), (5002, "", "en", "s", 1), (None, None, "en", "s", 1)]
    kept = sorted((r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = sorted([i for i, (c, _) in brute([r for r in rows if r[0] is not None and r[0] < 5000]).items() if i == c] + [5000, 5002, 5002, None], key=str)
    assert kept == want


def test_many_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    rows = corpus(3, 6, 5)
    kept = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in brute(rows).items() if i == c)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_classes(none).count() == 0
    assert jaccard.keep_one(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(none, items).count() == 0
    assert mixing.mix(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b:
                m = min(root[a], root[b])
                if root[a] != m or root[b] != m:
                    root[a] = root[b] = m
                    changed = True
    assert got == root


def test_containment(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(30)] + [(30, None), (31, ""), (32, "dup item of six words here"), (33, "dup item of six words here")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        _, item = rng.choice(items)
        own = (item or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            if own:
                own[rng.randrange(len(own))] = "changed"
        at = rng.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + [w.upper() + "," for w in own] + text[at:]), "en", "s", 1))
    docs += [(90, None, None, None, None), (91, items[3][1], "en", "s", 1), (91, items[3][1], "en", "s", 1), (None, items[4][1], "en", "s", 1)]
    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = [x for x in __import__("re").split(r"[\W_]+", (t or "").lower()) if x]
        return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    want = set()
    for i, t, *_ in docs:
        for k, x in items:
            g = grams(x)
            if g and len(g & grams(t)) >= 0.8 * len(g):
                want.add((i, k, len(g), len(g & grams(t))))
    take = lambda f: {(r.doc_id, r.item_id, r.item_shingles, r.found) for r in f.collect()}
    found = decontaminate.contained(frame, bench)
    assert take(found) == want and found.count() == len(want)
    monkeypatch.setattr(decontaminate, "BROADCAST_POSTINGS", 0)
    assert take(decontaminate.contained(frame, bench)) == want
    clean = [r.doc_id for r in decontaminate.clean(frame, bench).collect()]
    assert sorted(clean, key=str) == sorted((i for i, *_ in docs if i not in {w[0] for w in want}), key=str)


def plan(sizes, most=3.0):
    """Weights 1, 2, 3 over sources by name, null last, capped step by step."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, left * w[s] / sum(w[x] for x in free) if free else 0.0) for s in names}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(9)
    docs = [(i, "x " * rng.choice([0, 1, 5, 40, 300]), "en", rng.choice(["a", "b", "b", "b", "c", "dd", None]), 1) for i in range(400)]
    docs += [(500, None, "en", "a", 1), (501, "one", "en", "tiny", 1), (502, "", "en", "zero", 1), (7, "again and again", "en", "a", 1), (7, "again and again", "en", "a", 1), (None, "no id", "en", "b", 1)]
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("n_chars", "size")
    got = mixing.mix(frame).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame.repartition(3)).collect()))
    assert len(got) == len(docs)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = plan(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) < 1.0001 for s in sizes)
    assert sum(r.words for r in mixing.mixture(frame).collect()) == sum(taken.values())
