"""The classifiers' queries against plain forms of their models, row by row over whole small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orderlake.llm import quality, registry, toxicity


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def labels(spark, folder, name):
    rows = spark.read.parquet(f"{folder}/labels.parquet").where(f"{name} is not null").collect()
    votes = defaultdict(list)
    for r in rows:
        votes[r.doc_id].append(r[name])
    return {i: int(2 * sum(v) >= len(v)) for i, v in votes.items()}


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


class PlainLanguages:
    """Word counts and n-gram counts in dictionaries; a word votes by them one at a time."""

    def __init__(self, rows, longest=5):
        self.longest, self.word, self.gram = longest, defaultdict(Counter), defaultdict(Counter)
        self.words, self.grams = Counter(), defaultdict(Counter)
        for lang, text in rows:
            for w in words(text):
                self.word[w][lang] += 1
                self.words[lang] += 1
                for g in self.pieces(w):
                    self.gram[g][lang] += 1
                    self.grams[len(g)][lang] += 1
        self.langs = sorted(self.words)

    def pieces(self, w):
        w = f"^{w}$"
        return [w[i : i + k] for k in range(1, self.longest + 1) for i in range(len(w) - k + 1)]

    def shares(self, counts, totals):
        p = [(counts[x] + 0.5) / (totals.get(x, 1) + 500) for x in self.langs]
        return np.log(np.array(p) / sum(p))

    def vote(self, w):
        if w in self.word:
            return self.shares(self.word[w], self.words)
        for k in range(self.longest, 0, -1):
            known = [g for g in self.pieces(w) if len(g) == k and g in self.gram]
            if known:
                return sum(self.shares(self.gram[g], self.grams[k]) for g in known) / len(known) * 0.6 ** (1 + self.longest - k)
        return np.zeros(len(self.langs))

    def predict(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        sums = sum((self.vote(w) for w in words(text)), np.zeros(len(self.langs)))
        p = np.exp(sums - sums.max())
        return self.langs[int(sums.argmax())], float(p.max() / p.sum())


def test_language_is_the_plain_model(spark, folder, texts):
    plain = PlainLanguages([(r.lang, r.text) for i, r in texts.items() if r.lang is not None and fold(i, 4) != 2])
    got = {r.doc_id: r for r in registry.QUERIES["op5_language_id"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i, r in texts.items():
        lang, score = plain.predict(r.text)
        assert (got[i].held_out, got[i].lang_pred) == (fold(i, 4) == 2, lang)
        assert got[i].score == pytest.approx(score, abs=1e-4)


def plain_statistics(text):
    """The statistics of one text, one loop each."""
    data = (text or "").encode()
    tokens = [t for t in re.split(rb"[\x20\x09-\x0d]+", data) if t]
    one, n = max(len(data), 1), max(len(tokens), 1)
    share = {name: sum(bool(member[b]) for b in data) / one for name, member in quality._CLASSES.items()}
    mean = sum(map(len, tokens)) / n
    spread = math.sqrt(max(sum(len(t) ** 2 for t in tokens) / n - mean**2, 0))

    def distinct(k):
        runs = [tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]
        return len(set(runs)) / len(runs) if runs else 1.0

    capitals = [sum(65 <= b <= 90 for b in t) for t in tokens]
    return [
        len(data),
        len(tokens),
        *share.values(),
        mean,
        spread,
        max(map(len, tokens), default=0),
        len(set(tokens)) / n,
        sum(a == b for a, b in zip(tokens, tokens[1:])) / n,
        max(Counter(tokens).values(), default=0) / n,
        distinct(2),
        distinct(4),
        sum(c >= 2 and 2 * c >= len(t) for c, t in zip(capitals, tokens)) / n,
        share["line"] * one / n,
    ]


def test_quality_is_the_plain_rules(spark, folder, texts):
    y = labels(spark, folder, "quality")
    x = {i: plain_statistics(r.text) for i, r in texts.items()}
    learnt = sorted(i for i in y if i in texts and fold(i, 3) != 1)
    rules = quality.fit(np.array([x[i] for i in learnt], float), np.array([y[i] for i in learnt]))
    got = {r.doc_id: r for r in registry.QUERIES["op9_quality_classifier"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i in texts:
        margin = rules.bias + sum(w for rule, w in zip(rules.rules, rules.weight) if all((x[i][k] > at) == above for k, at, above in rule))
        assert got[i].held_out == (fold(i, 3) == 1)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_toxicity_is_the_plain_machine(spark, folder, texts):
    y = labels(spark, folder, "toxic")
    learnt = sorted(i for i in y if i in texts and fold(i, 5) != 0)
    doc, bucket = toxicity.terms(pa.array([texts[i].text for i in learnt], pa.string()))
    machine = toxicity.fit(doc, bucket, np.array([y[i] for i in learnt]))
    place = {int(k): n for n, k in enumerate(machine.keys)}
    got = {r.doc_id: r for r in registry.QUERIES["op10_toxicity"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i, r in texts.items():
        found = toxicity.terms(pa.array([r.text], pa.string()))[1].tolist()
        plain = {w[:k] if k else w for w in (w.encode() for w in words(r.text)) for k in (0, 4, 5) if not k or len(w) > k}
        assert len(found) <= 3 * len({w.encode() for w in words(r.text)}) and len(found) >= 0.99 * len(plain)
        own = [place[b] for b in found if b in place]
        z = machine.bias + sum(machine.weight[a] for a in own) + sum(float(machine.factor[a] @ machine.factor[b]) for n, a in enumerate(own) for b in own[:n])
        assert got[i].held_out == (fold(i, 5) == 0)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)
