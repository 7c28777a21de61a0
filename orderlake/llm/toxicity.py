"""Toxicity: a factorization machine over hashed terms.

Terms are words and their first four and five bytes, hashed into ``buckets``;
a document has each term once. The machine adds to the linear weights an inner
product for every pair of terms present, so an insult with a group mention can
weigh more than both alone. It is fitted, by one task, on a bounded sample of
labelled rows (``max_train``) over every term that tells the labels apart, alone
or beside another such term; the driver gets the weights only.

Null and empty texts have no terms and get the score of the bias alone; very long
texts are scored whole. Repeated rows and null ids are scored each; a text of one
id is learnt once. An id labelled both ways has the more frequent label, 1 in a
tie, and a null label is none. Without both labels every score is the share of
label 1 (0.001 without any). An empty table gives an empty result, and columns
other than doc_id, text and the label are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, durable, fold, slices, spread, text_tag, without
from .textcode import mix64, words_of

BUCKETS, RANK = 1 << 20, 4


def terms(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, distinct and sorted."""
    tokens = words_of(column)
    size = tokens.ends - tokens.starts
    found = []
    for salt, most in ((1, 0), (2, 4), (3, 5)):
        own = np.flatnonzero(size > most) if most else slice(None)
        cut = tokens._replace(starts=tokens.starts[own], ends=tokens.ends[own] if not most else tokens.starts[own] + most)
        with np.errstate(over="ignore"):
            bucket = mix64(cut.hashes() + np.uint64(salt)) % np.uint64(buckets)
        found.append(tokens.doc[own].astype(np.int64) * buckets + bucket.astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs // buckets, pairs % buckets


@dataclass
class Machine:
    """Sorted buckets with their weights and factors."""

    keys: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """doc ascending; term: row numbers of ``weight``."""
        out = np.full(n, self.bias)
        out += np.bincount(doc, self.weight[term], n)
        for v in self.factor.T:
            out += 0.5 * (np.bincount(doc, v[term], n) ** 2 - np.bincount(doc, v[term] ** 2, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        doc, bucket = terms(column)
        place = np.minimum(np.searchsorted(self.keys, bucket), max(len(self.keys) - 1, 0))
        ok = self.keys[place] == bucket if len(self.keys) else np.zeros(len(bucket), bool)
        return 1 / (1 + np.exp(-np.clip(self.margin(doc[ok], place[ok], len(column)), -30, 30)))


def telling(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, evidence: float, buckets: int) -> np.ndarray:
    """Buckets of at least three documents whose two by two table with the label has a chi-square above ``evidence``."""
    n, y = len(label), float(label.sum())
    # counts by bucket: no sort of all terms, which are many
    df = np.bincount(bucket, minlength=buckets)
    hits = np.bincount(bucket[label[doc] == 1], minlength=buckets)
    some = np.flatnonzero(df >= 3)
    a, b = hits[some].astype(float), (df - hits)[some].astype(float)
    c, d = y - a, (n - y) - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)
    return some[chi > evidence]


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, evidence: float = 15.0, rank: int = RANK, epochs: int = 80, rate: float = 0.05, decay: float = 2e-3, seed: int = 3, buckets: int = BUCKETS) -> Machine:
    """Over all terms that tell the labels apart, in all documents or in those that hold such a term.

    The second look, which asks for twice the evidence as it is one among many, takes
    in terms that matter only beside another one.
    """
    n, y = len(label), label.astype(float)
    share = min(max(y.mean() if n else 0.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if not n or len(set(label.tolist())) < 2:
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    best = telling(doc, bucket, label, evidence, buckets)
    mark = np.zeros(buckets, bool)
    mark[best] = True
    beside = np.bincount(doc, mark[bucket], n) > 0
    own = beside[doc]
    best = np.union1d(best, telling((np.cumsum(beside) - 1)[doc[own]], bucket[own], label[beside], 2 * evidence, buckets))
    if not len(best):
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    where = np.full(buckets, -1, np.int32)
    where[best] = np.arange(len(best))
    term = where[bucket]
    ok = term >= 0
    doc, term = doc[ok], term[ok]
    rng = np.random.RandomState(seed)
    params = [np.zeros(len(best)), rng.normal(0, 0.02, (len(best), rank)), np.array([bias])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    at = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 1024)):
            size = at[batch + 1] - at[batch]
            index = np.repeat(at[batch] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row, t = np.repeat(np.arange(len(batch)), size), term[index]
            w, v, b0 = params
            sums = np.stack([np.bincount(row, v[t, k], len(batch)) for k in range(rank)], 1)
            squares = np.bincount(row, (v[t] ** 2).sum(1), len(batch))
            z = b0[0] + np.bincount(row, w[t], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            gw = np.bincount(t, g[row], len(w)) + decay / len(w) ** 0.5 * w
            gv = np.stack([np.bincount(t, g[row] * (sums[row, k] - v[t, k]), len(w)) for k in range(rank)], 1) + decay * v
            step += 1
            for p, q, m, s in zip(params, (gw, gv, np.array([g.sum()])), first, second):
                m += 0.1 * (q - m)
                s += 0.001 * (q * q - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(best, float(params[2][0]), params[0], params[1])


def labelled(docs: DataFrame, labels: DataFrame, name: str, learn: F.Column, bound: int) -> DataFrame:
    """id, tag, text, y of about ``bound`` labelled rows whose label satisfies ``learn``.

    An id labelled both ways gets the more frequent label, 1 in a tie. Labels
    are sampled first: the bound keeps them small enough to broadcast, so only
    texts that they pick are shuffled. Each text of an id counts once, and an id
    of many texts is sampled too, so the bound holds for rows.
    """
    y = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy(F.col("doc_id").alias("label_id")).agg((F.avg(name) >= 0.5).cast("int").alias("y"))
    sample = bounded_sample(y, bound, "label_id")
    texts = docs.select(F.col("doc_id").alias("id"), text_tag().alias("tag"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("id", "tag", "text", "y").dropDuplicates(["id", "tag"])
    return bounded_sample(durable(rows, "labelled"), bound, "id", "tag")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            doc, bucket = terms(part.column(2))
            at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["id", "tag", "y", "terms"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, bucket, y = [], [], []
    for batch in batches:
        size.append(batch.column(1).value_lengths().to_numpy())
        bucket.append(batch.column(1).flatten().to_numpy())
        y.append(batch.column(0).to_numpy())
    if size:
        size, bucket, y = np.concatenate(size), np.concatenate(bucket), np.concatenate(y)
        model = fit(np.repeat(np.arange(len(size), dtype=np.int32), size), bucket, y)
        parts = [model.keys.astype(np.int64), np.float64([model.bias]), model.weight, model.factor]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["keys", "bias", "weight", "factor"])


def train(rows: DataFrame) -> Machine:
    """One task fits the bounded sample, in order of id and text."""
    kind = rows.schema["id"].dataType.simpleString()
    got = spread(rows).mapInArrow(_terms_of, f"id {kind}, tag long, y int, terms array<int>").repartition(1).sortWithinPartitions("id", "tag").select("y", "terms")
    got = got.mapInArrow(_fit, "keys binary, bias binary, weight binary, factor binary").first()
    if got is None:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, int))
    weight = np.frombuffer(got["weight"], np.float64)
    return Machine(np.frombuffer(got["keys"], np.int64), float(np.frombuffer(got["bias"], np.float64)[0]), weight, np.frombuffer(got["factor"], np.float64).reshape(len(weight), RANK))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, max_train: int = 12_000, tagged: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and if ``tagged`` its text tag; learns labels of rows whose fold is not ``held``."""
    out = fold("doc_id", parts) == held
    more = ["tag"] if tagged else []
    sample = labelled(docs, labels, "toxic", ~out, max_train)
    spread_model = docs.sparkSession.sparkContext.broadcast(train(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = spread_model.value.score(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *part.columns[3:]], ["doc_id", "held_out", "score", "predicted", *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text"), *(text_tag().alias(c) for c in more))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int" + ", tag long" * tagged)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are not predicted toxic."""
    return without(docs, toxicity(docs, labels, tagged=True).where("predicted = 1"))
