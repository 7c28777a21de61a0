"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text become columns. Small gradient-boosted trees are
grown on a bounded sample of labelled rows (``max_train``); each path from a
root to a node is a conjunctive rule. A lasso logistic fit keeps few rules, and
those are compiled into one Spark column expression over the statistics.
Null and empty texts have zero statistics and are scored like any text; very
long texts are scored whole. Repeated rows and null ids are scored each; a text
of one id is learnt once. An id labelled both ways has the more frequent label,
1 in a tie, and a null label is none. Without both labels the score is the share
of label 1. An empty table gives an empty result, and columns other than doc_id,
text and the label are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, spread
from .textcode import buffer_of, tokenize, TOKEN_BYTES
from .toxicity import labelled

_CHAR = np.arange(256)
_CLASSES = {
    "upper": (_CHAR >= 65) & (_CHAR <= 90),
    "lower": (_CHAR >= 97) & (_CHAR <= 122),
    "digit": (_CHAR >= 48) & (_CHAR <= 57),
    "stop": np.isin(_CHAR, [ord(c) for c in ".,"]),
    "shout": np.isin(_CHAR, [ord(c) for c in "!?"]),
    "symbol": np.isin(_CHAR, [ord(c) for c in "#$%&*+<=>@[]^_{|}~\\/"]),
    "pipe": _CHAR == ord("|"),
    "line": _CHAR == 10,
    "beyond": _CHAR >= 128,
}
STATISTICS = ["n_bytes", "n_words", *(f"{c}_share" for c in _CLASSES), "word_bytes", "word_spread", "longest_word", "distinct_words", "repeated_next", "top_word", "distinct_pairs", "distinct_fours", "upper_words", "lines_per_word"]


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by document, and the count of the most frequent one; values are told apart by 40 bits."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | value >> np.uint64(24))
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own = (key[cut] >> np.uint64(40)).astype(np.int64)
    times = np.diff(np.concatenate([cut, [len(key)]]))
    kinds = np.bincount(own, minlength=n)
    most = np.zeros(n)
    some = np.flatnonzero(kinds)
    most[some] = np.maximum.reduceat(times, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])))
    return kinds.astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """(documents, STATISTICS) of float64."""
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    tokens = tokenize(data, offsets, TOKEN_BYTES)
    size, count = np.diff(offsets).astype(float), np.diff(tokens.first).astype(float)
    one, words = np.maximum(size, 1), np.maximum(count, 1)
    out = [size, count]
    running = np.zeros(len(data) + 1, np.int64)
    share = {}
    for name, member in _CLASSES.items():
        np.cumsum(member[data], out=running[1:])
        share[name] = (running[offsets[1:]] - running[offsets[:-1]]) / one
        out.append(share[name])
        if name == "upper":
            capital = running[tokens.ends] - running[tokens.starts]
    width = (tokens.ends - tokens.starts).astype(float)
    mean = np.bincount(tokens.doc, width, n) / words
    spread = np.sqrt(np.maximum(np.bincount(tokens.doc, width**2, n) / words - mean**2, 0))
    longest = np.zeros(n)
    longest[count > 0] = np.maximum.reduceat(width, tokens.first[:-1][count > 0]) if len(width) else 0
    h = tokens.hashes()
    kinds, most = _distinct(tokens.doc, h, n)
    out += [mean, spread, longest, kinds / words]
    next_ = tokens.doc[1:] == tokens.doc[:-1]
    out.append(np.bincount(tokens.doc[1:][next_ & (h[1:] == h[:-1])], minlength=n) / words)
    out.append(most / words)
    with np.errstate(over="ignore"):
        for k in (2, 4):
            if len(h) >= k:
                code = h[k - 1 :].copy()
                for j in range(1, k):
                    code = code * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 - j : len(h) - j]
                own = tokens.doc[k - 1 :] == tokens.doc[: len(h) - k + 1]
                kinds, _ = _distinct(tokens.doc[k - 1 :][own], code[own], n)
            else:
                kinds = np.zeros(n)
            out.append(np.where(count >= k, kinds / np.maximum(count - k + 1, 1), 1.0))
    out.append(np.bincount(tokens.doc[(capital >= 2) & (capital * 2 >= width)], minlength=n) / words)
    out.append(share["line"] * one / words)
    return np.stack(out, 1)


#: A condition: statistic, threshold, whether values above it fit (else those up to it).
Condition = tuple[int, float, bool]


@dataclass
class Rules:
    bias: float
    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weight):
            out += w * fits(rule, x)
        return out

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weight):
            ok = F.lit(True)
            for k, at, above in rule:
                c = F.col(STATISTICS[k])
                ok = ok & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fits(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, at, above in rule:
        ok &= (x[:, k] > at) if above else (x[:, k] <= at)
    return ok


def _tree(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths of one tree on binned statistics, and its values by row."""
    paths, value = [], np.zeros(len(g))

    def grow(rows: np.ndarray, path: tuple[Condition, ...], level: int) -> None:
        if path:
            paths.append(path)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[rows] = -total_g / (total_h + 1.0)
        if level == depth or len(rows) < 2 * least:
            return
        best, base = None, total_g**2 / (total_h + 1.0)
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = bins[rows, k]
            n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
            left_g = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
            left_h = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
            gain = left_g**2 / (left_h + 1.0) + (total_g - left_g) ** 2 / (total_h - left_h + 1.0) - base
            gain[(n < least) | (len(rows) - n < least)] = 0
            j = int(gain.argmax())
            if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                best = (gain[j], k, j)
        if best:
            _, k, j = best
            below = bins[rows, k] <= j
            grow(rows[below], (*path, (k, float(cuts[k][j]), False)), level + 1)
            grow(rows[~below], (*path, (k, float(cuts[k][j]), True)), level + 1)

    grow(np.arange(len(g)), (), 0)
    return paths, value


def fit(x: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, lasso: float = 2e-4, steps: int = 600) -> Rules:
    y = label.astype(float)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if len(set(label.tolist())) < 2:
        return Rules(bias)
    cuts = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 129)))
        cuts.append((q[1:] + q[:-1]) / 2)
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    z, found = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, value = _tree(bins, cuts, p - y, p * (1 - p), depth, least)
        z += rate * value
        for path in paths:
            found.setdefault(tuple(sorted(path)), None)
    rules = list(found)
    r = np.stack([fits(rule, x) for rule in rules], 1).astype(np.float32)
    r, at = np.unique(r, axis=1, return_index=True)
    rules = [rules[i] for i in at]
    scale = np.maximum(r.std(0), 1e-3)
    m = r / scale
    # accelerated proximal gradient for logistic loss with an l1 penalty
    w, b, v, vb, t = np.zeros(m.shape[1]), bias, np.zeros(m.shape[1]), bias, 1.0
    q = np.ones(m.shape[1])
    for _ in range(20):
        q = m.T @ (m @ q)
        q /= np.linalg.norm(q)
    size = 4 * len(y) / (float(np.linalg.norm(m @ q) ** 2) + len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ v + vb, -30, 30)))
        e = (p - y) / len(y)
        new = v - size * (m.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - size * lasso, 0)
        new_b = vb - size * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(b), [rules[i] for i in keep], (w[keep] / scale[keep]).tolist())


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows``, which have a text, with that replaced by its statistics."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column(len(names)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x[:, k]) for k in range(x.shape[1]))], [*names, *STATISTICS])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "text").mapInArrow(run, kept + "".join(f", {s} double" for s in STATISTICS))


def train(rows: DataFrame) -> Rules:
    # some 200 bytes for each of the sample's rows
    got = with_statistics(spread(rows)).toArrow().sort_by([("id", "ascending"), ("tag", "ascending")])
    x = np.stack([got[s].to_numpy() for s in STATISTICS], 1)
    return fit(x, got["y"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, max_train: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns labels of rows whose fold is not ``held``."""
    out = fold("doc_id", parts) == held
    model = train(labelled(docs, labels, "quality", ~out, max_train))
    rows = with_statistics(spread(docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text"))))
    rows = rows.select("doc_id", "held_out", model.column().alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
