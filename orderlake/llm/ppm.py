"""LM scoring: prediction by partial matching over bytes.

A byte-context trie of order ``order`` is counted over all training texts with
one distributed aggregation; all contexts count. Those seen at least
``total / max_contexts`` times, so at most ``max_contexts`` of each length at any
corpus size, are sent to the workers. Symbols after rarer contexts are joined:
their probability depends on no more than the symbol and the ``order`` before
it, so each distinct one is looked up once: workers gather those of many rows and
ask for each once, and the rows hold places among the answers. Contexts that end in the same three
symbols lie in one group of the trie, and groups are dealt to tasks, which walk
all their levels with arrays; contexts of up to two symbols, which the alphabet
bounds, are sent to all. Escapes are estimated by method D (half a count for
each distinct symbol) and symbols of the longer contexts are excluded from the
shorter ones.

Counts being fixed, the trie and its suffix links fold into an automaton: a
state is the longest sent context, and next state and log10 probability of
every symbol are two dense tables. Scoring walks many stretches of text side by
side, a warm-up of ``order`` symbols giving each its exact state.

Text is scored as its token sequence: A-Z lower-cased, runs of white space as
one space, one end symbol. Null and empty texts consist of the end symbol.
Repeated rows are scored each; a null id belongs to the training fold. Very long
texts are learnt and scored whole, in one row. An empty table gives an empty
result, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, give_back, grouped, release, slices, spread, sweep
from .textcode import ASCII_LOWER, TOKEN_BYTES, Tokens, buffer_of, tokenize

END = 257
BITS = 9
#: Words seen in at least a share 1/HEAVY of the training tokens, and so at most HEAVY of them, are sent to all workers.
HEAVY = 1 << 20


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Tokens]:
    """Byte + 1 of the canonical texts, END after each; the first of each document, plus the end; the tokens."""
    data, offsets = buffer_of(column)
    data = ASCII_LOWER[data]
    tokens = tokenize(data, offsets, TOKEN_BYTES)
    keep = TOKEN_BYTES[data]
    gap = np.ones(len(tokens.starts), bool)
    gap[tokens.first[:-1][np.diff(tokens.first) > 0]] = False
    gap = tokens.starts[gap] - 1
    keep[gap] = True
    canonical = data.astype(np.uint16) + 1
    canonical[gap] = 0x21
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    ends = kept[offsets[1:]]
    seq = np.insert(canonical[keep], ends, END)
    first = np.zeros(len(offsets), np.int64)
    first[1:] = ends + np.arange(1, len(offsets))
    return seq, first, tokens


def grams(seq: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """For each symbol, it and up to ``order`` symbols before it in its document, packed, the symbol lowest."""
    place = np.arange(len(seq)) - np.repeat(first[:-1], np.diff(first))
    key = seq.astype(np.int64)
    for k in range(1, order + 1):
        back = np.zeros(len(seq), np.int64)
        back[k:] = seq[:-k] if k <= len(seq) else 0
        back[place < k] = 0
        key |= back << (BITS * k)
    return key


class _Counter:
    """Counts of int64 keys, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > 1_500_000 and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[cut], np.add.reduceat(n, cut)
        self.parts, self.held = [(keys, n)], len(keys)
        return keys, n


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, words, docs = _Counter(), _Counter(), 0

        def flush(kind: int, counter: _Counter) -> Iterator[pa.RecordBatch]:
            keys, n = counter.merge()
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[a : a + 100_000])], ["kind", "key", "n"])
            counter.parts, counter.held = [], 0
            give_back()

        for batch in batches:
            for part in slices(batch, "text"):
                seq, first, tokens = symbols(part.column(0))
                texts.add(grams(seq, first, order))
                words.add(tokens.hashes().view(np.int64))
                docs += part.num_rows
                for kind, counter in ((0, texts), (1, words)):
                    if counter.held > 2_000_000:
                        yield from flush(kind, counter)
        yield from flush(0, texts)
        yield from flush(1, words)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])

    return run


@dataclass
class PpmModel:
    """``code``: symbol to column of the tables; ``next`` and ``logp``: by state and column; ``depth``: length of a state's context; state 0 is the empty context."""

    order: int
    code: np.ndarray
    next: np.ndarray
    logp: np.ndarray
    depth: np.ndarray

    def steps(self, seq: np.ndarray, stretch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol, and the length of the context it is read from."""
        n = len(seq)
        if not n:
            return np.zeros(0, np.float32), np.zeros(0, np.int8)
        width = self.next.shape[1]
        begins = np.arange(0, n, stretch)
        padded = np.full(self.order + len(begins) * stretch, self.code[END], np.int64)
        padded[self.order : self.order + n] = self.code[seq]
        flat_next, flat_logp = self.next.ravel(), self.logp.ravel()
        state = np.zeros(len(begins), np.int64)
        for t in range(self.order):
            state = flat_next[state * width + padded[begins + t]].astype(np.int64)
        at, out, depth = begins + self.order, np.empty((stretch, len(begins)), np.float32), np.empty((stretch, len(begins)), np.int8)
        for t in range(stretch):
            depth[t] = self.depth[state]
            cell = state * width + padded[at + t]
            out[t] = flat_logp[cell]
            state = flat_next[cell].astype(np.int64)
        return out.T.ravel()[:n], depth.T.ravel()[:n]

    def score(self, seq: np.ndarray, first: np.ndarray, stretch: int = 512) -> np.ndarray:
        """log10 probability of each document of ``symbols``."""
        if not len(seq):
            return np.zeros(len(first) - 1)
        return np.add.reduceat(self.steps(seq, stretch)[0].astype(np.float64), first[:-1])


#: Contexts whose rows are worked out at once.
SLAB = 2048


class _Rows:
    """What the next longer contexts need of the contexts of one length."""

    def __init__(self, n: int, width: int) -> None:
        self.count, self.rest = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        self.total, self.distinct = np.zeros(n), np.zeros(n, np.int64)


def build(order: int, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> PpmModel:
    """From (context, symbol, count) of the kept contexts of each length."""
    root = levels.get(0, (np.zeros(0, np.int64),) * 3)
    seen = np.unique(root[1])
    code = np.full(END + 1, len(seen), np.int64)
    code[seen] = np.arange(len(seen))
    width = len(seen) + 1  # the last column: any one symbol that the training texts lack
    if END not in seen:
        code[END] = width
        width += 1
    unseen = END - len(seen)
    none = (np.zeros(0, np.int64),) * 3
    nodes_of = [np.unique(levels.get(k, none)[0]) if k else np.zeros(1, np.int64) for k in range(order + 1)]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in nodes_of])])
    # both tables are made once and filled in parts, so that a worker holds little beside them
    table, logp = np.zeros((begin[-1], width), np.int32), np.empty((begin[-1], width), np.float32)
    above = None
    for k, nodes in enumerate(nodes_of):
        ctx, sym, n = levels.get(k, none)
        sort = np.argsort(ctx, kind="stable")
        ctx, col, n = ctx[sort], code[sym[sort]], n[sort]
        if k:
            # a context of k symbols is the step from its first k - 1 by its last
            table[begin[k - 1] + np.searchsorted(nodes_of[k - 1], nodes >> BITS), code[nodes & ((1 << BITS) - 1)]] = begin[k] + np.arange(len(nodes))
            suffix = np.searchsorted(nodes_of[k - 1], nodes & ((1 << (BITS * (k - 1))) - 1))
        own = _Rows(len(nodes), width if k < order else 0)
        for s in range(0, len(nodes), SLAB):
            e = min(s + SLAB, len(nodes))
            x, y = np.searchsorted(ctx, nodes[s]), np.searchsorted(ctx, nodes[e - 1], "right")
            count = np.zeros((e - s, width), np.float32)
            np.add.at(count, (np.searchsorted(nodes[s:e], ctx[x:y]), col[x:y]), n[x:y])
            total = np.zeros(e - s)
            np.add.at(total, np.searchsorted(nodes[s:e], ctx[x:y]), n[x:y])
            has = count > 0
            distinct = has.sum(1)
            if k == 0:
                rest = np.full((1, width), 1 / max(unseen, 1))
            else:
                up = suffix[s:e]
                lower = above.count[up]
                left = above.total[up] - np.where(has, lower, 0).sum(1)
                new = above.distinct[up] - distinct
                size = 2 * np.where(left > 0, left, 1)
                some = (left > 0)[:, None]
                rest = np.where((lower > 0) & some, (2 * lower - 1) / size[:, None], np.where(some, (new / size)[:, None], 1.0) * above.rest[up])
                table[begin[k] + s : begin[k] + e] = table[begin[k - 1] + up]
            escape = distinct / np.maximum(2 * total, 1)
            if k == 0 and not total.sum():
                escape[:] = 1
            if k == 0 and not unseen:
                prob = count / np.maximum(total, 1)[:, None]
            else:
                prob = np.where(has, (2 * count - 1) / np.maximum(2 * total, 1)[:, None], escape[:, None] * rest)
            with np.errstate(divide="ignore"):
                logp[begin[k] + s : begin[k] + e] = np.log10(np.maximum(prob, 1e-30))
            if k < order:
                own.count[s:e], own.total[s:e], own.distinct[s:e], own.rest[s:e] = count, total, distinct, rest
        above = own
    if code[END] < width:
        table[:, code[END]] = 0
    depth = np.repeat(np.arange(order + 1, dtype=np.int8), np.diff(begin))
    return PpmModel(order, code, table, logp, depth)


def count_corpus(train: DataFrame, order: int) -> DataFrame:
    """(kind, key, n) over all training texts: packed grams (0), token hashes (1), documents (2)."""
    parts = train.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(order), "kind int, key long, n long")
    return durable(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


#: Contexts of so many symbols and more are dealt by their last so many symbols; shorter ones are sent to all workers.
DEALT = 3


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


@dataclass
class Level:
    """Contexts of one length: sorted (context, symbol) pairs with counts; sorted contexts with the count of symbols, of distinct ones, and what these count in the next shorter context."""

    pairs: np.ndarray
    n: np.ndarray
    ctx: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    inside: np.ndarray


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(n[order], cut) if len(cut) else np.zeros(0, np.int64)


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys``, and whether they are there."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def level(keys: np.ndarray, n: np.ndarray, k: int, below: Level | None) -> Level:
    """The contexts of ``k`` symbols that packed grams hold."""
    own = keys & _mask(k + 1)
    if k:
        ok = own >> (BITS * k) > 0
        own, n = own[ok], n[ok]
    pairs, n = _sums(own, n)
    ctx = pairs >> BITS
    cut = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    inside = np.zeros(len(cut), np.int64)
    if below is not None and len(cut):
        inside = np.add.reduceat(below.n[_find(below.pairs, pairs & _mask(k))[0]], cut)
    total = np.add.reduceat(n, cut) if len(cut) else np.zeros(0, np.int64)
    return Level(pairs, n, ctx[cut], total, np.diff(np.append(cut, len(ctx))), inside)


def walk(keys: np.ndarray, levels: list[Level], unseen: int) -> np.ndarray:
    """log10 probability of the last symbol of each packed gram: the definition of ``build``, for any contexts."""
    rest = np.full(len(keys), 1 / max(unseen, 1))
    value, n_below, total_below, kinds_below = rest, None, None, None
    for k, own in enumerate(levels):
        pair = keys & _mask(k + 1)
        at, seen = _find(own.pairs, pair)
        n = np.where(seen, own.n[at], 0) if len(own.n) else np.zeros(len(keys), np.int64)
        at, known = _find(own.ctx, pair >> BITS)
        known &= (pair >> (BITS * k) > 0) | (k == 0)
        total, kinds, inside = (np.where(known, x[at], 0) if len(x) else np.zeros(len(keys), np.int64) for x in (own.total, own.kinds, own.inside))
        if k:
            left = total_below - inside
            size = 2 * np.maximum(left, 1)
            lower = np.where(left <= 0, rest, np.where(n_below > 0, (2 * n_below - 1) / size, (kinds_below - kinds) / size * rest))
            rest = np.where(known, lower, rest)
        size = 2 * np.maximum(total, 1)
        if k == 0 and not unseen:
            now = n / np.maximum(total, 1)
        else:
            now = np.where(n > 0, (2 * n - 1) / size, kinds / size * rest)
        value = np.where(known & (total > 0), now, value)
        n_below, total_below, kinds_below = n, total, kinds
    return np.log10(np.maximum(value, 1e-30))


def _groups(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.Table]:
    """Whole groups, many at a time."""
    held: list[pa.Table] = []
    named = (pa.RecordBatch.from_arrays([*b.columns, pa.array(b.column(0).to_numpy() >> BITS & _mask(DEALT))], ["key", "n", "part"]) for b in batches)
    for table in grouped(named, "part"):
        held.append(table)
        if sum(t.num_rows for t in held) >= most:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def dealt(grams: DataFrame) -> DataFrame:
    """(key, n) with whole groups in one task: the last symbols of the context are the group."""
    part = F.shiftright("key", BITS).bitwiseAND(_mask(DEALT))
    return grams.repartition(part).sortWithinPartitions(part)


def _frequent(order: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            keys, n = table["key"].to_numpy(), table["n"].to_numpy()
            for k in range(DEALT, order + 1):
                own = level(keys, n, k, None)
                keep = own.total[np.searchsorted(own.ctx, own.pairs >> BITS)] >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), k, np.int32)), pa.array(own.pairs[keep]), pa.array(own.n[keep])], ["k", "pair", "n"])

    return run


def short_levels(grams: DataFrame, order: int) -> list[Level]:
    """Levels of contexts below ``DEALT`` symbols; the alphabet bounds their pairs."""
    # at most 257 ** DEALT rows; running text has some 100,000
    rows = grams.groupBy(F.col("key").bitwiseAND(_mask(DEALT)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    out: list[Level] = []
    for k in range(min(DEALT, order + 1)):
        out.append(level(keys, n, k, out[-1] if out else None))
    return out


def train_model(grams: DataFrame, short: list[Level], order: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, symbol, count) by length, of contexts that at least ``least`` symbols follow."""
    parts = {}
    for k, own in enumerate(short):
        keep = own.total[np.searchsorted(own.ctx, own.pairs >> BITS)] >= (least if k else 0)
        parts[k] = own.pairs[keep], own.n[keep]
    if order >= DEALT:
        # at most total / least contexts of each length, of at most 257 symbols
        rows = dealt(grams.select("key", "n")).mapInArrow(_frequent(order, least), "k int, pair long, n long").toArrow()
        k, pair, n = (rows[c].to_numpy() for c in ("k", "pair", "n"))
        parts |= {i: (pair[k == i], n[k == i]) for i in range(DEALT, order + 1)}
    return {i: (p >> BITS, (p & _mask(1)).astype(np.int16), n.astype(np.float32)) for i, (p, n) in parts.items()}


def gram_scores(keys: DataFrame, grams: DataFrame, short: list[Level], order: int, unseen: int) -> DataFrame:
    """key, logp of distinct packed grams, from all contexts."""
    spread_short = keys.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            key, n = table["key"].to_numpy(), table["n"].to_numpy()
            asked = key[n == 0]
            levels = list(spread_short.value)
            for k in range(DEALT, order + 1):
                levels.append(level(key[n > 0], n[n > 0], k, levels[-1]))
            for a in range(0, len(asked), 100_000):
                own = asked[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(walk(own, levels, unseen))], ["key", "logp"])

    both = grams.select("key", "n").unionByName(keys.select("key", F.lit(0).cast("long").alias("n")))
    return dealt(both).mapInArrow(run, "key long, logp double")


_BUILT: dict[object, PpmModel] = {}


def built(key: object, order: int, levels: dict) -> PpmModel:
    """The model of a broadcast, built once in each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        give_back()
        _BUILT[key] = build(order, levels)
        give_back()
    return _BUILT[key]


def tally(doc: np.ndarray, key: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Of each document its distinct keys, and how often each occurs."""
    sort = np.lexsort((key, doc))
    doc, key = doc[sort], key[sort]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([cut, [len(doc)]])).astype(np.int32)
    at = np.zeros(n_docs + 1, np.int32)
    np.cumsum(np.bincount(doc[cut], minlength=n_docs), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(key[cut])), pa.ListArray.from_arrays(pa.array(at), pa.array(times))


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the place of each key among them; ``np.unique`` holds three times as much."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], at


def _score(shared, seen: tuple[int, float], whole: bool, chunk: int):
    ends, denominator = seen
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "heavy", "score", "rare", "times", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, order, levels, keys, logs = shared.value
        model = built(key, order, levels)
        row = TaskContext.get().partitionId() << 40
        held: list[tuple[list, np.ndarray | None, np.ndarray]] = []
        wait = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            grams = np.concatenate([g for _, g, _ in held])
            # offsets end with the count, so the grams themselves are not held twice
            held[:] = [(columns, None, offsets) for columns, _, offsets in held]
            asked, at = distinct_places(grams)
            own = held[0][0][0][0].as_py()
            del grams
            for columns, _, offsets in held:
                n_docs = len(columns[0])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at[: offsets[-1]]))
                at = at[offsets[-1] :]
                # the chunk's first row carries what the chunk asks for
                ask = pa.ListArray.from_arrays(pa.array(np.where(np.arange(n_docs + 1) > 0, len(asked), 0).astype(np.int32)), pa.array(asked))
                asked = asked[:0]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.full(n_docs, own)), ask], [*names, "chunk", "asked"])
            held.clear()
            give_back()

        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                seq, first, tokens = symbols(part.column(2))
                logp, depth = model.steps(seq)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                place = np.arange(len(seq)) - first[doc]
                # a context that was not sent may be a rare one
                open_ = np.zeros(0, np.int64) if whole else np.flatnonzero(depth < np.minimum(place, order))
                logp = logp.astype(np.float64)
                logp[open_] = 0
                score = np.add.reduceat(logp, first[:-1])
                gram = seq[open_].astype(np.int64)
                for k in range(1, order + 1):
                    gram |= np.where(place[open_] >= k, seq[np.maximum(open_ - k, 0)], 0).astype(np.int64) << (BITS * k)
                h, n_docs = tokens.hashes().view(np.int64), part.num_rows
                place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                sums = np.bincount(tokens.doc[known], logs[place[known]] if len(keys) else None, n_docs) if known.any() else np.zeros(n_docs)
                n_known = np.bincount(tokens.doc[known], minlength=n_docs)
                columns = [
                    pa.array(row + np.arange(n_docs)),
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(tokens.first) + 1),
                    pa.array(n_known + (ends > 0)),
                    pa.array(sums + math.log10((ends + 1) / denominator)),
                    pa.array(score),
                    *tally(tokens.doc[~known], h[~known], n_docs),
                ]
                held.append((columns, gram, np.searchsorted(open_, first)))
                row += n_docs
                wait += len(gram) + n_docs
                if wait >= chunk:
                    yield from flush()
                    wait = 0
        yield from flush()

    return run


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows from the values of their chunk, which come before them by place (``logp`` set, ``row`` the place)."""
    own, got, values = None, [], np.zeros(0)
    for batch in batches:
        chunk, row, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 1))
        cut = np.flatnonzero((chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(chunk)]):
            if a == b:
                continue
            if chunk[a] != own:
                own, got, values = chunk[a], [], np.zeros(0)
            if not asks[a]:
                got.append(batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False))
                continue
            if got:
                # every place of the chunk is there once, in order
                values, got = np.concatenate(got), []
            lists = batch.column(4).slice(a, b - a)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b - a), size)
            deep = np.bincount(doc, values[lists.flatten().to_numpy()], b - a) if len(doc) else np.zeros(b - a)
            yield pa.RecordBatch.from_arrays([pa.array(row[a:b]), pa.array(deep)], ["row", "deep"])


def deep_scores(scored: DataFrame, asked: DataFrame, logps: DataFrame) -> DataFrame:
    """(row, deep): what the rows' open symbols add. Values are looked up once for each chunk of rows, and meet the rows in sorted partitions."""
    values = asked.join(logps, "key").select("chunk", F.lit(False).alias("is_row"), F.col("place").alias("row"), "logp", F.lit(None).cast("array<int>").alias("at"))
    rows = scored.where(F.size("at") > 0).select("chunk", F.lit(True).alias("is_row"), "row", F.lit(None).cast("double").alias("logp"), "at")
    both = values.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "is_row", "row")
    return both.select("chunk", "is_row", "row", "logp", "at").mapInArrow(_deep, "row long, deep double")


def lm_score(docs: DataFrame, order: int = 5, max_contexts: int = 1 << 18, parts: int = 7, held: int = 2, chunk: int = 1 << 21) -> DataFrame:
    """Scores every text by a model of the texts whose fold of ``parts`` is not ``held``.

    ``chunk``: symbols after rare contexts that a worker gathers, from whole rows,
    before it asks for each distinct one.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word
    model) and score (log10 probability). Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), F.col("text").cast("string").alias("text")))
    counts = count_corpus(rows.where(~F.col("held_out")), order)
    words = durable(counts.where("kind = 1").select("key", "n"), "ppm-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = n + ends, v + (ends > 0)
    denominator = float(n + 1 * (v + 1))
    grams = counts.where("kind = 0").select("key", "n")
    short = short_levels(grams, order)
    total = int(short[0].total.sum())
    sent = max(1, math.ceil(total / max_contexts))
    levels = train_model(grams, short, order, sent)
    sweep(spark)
    unseen = END - len(np.unique(levels[0][1]))
    least = max(1, math.ceil(n / HEAVY))
    heavy = words.where(F.col("n") >= least).select("key", "n").toArrow().sort_by("key")
    logs = np.log10((heavy["n"].to_numpy().astype(np.float64) + 1) / denominator)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, order, levels, heavy["key"].to_numpy(), logs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, heavy double, score double, rare array<long>, times array<int>, at array<int>, chunk long, asked array<long>"
    scored = durable(rows.mapInArrow(_score(shared, (ends, denominator), sent == 1, chunk), schema), "ppm-scored")
    sweep(spark)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    found = rare.join(words.where(F.col("n") < least).select("key", F.col("n").alias("c")), "key", "left")
    seen = F.col("c").isNotNull()
    rest = found.groupBy("row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(denominator))).alias("light"),
    )
    score = F.col("score")
    if sent > 1:
        asked = scored.select("chunk", F.posexplode("asked").alias("place", "key")).withColumn("place", F.col("place").cast("long"))
        logps = durable(gram_scores(asked.select("key").distinct(), grams, short, order, unseen), "ppm-gram-scores")
        release(counts)
        sweep(spark)
        deep = deep_scores(scored, asked, logps)
        rest = rest.join(deep, "row", "full")
        score = F.col("score") + F.coalesce("deep", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("heavy") + F.coalesce("light", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )


class AdaptivePpm:
    """The trie as it learns while it codes one text; also the plain form that the automaton is tested against."""

    def __init__(self, order: int = 5) -> None:
        self.order, self.trie = order, {}

    def learn(self, symbols: list[int], at: int) -> None:
        for k in range(min(self.order, at) + 1):
            own = self.trie.setdefault(tuple(symbols[at - k : at]), {})
            own[symbols[at]] = own.get(symbols[at], 0) + 1

    def log10(self, symbols: list[int], at: int) -> float:
        excluded: set[int] = set()
        out = 0.0
        for k in range(min(self.order, at), -1, -1):
            own = self.trie.get(tuple(symbols[at - k : at]))
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if symbols[at] in left:
                n = left[symbols[at]]
                return out + math.log10(n / total if k == 0 and len(own) == END else (2 * n - 1) / (2 * total))
            out += math.log10(len(left) / (2 * total))
            excluded |= set(own)
        return out - math.log10(END - len(excluded))

    def code(self, symbols: list[int]) -> float:
        """log10 probability of a text, learning each symbol after it is coded."""
        out = 0.0
        for at in range(len(symbols)):
            out += self.log10(symbols, at)
            self.learn(symbols, at)
        return out


def adaptive_score(docs: DataFrame, order: int = 5) -> DataFrame:
    """Adaptive code length of each text on its own: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seq, first, _ = symbols(part.column(1))
                score = [AdaptivePpm(order).code(seq[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
