"""Language ID by word-first backoff.

A word seen in training scores by its log frequency in each language. An unseen
word falls back to its longest known character n-grams, from ``longest`` down
to single characters, each step down weighing less. Log frequencies become
log shares across languages, so every word votes on one scale; the document's
sums give the language and, by softmax, the score.

The model is fitted on a bounded sample of labelled texts (``max_train``, each
text of an id once) and holds every word and every n-gram of it, told apart by
64-bit hashes. Words are runs of letters, digits and characters beyond ASCII,
lower-cased. A null text or one without a letter is ``und`` with score 0; ties
go to the smallest language; a text whose words say nothing gets the most
frequent language. With no labelled row every text is ``und``. Repeated rows and
null ids are predicted each, very long texts whole, an empty table gives an empty
result, and columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, durable, fold, release, slices, spread, text_tag, without
from .textcode import _BASE, buffer_of, mix64, tokenize, words_of

UNKNOWN = "und"
#: Weight of a fallback n-gram vote by the steps down from the longest.
STEP = 0.6


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            tokens = words_of(part.column(1))
            lang = langs.indices.to_numpy()[tokens.doc]
            h = tokens.hashes()
            for k, name in enumerate(names):
                own = np.flatnonzero(lang == k)
                _, at, n = np.unique(h[own], return_index=True, return_counts=True)
                words = [w.decode("utf-8", "replace") for w in tokens.words(own[at])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n)], ["lang", "word", "n"])


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = buffer_of(pa.array(words, pa.string()))
    tokens = tokenize(data, offsets, np.ones(256, bool))
    return tokens.hashes()


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` characters from each place on."""
    n = max(len(code) - k + 1, 0)
    with np.errstate(over="ignore"):
        letter = mix64(code.astype(np.uint64) + np.uint64(1))
        out = np.full(n, np.uint64(k))
        for j in range(k):
            out = out * _BASE + letter[j : j + n]
        return mix64(out)


def characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between ``^`` and ``$``, which no word holds; where each begins, plus the end."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    code = np.frombuffer((b"^" + b"$^".join(words) + b"$").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return code, np.append(np.flatnonzero(code == ord("^")), len(code))


def _shares(counts: np.ndarray, totals: np.ndarray, smooth: float) -> np.ndarray:
    """Log share of each language among the smoothed relative frequencies of each row."""
    p = (counts + smooth) / (totals + smooth * 1000)
    return np.log(p / p.sum(1, keepdims=True)).astype(np.float32)


class LanguageModel:
    """Sorted hashes of words and of n-grams, with a vote for each language."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], totals: np.ndarray, gram_totals: np.ndarray, longest: int) -> None:
        self.langs, self.longest, self.best = langs, longest, int(prior.argmax())
        h = _hash_words(words[0]) if words[0] else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.word_keys, self.word_votes = h[order], _shares(words[1][order], totals, 0.5)
        size = np.array([len(g) for g in grams[0]], int)
        h = np.zeros(len(size), np.uint64)
        for k in range(1, longest + 1):
            own = np.flatnonzero(size == k)
            code = np.frombuffer("".join(grams[0][i] for i in own).encode("utf-32-le"), np.uint32)
            h[own] = gram_hashes(code, k)[::k]
        order = np.argsort(h)
        votes = _shares(grams[1], gram_totals[size], 0.5) * (STEP ** (1 + longest - size))[:, None].astype(np.float32)
        self.gram_keys, self.gram_votes = h[order], votes[order]

    def fallback(self, words: list[bytes]) -> np.ndarray:
        """Votes of unseen words: the mean over their longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not words or not len(self.gram_keys):
            return out
        code, first = characters(words)
        word = np.repeat(np.arange(len(words)), np.diff(first))
        for k in range(self.longest, 0, -1):
            h = gram_hashes(code, k)
            h = np.where(word[: len(h)] == word[k - 1 :], h, np.uint64(0))
            place = np.minimum(np.searchsorted(self.gram_keys, h), len(self.gram_keys) - 1)
            known = np.flatnonzero((self.gram_keys[place] == h) & (word[: len(h)] == word[k - 1 :]))
            if not len(known):
                continue
            own, votes = word[known], self.gram_votes[place[known]]
            n = np.bincount(own, minlength=len(words))
            some = np.flatnonzero(n)
            out[some] = np.stack([np.bincount(own, votes[:, j], len(words)) for j in range(votes.shape[1])], 1)[some] / n[some][:, None]
            left = n[word] == 0
            code, word = code[left], word[left]
            if not len(code):
                break
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokens, n = words_of(column), len(column)
        keys, at, inverse = np.unique(tokens.hashes(), return_index=True, return_inverse=True)
        votes = np.zeros((len(keys), len(self.langs)), np.float32)
        if len(self.word_keys):
            place = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
            known = self.word_keys[place] == keys
            votes[known] = self.word_votes[place[known]]
        else:
            known = np.zeros(len(keys), bool)
        rest = np.flatnonzero(~known)
        votes[rest] = self.fallback(tokens.words(at[rest]))
        sums = np.stack([np.bincount(tokens.doc, votes[inverse, k], n) for k in range(len(self.langs))], 1)
        top = sums.argmax(1)
        top[(sums == sums[:, :1]).all(1)] = self.best
        p = np.exp(sums - sums.max(1, keepdims=True))
        return top, (p / p.sum(1, keepdims=True))[np.arange(n), top]


def train(rows: DataFrame, max_train: int, longest: int) -> LanguageModel | None:
    """From (doc_id, lang, text)."""
    some = rows.where("lang is not null").select("doc_id", text_tag().alias("tag"), "lang", F.col("text").cast("string").alias("text"))
    some = bounded_sample(some, max_train, "doc_id", "tag").dropDuplicates(["doc_id", "tag", "lang"]).select("lang", "text")
    counts = some.mapInArrow(_word_counts, "lang string, word string, n long")
    # what a bounded sample holds needs no more files than cores
    files = rows.sparkSession.sparkContext.defaultParallelism
    counts = durable(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).coalesce(files), "langid-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    langs = sorted(totals)

    def table(pairs: DataFrame, name: str) -> tuple[list[str], np.ndarray]:
        # the words and n-grams of max_train texts; a row each, with the counts by language side by side
        got = pairs.groupBy(name).agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]).toArrow().sort_by(name)
        return got[name].to_pylist(), np.stack([got[f"n{k}"].to_numpy() for k in range(len(langs))], 1).astype(np.float32)

    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    each = [counts.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 3 - k), lambda i: F.substring(marked, i, F.lit(k)))).alias("gram")).where(F.length("gram") == k) for k in range(1, longest + 1)]
    grams = each[0]
    for more in each[1:]:
        grams = grams.unionByName(more)
    grams = durable(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).coalesce(files), "langid-grams")
    number = {x: i for i, x in enumerate(langs)}
    gram_totals = np.ones((longest + 1, len(langs)))
    for r in grams.groupBy(F.length("gram").alias("k"), "lang").agg(F.sum("n").alias("n")).collect():
        gram_totals[r["k"], number[r["lang"]]] = r["n"]
    total = np.array([totals[x] for x in langs], float)
    model = LanguageModel(langs, total, table(counts, "word"), table(grams, "gram"), total, gram_totals, longest)
    release(counts, grams)
    return model


def identify(docs: DataFrame, parts: int = 4, held: int = 2, max_train: int = 8000, longest: int = 5, tagged: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and if ``tagged`` its text tag; learns from rows whose fold is not ``held``."""
    spark = docs.sparkSession
    more = ["tag"] if tagged else []
    rows = docs.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(~F.col("held_out")), max_train, longest)
    rows = spread(rows).select("doc_id", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text", *(text_tag().alias(c) for c in more))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *more)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                top, score = own.predict(part.column(3))
                letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                lang = [own.langs[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), *part.columns[4:]], ["doc_id", "held_out", "lang_pred", "score", *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double" + ", tag long" * tagged)


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows whose text has a language that the model knows: all but those that are ``und``."""
    return without(docs, identify(docs, tagged=True).where(F.col("lang_pred") == UNKNOWN))
