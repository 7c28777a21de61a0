"""The inverted index: postings, pinned search, integer term-frequency scores.

Documents are rows (shard, key, version, field, text, filter_flags,
search_flags). One posting stands for a term in a field of a document version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import in_prefix
from ..functions.text import tokenize
from .mvcc import latest


class IndexRefusal(ValueError):
    """A request that the index refuses."""


def has_flags(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) == mask


def flag_bits(names: list[str], known: list[str]) -> int:
    """The mask of named flags, the first known one being bit 0."""
    if len(known) > 64 or set(names) - set(known):
        raise IndexRefusal(f"unknown flags: {sorted(set(names) - set(known))}")
    return sum(1 << known.index(n) for n in set(names))


#: Fixed values of the replica's scorer: weight of a term, norm of the length.
TERM_WEIGHT, LENGTH_NORM = 1000, 8


def term_score(tf: Column, length: Column, k1: int = 1200, b: int = 0, reference: int = 8) -> Column:
    """Thousandths; whole-number divisions, the length's before the sum."""
    if b > 1000 or reference < 1:
        raise IndexRefusal("b is at most 1000 and the reference length at least 1")
    tf, length = tf.cast("long"), length.cast("long")
    norm = F.lit(1000 - b).cast("long") + whole(F.lit(b).cast("long") * length, F.lit(reference).cast("long"))
    top = tf * F.lit((k1 + 1000) * 1_000_000).cast("long")
    bottom = tf * F.lit(1_000_000).cast("long") + F.lit(k1).cast("long") * norm
    return F.when(tf > 0, whole(top, bottom)).otherwise(F.lit(0).cast("long"))


def whole(a: Column, b: Column) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", a, b)


def replica_score(tf: Column, length: Column, weight: int = TERM_WEIGHT, norm: int = LENGTH_NORM) -> Column:
    norm = max(norm, 1)
    top = tf.cast("long") * weight * norm
    bottom = length.cast("long") + norm
    return whole(top, bottom)


def postings(documents: DataFrame, tokenizer: str = "ascii-word") -> DataFrame:
    """field, term, shard, key, version, tf, positions, length, filter_flags, search_flags."""
    tokens = documents.withColumn("tokens", tokenize(F.col("text"), tokenizer))
    each = tokens.select("shard", "key", "version", "field", F.size("tokens").cast("long").alias("length"), "filter_flags", "search_flags", F.posexplode("tokens").alias("pos", "term"))
    by = ["field", "term", "shard", "key", "version"]
    return each.groupBy(*by).agg(
        F.count("*").alias("tf"),
        F.sort_array(F.collect_list("pos")).alias("positions"),
        F.max("length").alias("length"),
        F.max("filter_flags").alias("filter_flags"),
        F.max("search_flags").alias("search_flags"),
    )


def postings_for(index: DataFrame, field: str, term: str) -> DataFrame:
    return index.where((F.col("field") == field) & (F.col("term") == term))


def visible(documents: DataFrame, pin: int | None = None, oldest: int = 0, current: int | None = None) -> DataFrame:
    """shard, key, version of the documents that show at a pin; deleted ones have null text."""
    if pin is not None and (pin < oldest or (current is not None and pin > current)):
        raise IndexRefusal("the pin is outside the retained versions")
    # whether there is a text is enough: texts are not shuffled
    there = F.when(F.max(F.col("text").isNotNull()), F.lit(1))
    rows = documents.groupBy("shard", "key", "version").agg(there.alias("value"))
    return latest(rows, pin).select("shard", "key", "version")


def document_frequency(index: DataFrame, shown: DataFrame, field: str, term: str) -> DataFrame:
    """n: visible documents that hold a term."""
    return postings_for(index, field, term).join(shown, ["shard", "key", "version"], "left_semi").agg(F.count("*").alias("n"))


def derive(documents: DataFrame, prefix: str, admit: Column | None = None, tokenizer: str = "ascii-word") -> DataFrame:
    """Postings of the members in bounds that a scope admits; a repeated member fails."""
    own = documents.where(in_prefix(F.col("key"), prefix))
    own = own if admit is None else own.where(admit)
    times = F.count("*").over(Window.partitionBy("shard", "key", "version", "field"))
    own = own.withColumn("__n", times).withColumn("text", F.when(F.col("__n") > 1, F.raise_error(F.lit("a member occurs twice"))).otherwise(F.col("text")))
    return postings(own.drop("__n"), tokenizer)


def compact(documents: DataFrame, current: int) -> DataFrame:
    """The visible documents at the current version; older pins can no longer be read."""
    return documents.join(visible(documents, current), ["shard", "key", "version"], "left_semi")


def overhead(index: DataFrame) -> DataFrame:
    """bytes: of terms and positions of all postings."""
    return index.agg(F.sum(F.octet_length("term") + 8 * F.size("positions") + 24).cast("long").alias("bytes"))


def digest(index: DataFrame) -> DataFrame:
    """An order-free digest of the postings, equal for equal indexes."""
    row = F.xxhash64("field", "term", "shard", "key", "version", "tf", "positions")
    return index.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


Scorer = Callable[[Column, Column], Column]


def search(
    documents: DataFrame,
    terms: list[str],
    mode: str = "any",
    pin: int | None = None,
    fields: list[str] | None = None,
    filter_flags: int = 0,
    search_flags: int = 0,
    scorer: Scorer = term_score,
    tokenizer: str = "ascii-word",
) -> DataFrame:
    """shard, key, version, score of the visible documents that match; every distinct term counts once.

    No terms: all visible documents with the flags, score 0. ``all`` wants
    every term, in whatever fields.
    """
    if mode not in ("any", "all"):
        raise IndexRefusal(f"no such mode: {mode}")
    wanted = sorted(set(terms))
    rows = documents if fields is None else documents.where(F.col("field").isin(sorted(set(fields))))
    shown = visible(documents, pin)
    ok = has_flags(F.col("filter_flags"), filter_flags) & has_flags(F.col("search_flags"), search_flags)
    if not wanted:
        hit = rows.where(ok).select("shard", "key", "version").distinct()
        return hit.join(shown, ["shard", "key", "version"], "left_semi").withColumn("score", F.lit(0).cast("long"))
    # the terms are few and known: postings of others are never made
    tokens = tokenize(F.col("text"), tokenizer)
    own = rows.where(ok).select("shard", "key", "version", "field", tokens.alias("tokens"))
    own = own.select("shard", "key", "version", "field", F.size("tokens").cast("long").alias("length"), F.explode(F.filter("tokens", lambda t: t.isin(wanted))).alias("term"))
    own = own.groupBy("shard", "key", "version", "field", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    scored = own.groupBy("shard", "key", "version").agg(F.sum(scorer(F.col("tf"), F.col("length"))).cast("long").alias("score"), F.count_distinct("term").alias("n"))
    scored = scored.join(shown, ["shard", "key", "version"], "left_semi")
    return (scored.where(F.col("n") == len(wanted)) if mode == "all" else scored).drop("n")


def search_postings(index: DataFrame, shown: DataFrame, terms: list[str], mode: str = "any", filter_flags: int = 0, search_flags: int = 0) -> DataFrame:
    """Search over stored postings: shard, key, version, score, matches."""
    wanted = sorted(set(terms))
    hit = index.where(F.col("term").isin(wanted) & has_flags(F.col("filter_flags"), filter_flags) & has_flags(F.col("search_flags"), search_flags))
    hit = hit.join(shown, ["shard", "key", "version"], "left_semi")
    out = hit.groupBy("shard", "key", "version").agg(
        F.sum(term_score(F.col("tf"), F.col("length"))).cast("long").alias("score"),
        F.count_distinct("term").alias("n"),
        F.sort_array(F.collect_list(F.struct("field", "term", "tf", "positions"))).alias("matches"),
    )
    return (out.where(F.col("n") == len(wanted)) if mode == "all" else out).drop("n")
