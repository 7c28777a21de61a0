"""N-gram Jaccard join: MinHash banding, verified on full shingle sets.

Texts are sets of five-word shingles of lower-cased words (letters, digits and
all beyond ASCII); a text of one to four words is one shingle, a text without
words has none and is linked to nothing. Texts of one word sequence form one
class of copies, of which the smallest id stands for all. Bands and rows are
chosen so that a pair at the threshold meets in some band with the target
recall. Band hashes are dealt by a shuffle; a bucket is cut into blocks of
bounded size and each pair of blocks is one unit of work, so a hot bucket is
many units. A pair is compared only in the first band it shares, which counts
each link once without a shuffle of pairs. Units return counts and local
components, never pairs, so a group of n near copies costs n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, few, grouped, release, slices, spread, text_tag, without
from .components import connected
from .textcode import _BYTE_CODE, _BYTE_CODE2, Tokens, mix64, shingle_hashes, words_of

#: Limits of a block: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of up to ``most`` hashes that finds a pair at the threshold with ``recall``."""
    best = (1, 1)
    for rows in range(1, 13):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    return rng.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.randint(0, 2**31, n).astype(np.uint32)


def band_hashes(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """(documents, bands) of uint64; documents without shingles get zeros."""
    count = np.diff(first)
    some = np.flatnonzero(count)
    out = np.zeros((len(count), bands), np.uint64)
    if not len(some):
        return out
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    mul, add = _coefficients(bands * rows, seed)
    starts = first[:-1][some]
    with np.errstate(over="ignore"):
        for b in range(bands):
            own = np.full(len(some), np.uint64(b + 1) * np.uint64(0x9E3779B97F4A7C15))
            for r in range(rows):
                k = b * rows + r
                h = low * mul[k]
                h ^= high + add[k]
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                h *= mul[k]
                own = mix64(own ^ np.minimum.reduceat(h, starts).astype(np.uint64))
            out[some, b] = own
    return out


def sequence_keys(tokens: Tokens) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each document's word sequence."""
    size = np.diff(tokens.first)
    place = mix64((np.arange(len(tokens.starts)) - np.repeat(tokens.first[:-1], size)).astype(np.uint64))
    out = []
    for codes in (_BYTE_CODE, _BYTE_CODE2):
        with np.errstate(over="ignore"):
            total = np.zeros(len(place) + 1, np.uint64)
            np.cumsum(mix64(tokens.hashes(codes) + place), out=total[1:])
            out.append(mix64(total[tokens.first[1:]] - total[tokens.first[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out


def _signatures(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens = words_of(part.column(2))
                band = band_hashes(*shingle_hashes(tokens, width), bands, rows)
                n = part.num_rows
                at = pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), part.column(0), part.column(1), pa.array(np.diff(tokens.first)), *map(pa.array, sequence_keys(tokens)), pa.ListArray.from_arrays(at, pa.array(band.view(np.int64).ravel()))],
                    ["row", "id", "tag", "n_words", "k1", "k2", "bands"],
                )
                row += n

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens = words_of(part.column(0))
                shingles, first = shingle_hashes(tokens, width)
                sets = [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, sequence_keys(tokens)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["k1", "k2", "n", "set"])

    return run


def _pairs(table: pa.Table, bands: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each unit: its row numbers, and candidate pairs as places among them.

    A unit of one block holds the pairs within it, a unit of two those across.
    A pair is a candidate where its band is the first that the pair shares.
    """
    unit = table["unit"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    band, block, within = table["band"].to_numpy(), table["block"].to_numpy(), table["within"].to_numpy()
    keys = pa.concat_arrays([c.flatten() for c in table["bands"].chunks]).to_numpy().reshape(-1, bands)
    for a, b in zip(cut[:-1], cut[1:]):
        rows = np.arange(a, b)
        if len(rows) < 2:
            continue
        k = band[a]
        for i0 in range(0, len(rows), 256):
            i = rows[i0 : i0 + 256]
            ok = np.ones((len(i), len(rows)), bool)
            for j in range(k):
                ok &= keys[i, j][:, None] != keys[rows, j][None, :]
            ok &= np.arange(i0, i0 + len(i))[:, None] < np.arange(len(rows))[None, :]
            if not within[a]:
                ok &= block[i][:, None] != block[rows][None, :]
            x, y = np.nonzero(ok)
            if len(x):
                yield rows, x + i0, y


def _needed(bands: int):
    """(unit, rep) of the rows that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "unit"):
            used = np.zeros(table.num_rows, bool)
            for rows, x, y in _pairs(table, bands):
                used[rows[x]] = True
                used[rows[y]] = True
            if used.any():
                for batch in table.filter(pa.array(used)).combine_chunks().to_batches():
                    yield batch

    return run


def _verify(bands: int, threshold: float):
    """Per unit and text with a link: copies linked to, and the smallest id of its component in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "unit"):
            yield from check(table)

    def check(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, copies, n = table["rep"].to_numpy(), table["copies"].to_numpy(), table["n"].to_numpy()
        sets = table["set"]
        links, texts = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        held: tuple = (-1,)
        for rows, x, y in _pairs(table, bands):
            if held[0] != rows[0]:
                own = [np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in rows]
                values, code = np.unique(np.concatenate(own), return_inverse=True)
                at = np.concatenate([[0], np.cumsum([len(v) for v in own])])
                held = (rows[0], code, at, np.zeros(len(values), bool))
            _, code, at, mark = held
            a, b = n[rows[x]], n[rows[y]]
            fit = np.minimum(a, b) >= threshold * np.maximum(a, b)
            x, y = x[fit], y[fit]
            cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(0, np.int64)
            for s, e in zip(cut[:-1], cut[1:]):
                i, other = int(x[s]), y[s:e]
                mark[code[at[i] : at[i + 1]]] = True
                size = at[other + 1] - at[other]
                begin = np.cumsum(size) - size
                index = np.arange(int(size.sum())) + np.repeat(at[other] - begin, size)
                both = np.add.reduceat(mark[code[index]].astype(np.int64), begin)
                mark[code[at[i] : at[i + 1]]] = False
                total = n[rows[i]] + n[rows[other]] - both
                good = other[both >= threshold * total]
                if len(good):
                    links[rows[i]] += copies[rows[good]].sum()
                    links[rows[good]] += copies[rows[i]]
                    texts[rows[i]] += len(good)
                    texts[rows[good]] += 1
                    for j in good.tolist():
                        p, q = find(int(rows[i])), find(int(rows[j]))
                        if p != q:
                            p, q = (p, q) if rep[p] <= rep[q] else (q, p)
                            root[q] = p
        used = np.flatnonzero(links)
        if len(used):
            top = np.array([find(int(i)) for i in used])
            yield pa.RecordBatch.from_arrays([pa.array(rep[used]), pa.array(links[used]), pa.array(texts[used]), pa.array(rep[top])], ["rep", "links", "texts", "root"])

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", threshold: float = 0.8, recall: float = 0.999, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, n_copies, keeper, and a hash of the text as tag.

    class_id is the smallest id of the connected component, n_links the number
    of other rows whose text has a similarity of ``threshold`` or more, copies
    included; keeper marks the smallest (id, tag) of the class. Null texts are
    empty; a text without words is its own class. Null ids count as smallest,
    repeated rows are copies of each other. Very long texts are compared whole.
    An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")))
    schema = f"row long, id {kind}, tag long, n_words long, k1 long, k2 long, bands array<long>"
    known = texts.select("id", text_tag().alias("tag"), "text")
    known = durable(known.mapInArrow(_signatures(bands, rows, width), schema), "jaccard-signatures")
    some = known.where("n_words > 0")
    classes = some.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("id", "tag")).alias("first"))
    classes = durable(classes, "jaccard-classes")
    reps = durable(known.join(classes.select(F.col("rep").alias("row"), "copies"), "row").select(F.col("row").alias("rep"), "copies", "n_words", "bands"), "jaccard-texts")
    member = reps.select("rep", "n_words", F.posexplode("bands").alias("band", "key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("m"), F.sum("n_words").alias("w")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    member = member.select("rep", "band", "key").join(buckets.select("key", blocks.alias("blocks")), "key")
    member = member.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "band", "block", (F.col("block") == F.col("other")).alias("within"), "rep")
    member = member.join(reps, "rep")
    columns = "unit long, band int, block int, within boolean, rep long, copies long, bands array<long>"
    names = [c.split()[0] for c in columns.split(", ")]
    member = member.select(*names).repartition("unit").sortWithinPartitions("unit", "block", "rep")
    needed = durable(member.mapInArrow(_needed(bands), columns), "jaccard-candidates")
    wanted = durable(classes.join(needed.select("rep").distinct(), "rep", "left_semi").select("k1", "k2", "rep", F.col("first.id").alias("id")), "jaccard-wanted")
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    sets = texts.join(few(ids), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text").mapInArrow(_shingle_sets(width), "k1 long, k2 long, n long, set binary")
    sets = durable(sets.join(wanted.select("k1", "k2", "rep"), ["k1", "k2"]).select("rep", "n", "set").dropDuplicates(["rep"]), "jaccard-sets")
    units = needed.join(sets, "rep").select(*names, "n", "set").repartition("unit").sortWithinPartitions("unit", "block", "rep")
    found = durable(units.mapInArrow(_verify(bands, threshold), "rep long, links long, texts long, root long"), "jaccard-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = connected(found.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    named = classes.join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = durable(named.select("k1", "k2", "first", "copies", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-named")
    release(classes, reps, needed, wanted, sets, found)
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = named.join(heads, "label").select("k1", "k2", "head", "n_links", "copies")
    mine = F.struct("id", "tag")
    return known.drop("bands").join(named, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n_words") > 0, F.col("head.id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n_words") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("n_words") > 0, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
        ((F.col("n_words") == 0) | mine.eqNullSafe(F.col("head"))).alias("keeper"),
        "tag",
    )


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class; of repeated rows with words, one.

    Rows whose text has no word stay, empty tables stay empty, and other columns
    of any name are kept.
    """
    classes = durable(jaccard_classes(docs, threshold=threshold).groupBy("doc_id", "tag").agg(F.first("keeper").alias("keeper"), F.first("n_copies").alias("copies"), F.count("*").alias("times")), "jaccard-decisions")
    kept = without(docs, classes.where("not keeper"))
    twice = classes.where("keeper and copies > 1 and times > 1").select(F.col("doc_id").alias("twice_id"), F.col("tag").alias("twice_tag"))
    if twice.isEmpty():
        return kept
    twice = few(twice)
    rows = kept.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_tag().alias("own_tag"))
    same = F.col("own_id").eqNullSafe(F.col("twice_id")) & (F.col("own_tag") == F.col("twice_tag"))
    once = rows.join(twice, same, "left_anti")
    again = rows.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_tag"])
    return once.unionByName(again).select("row.*")
