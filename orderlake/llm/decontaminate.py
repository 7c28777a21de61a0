"""Benchmark decontamination, with DataFrame operations only.

Texts are lower-cased words (letters, marks, digits) in shingles of five; a
text of one to four words is one shingle, one without words has none and
matches nothing. Test items are partitioned by size, in powers of two. The
MinHash sketch of an item is its ``m`` smallest shingle hashes, ``m`` being one
more than the shingles that an item of the partition's largest size may lack
at the threshold: a document that contains the item holds at least one of the
sketch, however long the document, so no leak is missed. Sketches are joined
with the shingles of documents by a broadcast of checked size; where they are
too many for that, document shingles above a partition's largest sketch hash
are dropped before they are dealt. Candidates are verified by exact containment
of the whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, few, spread, text_tag, without

#: Postings, and item shingles, up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_POSTINGS = 1 << 20
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of a text's shingles; an empty array for texts without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), lambda x: x != "")
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    # the array is bound once, so that it isn't computed again for each shingle
    each = F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>")),
    )
    return F.array_distinct(F.get(each, 0))


def sketches(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """item_id, item (its shingles), n, slack (shingles that it may lack), sketch, and whether that is one hash."""
    rows = items.select("item_id", F.array_sort(shingles(F.col("text"), width)).alias("item")).where(F.size("item") > 0)
    rows = rows.withColumn("n", F.size("item")).withColumn("slack", F.floor((1 - F.lit(threshold)) * F.col("n") + 1e-9).cast("int"))
    largest = (F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1) - 1).cast("int")
    m = F.least(F.col("n"), F.floor((1 - F.lit(threshold)) * largest + 1e-9).cast("int") + 1)
    return rows.withColumn("m", m).withColumn("sketch", F.slice("item", 1, F.col("m"))).withColumn("exact", F.col("m") == 1)


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, tag (a hash of the text), item_id, item_shingles, found, containment of each test item inside a document.

    Repeated rows of one id and text give one result; ids may be null. Null,
    empty and wordless texts on either side match nothing, very long documents
    are searched whole, and repeated test items are searched each. Empty tables
    give an empty result.
    """
    sketch = durable(sketches(items, threshold, width).withColumn("item_row", F.xxhash64("item_id", "item")).dropDuplicates(["item_row"]), "decontaminate-sketches")
    posts = sketch.select("exact", F.explode("sketch").alias("h"), "item_row", (F.col("m") - F.col("slack")).alias("least"))
    classes = posts.groupBy("exact").agg(F.count("*").alias("number"), F.max("h").alias("top")).collect()
    texts = spread(docs.select(F.col("doc_id").alias("d"), text_tag().alias("t"), F.col("text").cast("string").alias("text")))
    if sum(c.number for c in classes) <= BROADCAST_POSTINGS:
        hits = texts.select("d", "t", F.explode(shingles(F.col("text"), width)).alias("h")).join(F.broadcast(posts.drop("exact")), "h")
    else:
        # items that may lack no shingle have a sketch of one hash, of any size; the others' sketches end low, so few shingles of documents are dealt
        hits = None
        for c in classes:
            low = F.filter(shingles(F.col("text"), width), lambda h, top=c.top: h <= F.lit(top))
            own = posts.where(F.col("exact") == F.lit(c.exact)).drop("exact")
            found = texts.select("d", "t", F.explode(low).alias("h")).join(F.broadcast(own) if c.number <= BROADCAST_POSTINGS else own, "h")
            hits = found if hits is None else hits.unionByName(found)
    candidates = hits.groupBy("d", "t", "item_row").agg(F.count_distinct("h").alias("both"), F.max("least").alias("least")).where("both >= least")
    candidates = durable(candidates.select("d", "t", "item_row"), "decontaminate-candidates")
    wanted = candidates.select(F.col("d").alias("wanted_d"), F.col("t").alias("wanted_t")).distinct()
    same = F.col("d").eqNullSafe(F.col("wanted_d")) & (F.col("t") == F.col("wanted_t"))
    # candidates' texts only, each once
    whole = durable(texts.join(few(wanted), same, "left_semi").dropDuplicates(["d", "t"]).select(F.col("d").alias("wanted_d"), F.col("t").alias("wanted_t"), shingles(F.col("text"), width).alias("doc")), "decontaminate-texts")
    own = sketch.select("item_row", "item_id", "item", "n")
    held = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = candidates.join(F.broadcast(own) if held <= BROADCAST_POSTINGS else own, "item_row").join(whole, same)
    found = F.size(F.array_intersect("item", "doc"))
    out = pairs.select(F.col("d").alias("doc_id"), F.col("t").alias("tag"), "item_id", F.col("n").cast("long").alias("item_shingles"), found.cast("long").alias("found"))
    return out.withColumn("containment", F.col("found") / F.col("item_shingles")).where(F.col("containment") >= threshold)


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without those that contain a test item."""
    return without(docs, contained(docs, items, threshold))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
it AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM it GROUP BY 1),
b AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN it USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, found, found / item_shingles AS containment FROM b JOIN n USING (item_id) WHERE found / item_shingles >= 0.8
"""
