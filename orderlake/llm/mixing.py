"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key of its id and text. Repeated rows are one entry
with a count, in portions of bounded size. Within each source entries are dealt
to ranges of the key space, whose number follows the number of entries, so a hot
source is cut into as many ranges as it needs and a hot row into as many
portions. Sums of sizes by range give, through a prefix over ranges (by blocks of
ranges, then within a block), where each range begins; a running sum inside each
range gives where each row begins. A source's budget is whole epochs of all its
rows and the rest cut exactly at a row's place, so the words taken equal the
budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, spread

#: White-space separated words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range, on average.
RANGE_ROWS = 1024
#: Repeated rows of a portion, at most; ranges of a block.
PORTION, BLOCK = 1024, 4096


def words(column: str = "text") -> Column:
    """Number of words of a text; 0 of null."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn and share the sum
    of all sizes; a target stops at ``most`` times its source's size and what
    is over goes to the others by weight. Sources in order of cap by weight are
    capped first: each step's rate is what is left by the weights that are left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    cap = F.lit(most) * F.col("source_size")
    rows = sources.withColumn("w", w).withColumn("cap", cap)
    by_rate = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    after = by_rate.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    rate = (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("rate", rate).withColumn("capped", F.col("cap") <= F.col("w") * F.col("rate"))
    # the first that is not capped gives the rate of all that are not
    common = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("w"), F.col("rate")))).over(Window.partitionBy())
    free = F.col("w") * F.coalesce(common.getField("rate"), F.lit(0.0))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Each row's doc_id, source, size, source_size, target and taken (words, repeats counted).

    Null texts and texts of white space have size 0 and take 0; very long texts
    count whole. Repeated rows follow one another in portions, so reruns agree;
    null ids are ids of no text. An empty table gives an empty result, and
    columns other than doc_id, source and text are not looked at.
    """
    sized = spread(docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))).select("doc_id", "source", words().alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    sized = sized.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("times"))
    sized = sized.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {PORTION}"))))
    sized = sized.withColumn("times", F.least(F.col("times") - F.col("portion") * PORTION, F.lit(PORTION)))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("portion").cast("string"), F.lit(seed)))
    sized = durable(sized.select("doc_id", "source", "size", "times", key.alias("key")), "mix-sizes")
    ranges = max(1, sized.count() // RANGE_ROWS)
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("range", F.shiftright(spot * F.lit(ranges), 32))
    sums = sized.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("times")).alias("range_size")).withColumn("block", F.expr(f"range div {BLOCK}"))
    sums = durable(sums, "mix-ranges")
    blocks = sums.groupBy("source", "block").agg(F.sum("range_size").alias("block_size"))
    plan = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)
    plan = plan.withColumn("budget", F.floor(F.col("target")).cast("long"))
    until = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1])
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), (F.sum("block_size").over(until("source", "block")) - F.col("block_size")).alias("b_begin"))
    starts = sums.withColumn("begin", F.sum("range_size").over(until("source", "block", "range")) - F.col("range_size"))
    starts = starts.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    starts = starts.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    starts = durable(starts.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("begin") + F.col("b_begin")).alias("begin"), "source_size", "target", "budget"), "mix-starts")
    rows = sized.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.col("begin") + F.sum(F.col("size") * F.col("times")).over(inside) - F.col("size") * F.col("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "epochs", part.cast("long").alias("part"))


def mixture(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 1), words; a row each time a document is taken, whole or in part."""
    rows = mix(docs, **options).where("taken > 0")
    epoch = F.explode(F.sequence(F.lit(1), (F.col("epochs") + (F.col("part") > 0).cast("int")).cast("int"))).alias("epoch")
    rows = rows.select("doc_id", "source", "size", "epochs", "part", epoch)
    return rows.select("doc_id", "source", F.col("epoch"), F.when(F.col("epoch") <= F.col("epochs"), F.col("size")).otherwise(F.col("part")).alias("words"))


ORACLE = r"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) - 1 AS copy FROM n),
s AS (SELECT doc_id, source, size, copy, md5(coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || (copy // 1024)::VARCHAR || ':mix') AS k FROM c),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM t),
r AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
f AS (SELECT arg_min(rate, cap / w) FILTER (cap > w * rate) AS common FROM r),
g AS (SELECT source, source_size, CASE WHEN cap <= w * rate THEN cap ELSE w * coalesce(common, 0.0) END AS target FROM r, f),
p AS (SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
  (sum(size) OVER (PARTITION BY s.source ORDER BY k, size, doc_id, copy ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken FROM e
"""
