r"""URL filters: host-suffix and path-prefix expressions, matched by short hashes first.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end. Each URL
is expanded into all suffixes of its host (cut at dots) times the prefixes of
its path that have the length of some rule's path. Expressions and rules meet
in an equi-join on the first 32 bits of SHA-256; the full digests then confirm.
Of the rules that fit, the longest (host and path together) wins, then the
longer host, then block before allow, then the smaller rule. URLs without a
rule get the default verdict. Null URLs and those without ``://`` have an empty
host and path and fit no rule. Repeated rules and URLs are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 1 << 18
A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), A_TO_Z, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url); rules: host, path, verdict."""
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), A_TO_Z, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    digest = _digest(F.col("host"), F.col("path"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        digest.alias("r_digest"),
        _short(digest).alias("short"),
        # the greatest fits best
        F.struct((F.length("host") + F.length("path")).alias("all"), F.length("host").alias("long"), F.col("verdict"), F.concat("host", "path").alias("rule")).alias("fit"),
        F.length("path").alias("size"),
    )
    rules = durable(rules, "url-rules")
    # as many as rules have different path lengths, which URLs' own length bounds
    n, sizes = rules.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    rules = F.broadcast(rules.drop("size")) if n <= BROADCAST_RULES else rules.drop("size")
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    # a host and path are judged once, however many pages have them
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(1 << 20)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s <= F.length("path")), lambda s: F.substring(F.col("path"), F.lit(1), s))
    kinds = rows.where("host <> ''").select("host", "path").distinct()
    each = kinds.select("host", "path", F.explode(hosts).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    each = each.select("host", "path", _digest(F.col("h"), F.col("p")).alias("digest")).withColumn("short", _short(F.col("digest")))
    hits = each.join(rules, "short").where("digest = r_digest")
    best = hits.groupBy("host", "path").agg(F.max("fit").alias("fit")).select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "fit")
    # rows without a host fit nothing: dealt by their id, not all by one empty host
    deal = F.when(F.col("host") == "", F.xxhash64("page_id")).otherwise(F.lit(0).cast("long"))
    best = best.withColumn("b_deal", F.lit(0).cast("long"))
    out = rows.withColumn("deal", deal).join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")) & (F.col("deal") == F.col("b_deal")), "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(v, len(rh || rp)) AS v
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f
"""
