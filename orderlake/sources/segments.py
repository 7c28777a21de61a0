"""A stored inverted index: a segment a commit, postings dealt to buckets by term.

A search opens only the buckets of its terms, checks their digests against the
manifest, and joins the members that show at its pin. Postings are dealt by range
of (bucket, term, shard, key), so the postings of a frequent term are many tasks'
and many files'; inside a file terms are sorted, so row groups are skipped.

Deletions and new versions hide older ones through the members; a member without
any token is still a member. ``compact`` leaves one segment; pins before it are
refused from then on.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_WORD, REPLICA_WORD, TOKENIZERS, fold_words, regex
from ..operators import index
from ..operators.index import IndexRefusal, Scorer
from ..operators.mvcc import latest
from .commits import Published

POSTINGS = "field string, term string, shard int, key string, version long, tf long, positions array<int>, length long, filter_flags long, search_flags long"
MEMBERS = "shard int, key string, version long, deleted boolean, filter_flags long, search_flags long"
BY = ["shard", "key", "version"]


def query_terms(text: str, tokenizer: str) -> list[str]:
    """The distinct terms of a query's text, by the tokenizer of the index."""
    if tokenizer == "unicode-word":
        return sorted(set(fold_words(text)))
    pattern = {"ascii-word": ASCII_WORD, "replica": REPLICA_WORD}[tokenizer]
    return sorted({w.lower() for w in regex.findall(pattern, text)})


class SegmentIndex(Published):
    """Segments in ``folder`` over the given fields; ``budget`` bounds the bytes of all postings."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], tokenizer: str = "ascii-word", flags: int = 0, buckets: int = 64, budget: int | None = None) -> None:
        super().__init__(spark, folder)
        if tokenizer not in TOKENIZERS:
            raise IndexRefusal(f"no such tokenizer: {tokenizer}")
        self.fields, self.tokenizer, self.flags, self.buckets, self.budget = sorted(set(fields)), tokenizer, flags, buckets, budget

    # -- writes
    def commit(self, version: int, puts: DataFrame, deletes: DataFrame | None = None) -> dict:
        """Adds a segment of the puts (shard, key, field, text, filter_flags, search_flags) and the deletes (shard, key).

        A key that is put and deleted in one commit is put. Fields that the index
        doesn't know fail the commit, as do postings beyond the budget; nothing of
        a failed commit shows.
        """
        entries = self.manifest()
        if entries and version <= entries[-1]["version"]:
            raise IndexRefusal(f"version {version} does not follow {entries[-1]['version']}")
        known = F.col("field").isin(self.fields)
        rows = puts.withColumn("version", F.lit(version).cast("long")).withColumn("field", F.when(known, F.col("field")).otherwise(F.raise_error(F.lit("the index has no such field"))))
        members = rows.groupBy(*BY).agg(F.lit(False).alias("deleted"), F.max("filter_flags").alias("filter_flags"), F.max("search_flags").alias("search_flags"))
        if deletes is not None:
            gone = deletes.select("shard", "key").distinct().join(puts.select("shard", "key"), ["shard", "key"], "left_anti")
            zero = F.lit(0).cast("long")
            members = members.unionByName(gone.select("shard", "key", F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted"), zero.alias("filter_flags"), zero.alias("search_flags")))
        entry = self._segment(f"v{version:020d}", version, index.postings(rows, self.tokenizer), members)
        self._publish([*entries, entry])
        return entry

    def _segment(self, name: str, version: int, postings: DataFrame, members: DataFrame) -> dict:
        dealt = postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int"))
        order = ["bucket", "term", "shard", "key"]
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(self._at("postings", name))
        members.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key").write.mode("overwrite").parquet(self._at("members", name))
        entry = {"segment": name, "version": version, "digests": {}, "bytes": 0}
        written = self._read("postings", [entry], f"{POSTINGS}, segment string, bucket int")
        for row in self._digests(written).collect():  # a row a bucket
            entry["digests"][str(row["bucket"])] = row["digest"]
            entry["bytes"] += row["bytes"]
        total = entry["bytes"] + self.bytes()
        if self.budget is not None and not name.startswith("c") and total > self.budget:
            self._drop(name)
            raise IndexRefusal(f"postings of {total} bytes are over the budget of {self.budget}")
        return entry

    def _at(self, kind: str, name: str) -> str:
        return f"{self.folder}/{kind}/segment={name}"

    def _drop(self, name: str) -> None:
        for kind in ("postings", "members"):
            path, files = self._files(self._at(kind, name))
            files.delete(path, True)

    def compact(self) -> None:
        """One segment of what shows now; older pins can no longer be read."""
        entries = self.manifest()
        if not entries:
            return
        now = entries[-1]["version"]
        shown = self.visible(now)
        rows = self._postings(entries, None).join(shown.select(*BY), BY, "left_semi").drop("segment", "bucket")
        entry = self._segment(f"c{now:020d}", now, rows, shown.withColumn("deleted", F.lit(False))) | {"oldest": now}
        self._publish([entry])
        for m in entries:
            if m["segment"] != entry["segment"]:
                self._drop(m["segment"])

    # -- reads
    def _read(self, kind: str, entries: list[dict], schema: str) -> DataFrame:
        paths = [self._at(kind, m["segment"]) for m in entries]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _postings(self, entries: list[dict], buckets: list[int] | None) -> DataFrame:
        """Postings of the segments; only the directories of the buckets are opened."""
        # segments without a posting have no files
        rows = self._read("postings", [m for m in entries if m["digests"]], f"{POSTINGS}, segment string, bucket int")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    @staticmethod
    def _digests(rows: DataFrame) -> DataFrame:
        """segment, bucket, digest, bytes: order-free digests, equal for equal postings."""
        row = F.xxhash64("field", "term", "shard", "key", "version", "tf", "positions", "length", "filter_flags", "search_flags")
        size = F.octet_length("term") + 8 * F.size("positions") + 24
        out = rows.groupBy("segment", "bucket").agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.sum(size).cast("long").alias("bytes"))
        return out.select("segment", "bucket", F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).alias("digest"), "bytes")

    def bytes(self) -> int:
        return sum(m["bytes"] for m in self.manifest())

    def _pinned(self, pin: int | None) -> tuple[list[dict], int]:
        entries = self.manifest()
        now = entries[-1]["version"] if entries else 0
        pin = now if pin is None else pin
        oldest = entries[0].get("oldest", 0) if entries else 0
        if pin < oldest or pin > now:
            raise IndexRefusal("the pin is outside the retained versions")
        return [m for m in entries if m["version"] <= pin], pin

    def visible(self, pin: int | None = None) -> DataFrame:
        """shard, key, version, filter_flags, search_flags of the members that show at the pin."""
        entries, pin = self._pinned(pin)
        rows = self._read("members", entries, MEMBERS)
        value = F.when(~F.col("deleted"), F.struct("filter_flags", "search_flags")).alias("value")
        return latest(rows.select(*BY, value), pin).select(*BY, "value.*")

    def verify(self, pin: int | None = None, terms: list[str] | None = None) -> None:
        """Fails unless the stored postings (of the terms' buckets) are those that the manifest names."""
        entries, _ = self._pinned(pin)
        entries = [m for m in entries if m["digests"]]
        buckets = None if terms is None else self._buckets(terms)
        found = {(r["segment"], str(r["bucket"])): r["digest"] for r in self._digests(self._postings(entries, buckets)).collect()}  # segments times buckets
        for m in entries:
            for bucket, digest in m["digests"].items():
                if (buckets is None or int(bucket) in buckets) and found.get((m["segment"], bucket)) != digest:
                    raise IndexRefusal(f"segment {m['segment']} is not what was committed")

    def _buckets(self, terms: list[str]) -> list[int]:
        return sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})

    def postings(self, terms: list[str], pin: int | None = None) -> DataFrame:
        """The postings of terms that show at the pin."""
        entries, pin = self._pinned(pin)
        rows = self._postings(entries, self._buckets(terms)).where(F.col("term").isin(sorted(set(terms))))
        return rows.join(self.visible(pin).select(*BY), BY, "left_semi").drop("segment", "bucket")

    def document_frequency(self, field: str, term: str, pin: int | None = None) -> DataFrame:
        """n: members that hold the term at the pin."""
        return index.postings_for(self.postings([term], pin), field, term).agg(F.count("*").alias("n"))

    def search(
        self,
        query: str,
        mode: str = "any",
        pin: int | None = None,
        fields: list[str] | None = None,
        filter_flags: int = 0,
        search_flags: int = 0,
        scorer: Scorer = index.term_score,
        verify: bool = True,
    ) -> DataFrame:
        """shard, key, version, score, matches of a pinned search; a query without terms gives all members with the flags, score 0."""
        if mode not in ("any", "all"):
            raise IndexRefusal(f"no such mode: {mode}")
        asked = self.fields if fields is None else sorted(set(fields))
        if set(asked) - set(self.fields):
            raise IndexRefusal(f"unknown fields: {sorted(set(asked) - set(self.fields))}")
        if (filter_flags | search_flags) & ~self.flags:
            raise IndexRefusal("a flag that the index does not know")
        entries, pin = self._pinned(pin)
        terms = query_terms(query, self.tokenizer)
        ok = index.has_flags(F.col("filter_flags"), filter_flags) & index.has_flags(F.col("search_flags"), search_flags)
        shown = self.visible(pin)
        if not terms:
            empty = F.lit(None).cast("array<struct<field:string,term:string,tf:bigint,positions:array<int>>>")
            return shown.where(ok).select(*BY, F.lit(0).cast("long").alias("score"), empty.alias("matches"))
        if verify:
            self.verify(pin, terms)
        hit = self._postings(entries, self._buckets(terms)).where(F.col("term").isin(terms) & F.col("field").isin(asked) & ok)
        hit = hit.join(shown.select(*BY), BY, "left_semi")
        out = hit.groupBy(*BY).agg(
            F.sum(scorer(F.col("tf"), F.col("length"))).cast("long").alias("score"),
            F.count_distinct("term").alias("n"),
            F.sort_array(F.collect_list(F.struct("field", "term", "tf", "positions"))).alias("matches"),
        )
        return (out.where(F.col("n") == len(terms)) if mode == "all" else out).drop("n")
