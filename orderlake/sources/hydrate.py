"""Hydration of a snapshot: pages come in rounds, are checked, and show all at once.

Verified pages of a round are one Parquet folder, which is the journal: a round
that was cut short is overwritten, and the next asks only for pages that no round
holds. Nothing shows before every page of the snapshot is verified and published;
diffs after the snapshot's version are then applied on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cdc import left_to_transfer
from .commits import CommitError, Published

PAGES = "page long, key string, value string, crc long"


def page_crc(rows: DataFrame) -> DataFrame:
    """page, crc of pages (page, key, value): an order-free checksum of their rows."""
    row = F.crc32(F.concat_ws("\x1f", "key", F.coalesce("value", F.lit("\x1e"))).cast("binary"))
    return rows.groupBy("page").agg(F.sum(row).cast("long").alias("crc"))


class Hydration(Published):
    """A snapshot (page, key, value) of one version on its way into ``folder``."""

    def journal(self) -> DataFrame:
        """page, key, value, crc of the verified pages so far."""
        path, files = self._files(f"{self.folder}/rounds")
        rounds = [s.getPath().toString() for s in files.listStatus(path)] if files.exists(path) else []
        return self.spark.read.schema(PAGES).parquet(*sorted(rounds)) if rounds else self.spark.createDataFrame([], PAGES)

    def left(self, plan: DataFrame) -> DataFrame:
        """Pages of the plan (page, crc) that are still to come."""
        return left_to_transfer(plan, self.journal().select("page", "crc").distinct())

    def receive(self, rows: DataFrame, plan: DataFrame, round_: int) -> int:
        """Keeps the pages that fit their checksum and aren't there yet; how many pages are left."""
        asked = self.left(plan).select("page", "crc")
        whole = page_crc(rows).join(asked, ["page", "crc"], "left_semi")
        rows.join(whole, "page").select("page", "key", "value", "crc").write.mode("overwrite").parquet(f"{self.folder}/rounds/{round_:06d}")
        return self.left(plan).count()

    def publish(self, plan: DataFrame, version: int) -> None:
        if not self.left(plan).isEmpty():
            raise CommitError("pages of the snapshot are missing")
        self._publish([{"version": version}])

    def read(self, diffs: DataFrame | None = None) -> DataFrame:
        """key, value of the published snapshot, and of diffs (key, version, op set or delete, value) after it."""
        entries = self.manifest()
        if not entries:
            raise CommitError("the snapshot is not hydrated")
        base = entries[-1]["version"]
        rows = self.journal().select("key", F.lit(base).cast("long").alias("version"), F.lit("set").alias("op"), "value")
        if diffs is not None:
            rows = rows.unionByName(diffs.where(F.col("version") > base).select("key", "version", "op", "value"))
        won = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "version").alias("w"))
        return won.where("w.op = 'set'").select("key", F.col("w.value").alias("value"))
