"""Migration of a stored table to a new epoch, step by step.

A pointer names the folder that readers open. Each step that is done is
published beside it, so a driver that comes back goes on with the next one, and
readers keep the old epoch until the pointer flips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitTable, Published


class MigrationError(ValueError):
    """A step that cannot be done."""


STEPS = ("QuiesceWrites", "DrainScheduler", "RewriteEpoch", "VerifyChecksums", "FlipPointer")


def rows_digest(rows: DataFrame) -> tuple:
    """An order-free digest of rows (key, value)."""
    row = F.xxhash64("key", F.coalesce("value", F.lit("")), F.col("value").isNull())
    return tuple(rows.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first())


class Migration(Published):
    """Rewrites what a table shows into ``target``; ``rewrite`` changes its rows (key, value) to the new format."""

    def __init__(self, spark: SparkSession, folder: str, source: str, target: str, rewrite: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        super().__init__(spark, folder)
        self.source, self.target, self.rewrite = CommitTable(spark, source), CommitTable(spark, target), rewrite

    def done(self) -> list[str]:
        entries = self.manifest()
        return entries[-1]["done"] if entries else []

    def current(self) -> CommitTable:
        """The table that readers open."""
        return self.target if "FlipPointer" in self.done() else self.source

    def admits_writes(self) -> bool:
        return not self.done() or "FlipPointer" in self.done()

    def step(self, unfinished: int = 0) -> str | None:
        """Does the next step and names it; None once all are done. ``unfinished``: requests that the scheduler still holds."""
        done = self.done()
        if len(done) == len(STEPS):
            return None
        now = STEPS[len(done)]
        if now == "DrainScheduler" and unfinished:
            raise MigrationError(f"{unfinished} requests are not finished")
        if now == "RewriteEpoch" and not self.target.manifest():  # a rewrite that was cut short after its commit is there already
            rows = self.rewrite(self.source.read().select("key", "value"))
            self.target.append(rows.select(F.lit(0).alias("pos"), "key", F.lit("set").alias("op"), "value"), self.source.version())
        if now == "VerifyChecksums" and rows_digest(self.target.read()) != rows_digest(self.rewrite(self.source.read().select("key", "value"))):
            raise MigrationError("the new epoch holds other rows")
        self._publish([{"version": len(done) + 1, "done": [*done, now]}])
        return now

    def run(self, unfinished: int = 0) -> None:
        while self.step(unfinished):
            pass

    def rollback(self) -> None:
        """Back to the old epoch; refused once the new one has writes of its own."""
        if self.target.manifest() and self.target.version() > self.source.version():
            raise MigrationError("the new epoch has writes that the old one lacks")
        written = [entry["path"] for entry in self.target.manifest()]
        self._publish([{"version": 0, "done": []}])
        for name in (f"{self.target.folder}/_manifests", *written):
            path, files = self._files(name)
            files.delete(path, True)
