"""A table of commits: versioned Parquet files, a manifest, followers, mirrors and metrics.

One writer appends; a commit's files are complete before the manifest names
them, so readers see whole commits only. Each commit is sorted by key, and its
key range is in the manifest, so reads of a range open only the files they need.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.mvcc import compact, latest
from .store import commit as batch_rows


class CommitError(ValueError):
    """A version that does not follow the last one."""


class Published:
    """A folder whose state is the newest of its numbered manifests."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> list[dict]:
        """An entry a commit since the last compaction, in order."""
        names = self._manifests()
        return json.loads(self.spark.read.text(f"{self.folder}/_manifests/{names[-1]}", wholetext=True).first()[0]) if names else []

    def _manifests(self) -> list[str]:
        """Names of the published manifests, oldest first; each is complete, as it is renamed into place."""
        path, files = self._files(f"{self.folder}/_manifests")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _publish(self, entries: list[dict]) -> None:
        """Adds a manifest of the next number; the one before stays, so there is always one to read."""
        names = self._manifests()
        fresh, now = f"{self.folder}/_next-{uuid.uuid4().hex}", f"{self.folder}/_manifests/{int(names[-1]) + 1 if names else 0:020d}"
        self.spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(fresh)
        a, files = self._files(fresh)
        b, _ = self._files(now)
        files.mkdirs(b.getParent())
        if files.exists(b) or not files.rename(a, b):
            raise CommitError("another writer has published this commit")
        for name in names[:-1]:
            files.delete(self._files(f"{self.folder}/_manifests/{name}")[0], True)

    def version(self) -> int:
        return max((m["version"] for m in self.manifest()), default=0)


class CommitTable(Published):
    """Rows (shard, key, version, value) of commits in ``folder``."""

    # -- writes
    def append(self, ops: DataFrame, version: int, shard: int = 0) -> dict:
        """Commits a batch (pos, key, op, value); versions must grow."""
        entries = self.manifest()
        if entries and version <= entries[-1]["version"]:
            raise CommitError(f"version {version} does not follow {entries[-1]['version']}")
        entry = self._write(batch_rows(ops, version).withColumn("shard", F.lit(shard)), f"v{version:020d}", version)
        self._publish([*entries, entry])
        return entry

    def _write(self, rows: DataFrame, name: str, version: int) -> dict:
        path = f"{self.folder}/{name}"
        rows.select("shard", "key", "version", "value").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        n, low, high = self.spark.read.parquet(path).agg(F.count("*"), F.min("key"), F.max("key")).first()
        return {"version": version, "path": path, "rows": n, "min_key": low, "max_key": high}

    # -- reads
    def log(self, lower: str | None = None, upper: str | None = None, pin: int | None = None) -> DataFrame:
        """Log rows of the commits whose keys may lie in the range."""
        own = [m["path"] for m in self.manifest() if m["rows"] and (lower is None or m["max_key"] >= lower) and (upper is None or m["min_key"] <= upper) and (pin is None or m["version"] <= pin or m.get("compacted"))]
        schema = "shard int, key string, version long, value string"
        rows = self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)
        rows = rows if lower is None else rows.where(F.col("key") >= lower)
        return rows if upper is None else rows.where(F.col("key") <= upper)

    def read(self, pin: int | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
        return latest(self.log(lower, upper, pin), pin)

    def checked(self, pin: int | None = None) -> int:
        """The pin (default: the newest version), if the table can still answer it."""
        entries = self.manifest()
        now = entries[-1]["version"] if entries else 0
        oldest = max((m["version"] for m in entries if m.get("compacted")), default=0)
        if pin is not None and not oldest <= pin <= now:
            raise CommitError(f"version {pin} is not retained: {oldest} to {now} are")
        return now if pin is None else pin

    def compact(self, pin: int | None = None) -> None:
        """Rewrites all commits up to ``pin`` (default: all) as one; older pins can no longer be read."""
        pin = self.version() if pin is None else pin
        entries = self.manifest()
        old = [m for m in entries if m["version"] <= pin]
        rows = compact(self.log(pin=pin).where(F.col("version") <= pin), pin)
        entry = self._write(rows, f"c{pin:020d}", pin) | {"compacted": True}
        self._publish([entry, *[m for m in entries if m["version"] > pin]])
        for m in old:
            path, files = self._files(m["path"])
            if m["path"] != entry["path"]:
                files.delete(path, True)


class Follower:
    """A read-only view that moves to newer commits when asked."""

    def __init__(self, table: CommitTable) -> None:
        self.table, self.pin = table, table.version()

    def refresh(self) -> bool:
        now = self.table.version()
        moved, self.pin = now != self.pin, now
        return moved

    def read(self) -> DataFrame:
        return self.table.read(self.pin)


class Mirror(Follower):
    """A follower whose rows are kept in memory until a newer commit is there; ``warm`` fills it at once."""

    def __init__(self, table: CommitTable, warm: bool = False) -> None:
        super().__init__(table)
        self.rows = super().read().persist()
        if warm:
            self.rows.count()

    def stale(self) -> bool:
        return self.table.version() != self.pin

    def read(self) -> DataFrame:
        if self.refresh():
            self.rows.unpersist()
            self.rows = super().read().persist()
        return self.rows


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows that count themselves as they are read: rows and bytes of keys and values."""
    seen = Observation(name)
    size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    return rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen
