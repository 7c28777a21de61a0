"""A facade over one key-value table: points, scans, filters, prefixes; and read-only views of a stored table at a pin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.keys import upper_bound
from .operators import scan
from .plans.filter import where_json
from .sources.commits import CommitTable


class Engine:
    """Operators over rows (key, value); values are texts, JSON where a query looks into them."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def get(self, key: str) -> DataFrame:
        return scan.get(self.rows, key)

    def get_many(self, keys: list[str]) -> DataFrame:
        return scan.get_many(self.rows, keys)

    def has(self, key: str) -> bool:
        return not scan.get(self.rows, key).isEmpty()

    def gets(self, limit: int | None = None, direction: str = "next", cursor: tuple[str | None, str | None] = (None, None), query: str | None = None) -> DataFrame:
        """A scan, with a query of the rows that match it.

        Bounds are included, but with a query the start is not: a page's last
        key is the next page's start. The limit counts matches.
        """
        start, end = cursor
        if query is None:
            return scan.scan_range(self.rows, start, end, limit, direction)
        rows = scan.scan_range(self.rows, start, end, None, direction)
        hit = where_json(rows if start is None else rows.where(F.col("key") != start), query)
        hit = hit.orderBy(F.asc("key") if direction == "next" else F.desc("key"))
        return hit if limit is None else hit.limit(limit)

    def prefix(self, prefix: str, after: str | None = None, limit: int = 100, values: bool = True) -> scan.Page:
        return scan.scan_prefix(self.rows, prefix, after, limit, values)

    def count_prefix(self, prefix: str, most: int) -> int:
        return scan.count_prefix(self.rows, prefix, most).first()["n"]

    def scoped(self, prefix: str) -> Engine:
        return Engine(scan.scoped(self.rows, prefix))


@dataclass(frozen=True)
class ViewPage:
    """``rows`` of a page, and the token that the next one starts from (None: this is the last)."""

    rows: DataFrame
    token: str | None


class View(Engine):
    """A stored table at a pinned version: later commits don't show, and each read opens only the files of its keys."""

    def __init__(self, table: CommitTable, pin: int | None = None) -> None:
        self.table = table
        self.pin = table.checked(pin)

    @property
    def rows(self) -> DataFrame:
        return self._between(None, None)

    def _between(self, lower: str | None, upper: str | None) -> DataFrame:
        return self.table.read(self.pin, lower, upper).select("key", "value")

    def get(self, key: str) -> DataFrame:
        return self._between(key, key)

    def has(self, key: str) -> bool:
        return not self.get(key).isEmpty()

    def get_many(self, keys: list[str]) -> DataFrame:
        rows = self._between(min(keys), max(keys)) if keys else self.rows
        return scan.get_many(rows, keys)

    def gets(self, limit: int | None = None, direction: str = "next", cursor: tuple[str | None, str | None] = (None, None), query: str | None = None) -> DataFrame:
        low, high = cursor if direction == "next" else cursor[::-1]
        return Engine(self._between(low, high)).gets(limit, direction, cursor, query)

    def page(self, most_rows: int, most_bytes: int, lower: str | None = None, upper: str | None = None, token: str | None = None, direction: str = "next") -> ViewPage:
        """The next page of an inclusive range, bounded by rows and bytes; a token of another pin or direction is refused."""
        if lower is not None and upper is not None and lower > upper:
            raise scan.ScanError("the range is inverted")
        at = scan.Cursor.read(token, self.pin, direction).position if token else None
        low, high = (lower if at is None else at, upper) if direction == "next" else (lower, upper if at is None else at)
        rows = self._between(low, high)
        rows = rows if at is None else rows.where(F.col("key") != at)
        held = scan.page_by_bytes(rows, most_rows, most_bytes, direction=direction)
        last = held.agg(F.max("key") if direction == "next" else F.min("key")).first()[0]
        if last is None:
            return ViewPage(rows.where(F.lit(False)), None)
        ahead = F.col("key") > last if direction == "next" else F.col("key") < last
        more = not rows.where(ahead).isEmpty()
        own = rows.where(~ahead).orderBy(F.asc("key") if direction == "next" else F.desc("key"))
        return ViewPage(own, scan.Cursor(self.pin, last, direction).token() if more else None)

    def scoped(self, prefix: str) -> Engine:
        if not prefix:
            return self
        return Engine(scan.scoped(self._between(f"{prefix}/", upper_bound(f"{prefix}/")), prefix))
