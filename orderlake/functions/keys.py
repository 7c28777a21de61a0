"""Ordered keys: prefix bounds, and an encoding of typed parts whose bytes sort as the parts do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_bound(prefix: str) -> str | None:
    """The least text above all that begin with ``prefix``; None if there is none."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code <= 0x10FFFF:
            return prefix[:at] + chr(code)
    return None


def in_prefix(key: Column, prefix: str) -> Column:
    """Keys that begin with ``prefix``, as a range that Parquet statistics prune, too."""
    top = upper_bound(prefix)
    return (key >= prefix) & (key < top) & key.startswith(prefix) if top else key.startswith(prefix)


def after(key: str) -> str:
    """The least key above ``key``."""
    return key + "\0"


#: Fixed values of the key format: markers, tags of the part kinds.
ROW_MARK, TEXT, RAW, UNSIGNED, SIGNED, FLAG = "01", "10", "11", "20", "21", "30"


def _escaped(value: Column) -> Column:
    # hex digits in pairs: a zero byte becomes 00FF, and 0000 ends the part
    pairs = F.regexp_replace(F.regexp_replace(F.hex(value), "(..)", "$1 "), "00 ", "00 FF ")
    return F.concat(F.regexp_replace(pairs, " ", ""), F.lit("0000"))


def encode_key(name: str, *parts: tuple[str, Column]) -> Column:
    """Binary key of a table name and (kind, column) parts; kinds: text, bytes, u64, i64, bool."""
    out = [F.lit(ROW_MARK), F.hex(F.lit(name).cast("binary")), F.lit("00")]
    for kind, column in parts:
        if kind in ("text", "bytes"):
            out += [F.lit(TEXT if kind == "text" else RAW), _escaped(column.cast("binary"))]
        elif kind == "u64":
            out += [F.lit(UNSIGNED), F.lpad(F.hex(column.cast("long")), 16, "0")]
        elif kind == "i64":
            out += [F.lit(SIGNED), F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")]
        elif kind == "bool":
            out += [F.lit(FLAG), F.when(column, "01").otherwise("00")]
        else:
            raise ValueError(f"no such kind of key part: {kind}")
    return F.unhex(F.concat(*out))


def table_bounds(name: str) -> tuple[bytes, bytes]:
    """Half-open byte range of all keys of a table."""
    low = bytes.fromhex(ROW_MARK) + name.encode() + b"\x00"
    return low, low[:-1] + b"\x01"
