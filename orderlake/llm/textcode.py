"""Vectorised text coding shared by the free-style operators.

One Arrow string column is treated as one byte buffer: tokens are found with
byte masks and hashed with a polynomial over random byte codes, so the cost is
a few nanoseconds a byte and no Python object is made per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.RandomState(20240229)
_BYTE_CODE = _RNG.randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE2 = _RNG.randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

#: Bytes of words for shingles: letters, digits and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
for _c in range(256):
    WORD_BYTES[_c] = _c >= 0x80 or chr(_c).isalnum()
#: Bytes of white-space separated tokens: all but 0x20 and 0x09 to 0x0D.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z only.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            for name, base in (("_POWERS", _BASE), ("_INVERSES", _BASE_INV)):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                globals()[name] = np.multiply.accumulate(out)


class Tokens(NamedTuple):
    """Tokens of a batch; ``first`` has a batch's first token per document, plus the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, codes: np.ndarray = _BYTE_CODE) -> np.ndarray:
        """A 64-bit hash per token."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        _grow(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(codes[self.data] * _POWERS[: len(self.data)], out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * _INVERSES[self.starts]
            return mix64(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, index: np.ndarray) -> list[bytes]:
        buffer = self.data.tobytes()
        return [buffer[s:e] for s, e in zip(self.starts[index].tolist(), self.ends[index].tolist())]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tokenize(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Tokens:
    """Maximal runs of ``member`` bytes within each document."""
    n = len(data)
    inside = member[data]
    begin = np.zeros(n + 1, bool)
    begin[:n] = inside
    begin[1:n] &= ~inside[: n - 1] if n > 1 else True
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin[:n])
    stop = np.zeros(n + 1, bool)
    stop[1 : n + 1] = inside
    stop[1:n] &= ~inside[1:n]
    edge = offsets[1:-1]
    edge = edge[edge > 0]
    stop[edge] = inside[edge - 1]
    ends = np.flatnonzero(stop)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Tokens(data, starts, ends, doc, first)


def words_of(column: pa.Array) -> Tokens:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    data, offsets = buffer_of(pc.utf8_lower(column.cast(pa.large_string())))
    return tokenize(data, offsets, WORD_BYTES)


def shingle_hashes(tokens: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles, in order, and the first per document, plus the end.

    A document of fewer words, but at least one, has one shingle of all its words.
    """
    h, count = tokens.hashes(), np.diff(tokens.first)
    n_docs = len(count)
    per_doc = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(per_doc, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) - np.repeat(first[:-1] - tokens.first[:-1], per_doc)
    left = np.minimum(np.repeat(count, per_doc), width)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + np.where(left > k, padded[at + k], np.uint64(k + 1)) if k >= 1 else padded[at].copy()
    return mix64(out), first
