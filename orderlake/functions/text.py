"""Tokenizers: ASCII words, replica words, Unicode words with case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default budget of a field.
MAX_TOKENS, MAX_TOKEN_BYTES = 256, 64
ASCII_WORD, REPLICA_WORD = "[A-Za-z0-9_]+", "[A-Za-z0-9]+"
_UNICODE_WORD = regex.compile(r"[\p{L}\p{N}\p{Pc}][\p{L}\p{M}\p{N}\p{Pc}]*")


def ascii_words(text: Column) -> Column:
    """Runs of letters, digits and underscore, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)), F.lower)


def replica_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(REPLICA_WORD), F.lit(0)), F.lower)


def fold_words(text: str | None) -> list[str]:
    """NFC words that begin with a letter, number or connector; marks follow; fully case-folded."""
    if text is None:
        return []
    return [w.casefold() for w in _UNICODE_WORD.findall(unicodedata.normalize("NFC", text))]


def unicode_words(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def words(column: pd.Series) -> pd.Series:
        return column.map(fold_words)

    return words(text)


TOKENIZERS = {"ascii-word": ascii_words, "replica": replica_words, "unicode-word": unicode_words}


def tokenize(text: Column, tokenizer: str = "ascii-word") -> Column:
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"no such tokenizer: {tokenizer}")
    return TOKENIZERS[tokenizer](text)


def within_budget(tokens: Column, most: int = MAX_TOKENS, most_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """Whether a field's tokens are few and short enough; strict readers refuse the others, none are cut."""
    return (F.size(tokens) <= most) & F.forall(tokens, lambda t: F.octet_length(t) <= most_bytes)


def checked(tokens: Column, most: int = MAX_TOKENS, most_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """The tokens; reading them fails where they exceed the budget."""
    return F.when(within_budget(tokens, most, most_bytes), tokens).otherwise(F.raise_error(F.lit("a field exceeds its token budget")).cast("array<string>"))
