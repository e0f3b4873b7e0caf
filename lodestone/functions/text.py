"""Text functions as native column expressions: identifiers to terms, hashes, safety, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest term in bytes (fixed value).
LEAST_BYTES = 2
#: A segment with a letter or digit outside ASCII stays whole; others are cut at humps, digits and underscores.
_TERM = (
    r"(?<![\p{L}\p{N}_])[A-Za-z0-9_]*+[\p{L}\p{N}&&[^\x00-\x7f]][\p{L}\p{N}_]*+"
    r"|[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|_+"
)


def lower(c: Column) -> Column:
    """Per-character lower case: without Java's rules for a dotted I and a final sigma."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def tokens(text: Column) -> Column:
    """Terms of a text in order; null and empty text have none.

    One pattern over the whole text, one lower-casing of the joined terms (they
    hold no spaces), so nothing but the length filter runs per term.
    """
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TERM), F.lit(0))
    return F.filter(F.split(lower(F.array_join(parts, " ")), " "), lambda t: F.octet_length(t) >= LEAST_BYTES)


def query_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def is_cyrillic(term: Column) -> Column:
    return term.rlike("[\\u0400-\\u04FF]")


def truncate_runes(text: Column, n: int) -> Column:
    return F.substring(text, 1, n) if n > 0 else text


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def data_dir_name(path: Column) -> Column:
    """The folder of a project's data: the first 16 hex digits of its path's hash."""
    return F.substring(sha256_hex(path), 1, 16)


#: Characters that print or separate.
PRINTABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S}\t-\r \u0085   -     　]"


def embedding_safe(text: Column, least: float = 0.85) -> Column:
    """Text fit for embedding: no NUL, and at least 85 % printing characters; empty text is fit."""
    n = F.char_length(text)
    return (n == 0) | (~text.contains("\0") & (F.regexp_count(text, F.lit(PRINTABLE)) / n >= least))


def embedding_safe_bytes(data: Column, least: float = 0.85) -> Column:
    return F.is_valid_utf8(data) & embedding_safe(F.decode(data, "UTF-8"), least)


def split_comma(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
