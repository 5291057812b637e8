"""Words and shingles as array columns, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """The lower-cased words (runs of letters and digits) of a text; null or wordless: empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of plain_words()."""
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def shingle_at(hashes: str | Column, i: Column, width: int) -> Column:
    """The hash of the ``width`` words from index i (from 0); hashes must be a plain column."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes
    return F.xxhash64(*(F.get(h, i + k) for k in range(width)))


def shingles(hashes: str | Column, width: int) -> Column:
    """All shingles in order; none where there are fewer words."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes
    some = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: shingle_at(h, i, width))
    return F.when(F.size(h) >= width, some).otherwise(F.array().cast("array<bigint>"))
