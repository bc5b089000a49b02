"""Tokens and adjacent pairs of a text column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of non-blank characters, blanks in the Unicode sense
# and the four ASCII separators.
TOKEN_PATTERN = r"(?U)[^\s\x1C-\x1F]+"


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased tokens in text order, punctuation kept, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stops = sorted(set(stop_words))
    if not stops:
        return found
    return F.filter(found, lambda word: ~word.isin(stops))


def adjacent_pairs(words: Column) -> Column:
    """``[a, b, c]`` becomes ``[{a, b}, {b, c}]``; fewer than two words give an empty array."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(words, F.lit(1), pairs).alias("source"),
        F.slice(words, F.lit(2), pairs).alias("target"),
    )
