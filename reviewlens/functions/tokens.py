"""Tokens and n-grams as array expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.text import LEGACY_PUNCTUATION, clean, null_to_empty, without_accents

# Fixed value: a word has at least two word characters.
WORD = r"(?U)\b\w\w+\b"


def word_tokens(cleaned: Column) -> Column:
    """Words of two or more characters of cleaned text."""
    return F.filter(F.split(cleaned, " "), lambda t: F.length(t) >= 2)


def raw_word_tokens(text: Column) -> Column:
    """The same for text that was not cleaned but is in lower case."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def all_tokens(cleaned: Column) -> Column:
    """Every word of cleaned text, one-letter words too."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def cleaned_words(text: Column) -> Column:
    """Every word of raw text that is cleaned first."""
    return all_tokens(clean(text))


def legacy_tokens(text: Column) -> Column:
    """Words of raw text with punctuation blanked; apostrophes stay."""
    blanked = F.translate(F.lower(null_to_empty(text)), LEGACY_PUNCTUATION, " " * len(LEGACY_PUNCTUATION))
    return F.filter(F.split(blanked, " "), lambda t: t != "")


@dataclass(frozen=True)
class WordPath:
    """How texts become words: prepared as a whole, then cut. A text that is prepared to nothing is empty."""

    name: str
    prepare: Callable[[Column], Column]
    cut: Callable[[Column], Column]


CLEANED = WordPath("cleaned", clean, word_tokens)
# Lower case and no accents, but markup and symbols stay until words are cut.
UNCLEANED = WordPath("uncleaned", lambda text: F.trim(without_accents(F.lower(null_to_empty(text)))), raw_word_tokens)
WORD_PATHS = {path.name: path for path in (CLEANED, UNCLEANED)}


def ngram_terms(tokens: Column, ngram_range: tuple[int, int]) -> Column:
    """All n-grams of the range, shorter ones first, words joined by one space.

    ``tokens`` has to be a column of its own: each n extends the (n-1)-grams by zipping
    them with the tokens n-1 further on, so no lambda evaluates the tokens again.
    """
    low, high = ngram_range
    grams = tokens
    groups = [tokens] if low <= 1 else []
    for n in range(2, high + 1):
        size = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), size),
            F.slice(tokens, F.lit(n), size),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        if n >= low:
            groups.append(grams)
    return groups[0] if len(groups) == 1 else F.concat(*groups)
