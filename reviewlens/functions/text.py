"""Text cleaning as Column expressions. The order of the steps is the semantics."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace code points of Unicode-aware regular expressions, which
# Java's own \s does not cover.
WHITESPACE = r"\t\n\x0B\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# What counts as a tag, an entity and a web address.
TAG = r"<[^>]+>"
ENTITY = r"&[a-zA-Z]+;|&#\d+;"
WEB_ADDRESS = rf"https?://[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+"

# Characters the older word tokeniser turns into spaces.
LEGACY_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def strip_entities(text: Column) -> Column:
    return F.regexp_replace(text, ENTITY, " ")


def strip_web_addresses(text: Column) -> Column:
    return F.regexp_replace(text, WEB_ADDRESS, "")


def blank_symbols(text: Column) -> Column:
    """Everything but a-z, 0-9 and whitespace becomes a space; expects lowercase."""
    return F.regexp_replace(text, f"[^a-z0-9{WHITESPACE}]", " ")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITESPACE}]+", " ")


def clean(text: Column) -> Column:
    """The whole cleaning chain; null and blank give the empty string.

    Symbols and whitespace runs are handled by one pattern, since both end as one space.
    """
    return F.trim(F.regexp_replace(F.lower(without_markup(text)), "[^a-z0-9]+", " "))


def without_markup(text: Column) -> Column:
    """Tags, entities and web addresses stripped in turn.

    A pattern is tried only where the raw text holds characters that each of its matches has. What is stripped
    before leaves a space, so no match of a later pattern arises that way.
    """
    raw = null_to_empty(text)
    tags = F.when(raw.contains("<"), strip_tags(raw)).otherwise(raw)
    entities = F.when(raw.contains("&"), strip_entities(tags)).otherwise(tags)
    return F.when(raw.contains("http") | raw.contains("www."), strip_web_addresses(entities)).otherwise(entities)


def clean_steps(text: Column) -> dict[str, Column]:
    """Each step of the chain on top of the one before."""
    tags = strip_tags(null_to_empty(text))
    entities = strip_entities(tags)
    addresses = strip_web_addresses(entities)
    lowered = F.lower(addresses)
    symbols = blank_symbols(lowered)
    collapsed = collapse_whitespace(symbols)
    return {
        "no_tags": tags,
        "no_entities": entities,
        "no_urls": addresses,
        "lowered": lowered,
        "no_symbols": symbols,
        "collapsed": collapsed,
        "cleaned": F.trim(collapsed),
    }


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def legacy_normalise(text: Column) -> Column:
    """Lowercase and strip only, as the older script did before scoring."""
    return strip_whitespace(F.lower(text))


def is_not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{WHITESPACE}]"), F.lit(False))


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def has_residual_markup(cleaned: Column) -> Column:
    return cleaned.contains("<br") | cleaned.contains("</") | cleaned.contains("&amp;")


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without combining marks is one other character or none (two
    strings as ``translate`` takes them), and those where it is several. Hangul follows a rule of its own."""
    changed, gone, several = {}, [], {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if "\ud800" <= c <= "\udfff" or HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            changed[c] = plain
        else:
            several[c] = plain
    # What has no partner in the second string is left out.
    return "".join(changed) + "".join(gone), "".join(changed.values()), several


# The syllables, and the first of each of their three kinds of parts.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
HANGUL_PARTS = (0x1100, 0x1161, 0x11A7)
NO_ACCENTS = "^[\\x00-\\x7f]*$"


def code_point(value: Column) -> Column:
    """The character of a code point below 65 536."""
    return F.decode(F.unhex(F.lpad(F.hex(value), 4, "0")), "UTF-16BE")


def hangul_parts(c: Column) -> Column:
    n = F.ascii(c) - F.lit(HANGUL_FIRST)
    lead, vowel, tail = n / F.lit(588), (n % 588) / F.lit(28), n % 28
    first, second, third = (code_point(F.floor(x).cast("long") + F.lit(base)) for x, base in zip((lead, vowel, tail), HANGUL_PARTS))
    return F.concat(first, second, F.when(tail > 0, third).otherwise(""))


def without_accents(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks, as one expression.

    Dropping all marks makes their order irrelevant, so the text's decomposition is that of its characters, one
    after the other. Characters that become one other or none are translated; only texts with others, such as
    ligatures and Hangul syllables, are taken apart.
    """
    matching, replacing, several = decompositions()
    syllable = f"[{chr(HANGUL_FIRST)}-{chr(HANGUL_LAST)}]"
    # The class is built of ranges of neighbours, since there are over a thousand such characters.
    odd = "[" + "".join(f"{a}-{b}" for a, b in code_ranges(sorted(several))) + "]"
    table = F.from_json(F.lit(json.dumps(several)), "map<string, string>")
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(syllable), hangul_parts(c)).when(
        c.rlike(odd), F.element_at(table, c)).otherwise(c)), "")
    whole = F.when(text.rlike(f"{syllable}|{odd}"), apart).otherwise(text)
    return F.when(text.rlike(NO_ACCENTS), text).otherwise(F.translate(whole, matching, replacing))


def code_ranges(chars: list[str]) -> list[tuple[str, str]]:
    """First and last of each run of neighbouring code points."""
    found: list[tuple[str, str]] = []
    for c in chars:
        if found and ord(found[-1][1]) == ord(c) - 1:
            found[-1] = (found[-1][0], c)
        else:
            found.append((c, c))
    return found
