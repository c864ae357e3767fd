"""Accent folding, words, term tests and scores, all as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that decompose into a base letter and marks, and that letter."""
    source, target = [], []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and base[0].isalpha() and letter == letter.lower():
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


_FROM, _TO = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents; a sharp s becomes ss; separate combining marks go."""
    plain = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _FROM, _TO)
    return F.regexp_replace(plain, r"\p{M}+", "")


def words(text: Column) -> Column:
    """The folded words of a text: runs of letters, digits and underscores."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def query_words(text: str) -> list[str]:
    """The same for one query, on the driver, by the same table of letters."""
    plain = text.lower().replace("ß", "ss").translate(str.maketrans(_FROM, _TO))
    return re.findall(r"\w+", "".join(c for c in plain if not unicodedata.category(c).startswith("M")))


def matches(tokens: Column, terms: list[str], last_is_prefix: bool = True) -> Column:
    """All terms occur among the tokens; the last may be a prefix. No terms match nothing."""
    if not terms:
        return F.lit(False)
    *whole, last = terms
    test = F.exists(tokens, lambda w: w.startswith(last)) if last_is_prefix else F.array_contains(tokens, last)
    for term in whole:
        test = test & F.array_contains(tokens, term)
    return test


def ends_in_word(text: str) -> bool:
    """Whether the last term of a query is still being typed."""
    return bool(text) and (text[-1].isalnum() or text[-1] == "_")


def lexical_score(tokens: Column, terms: list[str]) -> Column:
    return F.lit(float(len(set(terms)))) / F.size(tokens)


def scope_tokens(camera: Column, captured: Column) -> Column:
    """One token each for a file's camera, day, month and year."""
    part = lambda letter, n: F.concat(F.lit(letter), F.substring(captured, 1, n))
    return F.concat_ws(" ", F.concat(F.lit("c"), F.sha2(camera, 256)), part("d", 8), part("m", 6), part("y", 4))
