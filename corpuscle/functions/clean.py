"""Cleaning of text as column expressions: white space, quotes, ASCII, possessive its."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words for str.split: the white space of Unicode, and four separators of ASCII.
SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
SPACE_RE2 = SPACE.replace("\\u", "\\x{").replace("\\x{1680", "\\x{1680}").replace("\\x{2000", "\\x{2000}").replace("\\x{200a", "\\x{200a}").replace("\\x{2028", "\\x{2028}").replace("\\x{2029", "\\x{2029}").replace("\\x{202f", "\\x{202f}").replace("\\x{205f", "\\x{205f}").replace("\\x{3000", "\\x{3000}").replace("\\x85", "\\x{85}").replace("\\xa0", "\\x{a0}")
ASCII_SPACE = "[\\x09-\\x0d\\x1c-\\x20]+"
CURLY, STRAIGHT = "‘’“”", "''\"\""


@lru_cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition has one ASCII character, those characters, and those with several.

    The decomposition of a character doesn't depend on its neighbours once the rest is ASCII alone, so maps do for it.
    """
    one, to, many = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        ascii_ = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(ascii_) == 1 and code < 0x10000:
            one.append(chr(code))
            to.append(ascii_)
        elif ascii_:
            many[chr(code)] = ascii_
    return "".join(one), "".join(to), many


def squish(text: Column) -> Column:
    """Words separated by single spaces, without any at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, CURLY, STRAIGHT)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a plain nesting would repeat its expression wherever use has it."""
    return F.transform(F.array(value), use)[0]


def _narrowed(text: Column) -> Column:
    """Straight quotes, compatibility decomposition (NFKD), then ASCII alone."""
    one, to, many = decompositions()
    spellings = ("".join(many), F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02")))

    def spelled(t: Column) -> Column:
        # Of the few different characters that are left, those of several letters are replaced one by one.
        left = F.array_distinct(F.regexp_extract_all(t, F.lit("[^\\x00-\\x7F]"), F.lit(0)))
        some = F.filter(left, lambda c: F.translate(c, spellings[0], "") == "")
        return F.aggregate(some, t, lambda acc, c: F.replace(acc, c, F.element_at(spellings[1], c)))

    return F.regexp_replace(bound(F.translate(text, CURLY + one, STRAIGHT + to), spelled), "[^\\x00-\\x7F]", "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def to_ascii(text: Column) -> Column:
    """Compatibility decomposition (NFKD), then ASCII alone. Texts that are ASCII already pass as they are."""
    return F.when(is_ascii(text), text).otherwise(_narrowed(text))


def split_its(text: Column) -> Column:
    """its -> it s, whatever the case."""
    return F.regexp_replace(text, "(?i)\\b(it)(s)\\b", "$1 $2")


def clean(text: Column) -> Column:
    """All steps in order; white space is squished again, as decomposition can leave more. ASCII needs the first and last alone."""
    plain = F.trim(F.regexp_replace(text, ASCII_SPACE, " "))
    return split_its(F.when(is_ascii(text), plain).otherwise(squish(_narrowed(squish(text)))))


def clean_text(text: str) -> str:
    """clean() in Python, for texts that go through it anyway; tests hold the two against each other."""
    text = " ".join(text.split())
    if not text.isascii():
        for curly, straight in zip(CURLY, STRAIGHT):
            text = text.replace(curly, straight)
        text = " ".join(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().split())
    lower, parts, last = text.lower(), [], 0
    at = lower.find("its")
    while at >= 0:
        if not (_in_word(lower[at - 1 : at]) or _in_word(lower[at + 3 : at + 4])):
            parts.append(text[last : at + 2])
            last = at + 2
        at = lower.find("its", at + 3)
    return " ".join([*parts, text[last:]]) if parts else text


def _in_word(character: str) -> bool:
    return character.isalnum() or character == "_"


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """corpus with clean texts: ASCII, single spaces, straight quotes, its apart."""
    return corpus.withColumn("text", clean(F.col("text")))


def clean_sql(text: str) -> str:
    """clean() as a DuckDB expression of a column or expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one, to, many = decompositions()
    squished = lambda t: f"trim(regexp_replace({t}, {quote(SPACE_RE2)}, ' ', 'g'))"
    straight = f"translate({squished(text)}, {quote(CURLY)}, {quote(STRAIGHT)})"
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in many.items() if ord(k) < 0x10000)
    table = f"(MAP {{{pairs}}})"
    spelled = f"CASE WHEN regexp_matches(x, '[{''.join(k for k in many if ord(k) < 0x10000)}]') THEN array_to_string(list_transform(string_split(x, ''), lambda c: coalesce({table}[c], c)), '') ELSE x END"
    ascii_ = f"(SELECT regexp_replace(translate({spelled}, {quote(one)}, {quote(to)}), '[^\\x00-\\x7F]', '', 'g') FROM (SELECT {straight} AS x))"
    return f"regexp_replace({squished(ascii_)}, '(?i)\\b(it)(s)\\b', '\\1 \\2', 'g')"
