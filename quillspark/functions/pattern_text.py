"""Text functions of the pattern engine, as Column expressions.

This engine has its own segmenter and tokeniser, which differ from the core engine's: words are runs of ASCII
letters, digits and _ that may hold apostrophes and hyphens inside, and sentences end at . ! ? before white
space and a capital, digit or opening quote. White space is what ECMAScript calls so.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.pattern_keys import BEGIN, phrase_key

SPACES = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
SPACE = f"[{SPACES}]"
#: The same for Spark: few tests for a character that is none of them.
_WIDE = "[\\u1680-\\ufeff&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]]"
BLANK = f"[\\t\\n\\x0b\\f\\r \\u00a0{_WIDE}]"
#: Runs of it that are not one blank.
_UNEVEN = f"(?: {BLANK}+|[\\t\\n\\x0b\\f\\r\\u00a0{_WIDE}]{BLANK}*)"
#: Begins and ends with a letter, digit or _.
WORD = r"[A-Za-z0-9_](?:[A-Za-z0-9_’'-]*[A-Za-z0-9_])?"
_WORD = r"\w(?:[\w’'-]*\w)?"  # the same for Spark
CONTRACTION = r"[A-Za-z0-9_]+'[A-Za-z0-9_]+"
_BREAK = r""" (?<=[.!?] )(?=[A-Z0-9"“‘(\[])"""  # the blank first: most places are ruled out by one character
_HEADING = r"^(#{1,6}[ \t][^\n\r]+?)\n+([\s\S]+)$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and _ in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)), F.lower)


def tokens_of(text: Column, words: Iterable[str]) -> Column:
    """The tokens that are one of these words."""
    return F.filter(tokens(text), lambda w: w.isin(sorted(words)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; a heading is a paragraph of its own."""
    blocks = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{2,}"), strip), lambda b: b != "")
    parts = lambda b: F.when(F.rlike(b, F.lit(_HEADING)), F.array(strip(F.regexp_extract(b, _HEADING, 1)), strip(F.regexp_extract(b, _HEADING, 2)))).otherwise(F.array(b))
    return F.filter(F.flatten(F.transform(blocks, parts)), lambda p: p != "")


def sentences(text: Column) -> Column:
    t = strip(F.regexp_replace(text, _UNEVEN, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BREAK))


def normalised(text: Column) -> Column:
    """Line ends as \\n, no tabs, no white space before a line's end, single spaces."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(t, f"{BLANK}+\n", "\n"), "[ \u00a0]{2,}", " "))


def beginnings(low: Column, phrases: Iterable[str]) -> Column:
    """Which of the phrases' keys a lower-cased text holds: see phrases_in()."""
    keys = sorted({k for k in map(phrase_key, phrases) if k})
    starts = F.transform(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)), lambda w: F.left(w, F.lit(BEGIN)))
    return F.array_distinct(F.filter(starts, lambda w: w.isin(keys)))


def phrases_in(low: Column, begun: Column, phrases: list[tuple[int, int, str]]) -> Column:
    """array<struct<n, i, p, k>>: those phrases (two numbers and a text) that a lower-cased text holds; begun: its beginnings() of them or more.

    A phrase is looked for only where a word begins as one of the phrase's does.
    """
    rows = lambda some: "array(" + ", ".join(f"struct({n} AS n, {i} AS i, {T.quoted(p)} AS p, {T.quoted(phrase_key(p) or '')} AS k)" for n, i, p in some) + ")"
    there = lambda r: F.contains(low, r["p"])
    parts = []
    if free := [x for x in phrases if not phrase_key(x[2])]:
        parts.append(F.filter(F.expr(rows(free)), there))
    if keyed := [x for x in phrases if phrase_key(x[2])]:
        table = F.expr(rows(keyed))
        parts.append(F.filter(F.when(F.size(begun) > 0, table).otherwise(F.slice(table, 1, 0)), lambda r: F.array_contains(begun, r["k"]) & there(r)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def phrase_hits(low: Column, begun: Column, phrases: Iterable[str]) -> Column:
    """Occurrences of all phrases in a lower-cased text, inside words too; only a phrase that is there is counted."""
    there = phrases_in(low, begun, [(0, 0, p) for p in phrases])
    return F.aggregate(there, F.lit(0), lambda a, r: a + ((F.octet_length(low) - F.octet_length(F.replace(low, r["p"], F.lit("")))) / F.octet_length(r["p"])).cast("int"))


def any_word(words: Iterable[str]) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def title_case(token: Column) -> Column:
    """Parts between _, - and white space, their first letters in upper case."""
    parts = F.filter(F.split(token, rf"(?:_|-|{BLANK})+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), " ")


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def slug(c: Column) -> Column:
    """40 characters at most, cut after trimming."""
    s = F.left(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(40))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("batch"))


def append_warning(existing: Column, addition: Column) -> Column:
    old, new = F.coalesce(existing, F.lit("")), F.coalesce(addition, F.lit(""))
    return F.when(new == "", old).when(old == "", new).otherwise(F.concat(old, F.lit(" · "), new))


def signed(c: Column, digits: int = 0) -> Column:
    """With a plus or a minus sign (U+2212)."""
    return F.concat(F.when(c >= 0, "+").otherwise("−"), F.format_string(f"%.{digits}f", F.abs(c).cast("double")))


def pluralised(n: Column, singular: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(singular + "s"))
