"""Text functions of the core engine, as Column expressions.

Patterns are literals, so Spark compiles each once a task. `(?iU)` gives Unicode word boundaries and
case folding. Where an array is used inside a lambda, let() binds it: Spark may
put the expression of a column in its place, which would then be worked out for every element.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L

SPACE = " \t\n\r\x0b\x0c"
CLOSERS = "[\"')\\]”’]"
_ABBR = "|".join(re.escape(x) for x in [*L.ABBREVIATIONS, *L.ABBREVIATION_PAIRS])
#: White space between two sentences: after . ! ? and closers, before upper case, a digit or a quote, and not
#: after an abbreviation, a single letter or a number with a full stop.
SENTENCE_BREAK = rf"""(?U)(?<=[.!?]{CLOSERS}{{0,4}})(?<!(?:^|\s)(?i:{_ABBR}|\p{{L}}|\d{{1,12}})\.{{1,4}}{CLOSERS}{{0,4}})[ \t\n\r]+(?=[\p{{Lu}}\p{{Nd}}"'“‘])"""
STRUCTURAL = r"^(?:\s*#{1,6}\s|\s*[-*+]\s|\s*\d+\.\s|\s*>\s|\s*```|\s*\|)"
PASSIVE = "(?iU)" + L.PASSIVE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each worked out once a row whatever is made from it later.

    Spark merges neighbouring projections and may put an expression in the place of each of its names; it
    does not do so across a generator.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def quoted(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constants(values: Iterable[str | float | int]) -> Column:
    """An array of constants as one expression, however many there are."""
    return F.expr("array(" + ", ".join(quoted(v) if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in values) + ")")


def words_pattern(words: Iterable[str]) -> str:
    """Any of these phrases between word boundaries, case aside."""
    return rf"(?iU)\b(?:{'|'.join(map(re.escape, words))})\b".replace(r"\ ", " ").replace(r"\'", "'")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_literal(c: Column, what: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(what), F.lit("")))) / len(what.encode())).cast("int")


def is_structural_line(line: Column) -> Column:
    return matches(line, STRUCTURAL)


def paragraphs(text: Column) -> Column:
    parts = F.split(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), "\n{2,}")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """A text's sentences; a short tail without punctuation goes with the sentence before it."""

    def merged(p: Column) -> Column:
        last = F.element_at(p, -1)
        tail = (F.size(p) > 1) & (F.size(F.split(last, r"\s+")) <= 2) & ~matches(last, rf"[.!?]{CLOSERS}*$")
        joined = F.concat(F.slice(p, F.lit(1), F.greatest(F.size(p) - 2, F.lit(0))), F.array(F.concat_ws(" ", F.get(p, F.greatest(F.size(p) - 2, F.lit(0))), last)))
        return F.when(tail, joined).otherwise(p)

    t = strip(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(let(F.split(t, SENTENCE_BREAK), merged))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def slugify(c: Column, fallback: str = "untitled") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def mean(values: Column) -> Column:
    """Mean of an array, 0 if empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def stdev(values: Column) -> Column:
    """Population standard deviation of an array, 0 for fewer than two values."""
    spread = lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values))
    return F.when(F.size(values) > 1, let(mean(values), spread)).otherwise(0.0)


def rounded(c: Column, digits: int) -> Column:
    """c rounded, halves up even where a sum of doubles falls just short of one."""
    return F.round(c + 1e-9, digits)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lexical_diversity(words: Column, window: int = 10) -> Column:
    """Distinct share of words: over the whole of a short list, else the mean over chunks that are half full."""
    share = lambda w: F.size(F.array_distinct(w)) / F.size(w)

    def of(words: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(window)), lambda s: F.slice(words, s + 1, F.lit(window)))
        chunked = mean(F.transform(F.filter(chunks, lambda c: F.size(c) >= window // 2), share))
        return F.when(F.size(words) == 0, 0.0).when(F.size(words) <= window, share(words)).otherwise(chunked)

    return let(words, of)


def is_modifier(word: Column) -> Column:
    return word.isin(L.INTENSIFIERS) | (F.endswith(word, F.lit("ly")) & ~word.isin(L.NOT_MODIFIERS) & (F.length(word) > 3))


def how_many(words: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(words, test))


def monotonous(lengths: Column) -> Column:
    """For each place whether it ends three lengths that differ by 3 at most."""

    def of(n: Column) -> Column:
        at = lambda i: F.get(n, F.greatest(i, F.lit(0)))
        return F.transform(n, lambda x, i: (i >= 2) & (F.greatest(x, at(i - 1), at(i - 2)) - F.least(x, at(i - 1), at(i - 2)) <= 3))

    return let(lengths, of)


def repeated(starts: Column) -> Column:
    """For each place whether it ends three equal starts that are not empty."""

    def of(s: Column) -> Column:
        at = lambda i: F.get(s, F.greatest(i, F.lit(0)))
        return F.transform(s, lambda x, i: (i >= 2) & (x != "") & (x == at(i - 1)) & (x == at(i - 2)))

    return let(starts, of)


def starts(sentence_tokens: Column) -> Column:
    """The first two tokens of each sentence, joined."""
    return F.transform(sentence_tokens, lambda t: F.array_join(F.slice(t, 1, 2), " "))


def runs(values: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """array<array<...>>: values cut before each one for which begins(it, the one before) holds."""

    def of(v: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | begins(F.get(v, i), F.get(v, F.greatest(i - 1, F.lit(0)))))
        cut = lambda b: F.transform(b, lambda i, k: F.slice(v, i + 1, F.coalesce(F.get(b, k + 1), F.size(v)) - i))
        return F.when(F.size(v) > 0, let(places, cut)).otherwise(F.slice(F.array(v), 1, 0))

    return let(values, of)


def truths(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))
