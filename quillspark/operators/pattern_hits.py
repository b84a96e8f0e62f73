"""Hits of the pattern catalogue, the humanizer score, the residue audit and the acceptance gate, inside a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import pattern_edits as E
from quillspark.functions import pattern_keys as K
from quillspark.functions import pattern_lexicons as L
from quillspark.functions import pattern_rules as R
from quillspark.functions import pattern_text as P
from quillspark.functions import text as T

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
ALL = [*R.RULES, *R.DERIVED]


def pattern(regex: str) -> str:
    return regex.format(B=_BOUNDARY, S=P.SPACE)


def quick(regex: str) -> str:
    """The same as pattern() for Spark alone, with fewer tests for a character: there \\w is ASCII and classes can be intersected."""
    return K.boundaries(regex).format(B=_BOUNDARY.replace(_WORD, r"\w"), S=P.BLANK)


#: Needles in order: number, rule, phrase; and number, rule, pattern.
_NEEDLES = list(enumerate((i, kind, x) for i, rule in enumerate(R.RULES) for kind, xs in (("phrase", rule.phrases), ("regex", rule.regexes)) for x in xs))
_PHRASES = [(n, i, x) for n, (i, kind, x) in _NEEDLES if kind == "phrase"]
_REGEXES = [(n, i, x) for n, (i, kind, x) in _NEEDLES if kind == "regex"]


#: Words without which a pattern of the catalogue finds nothing; null where none are known.
_NEEDS = {r: K.needs(r) for rule in R.RULES for r in rule.regexes}
_KEYS = sorted(set().union(*(k for k in _NEEDS.values() if k)))
#: The beginning of a triplet; the rest of one is looked for first, as it begins with a sign.
_TRIPLET = "{B}[^,.!?]{{4,40}}"


def _begun(low: Column) -> Column:
    return P.beginnings(low, [p for _, _, p in _PHRASES])


def _matches(x: Column, regex: str) -> Column:
    """Whether a text matches a pattern of the catalogue; x: text and which of _KEYS it holds. The words and signs that it needs come first."""
    test, needs, sign = F.rlike(x["t"], F.lit(quick(regex))), _NEEDS[regex], K.mark(regex)
    if regex.startswith(_TRIPLET):
        test = F.rlike(x["t"], F.lit(quick(regex.removeprefix(_TRIPLET).removesuffix("{B}")))) & test
    if sign:
        test = F.contains(x["t"], F.lit(sign)) & test
    return F.arrays_overlap(x["k"], T.constants(sorted(needs))) & test if needs else test


def _found(x: Column) -> Column:
    """array<struct<rule, excerpt>> in order of rules, phrases before patterns; x: text, lower text, sentences, which of _KEYS it holds."""
    needle = lambda n, i, what: F.struct(n.alias("n"), i.alias("rule"), what.alias("needle"))
    phrases = F.transform(P.phrases_in(x["low"], x["b"], _PHRASES), lambda r: needle(r["n"], r["i"], r["p"]))
    regexes = F.array_compact(F.array(*[F.when(_matches(x, r), needle(F.lit(n), F.lit(i), F.regexp_extract(x["t"], quick(r), 0))) for n, i, r in _REGEXES]))

    def hit(h: Column) -> Column:
        word = P.strip(F.lower(h["needle"]))
        inside = F.get(F.filter(x["s"], lambda s: F.contains(F.lower(s), word)), F.lit(0))
        start = F.left(F.coalesce(F.get(x["s"], F.lit(0)), h["needle"]), F.lit(R.EXCERPT))
        return F.struct(h["rule"].alias("rule"), F.coalesce(inside, start).alias("excerpt"))

    return F.array_distinct(F.transform(F.array_sort(F.concat(phrases, regexes)), hit))


def found(c: Column, figure: Callable[[str], Column], mode: Column) -> Column:
    """array<struct<rule, excerpt, severity>> of a text, the first 24; figure: its metrics by name.

    rule is a place in ALL. One row a rule and excerpt; rules that a mode excludes give none.
    """
    source = F.struct(c.alias("t"), F.lower(c).alias("low"), P.sentences(c).alias("s"), P.tokens_of(c, _KEYS).alias("k"), _begun(F.lower(c)).alias("b"))
    tests = [
        (figure("sentence_count") >= 5) & (figure("sentence_spread") < 4.2),
        (figure("word_count") > 90) & (figure("abstract_density") > figure("concrete_density") * 1.35),
        (figure("word_count") > 120) & (figure("dialogue_density") == 0) & (figure("question_rate") < 0.02) & (figure("concrete_density") < 0.018),
    ]
    first = lambda x: F.left(F.coalesce(F.get(x["s"], F.lit(0)), P.strip(x["t"])), F.lit(R.EXCERPT))
    derived = lambda x: F.filter(F.array(*[F.when(test, F.struct(F.lit(len(R.RULES) + i).alias("rule"), first(x).alias("excerpt"))) for i, test in enumerate(tests)]), lambda h: h.isNotNull())
    modes = L.DOCUMENT_MODES
    table = T.constants([R.weight(r, m) for r in ALL for m in modes])
    at = F.coalesce(F.array_position(T.constants(modes), mode), F.lit(1)).cast("int")
    at = F.greatest(at, F.lit(1)) - 1
    weighed = lambda h: F.struct(h["rule"].alias("rule"), h["excerpt"].alias("excerpt"), F.get(table, h["rule"] * len(modes) + at).alias("severity"))
    every = T.let(source, lambda x: F.concat(_found(x), derived(x)))
    return F.slice(F.filter(F.transform(every, weighed), lambda h: h["severity"] > 0), 1, R.MOST_HITS)


def hits(df: DataFrame, mode: str = "mode", text: str = "text", out: str = "hits") -> DataFrame:
    """df (with the metrics of its texts and a document mode) with `out`: found() of its texts."""
    return df.withColumn(out, found(F.col(text), F.col, F.col(mode)))


def sentence_hits(c: Column, mode: Column) -> Column:
    """struct<categories, inflated> of one sentence: the categories of its hits, whether significance inflation is one.

    A sentence has one excerpt, so a rule has one hit and the limit of 24 is out of reach.
    """

    def present(x: Column, rule: R.PatternRule) -> Column:
        tests = [F.array_contains(x["p"], R.RULES.index(rule))] if rule.phrases else []
        tests += [_matches(x, r) for r in rule.regexes]
        excluded = [m for m in L.DOCUMENT_MODES if R.weight(rule, m) <= 0]
        hit = reduce(or_, tests)
        return ~mode.isin(excluded) & hit if excluded else hit

    def of(x: Column) -> Column:
        count = lambda words: T.count(x["t"], P.any_word(words)) / x["n"]
        concrete = count(L.DERIVED_CONCRETE)
        drift = (x["n"] > 90) & (count(L.DERIVED_ABSTRACT) > concrete * 1.35)
        neutral = (x["n"] > 120) & ~F.rlike(x["t"], F.lit('["“”]')) & (T.count_literal(x["t"], "?") < 0.02) & (concrete < 0.018)
        names = [F.when(present(x, r), F.lit(r.category)) for r in R.RULES] + [F.when(t, F.lit(r.category)) for r, t in zip(R.DERIVED[1:], (drift, neutral), strict=True)]
        return F.struct(F.array_distinct(F.array_compact(F.array(*names))).alias("categories"), present(x, R.RULES[R.INFLATION]).alias("inflated"))

    rules = lambda y: F.transform(P.phrases_in(y["low"], y["b"], _PHRASES), lambda r: r["i"])
    told = lambda y: T.let(F.struct(y["t"].alias("t"), y["n"].alias("n"), y["k"].alias("k"), rules(y).alias("p")), of)
    return T.let(F.struct(c.alias("t"), F.lower(c).alias("low"), P.word_count(c).alias("n"), P.tokens_of(c, _KEYS).alias("k"), _begun(F.lower(c)).alias("b")), told)


def category(rule: Column) -> Column:
    return F.get(T.constants([r.category for r in ALL]), rule)


def top_categories(found: Column) -> Column:
    """array<struct<category, count>>: the three most frequent, ties by first appearance."""

    def of(cats: Column) -> Column:
        counted = F.transform(F.array_distinct(cats), lambda c, i: F.struct((-F.size(F.filter(cats, lambda x: x == c))).alias("n"), i.alias("i"), c.alias("c")))
        return F.transform(F.slice(F.array_sort(counted), 1, R.TOP_CATEGORIES), lambda x: F.struct(x["c"].alias("category"), (-x["n"]).alias("count")))

    return T.let(F.transform(found, lambda h: category(h["rule"])), of)


def humanizer_score(h: Column, c: Callable[[str], Column] = F.col) -> Column:
    """100 less what hits, even cadence, abstraction, neutrality, modifiers and assistant talk cost; c: the text's metrics by name."""
    pattern_penalty = F.aggregate(h, F.lit(0.0), lambda a, x: a + x["severity"] * 4.8)
    talk = F.size(F.filter(h, lambda x: category(x["rule"]) == "communication")) * 4.5
    cadence = F.when(c("sentence_count") >= 5, T.clamp((4.5 - c("sentence_spread")) * 5.8, 0, 18)).otherwise(0)
    abstraction = T.clamp((c("abstract_density") - c("concrete_density")) * 95, 0, 16)
    neutral = F.when((c("word_count") > 120) & (c("dialogue_density") == 0), T.clamp((0.024 - c("concrete_density")) * 320, 0, 12)).otherwise(0)
    modifiers = T.clamp((c("modifier_density") - 0.018) * 260, 0, 12)
    return T.clamp(100 - (pattern_penalty + cadence + abstraction + neutral + modifiers + talk))


def findings(found: Column) -> Column:
    """array<struct<rule, excerpt, severity, priority>>: what an audit reports, six at most."""
    serious = lambda h, i: (h["severity"] >= 0.72) | category(h["rule"]).isin("communication", "hedging", "content", "soul") | (i < 4)
    priority = lambda s: F.when(s >= 0.8, "high").when(s >= 0.58, "medium").otherwise("low")
    return F.transform(F.slice(F.filter(found, serious), 1, R.MOST_FINDINGS), lambda h: F.struct(h["rule"].alias("rule"), h["excerpt"].alias("excerpt"), h["severity"].alias("severity"), priority(h["severity"]).alias("priority")))


def annotations(c: Column, found_: Column, mode: Column) -> Column:
    """array<struct<type, original, reason>> of a text, the first 12: its first hits, then what each sentence shows.

    found_: the text's hits. Where there are fewer than three, fillers in the text as a whole are noted too.
    """
    note = lambda kind, original, reason: F.struct(kind.alias("type"), original.alias("original"), reason.alias("reason"))
    of_hit = lambda h: note(category(h["rule"]), h["excerpt"], F.get(T.constants([R.HINTS[r.id] for r in ALL]), h["rule"]))
    narrative = mode.isin(E.NARRATIVE)

    def of_sentence(s: Column) -> Column:
        any_of = lambda phrases: F.exists(T.constants(phrases), lambda p: F.contains(F.lower(s), p))
        tests = [
            F.rlike(s, F.lit(quick(R.RULES[R.OPENER].regexes[0]))), any_of(L.STRUCTURE), narrative & any_of(L.FICTION_TELL), ~narrative & any_of(L.REGISTER), F.rlike(s, F.lit("[—;:]")) & (P.word_count(s) > R.LONG),
        ]
        return F.array_compact(F.array(*[F.when(t, note(F.lit(kind), s, F.lit(reason))) for t, (kind, reason) in zip(tests, R.REMARKS.items(), strict=True)]))

    def filled(notes: Column) -> Column:
        filler = F.exists(T.constants(L.FILLER), lambda p: F.contains(F.lower(c), p))
        last = F.array(note(F.lit(R.FALLBACK[0]), F.get(F.split(c, "\n+"), F.lit(0)), F.lit(R.FALLBACK[1])))
        return F.slice(F.when((F.size(notes) < R.FEW_NOTES) & filler, F.concat(notes, last)).otherwise(notes), 1, R.MOST_NOTES)

    return T.let(F.concat(F.transform(F.slice(found_, 1, R.HIT_NOTES), of_hit), F.flatten(F.transform(P.sentences(c), of_sentence))), filled)


# What a reason of the gate says.
REASONS = {
    "quality": "Quality dropped below the acceptance floor.",
    "risk": "Detector risk got worse after rewrite.",
    "humanizer": "Humanizer score regressed after rewrite.",
    "cut too much": "Rewrite cut too much material for the current edit budget.",
    "no gain": "Rewrite did not improve quality, risk, or Humanizer score enough to keep.",
    "residue": "High-priority residue remained after the second pass.",
}


def gate(quality: Column, risk: Column, humanizer: Column, word_ratio: Column, same: Column, budget: Column, high_residue: Column) -> Column:
    """array<string>: why a rewrite is reverted, empty if it is accepted. quality, risk, humanizer: gains; same: nothing was changed."""
    least = F.when(budget == "aggressive", 0.35).when(budget == "medium", 0.42).otherwise(0.5)
    reasons = [
        F.when(quality < -1.5, "quality"), F.when(risk < -0.5, "risk"), F.when(humanizer < -0.5, "humanizer"), F.when((word_ratio < least) & (quality < 8) & (humanizer < 8), "cut too much"),
        F.when((quality < 0.5) & (risk < 0.5) & (humanizer < 0.5), "no gain"), F.when(high_residue & (humanizer < 2), "residue"),
    ]
    return F.when(same, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*reasons)))
