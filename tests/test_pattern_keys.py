"""Substitutions tried only where the words they need are: same texts as without, whatever comes before them."""

import random
import re
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillspark.functions import pattern_edits as E
from quillspark.functions import pattern_keys as K
from quillspark.functions import pattern_rules as R
from quillspark.functions import pattern_text as P
from quillspark.operators import pattern_rewrite as W
from quillspark.operators.pattern_hits import pattern

_GROUPS = {"phrases": E.PHRASES, "tighten": E.TIGHTEN, "endings": E.ENDINGS, "spoken": E.CONTRACTED, "talk": E.TALK, **{f"direct {i}": r for i, (_, r) in enumerate(E.DIRECT)}, **{f"category {i}": r for i, (_, _, r) in enumerate(E.BY_CATEGORY)}}


def _texts(rules, n=150):
    """Texts of pieces of the patterns themselves, of what they put in and of signs, joined with and without blanks."""
    rng = random.Random(5)
    known = [re.sub("[\x00\x02]", lambda m: rng.choice(["wave", "road"]) if m[0] == "\x00" else ", ", r).replace("\x01", "") for p, _ in rules for r in (K.readings(p) or [])]
    parts = known + [r.replace("$1", "x") for _, r in rules] + ["He", "was", "they", "and", "And", ",", ".", "—", "**", "Kind", "s", "x_", " ", " ", "Fear"]
    change = [lambda s: s, str.upper, str.title, lambda s: s[1:], lambda s: s + "s"]
    return ["".join(rng.choice(change[:1] * 6 + change)(rng.choice(parts)) + rng.choice(["", " ", " ", " ", "  ", "'"]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", list(_GROUPS))
def test_edited_is_the_plain_fold(spark, name):
    rules = _GROUPS[name]
    df = spark.createDataFrame([(t,) for t in [*_texts(rules), "", None]], "t string").repartition(2)
    plain = reduce(lambda x, r: F.regexp_replace(x, pattern(r[0]), r[1]), rules, F.col("t"))
    assert [r for r in df.select("t", plain.alias("a"), W.edited(F.col("t"), rules).alias("b")).collect() if r.a != r.b] == []


def test_words_that_an_earlier_substitution_makes_are_needed_too():
    felt = K.guards([(r"(?i){B}felt a wave of ([a-z]+){B}", "felt $1"), ("(?i){B}felt fear{B}", "felt afraid")])
    assert felt == [{"felt"}, {"fear"}] or felt[1] >= {"felt"}
    assert K.guards([("(?i)then{S}+", " "), ("(?i){B}leng{B}", "")]) == [None, None]
    assert K.needs("(?i){B}(?:in order to|kind of){B}") == {"order", "kind"}
    assert K.needs("{S}+([,.;!?])") is None


@pytest.mark.parametrize("regex", [r for rule in R.RULES for r in rule.regexes])
def test_catalogue_patterns_hold_what_they_need(spark, regex):
    texts = _texts([(regex, "")], 80)
    df = spark.createDataFrame([(t,) for t in texts], "t string").where(F.rlike("t", F.lit(pattern(regex)))).select("t", P.tokens(F.col("t")).alias("k")).collect()
    needs, sign = K.needs(regex), K.mark(regex)
    assert all((needs is None or needs & set(r.k)) and (sign is None or sign in r.t) for r in df)


def test_white_space_classes_agree(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert {r.c for r in df.where(F.rlike("c", F.lit(f"^{P.BLANK}\\z"))).collect()} == set(P.SPACES)


def test_phrases_are_found_wherever_they_are(spark):
    """Inside words, beside signs and at both ends: the looks for beginnings of words leave none out."""
    phrases = [(i, 0, p) for i, p in enumerate(p for rule in R.RULES for p in rule.phrases)]
    texts = [a + p + b for _, _, p in phrases for a, b in (("", ""), ("un", "s"), ("(", ")"), ("it was x ", "ed, and"))] + ["", "nothing here"]
    low = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(P.phrases_in(low, P.beginnings(low, [p for _, _, p in phrases]), phrases), lambda r: r["n"]).alias("n"))
    assert all(sorted(r.n) == [n for n, _, p in phrases if p in r.t] for r in df.collect())


def test_long_sentences_without_three_clauses_are_told_at_once(spark):
    """Two times "was" among thousands of commas: no reading of the pattern is tried."""
    text = "was , " + "so, " * 1500 + "was here, " + "and so, " * 1500
    began = time.time()
    assert spark.createDataFrame([(text,)] * 4, "t string").select(W.collapse_subject_clauses(F.col("t")).alias("o")).distinct().collect()[0].o == text
    assert time.time() - began < 30
    assert spark.createDataFrame([("The Hall WAS dark, the hall was cold, and the hall was empty.",)], "t string").select(W.collapse_subject_clauses(F.col("t")).alias("o")).first().o == "The Hall was dark, cold, and empty."
