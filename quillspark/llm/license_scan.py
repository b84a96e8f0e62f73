"""License scan: ordered signature rules behind a keyword prefilter, all in DataFrame functions.

A text that holds none of the gate words is done after a few substring searches. The others are brought
to a form in which every word stands between two spaces of its own, each rule whose keyword is present
is run over the whole text, and every match becomes an interval of words. An interval is suppressed when
another one contains it that has a more specific tier, or the same tier and either greater length or an
earlier rule. Nothing is shuffled: a row never leaves its partition, so hot sources cost nothing extra.

Defined results: null and empty texts have no words and no detections; extra columns are kept as they
are unless they have the name of a result column, which then replaces them; repeated rows give repeated results.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let
from quillspark.llm.license_rules import Rule, rules

#: A word after A-Z are lower-cased; upper case is listed so that counting needs no lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
#: Confidence by tier.
TIER_SCORE = (1.0, 0.9, 0.7, 0.4)


def spaced(pattern: str) -> str:
    """A rule's pattern over words that each have a space on both sides."""
    return " " + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + " "


def keyword(rule: Rule) -> str:
    return re.sub(r"(?<=\S) (?=\S)", "  ", rule.keyword)


def gate_word(rule: Rule) -> str:
    """A word that every text with a match contains somewhere."""
    without_options = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?: \(\?:[^()]*\)\)\?", "", rule.pattern))
    return "licen" if "licen" in without_options else max(rule.keyword.split(), key=len)


def _gate(text: Column, table: list[Rule]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in sorted({gate_word(r) for r in table}):
        hit = F.contains(lowered, F.lit(word))
        found = found | ((hit & lowered.rlike(_CC_BY)) if word == "cc" else hit)
    return found


def _words(spaced_text: Column) -> Column:
    return F.size(F.filter(F.split(spaced_text, " "), lambda w: w != ""))


def scan_array(values: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before, value) for each value, the state going from zero through step(state, value); emit gives a `kind`.

    A fold that lengthens its result copies it at each value. So values go in slices of about the root of
    their number: one fold keeps the state at each slice's start, and each slice has a fold of its own.
    """

    def of(v: Column) -> Column:
        length = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / length).cast("int")), lambda k: F.slice(v, k * length + 1, length))

        def joined(parts: Column) -> Column:
            begun = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts"))
            starts = F.aggregate(parts, begun, lambda a, p: F.struct(F.aggregate(p, a["state"], step).alias("state"), F.concat(a["starts"], F.array(a["state"])).alias("starts")))["starts"]
            own = lambda p, s: F.aggregate(p, F.struct(s.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))["out"]
            return F.flatten(F.zip_with(parts, starts, own))

        return F.when(F.size(v) > 0, let(slices, joined)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(values, of)


def _spans(norm: Column, pattern: Column) -> Column:
    """array<struct<at, to>>: the word intervals, end excluded, of a pattern's matches."""

    def of(matches: Column) -> Column:
        between = F.transform(F.split(norm, pattern), _words)
        steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), _words(m).alias("n")))
        after = lambda pos, x: pos + x["gap"] + x["n"]
        return scan_array(steps, F.lit(0), after, lambda pos, x: F.struct((pos + x["gap"]).alias("at"), after(pos, x).alias("to")), "struct<at:int,to:int>")

    return let(F.regexp_extract_all(norm, pattern, F.lit(0)), of)


def detect(df: DataFrame, text: str = "text", out: str = "detections", table: list[Rule] | None = None) -> DataFrame:
    """df with `out`: array<struct<at,neg_to,tier,ord,label,base,to,suppressed>> in order of place.

    `at` and `to` count words from 0, `to` excluded. Columns of df stay.
    """
    table = rules() if table is None else table
    literal = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r.label).alias("label"), F.lit(r.tier).alias("tier"), F.lit(keyword(r)).alias("keyword"), F.lit(spaced(r.pattern)).alias("pattern"), F.lit(r.base).alias("base")) for i, r in enumerate(table)])
    words = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    norm = F.when(_gate(F.col(text), table), F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    df = df.withColumn("__norm", norm)
    n = F.col("__norm")
    found = F.flatten(
        F.transform(
            F.filter(literal, lambda r: F.contains(n, r["keyword"])),
            lambda r: F.transform(_spans(n, r["pattern"]), lambda s: F.struct(s["at"].alias("at"), (-s["to"]).alias("neg_to"), r["tier"].alias("tier"), r["ord"].alias("ord"), r["label"].alias("label"), r["base"].alias("base"))),
        )
    )
    df = df.withColumn("__found", F.when(n.isNotNull(), F.array_sort(found)))
    fields = "at:int,neg_to:int,tier:int,ord:int,label:string,base:boolean,to:int,suppressed:boolean"

    def reached(reach: Column, d: Column) -> Column:
        """How far the intervals of each tier reach, this one included."""
        return F.transform(reach, lambda x, i: F.when((i == d["tier"]) & (-d["neg_to"] > x), -d["neg_to"]).otherwise(x))

    def judged(reach: Column, d: Column) -> Column:
        # sorted by (start, longest, tier, rule): whatever contains this interval came before it
        hidden = F.exists(F.slice(reach, 1, d["tier"] + 1), lambda x: x >= -d["neg_to"])
        return F.struct(d["at"].alias("at"), d["neg_to"].alias("neg_to"), d["tier"].alias("tier"), d["ord"].alias("ord"), d["label"].alias("label"), d["base"].alias("base"), (-d["neg_to"]).alias("to"), hidden.alias("suppressed"))

    result = scan_array(F.col("__found"), F.array(*[F.lit(-1)] * 4), reached, judged, f"struct<{fields}>")
    return df.withColumn(out, F.when(F.col("__found").isNotNull(), result).otherwise(F.array().cast(f"array<struct<{fields}>>"))).drop("__norm", "__found")


def _score(tier: Column) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(TIER_SCORE):
        out = F.when(tier == i, F.lit(x)).otherwise(out)
    return out


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row a document: word count, places of the base phrases, labels and score.

    Labels are those of the base phrases and of all detections that aren't suppressed. score is the
    confidence of the most specific detection, 0 without any.
    """
    d = detect(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "detections", table)
    base = F.filter("detections", lambda x: x["base"])
    live = F.filter("detections", lambda x: ~x["suppressed"])
    best = F.array_min(F.transform(live, lambda x: x["tier"]))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    d = d.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), base.alias("base"), live.alias("live"), best.alias("best"))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
        join(F.transform("base", lambda x: x["label"])).alias("base_labels"),
        join(F.concat(F.transform("base", lambda x: x["label"]), F.transform("live", lambda x: x["label"]))).alias("labels"),
        _score(F.col("best")).alias("score"),
    )


def oracle(table: list[Rule] | None = None) -> str:
    """The same over `documents`, in SQL: suppression by window functions, no prefilter."""
    table = rules() if table is None else table
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({i},{quote(r.label)},{r.tier},{quote(spaced(r.pattern))},{str(r.base).lower()})" for i, r in enumerate(table))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH rule(ord,label,tier,pattern,base) AS (VALUES {values}),
doc AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'), '{word}') AS words FROM documents),
norm AS (SELECT k, ' ' || array_to_string(words, '  ') || ' ' AS t FROM doc),
hit AS (SELECT k, ord, label, tier, base, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS p FROM norm, rule WHERE regexp_matches(t, pattern)),
one AS (SELECT k, ord, label, tier, base, i,
  list_sum(list_transform(p[1:i], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)), 0) AS lo,
  (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit)),
span AS (SELECT k, ord, label, tier, base, lo, lo + n AS hi FROM one),
seen AS (SELECT *, {", ".join(f"max(CASE WHEN tier <= {x} THEN hi END) OVER w AS r{x}" for x in range(4))} FROM span WINDOW w AS (PARTITION BY k ORDER BY lo, hi DESC, tier, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, coalesce(CASE tier WHEN 0 THEN r0 WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END >= hi, false) AS hidden FROM seen),
found AS (SELECT k, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (base OR NOT hidden))), ',') AS labels, min(tier) FILTER (NOT hidden) AS best FROM judged GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(CASE best WHEN 0 THEN {TIER_SCORE[0]} WHEN 1 THEN {TIER_SCORE[1]} WHEN 2 THEN {TIER_SCORE[2]} WHEN 3 THEN {TIER_SCORE[3]} END, 0) AS DOUBLE) AS score FROM doc LEFT JOIN found USING (k)
"""
