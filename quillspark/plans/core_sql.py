"""SQL of the core engine's queries, written apart from the DataFrame code: long form, window functions, no look-around."""

from __future__ import annotations

import re

from quillspark.functions import lexicons as L
from quillspark.operators import signals
from quillspark.plans import seeded

CLOSERS = "[\"'')\\]”’]"
SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BASE = f"c AS ({seeded.sql()})"
#: RE2 has ASCII word boundaries; with accented letters as x they fall where Unicode's do.
ASCII = "regexp_replace({0}, '[À-ÖØ-öø-ÿĀ-ɏ]', 'x', 'g')"
_ABBR = "|".join(re.escape(x) for x in [*L.ABBREVIATIONS, *L.ABBREVIATION_PAIRS])


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def names(words) -> str:
    return "(" + ", ".join(map(quote, words)) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def sentences(out: str, source: str, key: str, text: str) -> str:
    """CTEs that end in out(key, i, s): the sentences of a text, numbered from 0."""
    mark = rf"regexp_replace({strip(text)}, '([.!?]{CLOSERS}*)([ \t\n\r]+)([\p{{Lu}}\p{{Nd}}\"''“‘])', '\1' || chr(1) || '\2\3', 'g')"
    return rf"""
{out}_a AS (SELECT {key}, string_split({mark.replace(chr(92) + '"', '"')}, chr(1)) AS p FROM {source} WHERE {strip(text)} <> ''),
{out}_b AS (SELECT {key}, unnest(p) AS piece, unnest(range(len(p))) AS j FROM {out}_a),
{out}_c AS (SELECT *, NOT regexp_matches(piece, '(?i)(?:^|[\s])(?:{_ABBR}|\p{{L}}|\d+)\.+{CLOSERS}*$') AS ends FROM {out}_b),
{out}_d AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {out}_c),
{out}_e AS (SELECT {key}, g, {strip("string_agg(piece, '' ORDER BY j)")} AS s FROM {out}_d GROUP BY {key}, g),
{out}_f AS (SELECT *, max(g) OVER (PARTITION BY {key}) AS last FROM {out}_e),
{out}_g AS (SELECT {key}, s, CASE WHEN g = last AND g > 0 AND len(string_split_regex(s, '\s+')) <= 2 AND NOT regexp_matches(s, '[.!?]{CLOSERS}*$') THEN g - 1 ELSE g END AS g, g AS g0 FROM {out}_f),
{out} AS (SELECT {key}, CAST(g AS INTEGER) AS i, string_agg(s, ' ' ORDER BY g0) AS s FROM {out}_g GROUP BY {key}, g)"""


def sentence_facts(out: str, source: str, key: str) -> str:
    """CTE out(key, i, s, t, n, start, mono, same): tokens, length, first two tokens, runs of three."""
    return rf"""
{out}_t AS (SELECT {key}, i, s, regexp_extract_all(lower(s), '[a-z'']+') AS t FROM {source}),
{out}_u AS (SELECT *, CAST(len(t) AS INTEGER) AS n, array_to_string(t[1:2], ' ') AS start FROM {out}_t),
{out} AS (SELECT *, coalesce(count(*) OVER w = 3 AND max(n) OVER w - min(n) OVER w <= 3, false) AS mono,
  coalesce(start <> '' AND start = lag(start) OVER o AND start = lag(start, 2) OVER o, false) AS same
  FROM {out}_u WINDOW o AS (PARTITION BY {key} ORDER BY i), w AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def words(patterns) -> str:
    return r"(?i)\b(?:" + "|".join(p.replace("'", "''") for p in patterns) + r")\b"


PASSIVE = "(?i)" + L.PASSIVE
FILLER = words(p for phrases, _, _ in L.FILLERS for p in phrases)
MODIFIER = f"(w IN {names(L.INTENSIFIERS)} OR (w LIKE '%ly' AND w NOT IN {names(L.NOT_MODIFIERS)} AND length(w) > 3))"


def counted(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


def literal(text: str, what: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {quote(what)}, ''))) // {len(what)} AS INTEGER)"


def annotations(out: str, facts: str, key: str) -> str:
    """CTE out(key, type, severity, original, sentence, rule): the first of each type and text."""
    a = ASCII.format("s")
    tests = [
        f"regexp_matches({a}, '{FILLER}')",
        f"len(list_filter(t, lambda w: w IN {names(L.INTENSIFIERS)})) >= 2",
        rf"regexp_matches({ASCII.format('lower(s)')}, '\b(?:started|began) to\b')",
        "(" + " OR ".join(f"contains(lower(s), {quote(p)})" for p in L.CLICHES) + ")",
        "(contains(s, '—') OR contains(s, '--'))",
        "mono",
        "same",
        "n >= 34",
        f"regexp_matches({a}, '{PASSIVE}')",
    ]
    union = " UNION ALL ".join(f"SELECT {key}, {quote(kind)} AS type, {severity} AS severity, s AS original, i AS sentence, {r} AS rule FROM {facts} WHERE {test}" for r, ((kind, severity, _), test) in enumerate(zip(signals.RULES, tests, strict=True)))
    return f"""
{out}_all AS ({union}),
{out} AS (SELECT * FROM {out}_all QUALIFY row_number() OVER (PARTITION BY {key}, type, original ORDER BY sentence, rule) = 1)"""


def diversity(out: str, source: str, key: str, tokens: str) -> str:
    """CTE out(key, ld): lexical diversity of a list of tokens."""
    return f"""
{out}_w AS (SELECT {key}, unnest({tokens}) AS w, unnest(range(len({tokens}))) AS j, len({tokens}) AS total FROM {source}),
{out}_k AS (SELECT {key}, total, j // 10 AS chunk, count(DISTINCT w) / count(*) AS share, count(*) AS size FROM {out}_w GROUP BY {key}, total, CASE WHEN total <= 10 THEN 0 ELSE j // 10 END, j // 10),
{out} AS (SELECT {key}, avg(share) AS ld FROM {out}_k WHERE total <= 10 OR size >= 5 GROUP BY {key})"""


def core() -> str:
    """CTEs up to sig: the signals, axes, quality and risk of every document of c."""
    t = ASCII.format("text")
    return f"""{BASE},{sentences("sent", "c", "doc_id", "text")},{sentence_facts("f", "sent", "doc_id")},{annotations("ann", "f", "doc_id")},
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM c),{diversity("ld", "tok", "doc_id", "t")},
per_ann AS (SELECT doc_id, count(*) FILTER (type = 'filler') AS filler_hits, count(*) FILTER (type = 'rhythm') AS rhythm_hits FROM ann GROUP BY doc_id),
per_sent AS (SELECT doc_id, count(*) AS sentence_count, count(*) FILTER (mono) AS monotonous_runs, CASE WHEN count(*) > 1 THEN stddev_pop(n) ELSE 0 END AS sd FROM f GROUP BY doc_id),
opening AS (SELECT doc_id, start, lag(start) OVER o AS a, lag(start, 2) OVER o AS b FROM f WHERE start <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
per_start AS (SELECT doc_id, count(*) FILTER (start = a AND start = b) AS repeated_starts FROM opening GROUP BY doc_id),
raw AS (SELECT doc_id, source, coalesce(filler_hits, 0) AS filler_hits, coalesce(rhythm_hits, 0) AS rhythm_hits, len(list_filter(t, lambda w: {MODIFIER})) AS modifier_hits,
  {counted(ASCII.format("lower(text)"), words(L.TRANSITIONS))} AS transition_hits, {" + ".join(f"contains(lower(text), {quote(p)})::INT" for p in L.CLICHES)} AS cliche_hits,
  len(list_filter(t, lambda w: w IN {names(L.GENERIC_WORDS)})) AS generic_hits, len(list_filter(t, lambda w: w IN {names(L.ABSTRACT_WORDS)})) AS abstract_hits,
  coalesce(repeated_starts, 0) AS repeated_starts, coalesce(monotonous_runs, 0) AS monotonous_runs, {counted(t, PASSIVE)} AS passive_hits, {literal("text", "—")} + {literal("text", "--")} AS dashes,
  coalesce(sentence_count, 0) AS sentence_count, len(t) AS word_count, coalesce(ld, 0) AS ld, coalesce(sd, 0) AS sd
  FROM c LEFT JOIN per_ann USING (doc_id) LEFT JOIN per_sent USING (doc_id) LEFT JOIN per_start USING (doc_id) LEFT JOIN tok USING (doc_id) LEFT JOIN ld USING (doc_id)),
axes AS (SELECT *, greatest(0.0, least(100.0, 100 - 8 * filler_hits - 4 * transition_hits - 1.5 * generic_hits - 5 * passive_hits))::DOUBLE AS x1, greatest(0.0, least(100.0, 100 - 7 * filler_hits - 1.6 * modifier_hits - 1.8 * generic_hits))::DOUBLE AS x2,
  greatest(0.0, least(100.0, 100 - 8 * rhythm_hits - 6 * monotonous_runs - 4 * greatest(0.0, 7 - sd)))::DOUBLE AS x3, greatest(0.0, least(100.0, 100 - 9 * cliche_hits - 5 * transition_hits - 2 * abstract_hits - 7 * repeated_starts - 4 * filler_hits))::DOUBLE AS x4,
  greatest(0.0, least(100.0, 100 - 3 * generic_hits - 2 * abstract_hits - 150 * greatest(0.0, 0.48 - ld)))::DOUBLE AS x5,
  greatest(0.0, least(100.0, 7 * filler_hits + 1.3 * modifier_hits + 5 * transition_hits + 9 * cliche_hits + 7 * repeated_starts + 6 * monotonous_runs + 4 * passive_hits + 70 * greatest(0.0, 0.72 - ld) + 4 * dashes))::DOUBLE AS risk FROM raw),
sig AS (SELECT *, round(x1, 1) AS directness, round(x2, 1) AS density, round(x3, 1) AS rhythm, round(x4, 1) AS authenticity, round(x5, 1) AS specificity, round((x1 + x2 + x3 + x4 + x5) / 5, 1) AS quality_score, round(risk, 1) AS detector_risk FROM axes)"""


def profiles(out: str, source: str, key: str, text: str) -> str:
    """CTEs that end in out(key, the 14 figures)."""
    return rf"""{sentences(out + "_s", source, key, text)},
{out}_p0 AS (SELECT {key}, unnest(string_split_regex({strip(f"replace({text}, chr(13) || chr(10), chr(10))")}, '\n{{2,}}')) AS q, unnest(range(len(string_split_regex({strip(f"replace({text}, chr(13) || chr(10), chr(10))")}, '\n{{2,}}')))) AS j FROM {source}),
{out}_p1 AS (SELECT {key} || '/' || j AS pk, {key} AS owner, {strip("q")} AS q FROM {out}_p0 WHERE {strip("q")} <> ''),{sentences(out + "_ps", out + "_p1", "pk", "q")},
{out}_pc AS (SELECT owner, pk, count(*) AS k FROM {out}_ps JOIN {out}_p1 USING (pk) GROUP BY owner, pk),
{out}_pm AS (SELECT owner, avg(k) AS para FROM {out}_pc GROUP BY owner),
{out}_l AS (SELECT {key}, CAST(len(regexp_extract_all(lower(s), '[a-z'']+')) AS INTEGER) AS n FROM {out}_s),
{out}_m AS (SELECT {key}, count(*) AS k, avg(n) AS mean, stddev_pop(n) AS sd, count(*) FILTER (n >= 24) AS long, count(*) FILTER (n <= 5) AS short FROM {out}_l GROUP BY {key}),
{out}_w AS (SELECT {key}, {text} AS x, regexp_extract_all(lower({text}), '[a-z'']+') AS t FROM {source}),{diversity(out + "_d", out + "_w", key, "t")},
{out} AS (SELECT {key}, coalesce(round(mean + 1e-9, 3), 0) AS avg_sentence_length, coalesce(round(sd + 1e-9, 3), 0) AS sentence_length_std, coalesce(round(para + 1e-9, 3), 0) AS avg_paragraph_sentences,
  round({literal("x", '"')} / greatest(2, length(x)) + 1e-9, 4) AS dialogue_ratio, round(len(list_filter(t, lambda w: contains(w, ''''))) / greatest(1, len(t)) + 1e-9, 4) AS contraction_rate,
  round({literal("x", ",")} / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS comma_rate, round({literal("x", "?")} / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS question_rate, round({literal("x", "!")} / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS exclamation_rate,
  round(({literal("x", "—")} + {literal("x", "--")}) / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS emdash_rate, round({literal("x", ";")} / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS semicolon_rate, coalesce(round(ld + 1e-9, 4), 0) AS lexical_diversity,
  round(coalesce(long, 0) / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS long_sentence_rate, round(coalesce(short, 0) / greatest(1, coalesce(k, 1)) + 1e-9, 4) AS fragment_rate, round(len(list_filter(t, lambda w: {MODIFIER})) / greatest(1, len(t)) + 1e-9, 4) AS modifier_rate
  FROM {out}_w LEFT JOIN {out}_m USING ({key}) LEFT JOIN {out}_d USING ({key}) LEFT JOIN {out}_pm ON owner = {key})"""


def distance(left: str, right: str, digits: int | None = 4) -> str:
    terms = [f"abs({left}.{k} - {right}.{k}) / greatest(abs({left}.{k}), abs({right}.{k}), {0.2 if 'rate' in k else 2.0}) * {w}" for k, w in L.VOICE_WEIGHTS.items()]
    return f"round({' + '.join(terms)} + 1e-9, {digits})" if digits else f"({' + '.join(terms)})"


def replaced(x: str, rules: list[tuple[str, str]], flags: str = "(?i)") -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, {quote(flags + pattern)}, {quote(new)}, 'g')"
    return x


def cleaned(out: str, source: str) -> str:
    """CTE out(doc_id, i, s, x): sentences s, cleaned as x; over text without accents."""
    stacked = "very|really|quite|rather|somewhat|truly|basically"
    first = [(rf"\b(?:{'|'.join(p)})\b{after}", new) for p, after, new in L.FILLERS]
    first += [(rf"\b(?:{stacked})\b\s+\b({stacked})\b", r"\1"), (rf"\b(?:very|really|truly|quite)\s+({'|'.join(L.SLOPPY_ADJECTIVES)})\b", r"\1")]
    then = [(r"(\w)\s*—\s*(\w)", r"\1, \2"), (r"(\w)\s*--\s*(\w)", r"\1, \2"), (r"\s+,", ","), (r",\s*,", ", "), (r"[ \t]{2,}", " ")]
    last = [(r"^\s*,\s*", ""), (r"\s+([.?!,;:])", r"\1")]
    return f"""
{out}_a AS (SELECT *, {replaced("s", first)} AS x0 FROM {source}),
{out}_b AS (SELECT *, {strip(replaced("x0", then, ""))} AS x1 FROM {out}_a),
{out}_c AS (SELECT *, {replaced("x1", last, "")} AS x2 FROM {out}_b),
{out} AS (SELECT doc_id, i, s, CASE WHEN x2 = '' THEN s WHEN regexp_matches(x2, '^[a-z]') THEN upper(left(x2, 1)) || x2[2:] ELSE x2 END AS x FROM {out}_c)"""


def contracted(out: str, source: str, spread_out: str) -> str:
    """CTE out(doc_id, text, x): texts contracted, or expanded where `spread_out` holds, if their rate is off the target."""
    tokens = "regexp_extract_all(lower(text), '[a-z'']+')"
    rate = f"round(len(list_filter({tokens}, lambda w: contains(w, chr(39)))) / greatest(1, len({tokens})), 4)"
    contract = replaced("text", [(rf"\b{a}\b", b) for a, b in L.CONTRACTIONS])
    expand = replaced("text", [(rf"\b{b}\b", a) for a, b in L.CONTRACTIONS])
    return f"""
{out}_r AS (SELECT *, {rate} AS rate, CASE WHEN {spread_out} THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS goal FROM {source}),
{out} AS (SELECT *, CASE WHEN goal >= rate + 0.012::DOUBLE THEN {contract} WHEN goal <= rate - 0.012::DOUBLE THEN {expand} ELSE text END AS x FROM {out}_r)"""
