"""SQL of the pattern engine's queries, written apart from the DataFrame code: long form, no look-around."""

from __future__ import annotations

from quillspark.functions import pattern_edits as E
from quillspark.functions import pattern_lexicons as L
from quillspark.functions import pattern_rules as R
from quillspark.functions import pattern_text as P
from quillspark.plans import seeded

BASE = f"c AS ({seeded.sql()})"
MODES = ["preserve", "house", "hybrid", "frozen", "other"]
VOICE_MODES = ["batch_only", "voice_pack_only", "hybrid", "frozen_project_voice"]
BUDGETS = ["minimal", "medium", "aggressive"]
#: Voice scores below are outliers.
THRESHOLD = 70
CATEGORIES = ["communication", "hedging", "style", "language", "content", "structure", "soul"]
DERIVED = ["word_count", "sentence_count", "avg_sentence", "sentence_spread", "dialogue_density", "question_rate", "modifier_density", "concrete_density", "abstract_density"]
METRICS = [
    "word_count", "sentence_count", "paragraph_count", "avg_sentence", "avg_paragraph", "sentence_spread", "paragraph_spread", "lexical_diversity", "contraction_rate", "dialogue_density", "em_dash_rate", "semicolon_rate",
    "question_rate", "exclamation_rate", "fragment_rate", "long_sentence_rate", "repetition_rate", "modifier_density", "concrete_density", "abstract_density", "filler_hits", "structure_hits", "fiction_hits", "register_hits", "quality_score", "detector_risk",
]
VOICE = ["batch_distance", "target_distance", "batch_similarity", "target_similarity", "voice_score", "intensity"]
_WHOLE = {"word_count", "sentence_count", "paragraph_count", "filler_hits", "structure_hits", "fiction_hits", "register_hits"}


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SPACES = quote(P.SPACES)
_SPACE = P.SPACE


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(P.WORD)})"


def normalised(x: str) -> str:
    t = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(9), ' ')"
    spaced = f"regexp_replace({t}, '{_SPACE}+' || chr(10), chr(10), 'g')"
    return strip(f"regexp_replace({spaced}, '[ \u00a0]{{2,}}', ' ', 'g')")


def rounded(names: list[str], digits: int = 6) -> str:
    out = []
    for n in names:
        expression, _, alias = n.partition(" AS ")
        out.append(f"CAST({n} AS INTEGER) AS {n}" if n in _WHOLE else f"round({expression} + 1e-9, {digits}) AS {alias or n}")
    return ", ".join(out)


PARAGRAPHS = rf"""{BASE},
blk AS (SELECT doc_id, j, {strip("b")} AS b FROM (SELECT doc_id, unnest(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n{{2,}}')) AS b, unnest(range(len(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n{{2,}}')))) AS j FROM c)),
hd AS (SELECT *, regexp_matches(b, '^#{{1,6}}[ \t]') AND contains(b, chr(10)) AS h FROM blk WHERE b <> ''),
par AS (SELECT doc_id, j, 0 AS k, {strip("CASE WHEN h THEN split_part(b, chr(10), 1) ELSE b END")} AS p FROM hd UNION ALL SELECT doc_id, j, 1, {strip("substr(b, strpos(b, chr(10)) + 1)")} FROM hd WHERE h)"""

_SPLIT = rf"""regexp_replace({strip(f"regexp_replace(text, '{_SPACE}+', ' ', 'g')")}, '([.!?]) ([A-Z0-9"“‘(\[])', '\1' || chr(1) || '\2', 'g')"""
SENTENCES = f"""{BASE},
sl AS (SELECT doc_id, string_split({_SPLIT}, chr(1)) AS l FROM c),
sent AS (SELECT doc_id, unnest(l) AS s, CAST(unnest(range(len(l))) AS INTEGER) AS i FROM sl WHERE NOT (len(l) = 1 AND l[1] = ''))"""


def literal(what: str) -> str:
    return f"(length(text) - length(replace(text, {quote(what)}, ''))) // {len(what)}"


def hits(phrases: list[str]) -> str:
    return "(" + " + ".join(f"(length(low) - length(replace(low, {quote(p)}, ''))) // {len(p)}" for p in phrases) + ")"


def density(of: list[str]) -> str:
    return rf"len(regexp_extract_all(text, '(?i)\b(?:{'|'.join(of)})\b')) / word_count"


_QUOTES = "len(regexp_extract_all(text, '[\"“”]'))"
_COUNTS = f"""
sn AS (SELECT doc_id, count(*) AS k, avg(n) AS mean, stddev_pop(n) AS sd, count(*) FILTER (n < 5) AS short, count(*) FILTER (n > 24) AS long FROM (SELECT doc_id, greatest(1, len({words('s')})) AS n FROM sent) GROUP BY doc_id),
wl AS (SELECT doc_id, lower(unnest(w)) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, {words('text')} AS w FROM c)),
wn AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS uniq, count(*) FILTER (w = before) AS repeats FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM wl) GROUP BY doc_id)"""


def all_metrics() -> str:
    """CTEs that end in m(doc_id, source, METRICS)."""
    over = lambda name, limit: f"greatest(0.0, {name} - {limit})"
    return f"""{PARAGRAPHS},{SENTENCES.removeprefix(BASE + ',')},{_COUNTS},
pn AS (SELECT doc_id, count(*) AS k, avg(n) AS mean, stddev_pop(n) AS sd FROM (SELECT doc_id, greatest(1, len({words('p')})) AS n FROM par WHERE p <> '') GROUP BY doc_id),
m0 AS (SELECT c.doc_id, c.source, c.text, lower(c.text) AS low, greatest(1, coalesce(wn.n, 0)) AS word_count, coalesce(sn.k, 0) AS sentence_count, coalesce(pn.k, 0) AS paragraph_count, coalesce(sn.mean, 0) AS avg_sentence, coalesce(pn.mean, 0) AS avg_paragraph,
  coalesce(sn.sd, 0) AS sentence_spread, coalesce(pn.sd, 0) AS paragraph_spread, coalesce(uniq, 0) / greatest(1, coalesce(wn.n, 0)) AS lexical_diversity, coalesce(repeats, 0) / greatest(1, coalesce(wn.n, 0)) AS repetition_rate,
  coalesce(short, 0) / greatest(1, coalesce(sn.k, 0)) AS fragment_rate, coalesce(long, 0) / greatest(1, coalesce(sn.k, 0)) AS long_sentence_rate, greatest(1, coalesce(sn.k, 0)) AS sents
  FROM c LEFT JOIN sn USING (doc_id) LEFT JOIN pn USING (doc_id) LEFT JOIN wn USING (doc_id)),
m1 AS (SELECT *, len(regexp_extract_all(text, {quote(P.CONTRACTION)})) / word_count AS contraction_rate, {_QUOTES} / 2 / greatest(1, paragraph_count) AS dialogue_density, {literal('—')} / sents AS em_dash_rate, {literal(';')} / sents AS semicolon_rate,
  {literal('?')} / sents AS question_rate, {literal('!')} / sents AS exclamation_rate, {density(L.MODIFIERS)} AS modifier_density, {density(L.CONCRETE)} AS concrete_density, {density(L.ABSTRACT)} AS abstract_density,
  {hits(L.FILLER)} + {hits(L.TRANSITIONS)} AS filler_hits, {hits(L.STRUCTURE)} AS structure_hits, {hits(L.FICTION_TELL)} AS fiction_hits, {hits(L.REGISTER)} AS register_hits FROM m0),
m AS (SELECT *, greatest(0.0, least(100.0, 100 - (5 * filler_hits + 3 * structure_hits + 4 * fiction_hits + 5 * register_hits + 120 * repetition_rate + 1.2 * abs(avg_sentence - 18) + 0.7 * sentence_spread + 0.05 * paragraph_spread + 28 * {over('long_sentence_rate', 0.15)} + 20 * {over('fragment_rate', 0.1)})))::DOUBLE AS quality_score,
  greatest(0.0, least(100.0, 16 + 7.5 * filler_hits + 4.5 * structure_hits + 5 * fiction_hits + 6 * register_hits + 140 * repetition_rate + 100 * modifier_density + 24 * {over('long_sentence_rate', 0.16)} + 18 * {over('fragment_rate', 0.15)}))::DOUBLE AS detector_risk FROM m1)"""


def derived() -> str:
    return f"""{SENTENCES},{_COUNTS},
d0 AS (SELECT c.doc_id, c.text, greatest(1, coalesce(wn.n, 0)) AS word_count, coalesce(sn.k, 0) AS sentence_count, coalesce(sn.mean, 0) AS avg_sentence, coalesce(sn.sd, 0) AS sentence_spread FROM c LEFT JOIN sn USING (doc_id) LEFT JOIN wn USING (doc_id)),
d AS (SELECT *, {_QUOTES} / 2 / greatest(1, len(list_filter(string_split_regex(text, '\\n{{2,}}'), lambda b: b <> ''))) AS dialogue_density, {literal('?')} / greatest(1, sentence_count) AS question_rate,
  {density(L.MODIFIERS)} AS modifier_density, {density(L.DERIVED_CONCRETE)} AS concrete_density, {density(L.DERIVED_ABSTRACT)} AS abstract_density FROM d0)"""


PROFILES = "\np AS (SELECT doc_id, source, " + ", ".join(f"greatest(0.0, least(1.0, {k} * {scale!r}::DOUBLE))::DOUBLE AS {k}" for k, scale in L.PROFILE_SCALE.items()) + " FROM m)"
CENTROIDS = "\ncen AS (SELECT source, " + ", ".join(f"avg({k}) AS {k}" for k in L.PROFILE_SCALE) + " FROM p GROUP BY source)"


def _case(name: str, values: dict[str, float], other: float) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def voice() -> str:
    number = "(length(source) + coalesce(TRY_CAST(regexp_extract(source, '([0-9])$', 1) AS INTEGER), 0))"
    pick = lambda values: "[" + ", ".join(map(quote, values)) + f"][{number} % {len(values)} + 1]"
    keys = list(L.PROFILE_SCALE)
    weight = _case("mode", {k: w for k, (w, _) in L.TARGET_WEIGHTS.items()}, L.OTHER_WEIGHTS[0])
    goal = ", ".join(f"CASE WHEN voice_mode IN ('voice_pack_only', 'frozen_project_voice') THEN f.{k} WHEN voice_mode = 'hybrid' THEN s.{k} * (1 - w) + f.{k} * w ELSE s.{k} END AS {k}" for k in keys)
    gap = lambda x: "(" + " + ".join(f"abs(p.{k} - {x}.{k})" for k in keys) + f") / {len(keys)}"
    return f"""WITH {all_metrics()},{PROFILES},{CENTROIDS},
s AS (SELECT *, {weight} AS w FROM (SELECT *, {pick(MODES)} AS mode, {pick(VOICE_MODES)} AS voice_mode, {pick(BUDGETS)} AS budget FROM cen)),
first AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
goal AS (SELECT s.source, {goal} FROM s JOIN first f USING (source)),
a AS (SELECT p.doc_id, p.source, mode, voice_mode, w, {_case('mode', L.MODE_INTENSITY, 1.0)} * {_case('budget', L.BUDGET_INTENSITY, 1.0)} AS intensity, {gap('s')} AS batch_distance, {gap('g')} AS target_distance FROM p JOIN s ON p.source = s.source JOIN goal g ON p.source = g.source),
b AS (SELECT *, greatest(0.0, least(100.0, 100 - 160 * batch_distance))::DOUBLE AS batch_similarity, greatest(0.0, least(100.0, 100 - 160 * target_distance))::DOUBLE AS target_similarity FROM a),
vs AS (SELECT *, greatest(0.0, least(100.0, target_similarity * w + batch_similarity * (1 - w)))::DOUBLE AS voice_score FROM b)
SELECT doc_id, source, mode, voice_mode, voice_score < {THRESHOLD} OR batch_distance > 0.22 AS outlier, {rounded(VOICE)} FROM vs"""


def labels() -> str:
    html = "'<b>' || head || '</b> & ''so'''"
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        html = f"replace({html}, {quote(sign)}, {quote(entity)})"
    parts = rf"list_filter(string_split_regex(source || '_of-the batch', '(?:_|-|{_SPACE})+'), lambda p: p <> '')"
    return f"""WITH {SENTENCES},
h AS (SELECT c.doc_id, c.source, coalesce(max(s) FILTER (i = 0), '') AS head, count(s) AS n FROM c LEFT JOIN sent USING (doc_id) GROUP BY c.doc_id, c.source)
SELECT doc_id, array_to_string(list_transform({parts}, lambda p: upper(p[1]) || p[2:]), ' ') AS title, {html} AS html,
  coalesce(nullif(left(trim(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '-'), 40), ''), 'batch') AS slug,
  CASE WHEN doc_id % 6 = 0 THEN 'Long · Dialogue' WHEN doc_id % 2 = 0 THEN 'Long' WHEN doc_id % 3 = 0 THEN 'Dialogue' ELSE '' END AS warning,
  CASE WHEN n >= 10 THEN '+' ELSE '−' END || abs(n - 10) AS gap, n || CASE WHEN n = 1 THEN ' sentence' ELSE ' sentences' END AS sentences,
  CASE WHEN doc_id % 100 >= 70 THEN 'good' WHEN doc_id % 100 >= 50 THEN 'warn' ELSE 'danger' END AS high_pill, CASE WHEN doc_id % 100 <= 35 THEN 'good' WHEN doc_id % 100 <= 55 THEN 'warn' ELSE 'danger' END AS low_pill FROM h"""


def catalogue_hits() -> str:
    """CTEs that end in h24(doc_id, no, rule, id, category, excerpt, severity): hits in order, the first 24 of a document."""
    rules = [*R.RULES, *R.DERIVED]
    needles = [(i, kind, x) for i, r in enumerate(R.RULES) for kind, xs in (("p", r.phrases), ("r", r.regexes)) for x in xs]
    needle = ",".join(f"({o},{i},'{kind}',{quote(x if kind == 'p' else x.format(B=chr(92) + 'b', S=_SPACE))})" for o, (i, kind, x) in enumerate(needles))
    weights = ",".join(f"({i},{quote(r.id)},{quote(r.category)},'{m}',{R.weight(r, m)!r}::DOUBLE)" for i, r in enumerate(rules) for m in L.DOCUMENT_MODES)
    return f"""{all_metrics()},
needle(ord, rule, kind, x) AS (VALUES {needle}),
weight(rule, id, category, mode, severity) AS (VALUES {weights}),
md AS (SELECT *, {"[" + ", ".join(map(quote, L.DOCUMENT_MODES)) + "]"}[doc_id % 5 + 1] AS mode FROM m),
start AS (SELECT doc_id, s FROM sent WHERE i = 0),
cand AS (SELECT doc_id, ord, rule, CASE kind WHEN 'p' THEN x ELSE regexp_extract(text, x) END AS needle FROM m, needle WHERE CASE kind WHEN 'p' THEN contains(low, x) ELSE regexp_matches(text, x) END),
inside AS (SELECT c.doc_id, c.ord, min(s.i) AS i FROM cand c JOIN sent s ON s.doc_id = c.doc_id AND contains(lower(s.s), {strip('lower(c.needle)')}) GROUP BY c.doc_id, c.ord),
ex AS (SELECT c.doc_id, c.ord, c.rule, coalesce(s.s, left(coalesce(st.s, c.needle), {R.EXCERPT})) AS excerpt FROM cand c LEFT JOIN inside USING (doc_id, ord) LEFT JOIN sent s ON s.doc_id = c.doc_id AND s.i = inside.i LEFT JOIN start st ON st.doc_id = c.doc_id),
dv AS (SELECT doc_id, 1000 AS ord, {len(R.RULES)} AS rule FROM m WHERE sentence_count >= 5 AND sentence_spread < 4.2
  UNION ALL SELECT doc_id, 1001, {len(R.RULES) + 1} FROM m WHERE word_count > 90 AND abstract_density > concrete_density * 1.35
  UNION ALL SELECT doc_id, 1002, {len(R.RULES) + 2} FROM m WHERE word_count > 120 AND dialogue_density = 0 AND question_rate < 0.02 AND concrete_density < 0.018),
al AS (SELECT doc_id, rule, excerpt, min(ord) AS ord FROM ex GROUP BY doc_id, rule, excerpt UNION ALL SELECT dv.doc_id, rule, left(coalesce(s, {strip('text')}), {R.EXCERPT}), ord FROM dv JOIN m USING (doc_id) LEFT JOIN start USING (doc_id)),
h24 AS (SELECT * FROM (SELECT al.doc_id, al.rule, id, category, excerpt, severity, row_number() OVER (PARTITION BY al.doc_id ORDER BY ord) AS no FROM al JOIN md USING (doc_id) JOIN weight w ON w.rule = al.rule AND w.mode = md.mode WHERE severity > 0) WHERE no <= {R.MOST_HITS})"""


def audit() -> str:
    cut = lambda x, top: f"greatest(0.0, least({top}.0, {x}))"
    return f"""WITH {catalogue_hits()},
per AS (SELECT doc_id, count(*) AS n, sum(severity) * 4.8 AS cost, count(*) FILTER (category = 'communication') * 4.5 AS talk FROM h24 GROUP BY doc_id),
cat AS (SELECT doc_id, category, count(*) AS k, min(no) AS f FROM h24 GROUP BY doc_id, category QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(no)) <= {R.TOP_CATEGORIES}),
cats AS (SELECT doc_id, string_agg(category || ':' || k, ',' ORDER BY k DESC, f) AS top_categories FROM cat GROUP BY doc_id),
fnd AS (SELECT doc_id, no, CASE WHEN severity >= 0.8 THEN 'high' WHEN severity >= 0.58 THEN 'medium' ELSE 'low' END AS p FROM h24 WHERE severity >= 0.72 OR category IN ('communication', 'hedging', 'content', 'soul') OR no <= 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY no) <= {R.MOST_FINDINGS}),
fs AS (SELECT doc_id, string_agg(p, ',' ORDER BY no) AS priorities FROM fnd GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS hit_count, round({cut(f"100 - (coalesce(cost, 0) + coalesce(talk, 0) + CASE WHEN sentence_count >= 5 THEN {cut('(4.5 - sentence_spread) * 5.8', 18)} ELSE 0 END + {cut('(abstract_density - concrete_density) * 95', 16)} + CASE WHEN word_count > 120 AND dialogue_density = 0 THEN {cut('(0.024 - concrete_density) * 320', 12)} ELSE 0 END + {cut('(modifier_density - 0.018) * 260', 12)})", 100)}::DOUBLE + 1e-9, 4) AS humanizer_score,
  coalesce(top_categories, '') AS top_categories, coalesce(priorities, '') AS priorities FROM m LEFT JOIN per USING (doc_id) LEFT JOIN cats USING (doc_id) LEFT JOIN fs USING (doc_id)"""


def gate() -> str:
    return f"""WITH {BASE}, g AS (SELECT doc_id, (doc_id % 9 - 4) / 2 AS q, (doc_id % 7 - 2) / 2 AS r, (doc_id % 11 - 3) / 2 AS h, (doc_id % 10) / 10 AS w, doc_id % 13 = 0 AS same, {"[" + ", ".join(map(quote, BUDGETS)) + "]"}[doc_id % 3 + 1] AS budget, doc_id % 4 = 0 AS high FROM c),
a AS (SELECT doc_id, CASE WHEN same THEN '' ELSE concat_ws(',', CASE WHEN q < -1.5 THEN 'quality' END, CASE WHEN r < -0.5 THEN 'risk' END, CASE WHEN h < -0.5 THEN 'humanizer' END,
  CASE WHEN w < CASE budget WHEN 'aggressive' THEN 0.35 WHEN 'medium' THEN 0.42 ELSE 0.5 END AND q < 8 AND h < 8 THEN 'cut too much' END, CASE WHEN q < 0.5 AND r < 0.5 AND h < 0.5 THEN 'no gain' END, CASE WHEN high AND h < 2 THEN 'residue' END) END AS reasons FROM g)
SELECT doc_id, reasons, reasons = '' AS accepted FROM a"""


_EDITED = SENTENCES.replace(BASE, f"c AS ({seeded.edits_sql()})")


def _pattern(regex: str) -> str:
    return quote(regex.format(B=chr(92) + "b", S=_SPACE))


def edited(x: str, rules: list[tuple[str, str]]) -> str:
    for regex, to in rules:
        x = f"regexp_replace({x}, {_pattern(regex)}, {quote(to.replace('$', chr(92)))}, 'g')"
    return x


def capitalised(x: str) -> str:
    mark = "[\"“‘(\\[]?"
    at = f"length(regexp_extract(r, {quote(f'^{_SPACE}*{mark}')}))"
    begins = f"CASE WHEN i = 1 THEN regexp_matches(r, {quote(f'^{mark}[a-z]')}) ELSE regexp_matches(r, {quote(f'^{_SPACE}+{mark}[a-z]')}) END"
    return f"array_to_string(list_transform(regexp_extract_all({strip(x)}, '[^.!?]+|[.!?]'), lambda r, i: CASE WHEN {begins} THEN left(r, {at}) || upper(substr(r, {at} + 1, 1)) || substr(r, {at} + 2) ELSE r END), '')"


def smooth() -> str:
    as_if = _pattern(E.AS_IF)
    whole = f"CASE WHEN regexp_matches(s, {as_if}) THEN {capitalised(f'regexp_extract(s, {as_if}, 1)')} || coalesce(nullif(regexp_extract(s, {as_if}, 2), ''), '.') ELSE s END"
    return f"""WITH {_EDITED},
e0 AS (SELECT doc_id, i, {edited(edited("s", E.TIGHTEN), E.PHRASES)} AS s FROM sent),
e1 AS (SELECT doc_id, i, {edited(whole, E.ENDINGS)} AS s FROM e0)
SELECT doc_id, i AS sentence_no, {capitalised(edited("s", E.FINAL))} AS sentence FROM e1"""


def by_category() -> str:
    listed = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    plain = f"mode NOT IN ({', '.join(map(quote, E.NARRATIVE))})"
    when = {"always": "true", "plain": plain, "marketing": "mode = 'marketing'", "not marketing": "mode <> 'marketing'", "aggressive": "strong", "plain, not aggressive": f"{plain} AND NOT strong", "plain, inflated": f"{plain} AND inflated"}
    steps, last = "", "k"
    for n, (cats, condition, rules) in enumerate(E.BY_CATEGORY):
        steps += f",\nk{n} AS (SELECT * REPLACE (CASE WHEN list_has_any(cats, {listed(cats)}) AND {when[condition]} THEN {edited('s', rules)} ELSE s END AS s) FROM {last})"
        last = f"k{n}"
    return f"""WITH {_EDITED},
k AS (SELECT *, [{listed(CATEGORIES)}[doc_id % {len(CATEGORIES)} + 1], {listed(CATEGORIES)}[doc_id // {len(CATEGORIES)} % {len(CATEGORIES)} + 1]] AS cats, {listed(L.DOCUMENT_MODES)}[doc_id % 5 + 1] AS mode, doc_id % 3 = 0 AS strong, doc_id % 2 = 0 AS inflated FROM sent){steps}
SELECT doc_id, i AS sentence_no, {strip(edited("s", E.SPACING))} AS sentence FROM {last}"""


def lead_runs() -> str:
    low, high = E.SHORT
    lead = "list_aggregate(w[1:2], 'string_agg', ' ')"
    return f"""WITH {_EDITED},
t AS (SELECT doc_id, i, s, w, CASE WHEN len(w) BETWEEN {low} AND {high} THEN lower({lead}) END AS lead FROM (SELECT *, {words('s')} AS w FROM sent)),
n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lead ORDER BY i) AS island FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lead, island ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, lead, island) AS n FROM n WHERE lead IS NOT NULL),
q AS (SELECT *, pos // 3 < n // 3 AS trio FROM p),
j AS (SELECT doc_id, min(i) AS i, arg_min({lead}, i) || ' ' || string_agg(array_to_string(w[3:], ' '), ', then ' ORDER BY i) || '.' AS s FROM q WHERE trio GROUP BY doc_id, lead, island, pos // 3)
SELECT doc_id, i AS sentence_no, s AS sentence FROM n WHERE lead IS NULL UNION ALL SELECT doc_id, i, s FROM q WHERE NOT trio UNION ALL SELECT doc_id, i, {capitalised('s')} FROM j"""


def subject_clauses() -> str:
    """By splitting: RE2 has no backreferences, so the three subjects are compared after the match."""
    subject = "(the [a-z](?:[a-z'-]|{S}){{1,30}}|[A-Z][a-z]+)"
    clauses = _pattern(rf"(?i)\b{subject}{{S}}+was{{S}}+([^,]+),{{S}}+{subject}{{S}}+was{{S}}+([^,]+),{{S}}+and{{S}}+{subject}{{S}}+was{{S}}+([^.!?]+)([.!?])?")
    part = lambda i: f"regexp_extract(s, {clauses}, {i})"
    wrapping = f"(?:{_SPACE}|[,;:.-])+"
    bare = lambda x: strip(f"regexp_replace(regexp_replace({x}, '^{wrapping}', ''), '{wrapping}$', '')")
    one = f"{capitalised('a')} || ' was ' || {bare('p')} || ', ' || {bare('q')} || ', and ' || {bare('r')} || coalesce(nullif(e, ''), '.')"
    return f"""WITH {_EDITED},
m AS (SELECT *, regexp_extract(s, {clauses}) AS m, {part(1)} AS a, {part(2)} AS p, {part(3)} AS b, {part(4)} AS q, {part(5)} AS c, {part(6)} AS r, {part(7)} AS e FROM sent),
n AS (SELECT *, m <> '' AND lower(a) = lower(b) AND lower(a) = lower(c) AS same, {one} AS new FROM m)
SELECT doc_id, i AS sentence_no, CASE WHEN same THEN left(s, strpos(s, m) - 1) || new || substr(s, strpos(s, m) + length(m)) ELSE s END AS sentence FROM n"""


def annotations() -> str:
    rules = [*R.RULES, *R.DERIVED]
    hints = ",".join(f"({quote(r.id)},{quote(R.HINTS[r.id])})" for r in rules)
    plain = f"mode NOT IN ({', '.join(map(quote, E.NARRATIVE))})"
    any_of = lambda phrases: "(" + " OR ".join(f"contains(lower(s), {quote(p)})" for p in phrases) + ")"
    opener = _pattern(R.RULES[R.OPENER].regexes[0])
    tests = [f"regexp_matches(s, {opener})", any_of(L.STRUCTURE), f"NOT ({plain}) AND {any_of(L.FICTION_TELL)}", f"{plain} AND {any_of(L.REGISTER)}", f"len({words('s')}) > {R.LONG} AND regexp_matches(s, '[—;:]')"]
    per = " UNION ALL ".join(f"SELECT doc_id, 1000 + i * 10 + {k} AS ord, {quote(kind)} AS type, s AS original, {quote(reason)} AS reason FROM sm WHERE {test}" for k, (test, (kind, reason)) in enumerate(zip(tests, R.REMARKS.items(), strict=True)))
    filler = " OR ".join(f"contains(lower(text), {quote(p)})" for p in L.FILLER)
    return f"""WITH {catalogue_hits()},
hint(id, hint) AS (VALUES {hints}),
sm AS (SELECT sent.doc_id, i, s, mode FROM sent JOIN md USING (doc_id)),
nt AS (SELECT doc_id, no AS ord, category AS type, excerpt AS original, hint AS reason FROM h24 JOIN hint USING (id) WHERE no <= {R.HIT_NOTES} UNION ALL {per}),
few AS (SELECT c.doc_id FROM c LEFT JOIN nt USING (doc_id) GROUP BY c.doc_id HAVING count(nt.ord) < {R.FEW_NOTES}),
al2 AS (FROM nt UNION ALL SELECT doc_id, 1000000000, {quote(R.FALLBACK[0])}, string_split_regex(text, '\\n+')[1], {quote(R.FALLBACK[1])} FROM c JOIN few USING (doc_id) WHERE {filler})
SELECT doc_id, no - 1 AS note_no, type, original, reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS no FROM al2) WHERE no <= {R.MOST_NOTES}"""
