"""Queries of the core engine over the seeded corpus, with their SQL.

Arrays that are worked out are exploded by the outer variants, and what is null is left out after that: of the
others Spark infers a filter on the array's size, for which it works the array out once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions import text as T
from quillspark.operators import rewrite, signals, voice
from quillspark.plans import batch, core_sql as S, seeded
from quillspark.plans.lineage import kept
from quillspark.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded.documents(spark, sf_dir)


_LINES = f"WITH {S.BASE}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM c)"


@query(_LINES + r" SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, '^(?:\s*#{1,6}\s|\s*[-*+]\s|\s*\d+\.\s|\s*>\s|\s*```|\s*\|)')")
def structural_lines(spark, sf_dir):
    lines = corpus(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    return lines.where(T.is_structural_line(F.col("line")))


@query(rf"WITH {S.BASE} SELECT doc_id, list_filter(list_transform(string_split_regex({S.strip('replace(text, chr(13) || chr(10), chr(10))')}, '\n{{2,}}'), lambda p: {S.strip('p')}), lambda p: p <> '') AS paragraphs FROM c")
def split_paragraphs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))


@query(f"WITH {S.BASE},{S.sentences('sent', 'c', 'doc_id', 'text')} SELECT doc_id, i AS sentence_no, s AS sentence FROM sent")
def split_sentences_core(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("sentence_no", "sentence")).where("sentence_no IS NOT NULL")


@query(f"WITH {S.BASE} SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS tokens FROM c")
def tokenize(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {S.BASE},{S.sentences('sent', 'c', 'doc_id', 'text')},{S.sentence_facts('f', 'sent', 'doc_id')} SELECT doc_id, list(n ORDER BY i) AS lengths, avg(n) AS mean_length, CASE WHEN count(*) > 1 THEN stddev_pop(n) ELSE 0 END AS std_length FROM f GROUP BY doc_id")
def sentence_lengths(spark, sf_dir):
    d = signals.segment(corpus(spark, sf_dir))
    return d.select("doc_id", F.col("__len").alias("lengths"), T.mean(F.col("__len")).alias("mean_length"), T.stdev(F.col("__len")).alias("std_length"))


@query(f"WITH {S.BASE} SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: contains(w, ''''))) AS contractions FROM c")
def contraction_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.how_many(T.tokens(F.col("text")), lambda w: F.contains(w, F.lit("'"))).cast("long").alias("contractions"))


@query(f"WITH {S.BASE} SELECT doc_id, phrase, hits FROM (SELECT doc_id, unnest({'[' + ', '.join(map(S.quote, L.TRANSITIONS)) + ']'}) AS phrase, unnest([{', '.join(S.counted(S.ASCII.format('text'), S.words([p])) for p in L.TRANSITIONS)}]) AS hits FROM c) WHERE hits > 0")
def phrase_hits(spark, sf_dir):
    d = corpus(spark, sf_dir)
    hits = F.array(*[F.struct(F.lit(p).alias("phrase"), T.count(F.col("text"), T.words_pattern([p])).alias("hits")) for p in L.TRANSITIONS])
    return d.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h["hits"] > 0)).alias("h")).where("h IS NOT NULL").select("doc_id", "h.phrase", "h.hits")


@query(f"WITH {S.BASE} SELECT doc_id, {S.counted(S.ASCII.format('text'), S.PASSIVE)} AS passive_hits FROM c")
def passive_hits(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.count(F.col("text"), T.PASSIVE).alias("passive_hits"))


_MARKS = {"quotes": '"', "commas": ",", "questions": "?", "exclamations": "!", "semicolons": ";", "em_dashes": "—", "double_hyphens": "--"}


@query(f"WITH {S.BASE} SELECT doc_id, {', '.join(S.literal('text', m) + ' AS ' + k for k, m in _MARKS.items())} FROM c")
def char_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", *[T.count_literal(F.col("text"), m).alias(k) for k, m in _MARKS.items()])


@query(f"WITH {S.BASE} SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower({S.strip('text')}), '[^a-zA-Z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM c")
def slugify(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"WITH {S.BASE}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM c),{S.diversity('ld', 'tok', 'doc_id', 't')} SELECT doc_id, round(coalesce(ld, 0) + 1e-9, 6) AS lexical_diversity FROM c LEFT JOIN ld USING (doc_id)")
def lexical_diversity_chunked(spark, sf_dir):
    d = corpus(spark, sf_dir).withColumn("w", T.tokens(F.col("text")))
    return d.select("doc_id", F.round(T.lexical_diversity(F.col("w")) + 1e-9, 6).alias("lexical_diversity"))


@query(f"WITH {S.BASE}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM c) SELECT doc_id, {', '.join(f'len(list_filter(t, lambda w: {test}))::INT AS {k}' for k, test in {'intensifiers': 'w IN ' + S.names(L.INTENSIFIERS), 'generic': 'w IN ' + S.names(L.GENERIC_WORDS), 'abstract': 'w IN ' + S.names(L.ABSTRACT_WORDS), 'modifiers': S.MODIFIER}.items())} FROM tok")
def token_class_counts(spark, sf_dir):
    d = corpus(spark, sf_dir).withColumn("w", T.tokens(F.col("text")))
    tests = {"intensifiers": lambda w: w.isin(L.INTENSIFIERS), "generic": lambda w: w.isin(L.GENERIC_WORDS), "abstract": lambda w: w.isin(L.ABSTRACT_WORDS), "modifiers": T.is_modifier}
    return d.select("doc_id", *[T.how_many(F.col("w"), f).alias(k) for k, f in tests.items()])


_FACTS = f"WITH {S.BASE},{S.sentences('sent', 'c', 'doc_id', 'text')},{S.sentence_facts('f', 'sent', 'doc_id')}"


@query(_FACTS + " SELECT doc_id, count(*) FILTER (mono) AS monotonous_runs FROM f GROUP BY doc_id")
def monotonous_runs(spark, sf_dir):
    d = signals.segment(corpus(spark, sf_dir))
    return d.select("doc_id", T.truths(T.monotonous(F.col("__len"))).cast("long").alias("monotonous_runs"))


@query(_FACTS + ", opening AS (SELECT doc_id, start, lag(start) OVER o AS a, lag(start, 2) OVER o AS b FROM f WHERE start <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(*) FILTER (start = a AND start = b) AS repeated_starts FROM c LEFT JOIN opening USING (doc_id) GROUP BY doc_id")
def repeated_starts(spark, sf_dir):
    d = signals.segment(corpus(spark, sf_dir))
    return d.select("doc_id", T.truths(T.repeated(F.filter("__start", lambda s: s != ""))).cast("long").alias("repeated_starts"))


@query(_FACTS + "," + S.annotations("ann", "f", "doc_id") + " SELECT doc_id, type, severity, original, sentence, rule FROM ann_all")
def sentence_annotations(spark, sf_dir):
    """All annotations, one row each, before repeated ones go."""
    d = signals.annotate(corpus(spark, sf_dir))
    d = d.select("doc_id", F.posexplode(F.arrays_zip("__s", "__st", "__mono", "__same")).alias("sentence", "z")).select("doc_id", "sentence", "z.*").withColumnRenamed("__s", "original")
    rows = [F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(n).alias("rule"))) for n, ((kind, severity, _), hit) in enumerate(zip(signals.RULES, signals.found(F.col("original"), F.col("__st"), F.col("__mono"), F.col("__same")), strict=True))]
    d = d.select("doc_id", "sentence", "original", F.explode_outer(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("a")).where("a IS NOT NULL")
    return d.select("doc_id", "a.type", "a.severity", "original", "sentence", "a.rule")


@query(_FACTS + "," + S.annotations("ann", "f", "doc_id") + " SELECT doc_id, type, severity, original, sentence, rule FROM ann")
def annotation_dedupe(spark, sf_dir):
    d = signals.annotate(corpus(spark, sf_dir)).select("doc_id", F.explode_outer("__ann").alias("a")).where("a IS NOT NULL")
    return d.select("doc_id", "a.type", "a.severity", "a.original", "a.sentence", "a.rule")


@query(f"WITH {S.core()} SELECT doc_id, {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in [*signals.SIGNALS, 'sentence_count', 'word_count'])} FROM sig")
def signals_all(spark, sf_dir):
    return signals.signals(corpus(spark, sf_dir)).select("doc_id", *signals.SIGNALS, "sentence_count", "word_count")


@query(f"WITH {S.core()} SELECT doc_id, {', '.join(signals.AXES)}, quality_score FROM sig")
def quality_axes(spark, sf_dir):
    return signals.scores(corpus(spark, sf_dir)).select("doc_id", *signals.AXES, "quality_score")


@query(f"WITH {S.core()} SELECT doc_id, detector_risk FROM sig")
def detector_risk(spark, sf_dir):
    return signals.scores(corpus(spark, sf_dir)).select("doc_id", "detector_risk")


_UNFLAGGED = f"""
p0 AS (SELECT doc_id, unnest(string_split_regex({S.strip('text')}, '\\n{{2,}}')) AS q, unnest(range(len(string_split_regex({S.strip('text')}, '\\n{{2,}}')))) AS j FROM c),
p1 AS (SELECT doc_id * 100000 + j AS pk, doc_id, j, {S.strip('q')} AS q FROM p0 WHERE {S.strip('q')} <> ''),{S.sentences('ps', 'p1', 'pk', 'q')},
left_over AS (SELECT doc_id, j, i, s FROM ps JOIN p1 USING (pk) WHERE NOT EXISTS (FROM ann WHERE ann.doc_id = p1.doc_id AND severity >= 55 AND {S.strip('original')} = {S.strip('s')})),
paras AS (SELECT doc_id, j, string_agg(s, ' ' ORDER BY i) AS q FROM left_over GROUP BY doc_id, j),
clean AS (SELECT doc_id, string_agg(q, chr(10) || chr(10) ORDER BY j) AS q FROM paras GROUP BY doc_id),
cl AS (SELECT doc_id, source, CASE WHEN EXISTS (FROM ann WHERE ann.doc_id = c.doc_id AND severity >= 55) THEN coalesce(nullif({S.strip('q')}, ''), text) ELSE text END AS clean_text FROM c LEFT JOIN clean USING (doc_id))"""
_CLEAN = f"""{_FACTS},{S.annotations("ann", "f", "doc_id")},{_UNFLAGGED}"""


@query(_CLEAN + " SELECT doc_id, clean_text FROM cl")
def unflagged_text(spark, sf_dir):
    return signals.unflagged(signals.annotate(corpus(spark, sf_dir))).select("doc_id", F.col("__clean").alias("clean_text"))


_PROFILE = f"WITH {S.BASE},{S.profiles('vp', 'c', 'doc_id', 'text')}"


def _profiled(spark, sf_dir):
    return voice.profiled(corpus(spark, sf_dir).select("doc_id", "text", "source"), "text", "p")


@query(f"{_PROFILE} SELECT doc_id, {', '.join(voice.KEYS)} FROM vp")
def voice_profile(spark, sf_dir):
    return _profiled(spark, sf_dir).select("doc_id", "p.*")


@query(f"WITH t0 AS ({seeded.sql()}), c AS (SELECT doc_id, {S.strip('text')} AS text, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE ' ' || source END AS name FROM t0 WHERE doc_id % 3 <> 0 AND {S.strip('text')} <> ''),{S.profiles('vp', 'c', 'doc_id', 'text')} SELECT doc_id AS id, coalesce(nullif({S.strip('name')}, ''), 'Untitled Voice') AS name, CAST(len(regexp_extract_all(lower(text), '[a-z'']+')) AS INTEGER) AS sample_size, {', '.join(voice.KEYS)} FROM vp JOIN c USING (doc_id)")
def new_voice_packs(spark, sf_dir):
    """Voice packs from the texts as samples; every third sample and some names are blank."""
    n = F.col("doc_id")
    d = corpus(spark, sf_dir).select(n.alias("id"), F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "source")).alias("name"), F.when(n % 3 == 0, " \n").otherwise(F.col("text")).alias("sample_text"), F.lit("2024").alias("created_at"))
    return store.new_packs(d).select("id", "name", "sample_size", "profile.*")


_MEANS = ", ".join(f"round(avg({k}) + 1e-9, 4) AS {k}" for k in voice.KEYS)
_BLEND = f"{_PROFILE}, b AS (SELECT source, {_MEANS} FROM vp JOIN c USING (doc_id) GROUP BY source)"


@query(f"{_BLEND} SELECT * FROM b")
def blend_profiles(spark, sf_dir):
    return _profiled(spark, sf_dir).groupBy("source").agg(voice.blended(F.col("p")).alias("p")).select("source", "p.*")


def _with_batch(d):
    blend = d.groupBy("source").agg(voice.blended(F.col("p")).alias("b"))
    return d.join(blend, "source")


@query(f"{_BLEND} SELECT doc_id, {S.distance('vp', 'b')} AS distance FROM vp JOIN c USING (doc_id) JOIN b ON b.source = c.source")
def voice_distance(spark, sf_dir):
    return _with_batch(_profiled(spark, sf_dir)).select("doc_id", voice.distance(F.col("p"), F.col("b")).alias("distance"))


def _reason(t, p):
    gaps = [f"abs({t}.{k} - {p}.{k})" for _, k in voice.REASONS]
    most = f"greatest({', '.join(gaps)})"
    return f"CASE WHEN {most} < {voice.LEAST_REASON} THEN '{voice.NO_REASON}' " + " ".join(f"WHEN {g} = {most} THEN '{label}'" for (label, _), g in zip(voice.REASONS, gaps, strict=True)) + " END"


@query(f"{_BLEND} SELECT doc_id, {_reason('b', 'vp')} AS reason FROM vp JOIN c USING (doc_id) JOIN b ON b.source = c.source")
def outlier_reason(spark, sf_dir):
    return _with_batch(_profiled(spark, sf_dir)).select("doc_id", voice.outlier_reason(F.col("p"), F.col("b")).alias("reason"))


@query(f"{_PROFILE}, m AS (SELECT vp.*, source FROM vp JOIN c USING (doc_id)) SELECT a.source, count(*) AS pairs, round(avg({S.distance('a', 'b', None)}) + 1e-9, 4) AS batch_voice_variance FROM m a JOIN m b ON a.source = b.source AND a.doc_id < b.doc_id GROUP BY a.source")
def batch_pair_variance(spark, sf_dir):
    return voice.variance(_profiled(spark, sf_dir), "source", "doc_id", "p")


_HOUSE = "CASE WHEN modes.mode = 'house-voice' THEN "


@query(
    f"{_BLEND}, h AS (SELECT {_MEANS} FROM vp JOIN labels l USING (doc_id) WHERE l.quality = 1), modes AS (SELECT source, CASE CAST(replace(source, 'src', '') AS INTEGER) % 3 WHEN 0 THEN 'house-voice' WHEN 1 THEN 'hybrid' ELSE 'preserve-batch-voice' END AS mode FROM b) "
    f"SELECT source, mode, {', '.join(f'CASE mode WHEN ' + chr(39) + 'house-voice' + chr(39) + f' THEN h.{k} WHEN ' + chr(39) + 'hybrid' + chr(39) + f' THEN round((b.{k} + h.{k}) / 2 + 1e-9, 4) ELSE b.{k} END AS {k}' for k in voice.KEYS)} FROM b JOIN modes USING (source), h"
)
def target_profile(spark, sf_dir):
    """Targets of batches in all three modes; the house's voice is that of documents labelled as good."""
    d = _profiled(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    house = d.join(good, "doc_id").agg(voice.blended(F.col("p")).alias("h"))  # one row
    number = F.regexp_replace("source", "src", "").cast("int") % 3
    mode = F.when(number == 0, "house-voice").when(number == 1, "hybrid").otherwise("preserve-batch-voice")
    b = d.groupBy("source").agg(voice.blended(F.col("p")).alias("b")).withColumn("mode", mode).join(F.broadcast(house))
    none = F.lit(None).cast(b.schema["b"].dataType)
    return b.select("source", "mode", batch.target_profile(F.col("mode"), F.col("b"), F.col("h"), none).alias("t")).select("source", "mode", "t.*")


def _quoted(rules):
    sql = "text"
    for pattern, new in rules:
        sql = f"regexp_replace({sql}, {S.quote('(?i)' + pattern)}, {S.quote(new)}, 'g')"
    return sql


_BIAS_TEXT = "regexp_replace(regexp_replace({0}, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.?!,;:])', '\\1', 'g')"


@query(
    f"WITH {S.BASE}, a AS (SELECT doc_id, {S.ASCII.format('text')} AS text FROM c), m AS (SELECT doc_id, ['fiction', 'essay', 'marketing', 'business', 'worldbuilding'][doc_id % 5 + 1] AS mode, text FROM a), "
    f"b AS (SELECT doc_id, mode, {_BIAS_TEXT.format('CASE mode ' + ' '.join(f'WHEN {S.quote(k)} THEN {_quoted(r)}' for k, r in rewrite.MODE_RULES.items()) + ' END')} AS x FROM m) "
    f"SELECT doc_id, mode, {S.strip('CASE WHEN regexp_matches(x, ' + chr(39) + '^[a-z]' + chr(39) + ') THEN upper(left(x, 1)) || x[2:] ELSE x END')} AS biased FROM b"
)
def mode_bias(spark, sf_dir):
    """Document-mode substitutions; accented letters are x on both sides, for RE2's word boundaries."""
    modes = F.element_at(F.array(*map(F.lit, rewrite.MODES)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = corpus(spark, sf_dir).select("doc_id", modes.alias("mode"), F.regexp_replace("text", "[À-ÖØ-öø-ÿĀ-ɏ]", "x").alias("text"))
    return d.select("doc_id", "mode", rewrite.document_mode_bias(F.col("text"), F.col("mode")).alias("biased"))


_PLAIN = f"WITH {S.BASE}, a AS (SELECT doc_id, {S.ASCII.format('text')} AS text FROM c)"


def _plain(spark, sf_dir):
    """The corpus with accented letters as x, for RE2's word boundaries."""
    return corpus(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[À-ÖØ-öø-ÿĀ-ɏ]", "x").alias("text"))


@query(f"{_PLAIN},{S.sentences('sent', 'a', 'doc_id', 'text')},{S.cleaned('cl', 'sent')} SELECT doc_id, i AS sentence_no, x AS cleaned FROM cl")
def cleanup_sentence(spark, sf_dir):
    d = _plain(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("sentence_no", "sentence")).where("sentence_no IS NOT NULL")
    return d.select("doc_id", "sentence_no", rewrite.cleanup_sentence(F.col("sentence")).alias("cleaned"))


@query(f"{_PLAIN},{S.contracted('cb', 'a', 'doc_id % 2 = 0')} SELECT doc_id, x AS biased FROM cb")
def contraction_bias(spark, sf_dir):
    return _plain(spark, sf_dir).select("doc_id", rewrite.contraction_bias(F.col("text"), F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.5)).alias("biased"))


@query()
def align_lengths(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", rewrite.align_lengths(F.col("text"), F.lit(12.0)).alias("aligned"))


@query(
    _LINES
    + """, k AS (SELECT *, starts_with(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '```') AS fence FROM l),
n AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS inside FROM k),
p AS (SELECT *, NOT fence AND NOT inside AND trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(line, '^(?:\\s*#{1,6}\\s|\\s*[-*+]\\s|\\s*\\d+\\.\\s|\\s*>\\s|\\s*```|\\s*\\|)') AS prose FROM n),
g AS (SELECT *, sum(CASE WHEN prose AND coalesce(lag_prose, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM (SELECT *, lag(prose) OVER (PARTITION BY doc_id ORDER BY line_no) AS lag_prose FROM p))
SELECT doc_id, CAST(block - 1 AS INTEGER) AS block, any_value(prose) AS prose, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY doc_id, block"""
)
def fence_blocks(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id", F.posexplode_outer(rewrite.blocks(F.col("text"))).alias("block", "b")).where("block IS NOT NULL")
    return d.select("doc_id", "block", "b.prose", "b.text")


def _packs(spark, sf_dir):
    """One pack, the voice of documents labelled as good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return _profiled(spark, sf_dir).join(good, "doc_id").agg(voice.blended(F.col("p")).alias("profile")).select(F.lit("good").alias("id"), "profile")


def _processed(spark, sf_dir):
    docs = corpus(spark, sf_dir).select(F.col("source").alias("batch_id"), "doc_id", F.col("text").alias("original_text"))
    number = F.regexp_replace("batch_id", "src", "").cast("int") % 3
    mode = F.when(number == 0, "house-voice").when(number == 1, "hybrid").otherwise("preserve-batch-voice")
    digit = F.regexp_replace("batch_id", "src", "").cast("int")
    pack = F.when(digit % 2 == 0, F.when(digit % 4 == 0, "good").otherwise("no such pack"))
    batches = docs.select("batch_id").distinct().select("batch_id", mode.alias("mode"), F.when(number == 2, "minimal").otherwise("medium").alias("edit_budget"), F.lit("We can't wait. It's late! The rain fell on the roof all night, and nobody slept.").alias("house_voice_samples"), pack.alias("voice_pack_id"))
    return batch.process(docs, batches, _packs(spark, sf_dir))


@query()
def rewrite_text(spark, sf_dir):
    return _processed(spark, sf_dir).select("batch_id", "doc_id", "revised_text", "change_count")


@query()
def document_scores(spark, sf_dir):
    p = _processed(spark, sf_dir)
    phase = lambda x: [F.col(f"{x}_analysis.{k}").alias(f"{x}_{k}") for k in ("quality_score", "detector_risk")]
    return p.select("batch_id", "doc_id", *phase("original"), *phase("revised"), "quality_delta", "detector_risk_delta", "voice_similarity_score", "is_outlier", "outlier_reason", "change_count")


@query()
def batch_summary(spark, sf_dir):
    return batch.summary(_processed(spark, sf_dir))


@query()
def portable_check(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    seed = F.element_at(F.array(*map(F.lit, seeded.SEEDS)), (F.col("conv_id") % len(seeded.SEEDS) + 1).cast("int"))
    mode = F.element_at(F.array(*map(F.lit, rewrite.MODES)), (F.col("turn") % 5 + 1).cast("int"))
    r = c.select("conv_id", "turn", F.concat_ws(" ", "text", seed).alias("text"), mode.alias("document_mode"), F.lit("hybrid").alias("mode"), F.lit(None).cast("string").alias("edit_budget"), (F.col("turn") % 3 < 2).alias("rewrite"), F.lit("Short. It's plain.").alias("house_voice_samples"), F.when(F.col("turn") % 2 == 0, "good").otherwise("").alias("voice_pack_id"))
    out = batch.check(r, _packs(spark, sf_dir))
    return out.select("conv_id", "turn", "revised_text", "change_count", "quality_delta", "detector_risk_delta", "voice_similarity_score", "accepted")


@query(f"WITH {S.core()} SELECT doc_id, phase, detector, score FROM (SELECT doc_id, 'original' AS phase, 'local-risk-panel' AS detector, detector_risk AS score FROM sig UNION ALL SELECT doc_id, 'quality', 'local-quality', quality_score FROM sig)")
def detector_results_unpivot(spark, sf_dir):
    s = signals.scores(corpus(spark, sf_dir)).select("doc_id", "detector_risk", "quality_score")
    return s.select("doc_id", F.expr("stack(2, 'original', 'local-risk-panel', detector_risk, 'quality', 'local-quality', quality_score) AS (phase, detector, score)"))


_KEYS = ", ".join(voice.KEYS)
_ANALYSED = f"{S.core()},{_UNFLAGGED},{S.profiles('vp', 'cl', 'doc_id', 'clean_text')} SELECT doc_id, sig.source, directness, density, rhythm, authenticity, specificity, quality_score, detector_risk, {_KEYS} FROM sig JOIN vp USING (doc_id)"
_PLAIN_ANALYSED = _ANALYSED.replace(S.BASE, "c AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents)")
_NUMBER = "CAST(replace(b.source, 'src', '') AS INTEGER) % 3"
_MOVED = f"""WITH o AS (WITH {_ANALYSED}), r AS (WITH {_PLAIN_ANALYSED}),
b AS (SELECT source, {_MEANS} FROM o GROUP BY source), h AS (SELECT {_MEANS} FROM o JOIN labels l USING (doc_id) WHERE l.quality = 1),
tg AS (SELECT b.source, {', '.join(f'CASE {_NUMBER} WHEN 0 THEN h.{k} WHEN 1 THEN round((b.{k} + h.{k}) / 2 + 1e-9, 4) ELSE b.{k} END AS {k}' for k in voice.KEYS)} FROM b, h),
mv0 AS (SELECT o.doc_id, o.source, o.quality_score AS q0, r.quality_score AS q1, o.detector_risk AS d0, r.detector_risk AS d1, {S.distance('r', 'tg')} AS far, {_reason('tg', 'r')} AS reason FROM o JOIN r USING (doc_id) JOIN tg ON tg.source = o.source),
mv AS (SELECT doc_id, source, q0, q1, round(q1 - q0, 1) AS qd, d0, d1, round(d0 - d1, 1) AS dd, greatest(0, least(100, round(CAST(CAST(100 - 100 * far AS VARCHAR) AS DECIMAL(30, 20)), 1)))::DOUBLE AS alike, far, reason FROM mv0),
out AS (SELECT mv.*, far >= 0.32 OR alike < 74 AS is_outlier, CASE WHEN far >= 0.32 OR alike < 74 THEN reason ELSE '' END AS outlier_reason FROM mv)"""


def _shortened(spark, sf_dir):
    """What a run makes of documents of which a revision is given: the texts without what was added to them.

    Analyses, targets, movements and outliers are those of a run; only the rewriting, which SQL can't express, is not in it.
    """
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("revised_text"))
    docs = corpus(spark, sf_dir).select(F.col("source").alias("batch_id"), "doc_id", F.col("text").alias("original_text")).join(plain, "doc_id")
    analysed = kept(signals.analyse(signals.analyse(docs, "original_text", "original_analysis"), "revised_text", "revised_analysis").drop("original_text", "revised_text"))
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    packs = analysed.join(good, "doc_id").agg(voice.blended(F.col("original_analysis.voice_profile")).alias("profile")).select(F.lit("good").alias("id"), "profile")
    number = F.regexp_replace("batch_id", "src", "").cast("int") % 3
    mode = F.when(number == 0, "house-voice").when(number == 1, "hybrid").otherwise("preserve-batch-voice")
    batches = analysed.select("batch_id").distinct().select("batch_id", mode.alias("mode"), F.lit("medium").alias("edit_budget"), F.lit("").alias("house_voice_samples"), F.lit("good").alias("voice_pack_id"))
    t = batch.targets(analysed, batches, packs).select("batch_id", "target_profile")
    d = batch.outliers(batch.deltas(analysed.join(t, "batch_id"))).withColumn("status", F.lit("done"))
    return d.withColumns({"id": F.col("doc_id"), "name": F.concat(F.lit("Doc "), "doc_id")})


@query(f"{_MOVED} SELECT doc_id AS document_id, 'Doc ' || doc_id AS name, q0 AS quality_original, q1 AS quality_revised, qd AS quality_delta, d0 AS detector_risk_original, d1 AS detector_risk_revised, dd AS detector_risk_delta, alike AS voice_similarity_score, is_outlier, outlier_reason FROM out")
def score_report(spark, sf_dir):
    """The scores report of documents of which a revision is given."""
    return store.score_rows(_shortened(spark, sf_dir))


@query(f"WITH o AS (WITH {_ANALYSED}), r AS (WITH {_PLAIN_ANALYSED}) SELECT doc_id AS document_id, 'original' AS phase, 'local-risk-panel' AS detector_name, detector_risk AS raw_score FROM o UNION ALL SELECT doc_id, 'revised', 'local-risk-panel', detector_risk FROM r")
def detector_results(spark, sf_dir):
    """Detector results, two rows a document."""
    return store.phase_rows(_shortened(spark, sf_dir))[0]


@query(f"WITH o AS (WITH {_ANALYSED}), r AS (WITH {_PLAIN_ANALYSED}), x AS (SELECT 'original' AS phase, * FROM o UNION ALL SELECT 'revised', * FROM r) SELECT doc_id AS document_id, phase, directness, density, rhythm, authenticity, specificity, quality_score FROM x")
def quality_results(spark, sf_dir):
    """Axes and quality, two rows a document."""
    return store.phase_rows(_shortened(spark, sf_dir))[1].select("document_id", "phase", "scores.*", "quality_score")


@query(
    f"""{_MOVED}, pv AS (SELECT a.source, avg({S.distance('a', 'b2', None)}) AS v FROM r a JOIN r b2 ON a.source = b2.source AND a.doc_id < b2.doc_id GROUP BY a.source)
SELECT out.source AS batch_id, count(*) AS document_count, round(avg(qd) + 1e-9, 1) AS avg_quality_delta, round(avg(dd) + 1e-9, 1) AS avg_detector_risk_delta, round(avg(alike) + 1e-9, 1) AS avg_voice_similarity,
  count(*) FILTER (is_outlier) AS outlier_count, round(round(coalesce(any_value(v), 0) + 1e-9, 4), 3) AS batch_voice_variance FROM out LEFT JOIN pv ON pv.source = out.source GROUP BY out.source"""
)
def movement_summary(spark, sf_dir):
    """The summary of batches of documents of which a revision is given."""
    return batch.summary(_shortened(spark, sf_dir))
