"""Queries of the pattern engine over the seeded corpus, with their SQL; a batch is a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import pattern_lexicons as L
from quillspark.functions import pattern_text as P
from quillspark.functions import text as T
from quillspark.operators import diff as D
from quillspark.operators import pattern_hits as H
from quillspark.operators import pattern_metrics as M
from quillspark.operators import pattern_rewrite as W
from quillspark.operators import workflow as K
from quillspark.plans import exports as X
from quillspark.plans import pattern_rerun as R
from quillspark.plans import pattern_run as N
from quillspark.plans import pattern_sql as S
from quillspark.plans import seeded
from quillspark.plans.lineage import kept, shared_folder
from quillspark.plans.workflow_queries import review_log
from quillspark.sources import saves

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
    return seeded.documents(spark, sf_dir).select("doc_id", "source", "text")


def rounded(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """keep, then names, doubles to six places."""
    kinds = dict(df.dtypes)
    return df.select(*keep, *[F.round(F.col(n) + 1e-9, 6).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


@query(f"WITH {S.PARAGRAPHS} SELECT doc_id, list(p ORDER BY j, k) AS paragraphs FROM par GROUP BY doc_id")
def pattern_paragraphs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", P.paragraphs(F.col("text")).alias("paragraphs")).where(F.size("paragraphs") > 0)


@query(f"WITH {S.SENTENCES} SELECT doc_id, i AS sentence_no, s AS sentence FROM sent")
def pattern_sentences(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.posexplode_outer(P.sentences(F.col("text"))).alias("sentence_no", "sentence")).where("sentence_no IS NOT NULL")


@query(f"WITH {S.BASE} SELECT doc_id, {S.words('text')} AS words FROM c")
def pattern_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", P.words(F.col("text")).alias("words"))


@query(f"WITH {S.BASE} SELECT doc_id, {S.normalised('text')} AS text FROM c")
def pattern_normalised(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", P.normalised(F.col("text")).alias("text"))


@query(f"WITH {S.all_metrics()} SELECT doc_id, source, {S.rounded(S.METRICS)} FROM m")
def pattern_metrics(spark, sf_dir):
    return rounded(M.metrics(corpus(spark, sf_dir)), ["doc_id", "source"], S.METRICS)


@query(f"WITH {S.derived()} SELECT doc_id, {S.rounded(S.DERIVED)} FROM d")
def pattern_derived_metrics(spark, sf_dir):
    return rounded(M.derived(corpus(spark, sf_dir)), ["doc_id"], S.DERIVED)


@query(f"WITH {S.all_metrics()},{S.PROFILES} SELECT doc_id, {S.rounded(M.PROFILE)} FROM p")
def pattern_profile(spark, sf_dir):
    return rounded(M.profile(M.metrics(corpus(spark, sf_dir))), ["doc_id"], M.PROFILE)


@query(f"WITH {S.all_metrics()},{S.PROFILES},{S.CENTROIDS} SELECT source, {S.rounded(M.PROFILE)} FROM cen")
def pattern_centroid(spark, sf_dir):
    return rounded(M.centroid(M.profile(M.metrics(corpus(spark, sf_dir))), "source"), ["source"], M.PROFILE)


def settings(df: DataFrame) -> DataFrame:
    """df with a mode, budget and voice mode for each batch, by the length and last digit of its name."""
    n = F.length("source") + F.coalesce(F.regexp_extract("source", "([0-9])$", 1).try_cast("int"), F.lit(0))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return df.withColumns({"mode": pick(S.MODES, n), "voice_mode": pick(S.VOICE_MODES, n), "budget": pick(S.BUDGETS, n)})


@query(S.voice())
def pattern_voice(spark, sf_dir):
    """Each document against its batch and the batch's target; the voice sample is the batch's first document.

    Profiles are made once and kept; a batch's centroid and sample are one row each, so the joins broadcast.
    """
    p = kept(M.profile(M.metrics(corpus(spark, sf_dir))).select("doc_id", "source", F.struct(*M.PROFILE).alias("profile")))
    batches = p.groupBy("source").agg(F.struct(*[F.avg(f"profile.{k}").alias(k) for k in M.PROFILE]).alias("batch"), F.min_by("profile", "doc_id").alias("sample"))
    batches = settings(batches).withColumn("target", M.target(F.col("voice_mode"), F.col("mode"), "batch", "sample")).drop("sample")
    out = p.join(batches, "source").withColumns(M.assessment("profile", "batch", "target", F.col("mode")))
    out = out.withColumn("intensity", M.intensity(F.col("mode"), F.col("budget"))).withColumn("outlier", (F.col("voice_score") < S.THRESHOLD) | (F.col("batch_distance") > 0.22))
    return rounded(out, ["doc_id", "source", "mode", "voice_mode", "outlier"], S.VOICE)


@query(f"""WITH v AS ({S.voice()}) SELECT source, count(*) AS documents, count(*) FILTER (outlier) AS outliers, {S.rounded(['avg(voice_score) AS avg_voice_score', 'avg(batch_distance) * 100 AS voice_variance', 'avg(target_distance) * 100 AS target_gap'], 3)} FROM v GROUP BY source""")
def pattern_batch_voice(spark, sf_dir):
    """A batch's mean voice score, its variance and its gap to the target."""
    v = pattern_voice(spark, sf_dir)
    mean = lambda c, out: F.round(c + 1e-9, 3).alias(out)
    return v.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("outlier").alias("outliers"), mean(F.avg("voice_score"), "avg_voice_score"), mean(F.avg("batch_distance") * 100, "voice_variance"), mean(F.avg("target_distance") * 100, "target_gap"))


@query(S.labels())
def pattern_labels(spark, sf_dir):
    """Display strings of a document: title, escaped start, slug, warning, signed and counted figures, pills."""
    c = corpus(spark, sf_dir)
    head, n = F.coalesce(F.get(P.sentences(F.col("text")), F.lit(0)), F.lit("")), F.size(P.sentences(F.col("text")))
    gap = n - 10
    band = lambda value, high: F.when(value >= 70, "good").when(value >= 50, "warn").otherwise("danger") if high else F.when(value <= 35, "good").when(value <= 55, "warn").otherwise("danger")
    return c.select(
        "doc_id",
        P.title_case(F.concat("source", F.lit("_of-the batch"))).alias("title"),
        P.escape_html(F.concat(F.lit("<b>"), head, F.lit("</b> & 'so'"))).alias("html"),
        P.slug(head).alias("slug"),
        P.append_warning(F.when(F.col("doc_id") % 2 == 0, "Long"), F.when(F.col("doc_id") % 3 == 0, "Dialogue")).alias("warning"),
        P.signed(gap).alias("gap"),
        P.pluralised(n, "sentence").alias("sentences"),
        band(F.col("doc_id") % 100, True).alias("high_pill"),
        band(F.col("doc_id") % 100, False).alias("low_pill"),
    )


def _with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with metrics, a mode by number and hits."""
    docs = corpus(spark, sf_dir)
    m = M.metrics(docs)
    mode = F.element_at(F.array(*map(F.lit, L.DOCUMENT_MODES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return H.hits(m.withColumn("mode", mode))


@query(f"WITH {S.catalogue_hits()} SELECT doc_id, no - 1 AS hit_no, id, excerpt, round(severity + 1e-9, 6) AS severity FROM h24")
def pattern_hits(spark, sf_dir):
    d = _with_hits(spark, sf_dir).select("doc_id", F.posexplode_outer("hits").alias("hit_no", "h")).where("hit_no IS NOT NULL")  # of posexplode Spark would infer a filter that works hits out again
    ids = F.get(F.array(*[F.lit(r.id) for r in H.ALL]), F.col("h.rule"))
    return d.select("doc_id", F.col("hit_no").cast("long").alias("hit_no"), ids.alias("id"), "h.excerpt", F.round(F.col("h.severity") + 1e-9, 6).alias("severity"))


@query(S.audit())
def pattern_audit(spark, sf_dir):
    """Score, top categories and findings of a text."""
    d = _with_hits(spark, sf_dir)
    f = H.findings(F.col("hits"))
    cats = F.array_join(F.transform(H.top_categories(F.col("hits")), lambda x: F.concat(x["category"], F.lit(":"), x["count"].cast("string"))), ",")
    return d.select("doc_id", F.size("hits").cast("long").alias("hit_count"), F.round(H.humanizer_score(F.col("hits")) + 1e-9, 4).alias("humanizer_score"), cats.alias("top_categories"), F.array_join(F.transform(f, lambda x: x["priority"]), ",").alias("priorities"))


@query(f"WITH {S.catalogue_hits()}, n AS (SELECT source, category, count(*) AS hits, count(DISTINCT h24.doc_id) AS documents, sum(severity) AS weight FROM h24 JOIN c USING (doc_id) GROUP BY source, category) SELECT source, upper(category[1]) || category[2:] AS category, hits, documents, round(weight + 1e-9, 4) AS weight FROM n")
def pattern_category_totals(spark, sf_dir):
    """Hits of a batch by category, by title; counts are made in every task before anything is shuffled."""
    d = _with_hits(spark, sf_dir).select("doc_id", "source", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    per = d.groupBy("source", "doc_id", H.category(F.col("h.rule")).alias("category")).agg(F.count("*").alias("hits"), F.sum("h.severity").alias("weight"))
    t = per.groupBy("source", "category").agg(F.sum("hits").alias("hits"), F.count("*").alias("documents"), F.round(F.sum("weight") + 1e-9, 4).alias("weight"))
    return t.withColumn("category", P.title_case(F.col("category")))


@query(S.gate())
def pattern_gate(spark, sf_dir):
    """The gate over movements that follow from a document's number."""
    n = F.col("doc_id")
    gain = lambda a, b: (n % a - b) / 2
    budget = F.element_at(F.array(*map(F.lit, S.BUDGETS)), (n % 3 + 1).cast("int"))
    reasons = H.gate(gain(9, 4), gain(7, 2), gain(11, 3), (n % 10) / 10, n % 13 == 0, budget, n % 4 == 0)
    return corpus(spark, sf_dir).select("doc_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with what is added for edits."""
    return seeded.with_edits(corpus(spark, sf_dir))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of _texts(), one a row."""
    return _texts(spark, sf_dir).select("doc_id", F.posexplode_outer(P.sentences(F.col("text"))).alias("sentence_no", "sentence")).where("sentence_no IS NOT NULL")


@query(S.smooth())
def pattern_smooth(spark, sf_dir):
    """Each sentence with verbs tightened, stock phrases smoothed and spaces tidied."""
    return _sentences(spark, sf_dir).withColumn("sentence", W.finalised(W.smoothed(W.tightened(F.col("sentence")))))


@query(S.by_category())
def pattern_sentence_edits(spark, sf_dir):
    """Each sentence as categories, a mode and a strength that follow from its document's number have it."""
    n = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    cats = F.array(pick(S.CATEGORIES, n), pick(S.CATEGORIES, F.floor(n / len(S.CATEGORIES))))
    return _sentences(spark, sf_dir).withColumn("sentence", W.by_category(F.col("sentence"), cats, pick(L.DOCUMENT_MODES, n), n % 3 == 0, n % 2 == 0))


@query(S.lead_runs())
def pattern_lead_runs(spark, sf_dir):
    """Sentences, runs of short ones with the same start joined by threes."""
    s = _texts(spark, sf_dir).select("doc_id", F.posexplode_outer(W.lead_runs(P.sentences(F.col("text")))).alias("no", "r")).where("no IS NOT NULL")
    return s.select("doc_id", F.col("r.i").alias("sentence_no"), F.col("r.s").alias("sentence"))


@query(S.subject_clauses())
def pattern_subject_clauses(spark, sf_dir):
    """Sentences with three clauses about one subject as one clause."""
    return _sentences(spark, sf_dir).withColumn("sentence", W.collapse_subject_clauses(F.col("sentence")))


@query(S.annotations())
def pattern_annotations(spark, sf_dir):
    """Annotations of a text: first hits, remarks by sentence, a fallback."""
    d = T.bound(_with_hits(spark, sf_dir), notes=H.annotations(F.col("text"), F.col("hits"), F.col("mode")))
    d = d.select("doc_id", F.posexplode_outer("notes").alias("note_no", "n")).where("note_no IS NOT NULL")
    return d.select("doc_id", F.col("note_no").cast("long").alias("note_no"), "n.*")


_SAMPLE = "It's late. We don't wait. He can't see it, and they're gone. Nobody came; I don't know."


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and batches of a run: a batch is a source, some documents have a mode of their own, are no texts or are settled."""
    n = F.col("doc_id")
    pick = lambda values, by: F.element_at(T.constants(values), (by % len(values) + 1).cast("int"))
    d = _texts(spark, sf_dir).select(
        "doc_id", F.col("source").alias("batch_id"), "text",
        F.when(n % 50 == 49, "pdf").otherwise("text").alias("source_type"),
        F.when(n % 7 == 0, pick(L.DOCUMENT_MODES, n)).alias("document_mode"),
        F.when(n % 11 == 0, "approved").when(n % 13 == 0, "rejected").when(n % 3 == 0, "pending").alias("review_state"),
    )
    batches = settings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct())
    size = F.length("source") + F.coalesce(F.regexp_extract("source", "([0-9])$", 1).try_cast("int"), F.lit(0))
    return d, batches.select(F.col("source").alias("batch_id"), "mode", "budget", "voice_mode", pick(L.DOCUMENT_MODES, size).alias("document_mode"), F.lit(S.THRESHOLD).alias("threshold"), F.when(size % 2 == 0, _SAMPLE).alias("voice_sample"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus through a run."""
    return N.run(*_inputs(spark, sf_dir))


@query()
def pattern_run(spark, sf_dir):
    """What a run makes of each document: movements, gate, residue, voice and review state, with the revised text."""
    r = _run(spark, sf_dir)
    figure = lambda k: F.round(F.col(k) + 1e-9, 4).alias(k)
    return r.select(
        "doc_id", "batch_id", "document_mode", "status", "accepted", F.array_join("reasons", ",").alias("reasons"), "warning", "revised_text", *[figure(k) for k in N.DELTAS], F.size("annotations").alias("annotations"),
        "residue.initial_hits", "residue.final_hits", F.size("residue.fixes").alias("fixes"), *[figure(k) for k in ("batch_distance", "target_distance", "voice_score")], "outlier", "review_state",
    )


@query()
def pattern_run_summary(spark, sf_dir):
    return N.summary(_run(spark, sf_dir))


@query()
def run_outcomes(spark, sf_dir):
    """From text to review: what a run and the log make of each document, as it is listed and in words."""
    d = K.explained(N.states(_run(spark, sf_dir), review_log(spark, sf_dir)))
    return d.select("doc_id", "batch_id", "mode", "mode_pending", "touched", "material", "priority", "review_state", K.display_state().alias("state"), "outcome", "summary", "next_step")


@query()
def run_batch_outcomes(spark, sf_dir):
    """From text to the batches' outcomes, in words."""
    _, batches = _inputs(spark, sf_dir)
    s = K.batch_summary(N.states(_run(spark, sf_dir), review_log(spark, sf_dir)), "batch_id")
    return K.batch_outcomes(batches.select("batch_id", F.lit("done").alias("status")), s, "batch_id")


@query()
def pattern_residue_fixes(spark, sf_dir):
    """What the second pass did to each text, in order."""
    d = _run(spark, sf_dir).select("doc_id", F.posexplode_outer("residue.fixes").alias("fix_no", "f")).where("fix_no IS NOT NULL")
    return d.select("doc_id", "fix_no", "f.*")


@query()
def word_diff(spark, sf_dir):
    """Runs of words that stayed, went and came between a text and its revision."""
    d = T.bound(_run(spark, sf_dir).select("doc_id", "original_text", "revised_text"), parts=D.word_diff(F.col("original_text"), F.col("revised_text")))
    d = d.select("doc_id", F.posexplode_outer(D.runs(F.col("parts"))).alias("run_no", "r")).where("run_no IS NOT NULL")
    return d.select("doc_id", "run_no", "r.*")


@query()
def line_diff(spark, sf_dir):
    """Changed lines of a text and its revision side by side, with two lines around them, broken after 90 characters."""
    d = T.bound(_run(spark, sf_dir).select("doc_id", "original_text", "revised_text"), rows=D.line_diff(F.col("original_text"), F.col("revised_text")))
    return D.wrapped(d, "rows", "doc_id")


@query()
def pattern_rerun(spark, sf_dir):
    """States after a first run and a rerun of the documents that the review log asks for, with an aggressive budget."""
    docs, batches = _inputs(spark, sf_dir)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    folder, columns = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", R.schema(spark)
    R.first(docs, batches, folder, "first", "2024-01-01")
    wanted = R.targets(review_log(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("doc_id"))
    wanted = docs.select("doc_id", "batch_id").join(wanted, "doc_id").withColumn("budget", F.lit("aggressive"))
    R.rerun(spark, folder, wanted, batches, "second", "2024-01-02", columns)
    state = saves.load(spark, folder, columns, "doc_id")
    return state.select("doc_id", "batch_id", "status", "accepted", "revised_text", F.round(F.col("voice_score") + 1e-9, 4).alias("voice_score"), "outlier", "review_state", "reruns", "updated_at")


@query()
def export_pieces(spark, sf_dir):
    """The files of a run's export, as rows: path, place in the file, content."""
    d = _run(spark, sf_dir).withColumns({"name": F.concat_ws("", F.lit("Doc "), "doc_id", F.lit(".md")), "sequence_no": F.col("doc_id"), "notes": F.lit(None).cast("string")})
    p = X.pieces(d)
    return p.select("path", "part.k", "part.n", "content")
