"""Core engine: segmentation, signals, voice, rewriting and batches on small texts of our own."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions import text as T
from quillspark.operators import rewrite, signals, voice
from quillspark.plans import batch, core_queries


def value(spark, column, **named):
    row = spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in named.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Lane left at 3.5 today. She slept.", ["Dr. Lane left at 3.5 today.", "She slept."]),
        ("Who came by? We did that! Yes we did.", ["Who came by?", "We did that!", "Yes we did."]),
        ("He met J. R. Hall in the U.S. office.", ["He met J. R. Hall in the U.S. office."]),
        ("One line only", ["One line only"]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert value(spark, T.sentences(F.col("t")), t=text) == want


def test_paragraphs_and_tokens(spark):
    assert value(spark, T.paragraphs(F.col("t")), t="a b\r\n\r\nc\n\n\n d ") == ["a b", "c", "d"]
    assert value(spark, T.tokens(F.col("t")), t="Don't STOP, at 5.") == ["don't", "stop", "at"]


def test_lexical_diversity(spark):
    words = [f"w{i}" for i in range(10)]
    assert value(spark, T.lexical_diversity(F.col("w")), w=words) == 1.0
    assert value(spark, T.lexical_diversity(F.col("w")), w=["a"] * 30) == pytest.approx(0.1)
    assert value(spark, T.lexical_diversity(F.col("w")), w=[]) == 0.0


SLOPPY = "It is important to note that this is a very really important thing. Moreover, it was as if the journey never ended. Ultimately, various aspects of the process were written down — at the end of the day."
CLEAN = "Rain hit the tin roof until dawn. Marta counted coins by the stove while the kettle ticked. Nobody came up the road that week, so she mended the gate herself and sold two hens on Friday."


def test_signals_tell_sloppy_from_clean(spark):
    df = spark.createDataFrame([(1, SLOPPY), (2, CLEAN), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in signals.scores(df).collect()}
    assert got[1].quality_score < 80 < got[2].quality_score and got[1].detector_risk > 30 > got[2].detector_risk
    assert got[1].filler_hits >= 2 and got[1].passive_hits >= 1 and got[3].word_count == got[4].word_count == 0


def test_analyse_keeps_columns(spark):
    df = spark.createDataFrame([(1, SLOPPY, "x")], "doc_id long, text string, __s string")
    out = signals.analyse(df)
    assert out.columns == ["doc_id", "text", "__s", "analysis"] and out.first().analysis.word_count > 30


def test_voice_distance(spark):
    df = voice.profiled(spark.createDataFrame([(1, SLOPPY), (2, CLEAN)], "doc_id long, text string"), "text", "p")
    a, b = df.select("doc_id", F.col("p").alias("a")), df.select(F.col("doc_id").alias("d2"), F.col("p").alias("b"))
    got = {(r.doc_id, r.d2): r.d for r in a.crossJoin(b).select("doc_id", "d2", voice.distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got[(1, 1)] == 0 and got[(1, 2)] == got[(2, 1)] > 0.05
    assert set(df.schema["p"].dataType.fieldNames()) == set(L.VOICE_WEIGHTS)


def test_rewriting_spares_code_and_headings(spark):
    text = "# It is important to note that\n\nMoreover, the rain fell.\n\n```\nMoreover, code\n```"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("budget", F.lit("medium"))
    df = voice.profiled(df, "text", "target")
    out = rewrite.rewrite(df, "text", "target", "budget").first()["rewrite"]
    assert out.text.startswith("# It is important to note that") and "Moreover, code" in out.text and "Moreover, the" not in out.text


def test_minimal_budget_touches_flagged_sentences_alone(spark):
    text = "The rain fell on  town. Moreover, the gate was broken by wind. It was a long night for them."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("budget", F.lit("minimal"))
    out = rewrite.rewrite(voice.profiled(df, "text", "target"), "text", "target", "budget").first()["rewrite"]
    assert "Moreover" not in out.text and out.change_count == 1


def test_batches(spark):
    docs = spark.createDataFrame([("b1", 1, SLOPPY), ("b1", 2, CLEAN), ("b2", 3, CLEAN)], "batch_id string, doc_id long, original_text string")
    batches = spark.createDataFrame([("b1", "preserve-batch-voice", "medium", "", None), ("b2", "hybrid", "minimal", CLEAN, None)], "batch_id string, mode string, edit_budget string, house_voice_samples string, voice_pack_id string")
    packs = spark.createDataFrame([], "id string, profile struct<" + ",".join(f"{k}:double" for k in voice.KEYS) + ">")
    done = batch.process(docs, batches, packs).cache()
    rows = {r.batch_id: r for r in batch.summary(done).collect()}
    assert rows["b1"].document_count == 2 and rows["b2"].document_count == 1 and rows["b2"].batch_voice_variance == 0
    one = {r.doc_id: r for r in done.collect()}
    assert one[1].change_count > 0 and one[1].quality_delta >= -2


def test_targets_take_a_pack_then_a_sample_then_the_batch(spark):
    docs = spark.createDataFrame([(b, i, CLEAN) for i, b in enumerate(["pack", "sample", "neither", "hybrid", "own"])], "batch_id string, doc_id long, original_text string")
    rows = [("pack", "house-voice", SLOPPY, "p"), ("sample", "house-voice", SLOPPY, "unknown"), ("neither", "house-voice", " \n", None), ("hybrid", "hybrid", SLOPPY, "p"), ("own", "preserve-batch-voice", SLOPPY, "p")]
    batches = spark.createDataFrame([(b, m, "medium", s, p) for b, m, s, p in rows], "batch_id string, mode string, edit_budget string, house_voice_samples string, voice_pack_id string")
    pack = {k: i / 8 for i, k in enumerate(voice.KEYS)}
    packs = spark.createDataFrame([("p", pack), ("q", pack)], "id string, profile struct<" + ",".join(f"{k}:double" for k in voice.KEYS) + ">")
    got = {r.batch_id: r for r in batch.targets(signals.analyse(docs, "original_text", "original_analysis"), batches, packs).collect()}
    profile = lambda text: voice.profiled(spark.createDataFrame([(text,)], "t string"), "t", "p").first().p.asDict()
    assert got["pack"].target_profile.asDict() == pack and got["sample"].target_profile.asDict() == profile(SLOPPY)
    for name in ("neither", "own"):
        assert got[name].target_profile == got[name].batch_profile
    own = got["hybrid"].batch_profile.asDict()
    assert got["hybrid"].target_profile.asDict() == {k: pytest.approx((own[k] + pack[k]) / 2, abs=1e-4) for k in voice.KEYS}


def test_slugify_covers_the_whole_text(spark, tmp_path):
    texts = ["One two " * 40 + "the END.", "-" * 70 + "Late", "  ", "x"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slug for r in core_queries.slugify(spark, str(tmp_path)).collect()}
    whole = {r.doc_id: r.text for r in core_queries.corpus(spark, str(tmp_path)).collect()}
    assert got == {i: re.sub(r"[^a-zA-Z0-9]+", "-", t.strip().lower()).strip("-") or "untitled" for i, t in whole.items()}
    assert got[0].startswith("one-two-" * 40 + "the-end")


@pytest.mark.parametrize("distinct,column,want", [([2, *[3] * 11], "specificity", 71.8), ([1, 1, 1, 4], "detector_risk", 38.2)])
def test_scores_round_halves_up_whatever_the_sum_of_shares(spark, distinct, column, want):
    """Chunks of ten words with so many distinct ones: the score is 71.75 and 38.15, the sum of shares falls short of it."""
    words = " ".join(" ".join(f"w{'abcdefghij'[min(i, n - 1)]}" for i in range(10)) for n in distinct)
    df = spark.createDataFrame([(words,)], "text string")
    assert signals.scores(df).first()[column] == want
