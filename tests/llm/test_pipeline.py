"""The pipeline's stages over a small corpus, each judged on its own input."""

import corpus_pipeline
from quillspark.llm import language_id, mixing, near_dedup, packing, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if i == 0:
            assert ids == sorted(r.doc_id for r in quality_rules.judge(docs).where("kept").collect())
        if i == 1:
            good = language_id.identify(docs).where("lang_pred <> 'und' AND NOT ambiguous")
            assert ids == sorted(r.doc_id for r in good.collect())
        if i == 2:
            assert ids == sorted(r.doc_id for r in near_dedup.link(docs, 5).where("kept").collect())
        if i == 3:
            assert len(ids) == sum(r.copies for r in mixing.mix(docs).collect())
        if i == 4:
            assert out.where("piece = 0").count() == docs.count() and out.count() == packing.pack(docs, __import__("public_tokenizers").path("word_bpe_49k.json")).count()
        else:
            assert out.columns == columns and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out


def test_stages_on_awkward_rows(spark, awkward, nothing, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names and an empty table pass every stage."""
    for df, name in ((awkward, "awkward"), (nothing, "nothing")):
        docs = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert i == 4 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}")) if i < 2 else docs
        # the quality rules reject all of these rows, so the later stages see the rows themselves
        for _, stage in corpus_pipeline.STAGES[2:]:
            assert stage(spark, df, SF).count() >= 0


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0
