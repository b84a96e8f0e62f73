"""A corpus pipeline over `documents`: quality rules, language, near-duplicates, source mix, packing.

Each stage takes what its predecessor kept, written as Parquet in between, and returns the rows that it
keeps with all their columns; the mix returns a row as often as it is taken, and the last stage returns
the packed pieces.

Defined results: null and empty texts fail the quality rules; an empty table passes every stage and gives no
pieces; rows that repeat a document are judged alike, and one of them is left by the near-duplicate stage,
as of groups without numbers; ties among equal documents go to the smallest doc_id; extra columns, also of
names that the stages use inside, come through to the mix.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import language_id, mixing, near_dedup, packing, quality_rules
from quillspark.llm.common import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs, size=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Language ID, near-duplicates, the draws of the mix and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
