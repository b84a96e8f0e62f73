"""Tables of a database: partitioned scans with what can be pushed down.

Batches are read with their documents by two scans and one join, not by a query a batch. A scan is split by ranges of
a number, so that executors read side by side; filters and columns go into the queries that Spark sends.
What is written goes to saves by key (see saves.py), from which a database may load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table. split: a numeric column, its least and greatest value, and into how many ranges they are cut."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def voice_packs(spark: SparkSession, url: str, options: dict[str, str] | None = None) -> DataFrame:
    """id, name, source, sample_text, sample_size, profile, created_at, missing values as their defaults."""
    p = scan(spark, url, "voice_packs", options)
    p = p.toDF(*[c.lower() for c in p.columns])
    default = {"source": "manual", "sample_text": "", "sample_size": 0, "profile": "{}", "created_at": ""}
    return p.select("id", "name", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in default.items()])


def batches(spark: SparkSession, url: str, where: Column | None = None, options: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """One row a batch with its documents nested in order of sequence: two scans, one join.

    where: a condition on batch_runs, which the database evaluates. split: how batch_documents is read, see scan().
    """
    runs = scan(spark, url, "batch_runs", options)
    runs = runs.toDF(*[c.lower() for c in runs.columns])
    runs = runs if where is None else runs.where(where)
    docs = scan(spark, url, "batch_documents", options, split)
    docs = docs.toDF(*[c.lower() for c in docs.columns])
    fields = [c for c in docs.columns if c not in ("batch_run_id", "sequence_no")]
    nested = docs.groupBy("batch_run_id").agg(F.sort_array(F.collect_list(F.struct("sequence_no", *fields))).alias("documents"))
    out = runs.join(nested, runs["id"] == nested["batch_run_id"], "left").drop("batch_run_id")
    return out.withColumn("documents", F.coalesce("documents", F.array().cast(nested.schema["documents"].dataType)))


def document_index(spark: SparkSession, url: str, options: dict[str, str] | None = None) -> DataFrame:
    """document id and batch id; no other column is read."""
    docs = scan(spark, url, "batch_documents", options)
    return docs.toDF(*[c.lower() for c in docs.columns]).select(F.col("id").alias("doc_id"), F.col("batch_run_id").alias("batch_id"))
