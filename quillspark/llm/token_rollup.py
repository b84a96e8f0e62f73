"""Token counts kept by delta: additive totals by source, language and tokenizer version.

A batch of changes is folded into one signed row a group (documents and tokens gained or lost) before
anything is written, so a hot source is pre-aggregated in every task. The delta is written under the
batch's name; Spark's commit leaves _SUCCESS last, and a batch that has it is never applied again, so a
batch may be delivered any number of times. A batch without it never happened: it is written anew.
Totals are the sum of the committed deltas; compact() replaces many deltas by one and keeps their names.

Changes are rows (op, source, lang, tokenizer, n_tokens, old_tokens): insert adds a document and n_tokens,
delete takes both away, revise adds n_tokens - old_tokens.

Defined results: null source, lang or tokenizer are groups of their own; null counts are 0; rows with another
op are refused by the commit; groups whose documents and tokens are both 0 are left out of the totals.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.common import SPACE_WORD, cut, ensure_checkpoint_dir, small_batches, text_bytes

GROUP = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def word_count(text: Column) -> Column:
    """Tokenizer words-1: words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    """Tokenizer bytes4-1: four UTF-8 bytes a token, begun ones counted."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def with_vocabulary_count(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the number of ids that a public vocabulary gives each text."""

    def run(batches):
        from quillspark.llm.token_ids import encoder

        for b in batches:
            counts = [len(x) // 4 for x in encoder(vocabulary).packed(text_bytes(b.column(b.schema.get_field_index(text))))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=[*b.schema.names, out])
        encoder(vocabulary).forget()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, LongType())]))


def change(df: DataFrame, op: str, tokenizer: str, n_tokens: Column, old_tokens: Column | None = None, source: str = "source", lang: str = "lang") -> DataFrame:
    """Changes of one kind, from a document's columns."""
    old = F.lit(0).cast("long") if old_tokens is None else old_tokens
    return df.select(F.lit(op).alias("op"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(tokenizer).alias("tokenizer"), n_tokens.alias("n_tokens"), old.alias("old_tokens"))


class Rollup:
    """A rollup kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def _name(batch_id: str) -> str:
        return "delta-" + hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def _committed(self, kind: str) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return sorted(n for n in names if n.startswith(kind) and fs.exists(self._path(f"{n}/_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The last committed compaction and the deltas that it holds."""
        bases = [b for b in self._committed("base-") if self._fs().exists(self._path(f"{b.replace('base-', 'held-')}/_SUCCESS"))]
        if not bases:
            return None, set()
        held = self.spark.read.schema("name string").parquet(f"{self.folder}/{bases[-1].replace('base-', 'held-')}")
        return bases[-1], {r.name for r in held.toLocalIterator()}

    def applied(self, batch_id: str) -> bool:
        name = self._name(batch_id)
        return name in self._committed("delta-") or name in self._base()[1]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        if self.applied(batch_id):
            return False
        n, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)), F.col("op")
        unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
        docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown)
        tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
        delta = changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/{self._name(batch_id)}")
        return True

    def totals(self) -> DataFrame:
        base, held = self._base()
        names = [*([base] if base else []), *(d for d in self._committed("delta-") if d not in held)]
        if not names:
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*[f"{self.folder}/{n}" for n in names])
        return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Write the totals as one base; the deltas that it holds are then deleted."""
        old, held = self._base()
        deltas = self._committed("delta-")
        if not deltas:
            return
        number = int(old.rpartition("-")[2]) + 1 if old else 0
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base-{number:08d}")
        names = sorted(held | set(deltas))
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(f"{self.folder}/held-{number:08d}")
        for d in deltas:
            self._fs().delete(self._path(d), True)


def document_totals(documents: DataFrame, labels: DataFrame, vocabulary: str) -> DataFrame:
    """Totals after the life of a corpus: loaded with estimates, revised, retracted where toxic.

    Batches: estimates (n_chars / 6) are inserted under words-1; exact counts revise them; exact byte
    counts are inserted under bytes4-1, and the ids of a public vocabulary under its file's name; documents
    labelled toxic are deleted under all three; the revision is delivered once more, which changes nothing.

    Rows that repeat a document count each; repeated labels count once; a null doc_id has no label; a null text
    has no tokens; an empty table gives no totals.
    """
    spark = documents.sparkSession
    rollup = Rollup(spark, f"{ensure_checkpoint_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    own = os.path.splitext(os.path.basename(vocabulary))[0]
    # texts are read once; what is kept of them is a few numbers a row
    texts = documents.select("doc_id", "source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("estimate"), word_count(F.col("text")).alias("words"), byte_count(F.col("text")).alias("bytes4"), "text")
    counted = cut(with_vocabulary_count(texts, vocabulary, out="ids").drop("text"))
    toxic = counted.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    revision = change(counted, "revise", "words-1", F.col("words"), F.col("estimate"))
    rollup.commit("load", change(counted, "insert", "words-1", F.col("estimate")))
    rollup.commit("revision", revision)
    exact = {"bytes4-1": F.col("bytes4"), own: F.col("ids")}
    for name, n in exact.items():
        rollup.commit(name, change(counted, "insert", name, n))
    gone = change(toxic, "delete", "words-1", F.col("words"))
    for name, n in exact.items():
        gone = gone.unionByName(change(toxic, "delete", name, n))
    rollup.commit("retraction", gone)
    rollup.commit("revision", revision)
    return rollup.totals()
