"""Importance resampling to a target distribution over hashed n-grams, long texts in overlapping chunks.

Features are runs of 1 to `n` words, hashed into buckets. A bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus; a document's weight is the mean gain of its features, and a Gumbel
draw that follows from its number turns the highest scores into a sample without replacement.

A text above CHUNK_BYTES is split at word boundaries into chunks that are rows of their own and are dealt out
over all tasks. A chunk owns the features that start in its words; the next n-1 words are carried along, so
that runs across the border are whole and counted once. Chunk counts are added up by bucket, and chunk weights
by document. Texts below that stay in their partition and are one chunk.

The driver gets one row a bucket (`buckets`, a parameter) and one a distinct score: scores are whole numbers
between -50,000 and 70,000, as gains and draws are logarithms of counts and of 32-bit numbers times 1000. Ranks
are places among equal scores, found in the score's own group, on top of the number of higher scores.

Defined results: a null or empty text has no words, weight 0 and no rank; rows alike in doc_id and text count once
each, have one score and neighbouring ranks; a null doc_id hashes as the empty string and comes last among ties;
no rows give no rows; an empty target has T = 0; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, small_batches, text_bytes, text_key

N = 2
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
CHUNK_BYTES = 1 << 16

#: A-Z in lower case; what no word holds as a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PIECE = "doc_id {kind}, key long, first boolean, own int, body binary"


def split(data: bytes, n: int = N, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """The chunks of a text: how many bytes a chunk owns, and its bytes with the next n-1 words behind them."""
    at = 0
    while True:
        gap = _GAP.search(data, at + chunk_bytes)
        end = gap.start() if gap else len(data)
        carried, seek = [], end
        while len(carried) < n - 1 and (word := _WORD.search(data, seek)):
            carried.append(word.group())
            seek = word.end()
        yield end - at, data[at:end] + b"".join(b" " + w for w in carried)
        if end >= len(data):
            return
        at = end


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, key (of the text), first (of its chunks), own, body: short texts where they are, chunks of long ones dealt out."""
    spark = df.sparkSession
    small_batches(spark)
    d = df.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(text_bytes(b.column(2))):
                of = b.slice(i, 1)
                for no, (own, body) in enumerate(split(data, n, chunk_bytes)):
                    yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), pa.array([no == 0]), pa.array([own], pa.int32()), pa.array([body], pa.binary())], names=["doc_id", "key", "first", "own", "body"])

    long = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    chunks = d.where(long).mapInArrow(run, _PIECE.format(kind=dict(d.dtypes)["doc_id"]))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = d.where(~long).select("doc_id", "key", F.lit(True).alias("first"), F.octet_length(body).alias("own"), body.alias("body"))
    return whole.union(chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hashed(body: bytes, own: int, n: int = N, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a chunk owns, and the buckets of the features that start in them."""
    words = body[:own].translate(_TABLE).split()
    k = len(words)
    words += body[own:].translate(_TABLE).split()
    runs = list(map(zlib.crc32, words))
    found = runs[:k]
    for length in range(1, n):
        # the checksum of a run goes on from that of the run without its last word
        runs = list(map(zlib.crc32, map(add, repeat(b" "), words[length:]), runs))
        found += runs[:k]
    return k, np.array(found, np.int64) % buckets


def bucket_counts(chunked: DataFrame, n: int = N, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket over all chunks, added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for own, body in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                total += np.bincount(hashed(body, own, n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(total[at])], names=["bucket", "n"])

    out = [0] * buckets
    for r in chunked.select("own", "body").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Each bucket's log ratio of smoothed shares, times 1000, floored."""
    s_all, t_all, k = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source, target, strict=True)]


def weights(chunked: DataFrame, gain: list[int], n: int = N) -> DataFrame:
    """doc_id, key, copies, n_words, n_features, weight: one row for each text of a doc_id, `copies` rows alike."""
    shared, buckets = chunked.sparkSession.sparkContext.broadcast(np.array(gain, np.int64)), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, body in zip(b.column(3).to_pylist(), text_bytes(b.column(4)), strict=True):
                words, found = hashed(body, own, n, buckets)
                rows.append((words, len(found), int(shared.value[found].sum())))
            figures = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *figures], names=["doc_id", "key", "first", "words", "features", "gain"])

    kind = dict(chunked.dtypes)["doc_id"]
    w = chunked.mapInArrow(run, f"doc_id {kind}, key long, first boolean, words long, features long, gain long")
    total = lambda c: F.sum(c).alias(c)
    g = w.groupBy("doc_id", "key").agg(F.count_if("first").alias("copies"), total("words"), total("features"), total("gain"))
    floored = F.when(F.col("features") > 0, F.expr("(gain - pmod(gain, features)) div features")).otherwise(F.lit(0)).cast("long")
    return g.select("doc_id", "key", "copies", F.expr("words div copies").alias("n_words"), F.expr("features div copies").alias("n_features"), floored.alias("weight"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel draw times 1000, floored, that follows from the seed and the number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def _each_copy(df: DataFrame, block: int = 4096) -> DataFrame:
    """One row for each of a row's `copies`, numbered from 1 in __no; arrays stay short however many there are."""
    begun = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))))
    return begun.withColumn("__no", F.explode(F.sequence(F.col("__block") * block + 1, F.least("copies", (F.col("__block") + 1) * block))))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, key, copies, n_words, ..., score) with one row for each copy and the rank of what is drawn."""
    spark = scored.sparkSession
    fit = scored.where(F.col("n_words") >= least_words)
    sizes = sorted(((r.score, r.n) for r in fit.groupBy("score").agg(F.sum("copies").alias("n")).collect()), reverse=True)
    taken, above, places = sum(n for _, n in sizes) * percent // 100, 0, []
    for score, n in sizes:
        if above >= taken:
            break
        places.append((score, above))
        above += n
    columns = [c for c in scored.columns if c != "copies"]
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= places[-1][0]) if places else F.lit(False)
    table = F.broadcast(spark.createDataFrame(places, "score long, __above long"))  # one row a distinct score, see above
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = scored.where(drawn).join(table, "score").withColumn("__before", F.col("__above") + F.coalesce(F.sum("copies").over(order), F.lit(0)))
    one = _each_copy(placed).withColumn("rank", F.col("__before") + F.col("__no"))
    rest = _each_copy(scored.where(~drawn)).withColumn("rank", F.lit(None).cast("long"))
    return one.select(*columns, F.when(F.col("rank") <= taken, F.col("rank")).alias("rank")).union(rest.select(*columns, "rank"))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (null if it is not drawn), n_words."""
    source = pieces(df, doc_id, text, n, chunk_bytes)
    aim = pieces(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), n=n, chunk_bytes=chunk_bytes)
    gain = gains(bucket_counts(source, n, buckets), bucket_counts(aim, n, buckets))
    scored = cut(weights(source, gain, n).withColumn("score", F.col("weight") + draw(F.col("doc_id"))))
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
