"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of +1 and -1; for each of its bits a binary classifier on byte trigrams of
letters tells the languages with +1 from those with -1. Its weights are log ratios of smoothed trigram
frequencies, all languages of a side counting alike. A text's margins are decoded to the codeword of
least loss (logistic, each bit weighted by how well its sides separate in training); the text is
ambiguous when the second codeword is about as near.

Training counts trigrams in a sample of at most about `per_lang` documents a language (the stated bound of
the classifier's sample, drawn by the hash of the text); partitions add up their counts, and the driver
gets one row a bucket and language, 2**14 buckets for at most 64 languages. Prediction reads whole texts,
in Arrow batches, where the model is a broadcast array of that same bounded size.

Defined results: a text that is null or has no letter is `und` with score 0, as is everything if no labelled
row exists; a null doc_id counts as held out; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches

BUCKETS = 1 << 14
PER_LANG = 4000
MAX_LANGS = 64
#: Trigrams that count fully towards a margin; longer texts are no more certain than that.
FULL_LENGTH = 60
#: Codewords whose losses differ by less are ambiguous.
AMBIGUOUS = 0.02
UND = "und"
_CHUNK = 1 << 18

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = 32
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 and -1
    weight: np.ndarray  # bits
    table: np.ndarray  # bits x (buckets + 1), the last bucket 0
    fallback: int


def codewords(n: int) -> np.ndarray:
    """The exhaustive code up to 7 languages; beyond that the best of some random codes, always the same."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, 12 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > best:
            best, found = apart, code
    return found


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte of all texts (BUCKETS where it isn't the middle of a trigram), and where texts start."""
    raw = [t.lower().encode() for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    b = _TABLE[np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int32)
    bucket[b[1:-1] == 32] = BUCKETS
    return bucket, starts


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train(rows: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model from (text, lang), or None without labelled rows."""
    small_batches(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / sizes[lang]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS + 1), np.int64)
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                bucket, starts = _trigrams(texts[lo:hi])
                ends = [*starts[1:], len(bucket)]
                for lang, s, e in zip(of[lo:hi], starts, ends, strict=True):
                    total[place[lang]] += np.bincount(bucket[s:e], minlength=BUCKETS + 1)
        at = np.argwhere(total[:, :BUCKETS] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype("int32")), pa.array(at[:, 1].astype("int32")), pa.array(total[at[:, 0], at[:, 1]])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(langs), BUCKETS))
    for r in sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.lang, r.bucket] = r.n
    p = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)
    code = codewords(len(langs))
    table, weight = np.zeros((code.shape[1], BUCKETS + 1), np.float32), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        plus, minus = p[code[:, b] > 0].mean(0), p[code[:, b] < 0].mean(0)
        table[b, :BUCKETS] = np.log(plus) - np.log(minus)
        weight[b] = 0.5 * np.abs(plus - minus).sum()
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(weight), 1 / max(1, len(weight)))
    return Model(langs, code, weight, table, max(range(len(langs)), key=lambda i: sizes[langs[i]]))


def decode(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of its language, the score and whether it is ambiguous."""
    n, k, bits = len(texts), len(model.langs), model.code.shape[1]
    lang, score, unsure = np.full(n, model.fallback), np.full(n, 1.0 / k), np.full(n, k > 1)
    if k == 1:
        return lang, np.ones(n), unsure
    for lo, hi in _chunks(texts):
        bucket, starts = _trigrams(texts[lo:hi])
        seen = np.add.reduceat((bucket < BUCKETS).astype(np.int64), starts)
        z = np.stack([np.add.reduceat(model.table[b][bucket], starts, dtype=np.float64) for b in range(bits)], 1)
        z *= (np.minimum(seen, FULL_LENGTH) / np.maximum(seen, 1))[:, None]
        loss = np.logaddexp(0, -z[:, None, :] * model.code[None]) @ model.weight  # texts x languages
        order = np.sort(loss, 1)
        p = np.exp(-bits * (loss - order[:, :1]))
        ok = seen > 0
        lang[lo:hi][ok] = loss.argmin(1)[ok]
        score[lo:hi][ok] = (1 / p.sum(1))[ok]
        unsure[lo:hi][ok] = (order[:, 1] - order[:, 0] < AMBIGUOUS)[ok]
    return lang, score, unsure


def predicted(df: DataFrame, model: Model | None, text: str = "text") -> Column:
    """struct<lang_pred, score, ambiguous> of a text column."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = F.rlike(F.col(text), F.lit(r"\p{L}"))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in parts:
            texts = s.tolist()
            out = pd.DataFrame({"lang_pred": [UND] * len(texts), "score": 0.0, "ambiguous": False})
            at = [i for i, t in enumerate(texts) if t]
            if m is not None and at:
                lang, score, unsure = decode(m, [texts[i] for i in at])
                out.loc[at, "lang_pred"] = [m.langs[i] for i in lang]
                out.loc[at, "score"], out.loc[at, "ambiguous"] = score, unsure
            yield out

    return predict.asNondeterministic()(F.when(letters, F.col(text)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the number as text leaves `fold`; true for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, ambiguous; learns from what is not held out."""
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(F.col(doc_id), 5, 0).alias("held_out"))
    model = train(d.where("NOT held_out"))
    return d.select("doc_id", "held_out", predicted(d, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose text has a language that is not ambiguous, with df's columns and names."""
    d = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(F.col(doc_id), 5, 0).alias("held_out"))
    model = train(d.where("NOT held_out"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), predicted(df, model, text).alias("__p"))
    return rows.where((F.col("__p.lang_pred") != UND) & ~F.col("__p.ambiguous")).select("__row.*")
