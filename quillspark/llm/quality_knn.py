"""Quality by the votes of the nearest labelled documents in a latent space.

A text becomes shares of hashed features: byte trigrams, trigrams of byte classes (case, digits, signs), and how
often words and lines come again. Shares are square-rooted and weighed by inverse document frequency, and the
main directions of a sample of labelled documents (truncated SVD, by subspace iteration) make a latent space
of DIMENSIONS numbers. The sample's unit vectors and labels are broadcast. Every document meets all of them:
blocks of documents are multiplied with the whole sample, the NEIGHBOURS with the greatest cosines vote with
a power of their cosine, and a vote is scaled by how many documents of its label it stands for.

The sample is bounded: at most PER_LABEL documents a label, those with the least hash of their number, so at
most 4,096 vectors of 64 numbers are fitted on the driver and broadcast. All else covers whole texts and all
documents. Nothing is shuffled but the labels' counts and the sample.

Defined results: a null text is the empty text, which has features of its own; a null doc_id counts as held out
and is never learnt from; a label other than 0 and 1 is not learnt from; a document with several labels votes
with each; without labelled documents every score is 0.5, with labels of one kind it is near that label; ties
go to the earlier vector of the sample; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, text_bytes
from quillspark.llm.language_id import held_out

PER_LABEL = 2048
DIMENSIONS = 64
NEIGHBOURS = 15
#: A neighbour's vote is its cosine to this power; PRIOR votes go to the shares of the labels.
SHARPNESS = 8
PRIOR = 0.05
FOLDS, FOLD = 3, 1
_BLOCK = 256
_SLICE = 1 << 20

_TRIGRAMS, _CLASSES = 2048, 9
_AT_CLASSES = _TRIGRAMS
_AT_REPEATS = _AT_CLASSES + _CLASSES**3
_LAGS = 8
_AT_SHAPE = _AT_REPEATS + _LAGS + 4
#: Features: trigrams, classes, words equal to one of the eight before and words and lines seen before or not, length.
FEATURES = _AT_SHAPE + 24
_GROUPS = np.array([0, _AT_CLASSES, _AT_REPEATS, _AT_REPEATS + _LAGS, _AT_REPEATS + _LAGS + 2, _AT_SHAPE])

_FOLDED = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint32)
_CLASS = np.full(256, 5, np.uint8)  # other signs; then space, line end, lower and upper case, digits, beyond ASCII, stops, marks
for _k, _bytes in enumerate([b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b"", bytes(range(128, 256)), b".,;:!?", b"#*$%&|<>"]):
    _CLASS[list(_bytes)] = _k


def counts(data: bytes) -> np.ndarray:
    """How often each feature occurs in a text; slices of a MB, cut at white space, are counted on their own."""
    out, at = np.zeros(FEATURES, np.float32), 0
    words = 0
    while at < len(data):
        end = len(data) if len(data) - at <= _SLICE else max(data.rfind(b" ", at, at + _SLICE), data.rfind(b"\n", at, at + _SLICE))
        end = end if end > at else min(at + _SLICE, len(data))
        part, at = data[at:end], end
        raw = np.frombuffer(b" " + part + b" ", np.uint8)
        b, c = _FOLDED[raw], _CLASS[raw].astype(np.int64)
        key = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        out[:_TRIGRAMS] += np.bincount(key, minlength=_TRIGRAMS)
        out[_AT_CLASSES:_AT_REPEATS] += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
        w = np.fromiter(map(zlib.crc32, part.lower().split()), np.uint32)
        lines = [x for x in part.split(b"\n") if x.strip()]
        words += len(w)
        for lag in range(1, min(_LAGS, len(w) - 1) + 1):
            out[_AT_REPEATS + lag - 1] += (w[lag:] == w[:-lag]).sum()
        at_seen = _AT_REPEATS + _LAGS
        distinct, lines_once = len(np.unique(w)), len(set(lines))
        out[at_seen : at_seen + 4] += (distinct, len(w) - distinct, lines_once, len(lines) - lines_once)
    out[_AT_SHAPE + min(23, int(np.log2(words + 1)))] = 1
    return out


def shares(data: bytes) -> np.ndarray:
    """The square roots of each feature's share of its group."""
    c = counts(data)
    total = np.add.reduceat(c, _GROUPS)
    size = np.diff(np.append(_GROUPS, FEATURES))
    return np.sqrt(c / np.repeat(np.maximum(total, 1), size))


@dataclass
class Model:
    weight: np.ndarray  # features
    axes: np.ndarray  # features x dimensions
    vectors: np.ndarray  # sample x dimensions, of length 1 or 0
    label: np.ndarray  # sample, 0.0 or 1.0
    stands_for: np.ndarray  # sample, votes
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of shares as unit vectors; what has no part in the space is 0."""
        z = (x * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest vectors of each row of shares."""
        near = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # to 16 bits and then by place, so that ties don't depend on the block
        order = np.argsort(-np.round(near.astype(np.float64), 5), axis=1, kind="stable")[:, :k] if near.shape[1] <= 4 * NEIGHBOURS else _best(near, k)
        cosine = np.maximum(np.take_along_axis(near, order, 1).astype(np.float64), 0)
        vote = cosine**SHARPNESS * self.stands_for[order]
        return ((vote * self.label[order]).sum(1) + PRIOR * self.prior) / (vote.sum(1) + PRIOR)


def _best(near: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k greatest cosines to five digits, ties to the smaller place."""
    n = near.shape[1]
    key = np.round(near.astype(np.float64) * 1e5).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    return np.argpartition(key, n - k, axis=1)[:, n - k :]


def fit(x: np.ndarray, label: np.ndarray, sizes: tuple[int, int], dimensions: int = DIMENSIONS) -> Model:
    """A model from the sample's shares and labels; sizes: all documents with label 0 and label 1."""
    n = len(x)
    weight = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    a = x * weight
    rng = np.random.default_rng(11)
    q = np.linalg.qr(a.T @ rng.standard_normal((n, min(n, dimensions + 16))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, s, turn = np.linalg.svd(a @ q, full_matrices=False)
    axes = (q @ turn.T[:, s > 1e-6 * s[0]])[:, :dimensions].astype(np.float32)
    model = Model(weight, axes, np.zeros((0, 0)), label, np.ones(n), sizes[1] / sum(sizes))
    for value in (0, 1):
        of = label == value
        if of.any():
            model.stands_for[of] = sizes[value] / sum(sizes) / of.sum() * n
    model.vectors = model.project(x)
    return model


def train(df: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from the texts (doc_id, text) and the labels (doc_id, label) that are not held out; None without any."""
    spark = df.sparkSession
    small_batches(spark)
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).distinct()
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chance = F.xxhash64("doc_id")
    chosen = [r for value in sizes for r in rows.where(F.col("label") == value).orderBy(chance, "doc_id").limit(per_label).collect()]
    if not chosen:
        return None
    table = F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for r in chosen], rows.select("doc_id", "label").schema))  # 2 * per_label rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shares(t).astype(np.float16).tobytes() for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    sample = df.join(table, "doc_id").select("doc_id", "label", "text")
    made = sample.mapInArrow(run, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, x binary")
    # repeated numbers could bring more texts than labels: the bound holds for them too
    found = made.orderBy(chance, "doc_id", "label", "x").limit(2 * per_label).collect()
    if not found:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in found]).astype(np.float32)
    return fit(x, np.array([float(r.label) for r in found]), (sizes.get(0, 0), sizes.get(1, 0)))


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. labels: doc_id, label (0 or 1)."""
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(train(d, labels.select("doc_id", F.col("label").cast("int").alias("label")), per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts, score = b.column(1), np.full(b.num_rows, 0.5)
            for at in range(0, b.num_rows if model is not None else 0, _BLOCK):
                score[at : at + _BLOCK] = model.score(np.stack([shares(t) for t in text_bytes(texts.slice(at, _BLOCK))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
