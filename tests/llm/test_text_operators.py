"""Quality votes, fill-in-the-middle and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fill_middle, importance, quality_knn

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# fill-in-the-middle


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(size):
    data = np.frombuffer(("aé€𝄞\n" * size).encode()[:size], np.uint8)
    begins = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    bounds = fill_middle.Boundaries(data)
    assert bounds.rank(np.arange(size + 1)).tolist() == [sum(x < i for x in begins) for i in range(size + 1)]
    assert bounds.select(np.arange(len(begins))).tolist() == begins


def fim(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    a, b, c = t[:lo], t[lo:hi], t[hi:]
    out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return (doc_id, len(t), out[0], lo, hi - lo, out[1])


def test_transform_is_as_by_code_points(spark, awkward):
    alphabet = "aé€𝄞\n<PSM> "
    rng = random.Random(5)
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(600)] + ["a <P> b", "x<", "é" * 100_000, "𝄞", None, ""]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (made.repartition(3), awkward.select("doc_id", "text")):
        got = fill_middle.transform(df).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
        want = [fim(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
        texts_by_id = Counter((r.doc_id, r.text or "") for r in df.collect())
        assert Counter((r.doc_id, r.back) for r in got) == texts_by_id
    assert {r.form for r in fill_middle.transform(made).collect()} == {"plain", "psm", "spm"}


def test_fill_middle_empty_and_extra_columns(awkward, nothing):
    assert fill_middle.digests(nothing).count() == 0
    got = fill_middle.digests(awkward)
    assert got.count() == awkward.count() and "kept" not in got.columns
    assert {r.form for r in got.where("n = 0").collect()} == {"plain"}


# importance resampling


def brute(docs, target):
    features = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 10000.0) / ((s[b] + 1.0) * (sum(t.values()) + 10000.0)))) for b in range(10000)]
    rows = []
    for doc_id, x in docs:
        f = features(x)
        w = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        n_words = len(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")))
        rows.append((doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    taken = fit[: 25 * len(fit) // 100]
    return rows, taken


@pytest.mark.parametrize("chunk", [1 << 16, 37])
def test_resampling_is_as_by_brute_force(spark, corpus, chunk):
    docs = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, taken = brute(docs, [r.text for r in bench.collect()])
    rank = {r[0]: i + 1 for i, r in enumerate(taken)}
    got = importance.resample(corpus, bench, chunk_bytes=chunk).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got))) == sorted(map(repr, ((*r[:4], rank.get(r[0])) for r in rows)))


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("text", ["", "a", " a  b ", "Ab cÉ d, e9 f" * 7, "x" * 50, "--" * 30 + "a" + "--" * 40 + "b c"])
def test_chunks_own_each_feature_once(text, n):
    data = text.encode()
    whole = importance.hashed(data, len(data), n)
    for size in (1, 3, 10, 1000):
        parts = [importance.hashed(body, own, n) for own, body in importance.split(data, n, size)]
        assert sum(p[0] for p in parts) == whole[0]
        assert Counter(np.concatenate([p[1] for p in parts]).tolist()) == Counter(whole[1].tolist())


def test_resampling_awkward(spark, awkward, nothing):
    target = spark.createDataFrame([(1, "cc by word"), (2, None)], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    rows, taken = brute(docs, ["cc by word", None])
    got = importance.resample(awkward, target, chunk_bytes=1000).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(repr, (r[:4] for r in rows)))
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(taken) + 1))
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(awkward, target.limit(0)).count() == len(docs)


def test_copies_and_ties_have_ranks_of_their_own(spark):
    rows = [(1, "k", 3, 30, 5), (2, "k", 1, 30, 9), (None, "a", 2, 30, 5), (0, "z", 1, 30, 5), (7, "q", 9000, 19, 99), (8, "q", 6, 30, 1)]
    d = spark.createDataFrame(rows, "doc_id long, key string, copies long, n_words long, score long")
    got = importance.ranked(d, percent=50).collect()
    assert len(got) == sum(r[2] for r in rows)
    ranks = sorted((r["rank"], r.doc_id) for r in got if r["rank"] is not None)
    assert ranks == [(1, 2), (2, 0), (3, 1), (4, 1), (5, 1), (6, None)]


# quality votes


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    rows = quality_knn.judge(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, r.label) for r in rows if r.held_out and r.label is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.95


def test_held_out_labels_change_nothing(spark, corpus):
    docs = corpus.select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality AS label")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("label", F.when(held, 1 - F.col("label")).otherwise(F.col("label")))
    score = lambda y: {r.doc_id: r.score for r in quality_knn.judge(docs, y).collect()}
    assert score(labels) == score(other)


def test_votes_are_as_by_brute_force():
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((200, quality_knn.FEATURES))).astype(np.float32)
    label = (rng.random(200) < 0.7).astype(float)
    model = quality_knn.fit(x, label, (300, 700))
    z = model.project(x)
    got = model.score(x[:40])
    for i in range(40):
        cosines = [round(float(z[i] @ z[j]), 5) for j in range(200)]
        near = sorted(range(200), key=lambda j: (-cosines[j], j))[: quality_knn.NEIGHBOURS]
        votes = [max(float(z[i] @ z[j]), 0) ** quality_knn.SHARPNESS * model.stands_for[j] for j in near]
        want = (sum(v * label[j] for v, j in zip(votes, near)) + quality_knn.PRIOR * 0.7) / (sum(votes) + quality_knn.PRIOR)
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None), (4, 7), (5, 0)], "doc_id long, label int")
    got = quality_knn.judge(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert quality_knn.judge(nothing, labels).count() == 0
    assert {r.score for r in quality_knn.judge(awkward, labels.limit(0)).collect()} == {0.5}
    ones = quality_knn.judge(awkward, labels.where("label = 1")).collect()
    assert all(r.predicted == 1 for r in ones)


def test_features_of_repeated_and_long_texts():
    plain, again = quality_knn.counts(b"one two three four five six seven"), quality_knn.counts(b"one one one one one one one")
    at = quality_knn._AT_REPEATS
    assert plain[at] == 0 and again[at] == 6 and quality_knn.counts(b"")[quality_knn._AT_SHAPE] == 1
    long = b"some words here. " * 200_000
    assert quality_knn.counts(long)[: quality_knn._TRIGRAMS].sum() >= len(long) and np.isfinite(quality_knn.shares(b"x" * 3_000_000)).all()
