"""Language ID, mixing, HMM scoring, near-duplicates, search and packing, against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import hmm_lm, language_id, mixing, near_dedup, packing, topk_search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_language_accuracy(corpus):
    rows = language_id.identify(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == corpus.count() and all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_learns_from_the_other_folds_alone(spark, documents):
    held = next(i for i in range(100) if crc(i) % 5 == 0)
    rest = [i for i in range(40) if crc(i) % 5][:10]
    df = documents([(held, "zzz qqq www", "xx", "s")] + [(i, "the cat and the hat", "en", "s") if i % 2 else (i, "le chat et la fleur", "fr", "s") for i in rest])
    assert "xx" not in {r.lang_pred for r in language_id.identify(df).collect()}


def test_language_awkward_and_empty(awkward, nothing, documents):
    got = language_id.identify(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents([(1, "some text", None, "a")])).collect()} == {"und"}
    assert language_id.keep(awkward).columns == awkward.columns


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= 1 and (n < 4 or min(apart) >= 3)


def test_mix_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3]) or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    for sizes in ([100, 100, 100], [1, 1000, 10, 0, 5], [7], [0, 0], []):
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    # the excess of a full source goes to the others by weight
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, (3015 - 20) * 2 / 3, (3015 - 20) / 3])


def test_pivotal_rounding_keeps_the_mass():
    rng = np.random.default_rng(1)
    w, p = rng.integers(1, 50, 400).astype(float), rng.random(400)
    out, held = mixing.round_group(p, w, np.random.default_rng(2), last=False)
    whole = [i for i in range(400) if i != held]
    assert set(np.round(out[whole], 12)) <= {0.0, 1.0} and (out * w).sum() == pytest.approx((p * w).sum())
    mean = np.mean([mixing.round_group(p, w, np.random.default_rng(s), last=True)[0] for s in range(600)], 0)
    assert np.abs(mean - p).max() < 0.12 and abs((mean - p).mean()) < 0.01


def test_mix_is_near_target_through_the_tree(corpus):
    df = corpus
    d = mixing.decide(mixing.sized(df, "doc_id", "text", "source"), bucket_rows=4, fan=2)
    per = {}
    for r in d.collect():
        assert 0 <= r.copies <= 2
        per.setdefault(r.source, [r.target, 0, 0])
        per[r.source][1] += r.copies * r.size * r.rows
        per[r.source][2] = max(per[r.source][2], r.size)
    assert all(abs(taken - target) <= most for target, taken, most in per.values())


def test_mix_reruns_and_applies(corpus, awkward, nothing):
    key = lambda rows: sorted(map(str, rows))
    for df in (corpus, awkward):
        a, b = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
        assert key(a) == key(b) and len(a) == df.count()
        applied = mixing.apply(df)
        assert applied.columns == df.columns and applied.count() == sum(r.copies for r in a)
    assert mixing.mix(nothing).count() == 0 and mixing.apply(nothing).count() == 0


def test_mix_of_repeated_rows_is_near_target(documents):
    rows = [(None, "one two three four five six seven", "en", "a")] * 1000 + [(i, "eight words are in this text of ours", "en", "b") for i in range(500)]
    got = mixing.mix(documents(rows)).collect()
    for source, size in (("a", 7), ("b", 8)):
        of = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= size and all(r.taken <= 2 * r.size for r in of)
    assert len(got) == 1500
    applied = mixing.apply(documents(rows).repartition(5))
    assert applied.count() == sum(r.copies for r in got) and applied.where("source = 'a'").count() == sum(r.copies for r in got if r.source == "a")


def test_mix_columns_are_as_restated_in_sql(corpus):
    import duckdb

    want = duckdb.sql(f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM '{SF}/documents.parquet'),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source)
        SELECT d.doc_id, d.size, s.source_size, s.source, s.w FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source""").fetchall()
    got = {r.doc_id: r for r in mixing.mix(corpus).collect()}
    assert {(i, r.size, r.source_size, r.source) for i, r in got.items()} == {x[:4] for x in want}
    # water level: a level per weight, cut at twice the size, that fills 150 %
    sizes = {x[3]: (x[2], x[4]) for x in want}
    goal, low, high = 1.5 * sum(n for n, _ in sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * n, mid * w) for n, w in sizes.values()) < goal else (low, mid)
    assert all(r.target == pytest.approx(min(2 * sizes[r.source][0], low * sizes[r.source][1]), rel=1e-6) for r in got.values())


def test_hmm_learns_from_training_texts_alone(documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    train = [i for i in range(200) if crc(i) % 7 != 2]
    held = [i for i in range(200) if crc(i) % 7 == 2]
    base = [(i, " ".join(rng.choices(words, k=30)), "en", "s") for i in train]
    for other in ("zz " * 50, "w39 w38 " * 400):
        df = documents(base + [(i, other, "en", "s") for i in held])
        score = {r.doc_id: (r.score, r.base_score) for r in hmm_lm.score(df, head=10, rounds=2).collect() if not r.held_out}
        first = score if other.startswith("zz") else first
        assert all(score[i] == pytest.approx(first[i], abs=1e-9) for i in train)


def test_hmm_base_and_tail(corpus, awkward):
    for df, head in ((corpus, 50), (corpus, 10**6), (awkward, 3)):
        rows = df.collect()
        count = Counter()
        for r in rows:
            if r.doc_id is not None and crc(r.doc_id) % 7 != 2:
                count.update((r.text or "").encode().lower().split() + [b"\n"])
        n, v = sum(count.values()), len(count)
        want = []
        for r in rows:
            words = (r.text or "").encode().lower().split() + [b"\n"]
            want.append((r.doc_id or -1, r.doc_id is None or crc(r.doc_id) % 7 == 2, len(words), sum(w in count for w in words), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 5)))
        got = hmm_lm.score(df, head=head, rounds=1).collect()
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
        assert all(r.score <= 1e-9 for r in got)


def test_hmm_beats_the_base_on_held_out_texts(corpus):
    rows = [r for r in hmm_lm.score(corpus).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    pi, a, b = (x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 5))))
    seqs = [rng.integers(0, 5, n).astype(np.int16) for n in (1, 4, 6)]
    got = hmm_lm.forward(np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs]), pi, a, b)
    import itertools

    for s, x in zip(seqs, got, strict=True):
        total = sum(pi[path[0]] * b[path[0], s[0]] * np.prod([a[path[i - 1], path[i]] * b[path[i], s[i]] for i in range(1, len(s))]) for path in itertools.product(range(3), repeat=len(s)))
        assert x == pytest.approx(math.log10(total))


def test_expected_counts_add_up_and_training_climbs():
    rng = np.random.default_rng(4)
    seq, starts = rng.integers(0, 6, 500).astype(np.int16), np.array([0, 3, 100, 101, 500])
    params = hmm_lm.initial(np.ones(6), 3)
    before = None
    for _ in range(5):
        begin, trans, emissions, likelihood = hmm_lm.expected(seq, starts, *params)
        assert begin.sum() == pytest.approx(4) and trans.sum() == pytest.approx(496) and emissions.sum() == pytest.approx(500)
        now = hmm_lm.forward(seq, starts, *params).sum()
        assert likelihood == pytest.approx(now)
        assert before is None or now >= before - 1e-9
        before = now
        params = begin / begin.sum(), trans / trans.sum(1, keepdims=True), emissions / emissions.sum(1, keepdims=True)


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(8)
    pi, a, b = (x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 5))))
    seqs = [rng.integers(0, 5, n) for n in (1, 6, 4, 6)]
    begin, trans, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    import itertools

    for s in seqs:
        paths = {p: pi[p[0]] * b[p[0], s[0]] * np.prod([a[p[i - 1], p[i]] * b[p[i], s[i]] for i in range(1, len(s))]) for p in itertools.product(range(3), repeat=len(s))}
        for p, x in paths.items():
            x /= sum(paths.values())
            begin[p[0]] += x
            for i, at in enumerate(p):
                emissions[at, s[i]] += x
                if i:
                    trans[p[i - 1], at] += x
    starts = np.cumsum([0] + [len(s) for s in seqs])
    for segment in (1, 2, 5, 6, 100):
        got = hmm_lm.expected(np.concatenate(seqs), starts, pi, a, b, segment=segment)
        for x, want in zip(got, (begin, trans, emissions), strict=False):
            assert x == pytest.approx(want)
    parts = [hmm_lm.expected(np.concatenate(seqs), starts, pi, a, b, np.array(w)) for w in ([1, 0], [3, 2])]
    assert parts[0][2] + parts[1][2] == pytest.approx(emissions) and parts[0][1] + parts[1][1] == pytest.approx(trans)


def test_hmm_empty(nothing, documents):
    assert hmm_lm.score(nothing).count() == 0
    held = next(i for i in range(99) if crc(i) % 7 == 2)
    r = hmm_lm.score(documents([(held, "no training rows", "en", "a")])).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)


def linked(rows, size):
    words = [(r.text or "").encode().lower().split() for r in rows]
    sets = [set(zip(*[w[i:] for i in range(size)])) if len(w) >= size else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r.doc_id)
    return [(r.doc_id, len(sets[i]), r.doc_id if not sets[i] else min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def near_copies(n=60, seed=9):
    """Chains and groups of near copies around the threshold, short texts among them."""
    rng, out = random.Random(seed), []
    vocabulary = [f"v{i}" for i in range(40)]
    for g in range(8):
        text = [rng.choice(vocabulary) + (str(g) if g % 2 else "") for _ in range(rng.choice([5, 8, 30, 120]))]
        for _ in range(n // 4):
            text = text[:] if rng.random() < 0.2 else [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.08]) else w for w in text]
            out.append((len(out), " ".join(text), "en", "a"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(corpus, documents, awkward, size):
    for df in (corpus, documents(near_copies()), awkward):
        rows = df.collect()
        got = near_dedup.link(df, size).collect()
        assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, linked(rows, size)))
        assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_keep(awkward, nothing, documents):
    df = documents(near_copies())
    kept = near_dedup.keep(df, size=2)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in near_dedup.link(df, 2).where("kept").collect())
    assert near_dedup.keep(nothing).count() == 0 and near_dedup.keep(awkward).count() > 0


def test_near_duplicates_keep_one_row_whatever_the_numbers(documents):
    """Groups of null, repeated and equal numbers; rows without words stay."""
    text = lambda g, v=0: " ".join(f"g{g}w{i}" for i in range(60)) + f" v{v}"
    rows = [(None, text(0, v), "en", "a") for v in range(4)] + [(7, text(1, v), "en", "a") for v in range(3)] + [(8, text(2), "en", x) for x in "abc"] + [(None, text(2, 1), "en", "a")]
    rows += [(9, "", "en", "a"), (9, "", "en", "a"), (10, None, "en", "a")]
    left = near_dedup.keep(documents(rows), size=2).collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:2]) for r in left) == [(-1, "g0"), (7, "g1"), (8, "g2"), (9, ""), (9, ""), (10, "")]
    assert len(left) == 6


def test_near_duplicates_in_long_lists(documents):
    """Templates that hundreds of texts share, with chains at the threshold: lists longer than SHORT hold several components."""
    rng, out = random.Random(3), []
    base = [f"b{i}" for i in range(100)]
    for g in range(12):
        body = base[:70] + [f"g{g}x{i}" for i in range(30)]
        for k in range(20):
            at = rng.sample(range(100), rng.choice([0, 1, 3, 5]))
            out.append((len(out), " ".join(f"n{g}k{k}i{i}" if i in at else w for i, w in enumerate(body)), "en", "a"))
    df = documents(out)
    got = near_dedup.link(df, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(linked(df.collect(), 2))


def test_near_duplicates_pairs_of_a_large_group(documents, monkeypatch):
    """Texts at the edge of a large group are not compared with all of it, and links are as by brute force."""
    rng, out, made = random.Random(7), [], []
    families = [[f"b{i}" for i in range(146)] for _ in range(6)]
    change = lambda t, n: [f"v{rng.randrange(60)}" if i in at else w for at in [set(rng.sample(range(146), min(146, n)))] for i, w in enumerate(t)]
    families = [change(t, rng.choice([0, 2, 4, 6])) for t in families]
    for k in range(400):
        out.append((k, " ".join(change(rng.choice(families), int(rng.expovariate(1 / 3)))), "en", "a"))

    def counted(near, *rest, f=near_dedup._similar_sets):
        made.append(near.count())
        return f(near, *rest)

    monkeypatch.setattr(near_dedup, "_similar_sets", counted)
    df = documents(out)
    got = near_dedup.link(df, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(linked(df.collect(), 2))
    assert sum(made[1:]) < len(out), made


def test_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n in (1, 10, 300, 5000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = both[: n - n // 5], both[n // 5 :]
        apart = sum(int(w).bit_count() for w in (near_dedup.sketch(x) ^ near_dedup.sketch(y)).view(np.uint64))
        assert apart <= 2 * (n // 5) and (n > 300 or apart >= n // 5)


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(50)] + [(101, 100), (103, 101), (103, 102)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 104)}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, run):
    """What run() returns and the number of Spark jobs that it took."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_components_end_with_stars(spark):
    """Edges that are stars need no round; others are searched as before, with roots of any depth."""
    stars = [(100 * i + j, 100 * i) for i in range(5) for j in range(1, 9)]
    got, jobs = jobs_of(spark, lambda: near_dedup.components(spark.createDataFrame(stars, "a long, b long")))
    assert {r.node: r.root for r in got.collect()} == {a: b for a, b in stars} | {b: b for _, b in stars}
    assert jobs < 6, jobs
    rng = random.Random(4)
    edges = {(max(e), min(e)) for e in (rng.sample(range(300), 2) for _ in range(200))}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in near_dedup.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()} == root


def test_sets_ask_the_driver_once(spark, documents):
    """The bitmap of wanted texts takes no job for each of many shuffle partitions."""
    df = documents([(i, f"text number {i} of some words", "en", "a") for i in range(40)]).withColumn("key", near_dedup.text_key("text"))
    identity = {i: near_dedup._identity(near_dedup.shingles(f"text number {i} of some words".encode(), 2)) for i in range(0, 40, 3)}
    wanted = spark.createDataFrame([(1000 + i, identity[i], i) for i in identity], "nid long, node binary, id long")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got, jobs = jobs_of(spark, lambda: near_dedup._sets(df, wanted, 2))
        assert sorted(r.nid for r in got.collect()) == [1000 + i for i in identity]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs < 40, jobs


def brute_search(rows, k, every):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(vectors):
        if i % every == 0:
            score = lambda c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True))))  # noqa: B023, E731
            scores = sorted((-score(c), j) for other, (j, c) in enumerate(vectors) if other != at and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5]) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 360)]
    rows += [(1000, None), (None, [1.0] * 6), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [0.5, 0.5]), (1250, []), rows[50], rows[7], (100, [0.25] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, query_id int")
    for slices, c, q in ((4, 4096, 2048), (3, 50, 2), (1, 7, 100)):
        got = topk_search.search(df, slices=slices, candidates_per_block=c, queries_per_block=q).collect()
        assert sorted(tuple(r) for r in got) == brute_search(rows, 5, 50)
    assert topk_search.search(df.limit(0)).count() == 0


def test_search_of_huge_components(spark):
    """Scores beyond a long are clamped, and tie there."""
    rows = [(0, [1e13, 3.0]), (1, [1.0, 2.0]), (2, [-1e3, 1.0]), (3, [-1e4, 1.0]), (4, [1e3, 1.0]), (5, [1e4, 1.0]), (50, [-1e13, 0.0])]
    got = topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == brute_search(rows, 5, 50)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_packing(df, parts, **options):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(vocabulary()), []
    capacity = options.get("capacity", 2048)
    for r in df.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    got = packing.pack(df.repartition(parts), vocabulary(), **options).collect()
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing(corpus, awkward, nothing):
    used, least = check_packing(corpus, 1)
    assert used <= least + 2
    check_packing(awkward, 3)
    used, least = check_packing(corpus, 40, fan=3)
    assert used <= 1.25 * least, "the tree merges what 40 small partitions leave"
    check_packing(corpus, 9, capacity=64, fan=2, passed=5)
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_packing_special_strings_and_case(documents):
    texts = ["a <|endoftext|> b", "It's THE end... 1.5, x,y ,z (ok), Éa Í I\u0307 \u00a0 \u2003x", "e\u0301 E\u0301 ß ŒUVRE ﬁ", "end.\nend. end,", "don't DON'T 'S'"]
    check_packing(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), 2)


def test_best_fit():
    where, off, fill = packing.best_fit(np.array([5, 5, 3, 2, 2, 3]), 10)
    assert len(fill) == 2 and fill.sum() == 20 and set(where) == {0, 1}
