"""A hidden Markov language model, trained by Baum-Welch over the whole training part of a corpus.

Latent states emit classes of tokens. Each token of the head, the most frequent tokens up to `head`, is a
class of its own, with an expected count in each state; the others are classed by their last bytes, and a
class emits its tokens in proportion to their counts plus one. So every token has a probability.

1. Each partition counts its tokens; the counts are added up by token. All tokens are counted.
2. The tokens above a cutoff on their counts in training, `head` at most, become a broadcast table, the head.
3. Each round of Baum-Welch reads all training texts: partitions add up expected counts by the exact
   forward-backward recursion over whole texts, and these are added up by class. Rounds end when the
   likelihood of a token gains less than `GAIN`, after `rounds` at most.
4. Scoring runs the scaled forward recursion over each whole text, many texts side by side. Tokens of
   the head are resolved there; the rest, in which no token is frequent, are joined with their counts.

Defined results: a null or empty text is its end token alone; a null doc_id counts as held out; without
training rows every token has probability 1, so scores are those of the states alone; repeated rows get
the same scores; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, small_batches, text_bytes

STATES = 8
ROUNDS = 4
#: Least gain of a round, in log10 likelihood of a token.
GAIN = 0.002
#: How likely a state is to last at the start of training.
STAY = 0.9
#: Occurrences by the states' shares that a class has beside its own, so that rare tokens lean on no state.
LEAN = 2.0
HEAD = 150_000
#: What the head's tokens take together at most.
HEAD_BYTES = 16 << 20
TAIL_CLASSES = 4096
FOLDS, FOLD = 7, 2
#: The end of a text; white space, so that no word is like it.
END = b"\n"
_FLUSH = 200_000
#: Tokens of texts that are read together and that run side by side, steps whose states are held at once, tokens whose emissions are added up at once.
_GATHER, _GROUP, _SEGMENT, _HELD = 6_000_000, 1 << 19, 4096, 1 << 17


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAIL_CLASSES


class _Classes(dict):
    """Class of a token: its own if it has one, else by its last bytes."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.own = len(own)

    def __missing__(self, token: bytes) -> int:
        return self.own + tail_class(token)


def token_counts(df: DataFrame) -> DataFrame:
    """token (binary), n, m, cls (its class among the tail): n over the training texts of df (held_out, text), m over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush(of: Counter, learnt: bool) -> pa.RecordBatch:
            tokens, m = list(of), pa.array(list(of.values()), pa.int64())
            n = m if learnt else pa.array(np.zeros(len(tokens), np.int64))
            of.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), n, m, pa.array(list(map(tail_class, tokens)), pa.int32())], names=["token", "n", "m", "cls"])

        for batch in batches:
            for held_out, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                of = counts[held_out]
                of.update(text.lower().split())
                of[END] += 1
                if len(of) > _FLUSH:
                    yield flush(of, not held_out)
        for of, learnt in zip(counts, (True, False), strict=True):
            if of:
                yield flush(of, learnt)

    partial = df.select("held_out", "text").mapInArrow(run, "token binary, n long, m long, cls int")
    return partial.groupBy("token", "cls").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _above(counts: DataFrame, by: str, most: int) -> list[tuple[bytes, int]]:
    """The tokens above a cutoff on the count `by`, `most` and HEAD_BYTES at most, with their counts in training."""
    step = F.floor(F.log2(by) * 16).cast("int")
    sizes = counts.where(F.col(by) > 0).groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.sum(F.octet_length("token")).alias("b")).orderBy(F.desc("s")).collect()
    total, width, cutoff = 0, 0, None
    for r in sizes:
        if total + r.k > most or width + r.b > HEAD_BYTES:
            break
        total, width, cutoff = total + r.k, width + r.b, r.s
    rows = counts.where((F.col(by) > 0) & (step >= cutoff)).select("token", "n").collect() if cutoff is not None else []
    return [(bytes(r.token), r.n) for r in rows]


class Vocabulary:
    """Classes of the head's tokens, the tokens' counts, and for every class its weight and the logarithm of its size.

    The head is what is frequent in the training texts, so held-out texts have no part in the model. `aside` are the
    tokens that are frequent in all texts but not in training: the model takes them for tokens of the tail, but
    their counts are looked up here, so that no frequent token is joined.
    """

    def __init__(self, head: list[tuple[bytes, int]], frequent: list[tuple[bytes, int]], tail: dict[int, tuple[int, int]], ends: int):
        # the end always has a class
        head = sorted(((t, n) for t, n in head if t != END), key=lambda x: (-x[1], x[0]))
        own = [(END, ends), *head]
        self.cls = {t: i for i, (t, _) in enumerate(own)}
        self.aside = {t: n for t, n in frequent if t not in self.cls}
        self.n = np.array([n for _, n in own], float)
        words = np.array([tail.get(c, (0, 0)) for c in range(TAIL_CLASSES)], float)
        for t, n in own:
            words[tail_class(t)] -= (n, n > 0)
        self.log_size = np.log10(np.concatenate([self.n + 1, np.maximum(words.sum(1) + 1, 1)]))
        # how often a class occurs in training
        self.weight = np.concatenate([self.n, words[:, 0]])


def initial(weight: np.ndarray, states: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities: states that last, class frequencies apart by a seeded draw."""
    rng = np.random.default_rng(seed)
    b = (weight + 1)[None] * rng.gamma(1.0, 1.0, (states, len(weight)))
    a = rng.gamma(4.0, 0.25, (states, states))
    a = (1 - STAY) * a / a.sum(1, keepdims=True) + STAY * np.eye(states)
    return np.full(states, 1 / states), a, b / b.sum(1, keepdims=True)


def _batch_classes(column, classes: _Classes) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Classes of all tokens of a column of texts, where each text starts (with the end at last), its tokens beyond the head."""
    parts, starts, rest = [], [0], []
    for text in text_bytes(column):
        words = text.lower().split()
        words.append(END)
        found = np.fromiter(map(classes.__getitem__, words), np.int32, len(words))
        parts.append(found)
        starts.append(starts[-1] + len(words))
        rest.append([words[i] for i in np.flatnonzero(found >= classes.own)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(starts), rest


def forward(classes: np.ndarray, starts: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion; sequences run side by side."""
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    first, length = starts[:-1][order], length[order]
    out, emit = np.zeros(len(order)), np.ascontiguousarray(b.T)
    if not len(order):
        return out
    # how many sequences are longer than t
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    alpha = np.broadcast_to(pi, (len(order), len(pi)))
    for t in range(length[0]):
        n = active[t]
        alpha = (alpha[:n] @ a if t else alpha[:n]) * emit.take(classes[first[:n] + t], axis=0)
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:n] += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected(classes: np.ndarray, starts: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray, which: np.ndarray | None = None, segment: int = _SEGMENT, emissions: np.ndarray | None = None):
    """Expected counts of whole sequences by forward-backward: start (K), transitions (K, K), emissions (K, C); log10 likelihood.

    Sequences (those of `which`, if given) run side by side. The states of `segment` steps are held at once:
    where sequences are longer, those at each segment's beginning are kept and the others worked out again.
    The emissions are added to those given.
    """
    k, c = b.shape
    emissions = np.zeros((k, c)) if emissions is None else emissions
    length = np.diff(starts) if which is None else np.diff(starts)[which]
    order = np.argsort(-length, kind="stable")
    first, length = (starts[:-1] if which is None else starts[which])[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    emit = np.ascontiguousarray(b.T)

    ones = np.ones((k, 1), b.dtype)

    def ahead(alpha: np.ndarray, lo: int, hi: int) -> tuple[list, list, list, list]:
        alphas, scales, seen, emitted = [], [], [], []
        for t in range(lo, hi):
            n = active[t]
            at = classes[first[:n] + t]
            of = emit.take(at, axis=0)
            alpha = (alpha[:n] @ a if t else alpha[:n]) * of
            scale = alpha @ ones
            alpha /= scale
            alphas.append(alpha)
            scales.append(scale)
            seen.append(at)
            emitted.append(of)
        return alphas, scales, seen, emitted

    borders = range(0, int(length[0]), segment)
    entries = [np.broadcast_to(pi, (len(order), k))]
    for lo in borders[:-1]:
        entries.append(ahead(entries[-1], lo, lo + segment)[0][-1])
    trans, gammas, classed, held, likelihood = np.zeros((k, k)), [], [], 0, 0.0

    def add() -> None:
        at, gamma = np.concatenate(classed), np.concatenate(gammas)
        by_class = np.argsort(at)
        at = at[by_class]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        emissions[:, at[begins]] += np.add.reduceat(gamma.take(by_class, axis=0), begins, axis=0).T
        classed.clear()
        gammas.clear()

    beta = np.ones((active[-1], k), b.dtype)
    for lo, entry in zip(reversed(borders), reversed(entries), strict=True):
        alphas, scales, seen, emitted = ahead(entry, lo, min(lo + segment, int(length[0])))
        likelihood += float(np.log10(np.concatenate(scales)).sum(dtype=float))
        # exact arithmetic would give 1 here: single precision shall not drift
        beta = beta / (alphas[-1][: len(beta)] * beta).sum(1, keepdims=True)
        for t in range(lo + len(alphas) - 1, lo - 1, -1):
            n = active[t]
            if n > len(beta):
                beta = np.concatenate([beta, np.ones((n - len(beta), k), b.dtype)])
            gammas.append(alphas[t - lo] * beta)
            classed.append(seen[t - lo])
            held += n
            if t:
                back = emitted[t - lo]
                back *= beta
                back /= scales[t - lo]
                trans += (alphas[t - lo - 1] if t > lo else entry)[:n].T @ back
                beta = back @ a.T
            else:
                begin = gammas[-1].sum(0)
            if held > _HELD or not t:
                add()
                held = 0
    return begin, trans * a, emissions, likelihood


def _groups(starts: np.ndarray) -> list[np.ndarray]:
    """Texts, the longest first, in groups of about _GROUP tokens, so that long texts run beside each other."""
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    group = (np.cumsum(length[order]) - length[order]) // _GROUP
    return np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []


def _sequences(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of a column of encoded texts, and where each text starts (with the end at last)."""
    starts = column.offsets.to_numpy().astype("int64")
    return column.flatten().to_numpy(), starts - starts[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of encoded texts joined to some of about _GATHER tokens: of many texts, those of like length run side by side."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(batch.num_columns - 1).flatten())
        if size >= _GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def baum_welch(training: DataFrame, vocabulary, params: tuple, rounds: int, gain: float = GAIN) -> tuple:
    """Start, transition and emission probabilities after `rounds` over all encoded training texts, fewer if the likelihood no longer gains."""
    spark = training.sparkSession
    k, c = params[2].shape
    weight, before = vocabulary.value.weight, -np.inf
    names = [f"e{j}" for j in range(k)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(tuple(x.astype("float32") for x in params))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pi, a, b = shared.value
            # rows by class; before them the start, the likelihood and the transitions from each state
            other, emissions = np.zeros((2 + k, k)), np.zeros((c, k)).T
            for batch in _gathered(batches):
                seq, starts = _sequences(batch.column(0))
                for which in _groups(starts):
                    begin, trans, _, likelihood = expected(seq, starts, pi, a, b, which, emissions=emissions)
                    other[0] += begin
                    other[1, 0] += likelihood
                    other[2:] += trans
            at = np.flatnonzero(emissions.any(0))
            i = np.concatenate([np.arange(-2 - k, 0), at]).astype("int32")
            x = np.concatenate([other, emissions[:, at].T])
            yield pa.RecordBatch.from_arrays([pa.array(i), *[pa.array(x[:, j].astype("float32")) for j in range(k)]], names=["i", *names])

        sums = training.mapInArrow(run, "i int, " + ", ".join(f"{e} float" for e in names)).groupBy("i").agg(*[F.sum(e).alias(e) for e in names]).toArrow()
        x = np.zeros((2 + k + c, k))
        x[sums["i"].to_numpy() + 2 + k] = np.column_stack([sums[e].to_numpy() for e in names])
        pi, a, b = x[0] + 0.1, x[2 : 2 + k] + 0.1, x[2 + k :].T
        # of a class's weight plus one, each state emits its part
        b = (weight + 1) * (b + LEAN * b.sum(1, keepdims=True) / b.sum()) / (weight + LEAN)
        params = pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
        shared.destroy()
        if x[1, 0] - before < gain * weight.sum():
            break
        before = x[1, 0]
    return params


def _encoded(df: DataFrame, vocabulary) -> DataFrame:
    """Per row: tokens, known ones and sums over the head, the logarithms of its classes' sizes, the tokens beyond the head, all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        classes = _Classes(v.cls)
        logs = np.concatenate([np.log10(v.n + 1), np.zeros(TAIL_CLASSES)])
        knows = np.concatenate([v.n > 0, np.zeros(TAIL_CLASSES, bool)]).astype("int64")
        for batch in batches:
            seq, starts, rest = _batch_classes(batch.column(2), classes)
            known, sums, sizes = (np.add.reduceat(x[seq], starts[:-1]) if len(starts) > 1 else x[:0] for x in (knows, logs, v.log_size))
            aside = [[n for w in words if (n := v.aside.get(w, 0))] for words in rest]
            known += np.array([len(x) for x in aside], known.dtype)
            sums += np.array([sum(math.log10(n + 1) for n in x) for x in aside], float)
            counted = [list(Counter(w for w in words if w not in v.aside).items()) for words in rest]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(known), pa.array(sums), pa.array(sizes), pa.array(counted, pa.map_(pa.binary(), pa.int64())), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(seq))],
                names=["doc_id", "held_out", "n_tokens", "known", "sum_head", "sizes", "rest", "classes"],
            )

    return df.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, sum_head double, sizes double, rest map<binary, bigint>, classes array<int>")


def _scored(encoded: DataFrame, params) -> DataFrame:
    """The columns of `encoded` with `states`, the states' log10 likelihood of the classes, in place of the last one, `classes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            *others, classes = batch.columns
            yield pa.RecordBatch.from_arrays([*others, pa.array(forward(*_sequences(classes), *params.value))], names=[*batch.schema.names[:-1], "states"])

    kinds = dict(encoded.dtypes[:-1]) | {"states": "double"}
    return encoded.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    small_batches(spark)
    fold = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == FOLD, F.lit(True))
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), fold.alias("held_out"), F.col(text).alias("text"))
    counts = cut(token_counts(d))
    learnt = F.col("n") > 0
    by_class = counts.where(learnt).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in by_class), sum(r.v for r in by_class)
    ends = counts.where(F.col("token") == F.lit(END)).select("n").first()
    v = Vocabulary(_above(counts, "n", head), _above(counts, "m", head), {r.cls: (r.n, r.v) for r in by_class}, ends.n if ends else 0)
    vocabulary = spark.sparkContext.broadcast(v)
    # texts are split and looked up once, for all rounds and the scores
    rows = cut(_encoded(d, vocabulary))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())  # of a checkpoint: the same on every read
    params = baum_welch(rows.where("NOT held_out").select("classes"), vocabulary, initial(v.weight, states), rounds if total else 0)
    rare = rows.where(F.size("rest") > 0).select("rid", F.explode("rest").alias("token", "times"))
    # one row a text and token, and what is frequent in all texts is in the head: no hot key
    log = F.col("times") * F.log10(F.col("n") + 1)
    rare = rare.join(counts.where(learnt).select("token", "n"), "token").groupBy("rid").agg(F.sum(log).alias("sum_rest"), F.sum("times").alias("known_rest"))
    numbers = ["rid", "doc_id", "held_out", "n_tokens", "known", "sum_head", "sizes"]
    out = _scored(rows.select(*numbers, "classes"), spark.sparkContext.broadcast(params)).join(rare, "rid", "left")
    sums = F.col("sum_head") + F.coalesce("sum_rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rest", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (sums - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (sums + F.col("states") - F.col("sizes")).alias("score"),
    )
