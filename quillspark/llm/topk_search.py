"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are quantised to integers. Candidates and queries are dealt into blocks of bounded size, and every
block of queries meets every block of candidates once in each of two passes. The dimensions of a vector
are split into `slices`, whose inner products are the local scores that add up to a score.

1. In each block every slice gives its k best entries for each query; the k-th best score among all
   entries gathered for a query is a safe cutoff: k candidates at least reach it.
2. The cutoff goes back to the blocks. With m slices, an entry whose slices all stay under an m-th of the
   cutoff (above the block's floors) can't reach it, so entries with a slice at or over that are sufficient.
3. The remaining slices of those entries are added, exactly, and the k best of a block that reach the
   cutoff go on to the final ranking.

Nothing is collected or broadcast. Blocks are dealt by the hash of the vector's number, so a vector that
many rows share spreads like any other.

Defined results: rows whose vec_id or vector is null or empty, or whose vector has null or non-finite
components, take no part; rows are what is searched, so a row that repeats another is a candidate and, as a
query, has ranks of its own under the same query_id; a query meets the candidates of its own length alone,
every row but itself; ties go to the smaller vec_id; quantised components and scores beyond a long are clamped
to its ends before they are ranked; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

SCALE = 256
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 2048
SLICES = 4

_PHASE1 = "query_id long, qkey long, vec_id long, score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KEYS = ["dim", "cb", "qb"]


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * component) as long, for the rows that take part."""
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, e).alias("e")).where("vec_id IS NOT NULL AND size(e) > 0")
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _products(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Exact inner products of each slice of the dimensions: queries by candidates."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    kind = "float64" if most < 2**52 else "int64" if most < 2**62 else object
    q, c = q.astype(kind), c.astype(kind)
    return [q[:, s] @ c[:, s].T for s in np.array_split(np.arange(q.shape[1]), min(slices, q.shape[1]))]


def _total(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of the slices' scores, within a long."""
    total = sum(parts)
    return np.clip(total, _LEAST, _MOST) if total.dtype == object else total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        equal = equal[np.argsort(ids[equal], kind="stable")[: k - len(above)]]
        return np.concatenate([above, equal])
    return np.arange(len(scores))


def _rows(q: pa.Table, c: pa.Table, picked: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    ids = c["vec_id"].to_numpy()
    at = np.concatenate([np.full(len(p), i) for i, p, _ in picked]) if picked else np.zeros(0, int)
    cols = [q["vec_id"].to_numpy()[at.astype(int)], q["rid"].to_numpy()[at.astype(int)]]
    cols += [ids[np.concatenate([p for _, p, _ in picked])] if picked else np.zeros(0, "int64"), np.concatenate([s for *_, s in picked]) if picked else np.zeros(0)]
    return pa.table([pa.array(x, pa.int64()) for x in (*cols[:3], [int(x) for x in cols[3]])], names=["query_id", "qkey", "vec_id", "score"])


def _gather(k: int, slices: int):
    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        picked = []
        if len(c) and len(q):
            ids, rids, own = c["vec_id"].to_numpy(), c["rid"].to_numpy(), q["rid"].to_numpy()
            parts = _products(_matrix(q["v"]), _matrix(c["v"]), slices)
            for i in range(len(q)):
                others = np.flatnonzero(rids != own[i])
                found = np.unique(np.concatenate([others[_best(p[i][others], ids[others], k)] for p in parts]))
                picked.append((i, found, _total([p[i][found] for p in parts])))
        return _rows(q, c, picked)

    return run


def _resolve(k: int, slices: int):
    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        picked = []
        if len(c) and len(q):
            ids, rids, own = c["vec_id"].to_numpy(), c["rid"].to_numpy(), q["rid"].to_numpy()
            cutoffs = q["cutoff"].to_pylist()
            parts = _products(_matrix(q["v"]), _matrix(c["v"]), slices)
            for i in range(len(q)):
                mask = rids != own[i]
                if cutoffs[i] is not None and cutoffs[i] > _LEAST:
                    floors = [p[i].min() for p in parts]
                    share = (cutoffs[i] - sum(floors)) / len(parts) - 1e-6 * (1 + abs(cutoffs[i]))
                    enough = np.zeros(len(ids), bool)
                    for p, low in zip(parts, floors, strict=True):
                        enough |= p[i] - low >= share
                    mask &= enough
                at = np.flatnonzero(mask)
                total = _total([p[i][at] for p in parts])
                if cutoffs[i] is not None:
                    at, total = at[total >= cutoffs[i]], total[total >= cutoffs[i]]
                best = _best(total, ids[at], k)
                picked.append((i, at[best], total[best]))
        return _rows(q, c, picked)

    return run


def search(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", slices: int = SLICES, candidates_per_block: int = CANDIDATES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose vec_id is divisible by `every`."""
    vectors = cut(quantised(df, vec_id, embedding).withColumn("dim", F.size("v")))
    vectors = vectors.withColumn("rid", F.monotonically_increasing_id())  # of a checkpoint: the same on every read
    is_query = F.col("vec_id") % every == 0
    n = vectors.agg(F.count("*").alias("c"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, query_blocks = max(1, -(-n.c // candidates_per_block)), max(1, -(-n.q // queries_per_block))
    number = lambda count: F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    same = [F.col(x).alias(x) for x in ("vec_id", "rid", "v", "dim")]  # columns of their own, for the joins with queries
    c = vectors.select(*same, number(blocks).alias("cb"), all_of(query_blocks).alias("qb")).groupBy(*_KEYS)
    queries = vectors.where(is_query).withColumn("qb", number(query_blocks))
    q = queries.withColumn("cb", all_of(blocks))
    lists = c.cogroup(q.groupBy(*_KEYS)).applyInArrow(_gather(k, slices), _PHASE1)
    by_query = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    cutoffs = lists.withColumn("rn", F.row_number().over(by_query)).where(F.col("rn") == k).select(F.col("qkey").alias("k2"), F.col("score").alias("cutoff"))
    q = queries.join(cutoffs, F.col("rid") == F.col("k2"), "left").drop("k2").withColumn("cb", all_of(blocks))
    found = c.cogroup(q.groupBy(*_KEYS)).applyInArrow(_resolve(k, slices), _PHASE1)
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    """search() over `embeddings`, in SQL: every pair, ranked."""
    return f"""
WITH ok AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS qrid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM ok q JOIN ok c ON q.vec_id % {every} = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
