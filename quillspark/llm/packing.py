"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenises its documents, cuts those that are too long, and best-fits the pieces, longest
first, into sequences. Nearly full sequences are final. The others go up a tree as items of their own:
`fan` partitions at a time, level by level, best-fit their underfull sequences into one another until
one group is left. Pieces stay where they are; a sequence that moves is one row of a table of moves,
joined back at the end. Best fit leaves at most one sequence that is half empty in a group, and two
that are more than half full never go together, so a group passes on the `passed` emptiest at most and
keeps the rest as they are; no piece is lost by that.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they
occur; a null doc_id is kept; no rows give no sequences. Extra columns are not read. The packing depends
on how the rows are dealt over partitions; the pieces do not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, small_batches, text_bytes

CAPACITY = 2048
END_ID = 0
#: A sequence with no more room than this is final at once.
SLACK = 8
FAN = 16
PASSED = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, off long, fill long, open boolean"
_MOVES = "bin long, part long, to long, add long, fill long, open boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and place in it, and the fill of each bin."""
    where, off, fill = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64"), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with room r exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        where[i], off[i] = b, fill[b]
        fill[b] += size
        if r > size:
            room[r - size].append(b)
            mask |= 1 << (r - size)
    return where, off, np.array(fill, "int64")


def _open(fill: np.ndarray, capacity: int, slack: int, passed: int) -> np.ndarray:
    out = np.zeros(len(fill), bool)
    out[np.argsort(fill, kind="stable")[:passed]] = True
    return out & (fill < capacity - slack)


def pieces(df: DataFrame, vocabulary: str, doc_id: str, text: str, capacity: int = CAPACITY, slack: int = SLACK, passed: int = PASSED) -> DataFrame:
    """The pieces of every document, packed within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.token_ids import encoder

        ids, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        docs, rows = [], []
        for batch in batches:
            for d, packed in zip(batch.column(0).to_pylist(), ids.packed(text_bytes(batch.column(1))), strict=True):
                packed += end
                n = len(packed) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    docs.append(d)
                    rows.append((k, at, size, zlib.crc32(packed if size == n else packed[4 * at : 4 * (at + size)])))
        ids.forget()
        if not rows:
            return
        table = np.array(rows, "int64")
        where, off, fill = best_fit(table[:, 2], capacity)
        is_open = _open(fill, capacity, slack, passed)
        for i in range(0, len(table), 50_000):
            s = slice(i, i + 50_000)
            cols = [pa.array(docs[s], pa.int64()), pa.array(table[s, 0], pa.int32()), *(pa.array(table[s, k]) for k in (1, 2, 3))]
            n = len(cols[0])
            cols += [pa.array(np.full(n, part, "int64")), pa.array((part << 32) + where[s]), pa.array(off[s]), pa.array(fill[where[s]]), pa.array(is_open[where[s]])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "off", "fill", "open"])

    small_batches(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def _merger(capacity: int, slack: int, passed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        where, off, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        first = np.full(len(fill), -1, "int64")
        names = pdf["bin"].to_numpy()
        first[where[off == 0]] = names[off == 0]
        is_open = _open(fill, capacity, slack, passed)
        return pd.DataFrame({"bin": names, "part": key[0], "to": first[where], "add": off, "fill": fill[where], "open": is_open[where]})

    return run


def pack(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, fan: int = FAN, passed: int = PASSED) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    local = cut(pieces(df, vocabulary, doc_id, text, capacity, slack, passed))
    rising = local.where("open AND off = 0").select("bin", "part", "fill")
    last = local.agg(F.max("part")).first()[0] or 0
    moves = None
    while last > 0:
        level = rising.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInPandas(_merger(capacity, slack, passed), _MOVES)
        last //= fan
        level = cut(level)
        step = level.where("bin <> to").select(F.col("bin").alias("__b"), F.col("to").alias("__t"), F.col("add").alias("__a"))
        if moves is None:
            moves = step.select(F.col("__b").alias("m_bin"), F.col("__t").alias("m_to"), F.col("__a").alias("m_add"))
        else:
            # sequences that moved before move on with the one that they are in
            on = moves.join(step, F.col("m_to") == F.col("__b"), "left").select("m_bin", F.coalesce("__t", "m_to").alias("m_to"), (F.col("m_add") + F.coalesce("__a", F.lit(0))).alias("m_add"))
            moves = on.unionByName(step.select(F.col("__b").alias("m_bin"), F.col("__t").alias("m_to"), F.col("__a").alias("m_add")))
        rising = level.where("open AND add = 0").select("bin", "part", "fill")
    if moves is None:
        return local.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("off").alias("offset"))
    out = local.join(moves, F.col("bin") == F.col("m_bin"), "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("m_to", "bin").alias("sequence_id"), (F.col("off") + F.coalesce("m_add", F.lit(0))).cast("long").alias("offset"))
