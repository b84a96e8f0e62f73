"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One whitespace-separated word: anything but space, tab, newline, vertical tab, form feed, return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; on a local master without one, as in tests, a folder of its own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows in an Arrow batch of texts: some MB, not the tens that Spark's default of 10,000 would hold.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of TEXT_ROWS at most; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, wherever a filter or projection is moved."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder.

    Nothing reads what the checkpoint was made from any more; collecting garbage lets Spark's cleaner
    delete the shuffle files of it now, not whenever the driver next runs short of memory.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives b''.

    bytes.split() and bytes.lower() work on ASCII white space and ASCII letters alone, which is what the
    contracts of these operators ask for.
    """
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def text_key(text: str = "text"):
    """A 64-bit key of a text; null and empty differ."""
    return F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(text)))


#: What may be broadcast, by the measured size of its rows.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows, measured, take BROADCAST_BYTES at most. df should be cheap to read."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            width = width + 8 * F.greatest(F.size(name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def without(df: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of df whose keys are not in `dropped`, with df's columns and names.

    keys: for each column of dropped the expression over df that it is compared with, null with null. The
    keys are measured first: few are broadcast, so that the rows of df stay where they are; many are joined.
    """
    dropped = broadcast_if_small(cut(dropped.distinct().toDF(*[f"__{k}" for k in dropped.columns])))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[e.alias(f"__of_{k}") for k, e in keys.items()])
    same = [F.col(f"__of_{k}").eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(dropped, reduce(and_, same), "left_anti").select("__row.*")
