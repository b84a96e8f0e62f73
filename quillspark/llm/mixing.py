"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document of it should be taken target / source size times, a number
from 0 to 2. The whole part is taken; the fractions of all documents of a source are rounded together:
two fractional documents exchange mass, word for word, at random and without bias until one of them is
0 or 1, so that the words taken stay on target all the while. What is left in the end is one fractional
document, which is drawn.

Rounding runs in groups of bounded size: the rows of a source are dealt by hash into buckets of about
`bucket_rows`, each bucket rounds its own and leaves one residual document at most, and the residuals are
combined `fan` buckets at a time, level by level, until one is left. A source with a third of all rows
has more buckets, not larger ones. Only (doc_id, source, size) travels.

Rows that agree in doc_id, source and text are one item: of n rows with the fraction f, floor(n * f) take one copy
more than the others, and the fraction that is left is rounded with those of the other documents. So
repeated rows come as near to the target as different ones.

Defined results: a null text has size 0; a null source is a source, the last in order; documents of size 0 are
drawn on their own; a source without words has target 0; no rows give no rows. Draws depend on the seed and the
rows alone, so reruns agree; which of the rows that agree as above takes the copy more is not fixed. Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE_WORD, cut, text_key

#: Weights of the sources in order, repeating; the mix's size and a source's most, as shares of the sizes.
WEIGHTS = (5.0, 2.0, 1.0)
MIX_SHARE = 1.5
MOST_COPIES = 2.0
BUCKET_ROWS = 4096
FAN = 256
SEED = 20240117
#: The targets of the sources are worked out on the driver, one row a source; more sources are refused.
MAX_SOURCES = 200_000

_UNIT = "doc_id long, source string, size long, key long, rows long, whole long, p double, more long, bucket long"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = MIX_SHARE, most: float = MOST_COPIES) -> list[float]:
    """Targets for sources in order: shares by weight, none above `most` times its size, the excess reshared."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    weight = lambda i: weights[i % len(weights)]
    while open_:
        per = (total - sum(out)) / sum(map(weight, open_))
        full = [i for i in open_ if per * weight(i) >= most * sizes[i]]
        for i in full or open_:
            out[i] = min(most * sizes[i], per * weight(i))
        done = set(full)
        open_ = [i for i in open_ if i not in done] if full else []
    return out


def round_group(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator, last: bool) -> tuple[np.ndarray, int]:
    """Pivotal rounding of fractions p of items in the given order: 0 or 1 for each, and the residual's place or -1.

    sum(weight * p) is kept, but for the residual, which is drawn if `last`. Items without weight are drawn.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    held, eps = -1, 1e-9
    for i in range(len(p)):
        if weight[i] <= 0:
            p[i] = float(draws[i] < p[i])
            continue
        if eps < p[i] < 1 - eps:
            if held < 0:
                held = i
                continue
            a, b = weight[held], weight[i]
            into, out = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
            mass = into if draws[i] < out / (into + out) else -out
            p[held] += mass / a
            p[i] -= mass / b
            if not eps < p[held] < 1 - eps:
                p[held] = round(p[held])
                held = i if eps < p[i] < 1 - eps else -1
            if held != i:
                p[i] = round(p[i])
        else:
            p[i] = round(p[i])
    if held >= 0 and last:
        p[held] = float(rng.random() < p[held])
        held = -1
    return p, held


def _rounder(level: int, last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng(zlib.crc32(repr((seed, level, *map(str, key))).encode()))
        part, held = round_group(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rng, last)
        more = pd.array(pdf["whole"].to_numpy() + np.round(part).astype("int64"), dtype="Int64")
        p = pdf["p"].to_numpy().copy()
        if held >= 0:
            more[held] = pd.NA
            p[held] = part[held]
        return pdf.assign(p=p, more=more)[["doc_id", "source", "size", "key", "rows", "whole", "p", "more", "bucket"]].astype({"doc_id": "Int64"})

    return run


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def sized(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), text_key(text).alias("key"))


def _decided(rows: DataFrame, bucket_rows: int, fan: int, seed: int) -> DataFrame:
    """One row an item: doc_id, source, size, key, rows, of which `more` take low + 1 copies and the others low, source_size, target."""
    spark = rows.sparkSession
    units = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    stats = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.words for r in stats])
    table = [(r.source, r.words, float(t), max(1, -(-r.n // bucket_rows))) for r, t in zip(stats, goals, strict=True)]
    sources = spark.createDataFrame(table, "__source string, source_size long, target double, __buckets long")
    same = F.col("source").eqNullSafe(F.col("__source"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    low = F.floor(share + 1e-9)
    part = F.col("rows") * F.greatest(share - low, F.lit(0.0))  # of all rows of the item together
    whole = F.floor(part + 1e-9)
    units = units.join(sources, same).select(
        "doc_id", "source", "size", "key", "rows", whole.alias("whole"), F.greatest(part - whole, F.lit(0.0)).alias("p"), F.lit(None).cast("long").alias("more"), F.pmod(F.xxhash64("doc_id", "key"), F.col("__buckets")).alias("bucket"),
    )
    most = max([x[3] for x in table], default=1)
    decided, level = [], 0
    while True:
        last = most == 1
        rounded = units.groupBy("source", "bucket").applyInPandas(_rounder(level, last, seed), _UNIT)
        if last:
            decided.append(rounded)
            break
        rounded = cut(rounded)
        decided.append(rounded.where("more IS NOT NULL"))
        units = rounded.where("more IS NULL").withColumn("bucket", F.floor(F.col("bucket") / fan))
        most, level = -(-most // fan), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.join(sources, same).select("doc_id", "source", "size", "key", "rows", low.cast("int").alias("low"), "more", "source_size", "target")


def decide(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """From rows of sized(): for each item and number of copies how many rows take so many, source_size, target."""
    d = _decided(rows, bucket_rows, fan, seed)
    shares = F.array(F.struct(F.col("more").alias("rows"), (F.col("low") + 1).alias("copies")), F.struct((F.col("rows") - F.col("more")).alias("rows"), F.col("low").alias("copies")))
    d = d.select("doc_id", "source", "size", F.explode(shares).alias("of"), "source_size", "target")
    return d.where("of.rows > 0").select("doc_id", "source", "size", "of.rows", "of.copies", "source_size", "target")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: size, source_size, target, taken, source, copies."""
    d = decide(sized(df, doc_id, text, source))
    # a row for each of the rows that share the decision, in steps that keep the arrays small
    step = 10_000
    d = d.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step))))
    d = d.withColumn("__j", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(step), F.col("rows") - F.col("__i") * step).cast("int"))))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def apply(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it, with df's columns and names."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(doc_id).alias("__d"), F.col(source).alias("__s"), _size(text).alias("__z"), text_key(text).alias("__k"))
    d = _decided(sized(df, doc_id, text, source), BUCKET_ROWS, FAN, SEED).where("low > 0 OR more > 0")
    on = F.col("__d").eqNullSafe(F.col("doc_id")) & F.col("__s").eqNullSafe(F.col("source")) & (F.col("__z") == F.col("size")) & (F.col("__k") == F.col("key"))
    joined = rows.join(d.select("doc_id", "source", "size", "key", "rows", "low", "more"), on)
    # all rows of most items take the same; only where they don't, rows are numbered
    alike = joined.where("more = 0 OR more = rows").select("__row", (F.col("low") + (F.col("more") > 0).cast("int")).alias("__copies"))
    copied = alike.union(_numbered(joined.where("more > 0 AND more < rows")))
    return copied.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).select("__row.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """The first `more` rows of each item with low + 1 copies, the others with low.

    Rows are numbered within each partition of a checkpoint, on top of what the partitions before it hold, so the rows
    of an item, however many, are never in one task together.
    """
    item = ["doc_id", "source", "size", "key"]
    d = cut(rows.select("__row", *item, "low", "more")).withColumn("__p", F.spark_partition_id())
    before = Window.partitionBy(*item).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy(*item, "__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    held = held.select(*[F.col(c).alias(f"__{c}") for c in item], F.col("__p").alias("__q"), "__before")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in item]) & (F.col("__p") == F.col("__q"))
    place = F.row_number().over(Window.partitionBy(*item, "__p").orderBy("__p"))
    return d.join(held, same).select("__row", (F.col("low") + (F.col("__before") + place <= F.col("more")).cast("int")).alias("__copies"))
