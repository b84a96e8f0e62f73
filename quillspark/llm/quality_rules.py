"""Quality rules: figures of each document and the frequency of its lines across documents, all native.

Base figures come from the document alone and stay in its partition. The method counts, for every host
(here the source), in how many different documents each normalised line stands; a line in more than
`LIMIT_DOCS` is removed from all of them but the first (the smallest doc_id), and a document that
loses more than `max_lost` of its words is depleted and rejected. judge() gives the verdicts; keep() gives
the documents that pass, their text without the removed lines.

One pass over the texts gives each row its figures and the hashes of its lines; nothing else travels after
that. Lines are made distinct by document first, whose key spreads a line that a third of all documents
share, and pre-aggregated before they are counted. Only frequent lines are joined back, by broadcast while
they are measured to be small.

Defined results: null text counts as empty and fails the base rule; a null host is a host of its own;
rows that repeat doc_id, host and text share one verdict and are one document; exact copies under other
numbers are documents of their own; lines without a word are never counted. Extra columns are not read; keep() sets n_chars of the texts it
changes, where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE_WORD, broadcast_if_small, cut, let, text_key

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is frequent in a host beyond this many documents, whatever else the host holds.
LIMIT_DOCS = 20
#: A document is depleted when more than this share of its words stands in frequent lines.
MAX_LOST = 0.6
_BREAK = r"[\x20\x09-\x0D]+"


def normalised(line: Column) -> Column:
    """A line without case, digits and punctuation; one without letters keeps its signs, any digit being 0."""
    words = F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))
    signs = F.regexp_replace(F.regexp_replace(line, _BREAK, ""), "[0-9]", "0")
    return F.when(words == "", signs).otherwise(words)


def without_lines(text: Column, places: Column) -> Column:
    """text without the lines at these places; the others stay as they are, empty ones included."""
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))
    return let(F.split(text, "\n"), lambda lines: F.array_join(left(lines), "\n"))


def repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash of their words. Only texts in which a window repeats sort their
    windows; the cost is n log n in the words of a text. Every array that a lambda uses is bound by let().
    """

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + F.lit(3) - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + 3).alias("end")),
        )["n"]

    windows = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    sorted_ = lambda x: F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(words, lambda w: let(windows(w), lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), let(sorted_(x), covered)).otherwise(0)))


def figures(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines.

    lines: array<struct<pos,h,n>> of the lines with a word: place among all lines, hash of the normalised line,
    words. The text is read and split once for all of them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("rep"))
    placed = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.regexp_count(x, F.lit(SPACE_WORD)).alias("n"))), lambda s: s["n"] > 0)
    of_lines = lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls["line"]))).cast("long").alias("dup"),
        F.transform(ls, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(normalised(s["line"])).alias("h"), s["n"].alias("n"))).alias("lines"),
    )
    d = df.select(
        *keep,
        let(F.array_remove(F.split(t, _BREAK), ""), of_words).alias("__w"),
        let(placed(F.split(t, "\n")), of_lines).alias("__l"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return d.select(*keep, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", F.col("__l.dup").alias("n_dup_lines"), F.col("__w.rep").alias("n_repeat_words"), F.col("__l.lines").alias("lines"))


def measured(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """__d, __h, __k (doc_id, host, text key) and figures() of every row, worked out once and kept in the shared folder."""
    d = df.select(F.col(doc_id).alias("__d"), F.col(host).alias("__h"), text_key(text).alias("__k"), F.col(text).alias("__t"))
    return cut(figures(d, ["__d", "__h", "__k"], "__t"))


def lost_words(measures: DataFrame, limit_docs: int = LIMIT_DOCS) -> DataFrame:
    """__d, __h, __k, __lost and __gone: the words in frequent lines and the places of these, for documents that have any."""
    rows = measures.select("__d", "__h", "__k", F.explode("lines").alias("__at")).select("__d", "__h", "__k", F.col("__at.pos").alias("__pos"), F.col("__at.h").alias("__x"), F.col("__at.n").alias("__n"))
    documents = rows.select("__h", "__x", "__d", "__k").distinct()
    often = documents.groupBy("__h", "__x").agg(F.count("*").alias("__c"), F.min("__d").alias("__first")).where(F.col("__c") > limit_docs)
    often = broadcast_if_small(cut(often.select(F.col("__h").alias("__fh"), F.col("__x").alias("__fx"), "__first")))
    hit = rows.join(often, F.col("__h").eqNullSafe(F.col("__fh")) & (F.col("__x") == F.col("__fx"))).where("NOT (__d <=> __first)")
    return hit.select("__d", "__h", "__k", "__pos", "__n").distinct().groupBy("__d", "__h", "__k").agg(F.sum("__n").alias("__lost"), F.sort_array(F.collect_list("__pos")).alias("__gone"))


def verdicts(measures: DataFrame, limit_docs: int = LIMIT_DOCS) -> DataFrame:
    """measures with lost_words, __gone, base_failed and kept."""
    lost = lost_words(measures, limit_docs).select(F.col("__d").alias("__d2"), F.col("__h").alias("__h2"), F.col("__k").alias("__k2"), "__lost", "__gone")
    joined = measures.drop("lines").join(lost, F.col("__d").eqNullSafe(F.col("__d2")) & F.col("__h").eqNullSafe(F.col("__h2")) & (F.col("__k") == F.col("__k2")), "left").drop("__d2", "__h2", "__k2")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost_n = F.coalesce("__lost", F.lit(0)).cast("long")
    return joined.withColumn("lost_words", lost_n).withColumn("base_failed", failed).withColumn("kept", ~failed & (lost_n <= MAX_LOST * F.col("n_words")))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit_docs: int = LIMIT_DOCS) -> DataFrame:
    """One row a document: figures, base_failed, kept, lost_words."""
    out = verdicts(measured(df, doc_id, text, host), limit_docs)
    return out.select(F.col("__d").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", limit_docs: int = LIMIT_DOCS) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns and names, their texts without frequent lines."""
    judged = verdicts(measured(df, doc_id, text, host), limit_docs).where("NOT kept OR __gone IS NOT NULL")
    changes = judged.select("__d", "__h", "__k", F.when(F.col("kept"), F.col("__gone")).alias("__gone"), F.lit(True).alias("__any")).distinct()
    changes = broadcast_if_small(cut(changes))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(doc_id).alias("__of_d"), F.col(host).alias("__of_h"), text_key(text).alias("__of_k"))
    same = F.col("__of_d").eqNullSafe(F.col("__d")) & F.col("__of_h").eqNullSafe(F.col("__h")) & F.col("__of_k").eqNullSafe(F.col("__k"))
    rows = rows.join(changes, same, "left").where("__any IS NULL OR __gone IS NOT NULL")
    gone, old = F.col("__gone"), F.col("__row")[text]
    rows = rows.select("__row", F.when(gone.isNotNull(), without_lines(old, gone)).otherwise(old).alias("__text"), gone.isNotNull().alias("__changed"))
    new = {text: F.col("__text")}
    if n_chars in df.columns:
        new[n_chars] = F.when(F.col("__changed"), F.length("__text").cast(df.schema[n_chars].dataType)).otherwise(F.col("__row")[n_chars])
    return rows.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in df.columns])


def oracle() -> str:
    """judge() over `documents`, in SQL."""
    word = SPACE_WORD
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT k, regexp_extract_all(t, '{word}') AS ws FROM doc)),
tri AS (SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
rep AS (SELECT k, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY k, w, w2, w3) > 1 AS r FROM tri),
cov AS (SELECT k, r OR coalesce(lag(r) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS c FROM rep WINDOW o AS (PARTITION BY k ORDER BY i)),
ws AS (SELECT k, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM cov GROUP BY k),
wc AS (SELECT k, sum(length(w)) AS word_chars FROM w GROUP BY k),
l AS (SELECT k, doc_id, source, text, line, coalesce(nullif(trim(regexp_replace(lower(line), '[^\p{{L}}]+', ' ', 'g')), ''), regexp_replace(regexp_replace(line, '{_BREAK}', '', 'g'), '[0-9]', '0', 'g')) AS norm FROM (SELECT *, unnest(string_split(t, chr(10))) AS line FROM doc) WHERE regexp_matches(line, '{word}')),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY k),
freq AS (SELECT source, norm, min(doc_id) AS first FROM l GROUP BY source, norm HAVING count(DISTINCT row(doc_id, text)) > {LIMIT_DOCS}),
lost AS (SELECT k, sum(len(regexp_extract_all(line, '{word}'))) AS lost_words FROM l JOIN freq f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source WHERE l.doc_id IS DISTINCT FROM f.first GROUP BY k),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(CAST(word_chars AS BIGINT), 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
  FROM doc LEFT JOIN ws USING (k) LEFT JOIN wc USING (k) LEFT JOIN dup USING (k) LEFT JOIN lost USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_words <= {MAX_LOST} * n_words AS kept FROM b
"""
