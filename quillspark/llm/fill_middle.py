"""Fill-in-the-middle: every text cut into prefix, middle and suffix at code points, put together in another order.

Cuts count code points, but texts are UTF-8. For each Arrow batch the bits "a code point begins at this byte"
are packed into 64-bit words, with the number of ones before every block of 512 bits as a directory. A text's
length in code points is the difference of two ranks, and the byte at which the k-th code point begins is a
select: a binary search in the directory, then eight popcounts, then one word. No text is decoded, and the
bits and the directory take a quarter of the batch's bytes. Texts never leave their partition.

Where a text is cut and in which form it is written follows from the SHA-256 of the seed and doc_id alone, so
reruns agree. restore() rebuilds the text from output and form: none of the marks occurs in a text that is
transformed, and where two parts meet none can arise, because a mark is no suffix or prefix of another.

Defined results: a null text is the empty text; an empty text, or one that holds a mark, is plain; a null doc_id
hashes as the empty string; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts, how many are transformed, and of 100 of these how many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
_BLOCK = 8  # words of 64 bits


class Boundaries:
    """Where code points begin in some UTF-8 bytes, by rank and select."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        size = -(-len(bits) // (8 * _BLOCK)) * 8 * _BLOCK + 8 * _BLOCK  # a whole block of zeros at the end
        self.words = np.pad(bits, (0, size - len(bits))).view("<u8").reshape(-1, _BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before each byte."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block, inside = word // _BLOCK, word % _BLOCK
        row = self.words[block]
        whole = np.where(np.arange(_BLOCK) < inside[:, None], np.bitwise_count(row), 0).sum(1, dtype=np.int64)
        rest = row[np.arange(len(at)), inside] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(rest)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte at which the code point k begins, from 0; there must be one."""
        block = np.searchsorted(self.before, k, side="right") - 1
        row = self.words[block]
        upto = np.cumsum(np.bitwise_count(row), axis=1, dtype=np.int64)
        left = k - self.before[block]
        inside = (upto <= left[:, None]).sum(1)
        at = np.arange(len(k))
        left -= np.where(inside > 0, upto[at, inside - 1], 0)
        bits = (row[at, inside][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return (block * _BLOCK + inside) * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None]).argmax(1)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that follow from the seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _cut(texts: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's code points, and the two cuts in code points and in bytes, the smaller first."""
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    bounds = Boundaries(np.frombuffer(b"".join(texts), np.uint8))
    first, last = bounds.rank(starts), bounds.rank(ends)
    n = last - first
    chars = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    at_end = chars == n[:, None]
    # a cut at the end lies where the text ends; a cut at 0 where it begins
    places = np.where(at_end, 0, first[:, None] + chars)
    inside = ~at_end & (chars > 0)
    byte = np.where(at_end, (ends - starts)[:, None], 0)
    if inside.any():
        byte[inside] = bounds.select(places[inside]) - np.repeat(starts, 2).reshape(-1, 2)[inside]
    return n, chars, byte


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row a document: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output."""
    small_batches(df.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            texts = list(text_bytes(b.column(1)))
            h = np.array([draws(i, seed) for i in b.column(0).to_pylist()], np.int64)
            n, chars, byte = _cut(texts, h)
            forms, outputs = [], []
            for t, (lo, hi), third, fourth in zip(texts, byte.tolist(), h[:, 2].tolist(), h[:, 3].tolist(), strict=True):
                if not t or third % 100 >= transformed or any(x in t for x in marks):
                    forms.append("plain")
                    outputs.append(t)
                elif fourth % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join([s, t[hi:], p, t[:lo], m, t[lo:hi]]))
                else:
                    forms.append("psm")
                    outputs.append(b"".join([p, t[:lo], s, t[hi:], m, t[lo:hi]]))
            plain = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(forms), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1] - chars[:, 0], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = dict(df.dtypes)[doc_id]
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that transform() wrote as output in that form."""
    part = lambda c, mark, i: F.split_part(c, F.lit(mark), F.lit(i))
    head, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    psm = F.concat(F.substr(part(head, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, F.substr(part(head, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """transform() with the SHA-256 of each output and of the text rebuilt from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    t = transform(df, doc_id, text)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    """The same over `documents`, in SQL, by code points throughout; the text rebuilt from the output by pattern."""
    h = lambda i: f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS UBIGINT)::BIGINT"
    marks = f"contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')"
    rebuilt = rf"regexp_replace(o, '(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$', '\1\3\2')"
    rebuilt_spm = rf"regexp_replace(o, '(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$', '\2\3\1')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, CASE WHEN t = '' OR {marks} OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || substr(t, 1, lo) || '{SUFFIX}' || substr(t, hi + 1) || '{MIDDLE}' || substr(t, lo + 1, hi - lo) ELSE '{SUFFIX}' || substr(t, hi + 1) || '{PREFIX}' || substr(t, 1, lo) || '{MIDDLE}' || substr(t, lo + 1, hi - lo) END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(o) AS output_sha256, sha256(CASE form WHEN 'psm' THEN {rebuilt} WHEN 'spm' THEN {rebuilt_spm} ELSE o END) AS restored_sha256 FROM o"""
