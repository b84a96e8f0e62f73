"""Output codes decoded once more in plain Python: counts, sides of each bit, weighted losses, nearest codeword."""

import math
import zlib
from collections import Counter

import pytest

from quillspark.llm import language_id

SF = "/root/testdata/sf0.001"
BUCKETS = 16384


def trigrams(text):
    """Buckets of the trigrams around each letter byte; anything but ASCII letters and bytes above 127 is a space."""
    letters = [x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode()]
    letters = [32, *letters, 32]
    out = Counter()
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b != 32:
            out[((a * 65536 + b * 256 + c) * 0x9E3779B1 % 2**32) >> 18] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_predictions_are_those_of_a_plain_decoder(docs):
    rows = docs.collect()
    found = {r.doc_id: trigrams(r.text or "") for r in rows}
    learnt = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    langs = sorted({r.lang for r in learnt})
    counts = {lang: Counter() for lang in langs}
    for r in learnt:
        counts[r.lang].update(found[r.doc_id])
    share = {lang: (sum(c.values()) + 0.1 * BUCKETS, c) for lang, c in counts.items()}
    p = {lang: [(c[b] + 0.1) / total for b in range(BUCKETS)] for lang, (total, c) in share.items()}
    assert 2 <= len(langs) <= 7  # each way of putting the languages on two sides is a bit, the first one's side is +1
    bits = [{lang: -1 if i and (b >> (i - 1)) & 1 else 1 for i, lang in enumerate(langs)} for b in range(1, 2 ** (len(langs) - 1))]
    tables, weights = [], []
    for bit in bits:
        sides = [[p[lang] for lang in langs if bit[lang] == sign] for sign in (1, -1)]
        plus, minus = ([sum(x) / len(side) for x in zip(*side, strict=True)] for side in sides)
        tables.append([math.log(a / b) for a, b in zip(plus, minus, strict=True)])
        weights.append(sum(abs(a - b) for a, b in zip(plus, minus, strict=True)) / 2)
    weights = [w / sum(weights) for w in weights]
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got.keys() == found.keys()
    for r in rows:
        mine, seen = got[r.doc_id], sum(found[r.doc_id].values())
        if not any(x.isalpha() for x in r.text or ""):
            assert (mine.lang_pred, mine.score) == ("und", 0)
            continue
        margins = [sum(t[b] * n for b, n in found[r.doc_id].items()) * min(seen, 60) / seen for t in tables]
        loss = {lang: sum(w * math.log1p(math.exp(-z * bit[lang])) for w, z, bit in zip(weights, margins, bits, strict=True)) for lang in langs}
        order = sorted(loss.values())
        assert loss[mine.lang_pred] == pytest.approx(order[0], abs=1e-4), r.doc_id
        assert mine.score == pytest.approx(1 / sum(math.exp(-len(bits) * (x - order[0])) for x in order), abs=1e-3)
        assert abs(order[1] - order[0] - language_id.AMBIGUOUS) < 1e-4 or mine.ambiguous == (order[1] - order[0] < language_id.AMBIGUOUS)
