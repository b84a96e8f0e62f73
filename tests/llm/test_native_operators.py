"""License scan, quality rules, URL reputation and token rollups, against rules restated in Python."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import license_rules, license_scan, quality_rules, token_rollup, url_reputation

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_places(text):
    words, out = WORD.findall(lowered(text)), []
    for phrase, label in BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


TEXTS = [
    "Licensed under CC BY-NC 4.0. All  rights--reserved!",
    "cc by cc by, general public license; GNU General Public License, version 3.",
    "Released under the MIT License.",
    "SPDX-License-Identifier: Apache-2.0",
    "accby is no license and general-public is none",
    "No Rights Reserved ŒCC BY",
    "",
    None,
]


def test_license_base_places(documents):
    got = {r.doc_id: r for r in license_scan.scan(documents([(i, t, "en", "a") for i, t in enumerate(TEXTS)])).collect()}
    for i, t in enumerate(TEXTS):
        n, places = base_places(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_suppression(documents):
    d = license_scan.detect(documents([(0, TEXTS[0], "en", "a")]).select("text"))
    found = {(x["label"], x["tier"]): x["suppressed"] for x in d.first()["detections"]}
    assert found[("cc-by-nc-4.0", 0)] is False and found[("cc-by-nc-4.0", 1)] and found[("cc-by", 3)]
    labels = {r.doc_id: r.labels for r in license_scan.scan(documents([(i, t, "en", "a") for i, t in enumerate(TEXTS)])).collect()}
    assert labels[2] == "mit" and labels[3] == "apache-2.0" and labels[0] == "cc-by,cc-by-nc-4.0,reserved"


def test_license_rules_are_many_and_gated():
    table = license_rules.rules()
    assert len(table) > 250 and all(re.compile(license_scan.spaced(r.pattern)) for r in table)


def samples(pattern):
    """Texts that a rule's pattern matches: each alternative, each option with and without."""

    def of(parsed):
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                more = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg]
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in of(branch)]
            elif name == "SUBPATTERN":
                more = of(arg[-1])
            else:
                least, most, inner = arg
                assert name == "MAX_REPEAT"
                more = [x * n for x in of(inner) for n in {least, max(least, min(most, 1))}]
            out = [a + b for a in out for b in more]
        return out

    return {" ".join(x.split()) for x in of(re._parser.parse(pattern))}


def test_license_samples_pass_gate_and_keyword():
    """A word of the gate and the rule's keyword stand in whatever the rule matches."""
    table = license_rules.rules()
    gate = {license_scan.gate_word(r) for r in table}
    lost = set()
    for r in table:
        for s in samples(r.pattern):
            norm = " " + "  ".join(s.split()) + " "
            if re.search(license_scan.spaced(r.pattern), norm) and (license_scan.keyword(r) not in norm or not any(w in s for w in gate)):
                lost.add((r.label, r.keyword, s))
    assert not lost, sorted(lost)[:10]


def test_license_alternatives_get_their_labels(documents):
    texts = {"Expat License": "mit", "released under the Expat licence": "mit", "original BSD license": "bsd-4-clause", "Open RAIL-M": "openrail", "available under OpenRAIL": "openrail", "Mulan PSL v2": "mulan-2.0", "MIT X11 license": "mit"}
    got = license_scan.scan(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    labels = {r.doc_id: set(r.labels.split(",")) for r in got}
    assert all(want in labels[i] for i, want in enumerate(texts.values())), labels


def test_license_awkward_and_empty(awkward, nothing):
    rows = license_scan.scan(awkward).collect()
    assert len(rows) == awkward.count() and license_scan.scan(nothing).count() == 0
    long = next(r for r in rows if r.doc_id == 5)
    assert long.n_words == 60_600 and long.n_base == 300 and (long.first_word, long.last_word) == (60_000, 60_598)


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(documents, awkward):
    texts = ["a b c a b c", "a a a a", "x\ny\nx\n \n \nx", "# é😀 $| <a>", "one two", "a b c d a b c x b c d"]
    df = documents([(i, t, "en", "a") for i, t in enumerate(texts)]).unionByName(awkward)
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(df).collect())
    assert got == sorted((r.doc_id or -1, *figures(r.text)) for r in df.collect())


def unique(i, n=80):
    """Words of letters that no other document has."""
    digits = str.maketrans("0123456789", "abcdefghij")
    return " ".join(f"w{i}x{j}q".translate(digits) for j in range(n))


def test_quality_frequent_lines(documents):
    lines = "\n".join(" ".join(f"menu{chr(97 + k)}{x}" for k in range(20)) for x in "abcdefghij")
    rows = [(i, unique(i, 60) + "\n" + lines, "en", "a") for i in range(30)]
    rows += [(100 + i, unique(100 + i), "en", "a") for i in range(30)] + [(200, rows[0][1], "en", "b")]
    df = documents(rows)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert kept[0] and kept[200], "the first carrier and another host keep theirs"
    assert not any(kept[i] for i in range(1, 30)) and all(kept[100 + i] for i in range(30))
    left = quality_rules.keep(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_quality_kept_carriers_lose_their_frequent_lines(documents):
    """Frequent lines around and between a text's own; 30 carriers, a repeated row, another host, an untouched text."""
    menu, foot = "Home | About us | Terms of use", "Copyright 2019, all rights reserved by us"
    full = [f"{menu}\n\n{unique(i, 60)}\n{foot}\n{menu}\n{unique(50 + i, 40)}\n{foot} {i}\n" for i in range(30)]
    rows = [(i, t, "en", "a") for i, t in enumerate(full)] + [(7, full[7], "en", "a"), (None, full[8], "en", "a"), (200, full[9], "en", "b"), (201, unique(201) + "\n\n" + menu, "en", "a"), (202, unique(202), "en", None)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text, r.n_chars) for r in quality_rules.keep(documents(rows)).collect()))
    bare = {i: f"\n{unique(i, 60)}\n{unique(50 + i, 40)}\n" for i in range(30)}
    expected = [(i, bare[i], len(bare[i])) for i in [*range(1, 30), 7]] + [(-1, bare[8], len(bare[8])), (0, full[0], None), (200, full[9], None), (201, unique(201) + "\n", len(unique(201)) + 1), (202, unique(202), None)]
    assert got == sorted(expected)


def test_quality_other_rows_free_no_line(spark, documents):
    """Neither unrelated rows nor copies in the host raise the limit."""
    menu = "Home | About us | Terms of use"
    df = documents([(i, f"{menu}\n{unique(i)}", "en", "a") for i in range(30)])

    def lost(more):
        rows = df.select("doc_id", "text", "source").unionByName(more) if more is not None else df
        return {(r["__d"], r["__lost"]) for r in quality_rules.lost_words(quality_rules.measured(rows, "doc_id", "text", "source")).where("__d < 1000").collect()}

    many = spark.range(1000, 17000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    assert lost(None) == {(i, 8) for i in range(1, 30)}
    assert lost(many.withColumn("text", F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"))) == lost(None)
    assert lost(many.withColumn("text", F.lit("one text"))) == lost(None)


def test_quality_copies_are_documents_and_repeated_rows_are_not(documents):
    """Copies under other numbers count, so the first one keeps the lines; one row a hundred times is one document."""
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents([(i, unique(1), "en", "a") for i in range(100)])).collect()}
    assert kept == {i: i == 0 for i in range(100)}
    assert all(r.kept for r in quality_rules.judge(documents([(5, unique(1), "en", "a")] * 100)).collect())
    assert all(r.kept for r in quality_rules.judge(documents([(i, unique(1), "en", "a") for i in range(20)])).collect()), "20 documents are within the limit"


def test_quality_lines_without_letters_count(documents):
    rows = [(i, unique(i) + f"\n-- {1900 + i} --", "en", "a") for i in range(30)]
    assert {(r["__d"], r["__lost"]) for r in quality_rules.lost_words(quality_rules.measured(documents(rows), "doc_id", "text", "source")).collect()} == {(i, 3) for i in range(1, 30)}


def test_quality_filters_cost_no_more(documents):
    """A filter on the figures of a long text whose windows repeat works nothing out for every element again."""
    df = documents([(1, " ".join(f"w{i % 40_000}" for i in range(60_000)), "en", "a")])
    judged, figured = quality_rules.judge(df), quality_rules.figures(df, ["doc_id"], "text")
    began = time.time()
    assert judged.where("NOT base_failed AND n_repeat_words >= 0 AND kept IS NOT NULL").count() == 0
    assert figured.where("n_repeat_words > 0 AND n_words > 0").select("n_repeat_words").first()[0] == 40_000
    assert time.time() - began < 10


def test_quality_empty(nothing, awkward):
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep(nothing).columns == nothing.columns
    assert {r.doc_id for r in quality_rules.judge(awkward).where("NOT base_failed").collect()} == set()


URLS = {
    "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"),
    "https://xcom/en/": ("xcom", "/en/", None, "allow"),
    "https://m.example.net/de/8#top": ("m.example.net", "/de/8", "example.net/de/8", "block"),
    "https://m.example.net/de/9": ("m.example.net", "/de/9", "net/de/", "allow"),
    "https://a.org?b/es/": ("a.org", "", None, "allow"),
    "no url": ("", "", None, "allow"),
    "x://y://z/es/": ("y:", "//z/es/", None, "allow"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*URLS, None])], "page_id long, url string, host int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, none).collect()}
    assert [got[i] for i in range(len(URLS))] == list(URLS.values()) and got[len(URLS)] == ("", "", None, "allow")
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_url_reputation_shrinks(spark):
    rows, bad = [], []
    for host, n, b in (("bad.one.io", 40, 40), ("new.one.io", 0, 0), ("few.two.io", 1, 1), ("good.two.io", 60, 0), ("three.io", 60, 1)):
        for _ in range(n + 1):
            rows.append((len(rows), f"http://{host}/p"))
            if len(rows) and n:
                bad.append((len(rows) - 1, int(b > 0)))
                b, n = b - 1, n - 1
    out = url_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad + [(None, 1), (5, None)], "page_id long, bad int"))
    verdict = {r.host: r.verdict for r in out.collect()}
    assert verdict["bad.one.io"] == "block" and verdict["good.two.io"] == verdict["three.io"] == verdict["few.two.io"] == "allow"
    assert verdict["new.one.io"] == "block", "an unknown host has its domain's reputation"


def test_registered_domain(spark):
    df = spark.createDataFrame([("a.b.example.co.uk:80",), ("x@example.com",), ("com",), ("",), ("www.example.org",)], "h string")
    got = [tuple(r) for r in df.select(url_reputation.domain_of(F.col("h")), url_reputation.suffix_of(F.col("h"))).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("example.org", "org")]


def test_rollup_is_idempotent_and_compacts(spark, tmp_path, awkward):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    first = token_rollup.change(awkward, "insert", "words-1", token_rollup.word_count(F.col("text")))
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    n = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert n[("a", "en")][0] == 5 and n[(None, None)] == (1, 0)
    # a batch whose job never ended was never applied
    import shutil

    rollup.commit("two", first)
    name = rollup._name("two")
    (tmp_path / "r" / name / "_SUCCESS").unlink()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == n
    shutil.rmtree(tmp_path / "r" / name)
    rollup.compact()
    assert rollup.applied("one") and not rollup.commit("one", first)
    rollup.commit("three", token_rollup.change(awkward.where("source = 'a'"), "delete", "words-1", token_rollup.word_count(F.col("text"))))
    left = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert ("a", "en") not in left and left[("b", "de")] == n[("b", "de")]
    rollup.compact()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == left
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("four", token_rollup.change(awkward, "upsert", "words-1", F.lit(1)))


def test_rollup_with_a_vocabulary(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.text or "", r.n_tokens) for r in token_rollup.with_vocabulary_count(awkward.select("text"), path).collect())
    assert got == sorted((r.text or "", len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.select("text").collect())


def test_rollup_of_documents(spark, documents):
    """Totals against a brute force: null and repeated numbers, repeated labels, null texts, retracted groups, empty tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, "One text, of words.", "en", "a"), (1, "One text, of words.", "en", "a"), (2, None, "en", "a"), (3, "gone altogether", None, None), (None, "no number at all", "fr", "b"), (4, "", "fr", "b"), (5, "toxic words " * 9, "fr", "b")]
    labels = spark.createDataFrame([(3, 0, 1), (5, 1, 1), (5, 1, 1), (1, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    want = Counter()
    for d, text, lang, source in rows:
        if d not in (3, 5):
            n = text or ""
            for name, tokens in (("words-1", len(n.split())), ("bytes4-1", -(-len(n.encode()) // 4)), ("word_bpe_49k", len(t.encode(n, add_special_tokens=False).ids))):
                want[(source, lang, name, "docs")] += 1
                want[(source, lang, name, "tokens")] += tokens
    df = documents(rows)
    got = Counter()
    for r in token_rollup.document_totals(df, labels, path).collect():
        got[(r.source, r.lang, r.tokenizer, "docs")] += r.n_docs
        got[(r.source, r.lang, r.tokenizer, "tokens")] += r.n_tokens
    assert got == want
    assert token_rollup.document_totals(df.limit(0), labels, path).count() == 0
    assert token_rollup.document_totals(df, labels.limit(0), path).groupBy().sum("n_docs").first()[0] == 3 * len(rows)


def test_license_scan_of_many_matches_in_one_text(spark):
    license_scan.scan(spark.createDataFrame([(0, "cc by")], "doc_id long, text string")).collect()
    began = time.time()
    rows = [(n, "cc by " * n + "all rights reserved") for n in (1, 2, 63, 64, 65, 20_000)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    assert {n: (r.n_base, r.first_word, r.last_word, r.base_labels) for n, r in got.items()} == {n: (n + 1, 0, 2 * n, "cc-by,reserved") for n, _ in rows}


@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 99, 100, 101])
def test_scan_array_is_a_running_fold(spark, size):
    values = [(i * 7) % 11 for i in range(size)]
    d = spark.createDataFrame([(values,)], "v array<int>")
    got = d.select(license_scan.scan_array(F.col("v"), F.lit(0), lambda s, x: s + x, lambda s, x: F.struct(s.alias("before"), x.alias("x")), "struct<before:int,x:int>")).first()[0]
    assert [(r.before, r.x) for r in got] == [(sum(values[:i]), x) for i, x in enumerate(values)]
