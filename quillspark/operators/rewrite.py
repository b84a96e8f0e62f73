"""Rule-based rewriting, from a sentence to a document, in Column expressions.

Substitutions are folds of regexp_replace; what looks ahead (aligning sentence lengths, telling prose from
code and markup) is a fold over the array of sentences or lines of one document. No row leaves its partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions import text as T
from quillspark.operators import signals

BUDGETS = ["minimal", "medium", "aggressive"]
MODES = ["fiction", "essay", "marketing", "business", "worldbuilding"]

# Substitutions of each document mode, in the order in which they are applied.
_FORMAL = [
    (r"\b(?:in conclusion|ultimately)\b[, ]*", ""),
    (r"\ba powerful reminder(?: that)?\b", "evidence"),
    (r"\bthis highlights the importance of\b", "this shows"),
    (r"\bthis underscores the need for\b", "this shows"),
    (r"\bit could be argued that\b\s*", ""),
    (r"\bone might say(?: that)?\b\s*", ""),
    (r"\bit goes without saying(?: that)?\b\s*", ""),
    (r"\bimagine a world where\b\s*", ""),
    (r"\bpicture this[: ]*\b\s*", ""),
    (r"\blet's take a moment to\b\s*", ""),
]
_ESSAY = [
    (r"\bi believe(?: that)?\b\s*", ""),
    (r"\bin my opinion[, ]*\b\s*", ""),
    (r"\bit is my view that\b\s*", ""),
    (r"\bi would argue that\b\s*", ""),
    (r"\bas we all know[, ]*\b\s*", ""),
]
_MARKETING = [
    (r"\b(?:world-class|breathtaking|stunning)\b\s*", ""),
    (r"\bnestled within\b", "in"),
    (r"\bvibrant tapestry\b", "scene"),
    (r"\b(?:revolutionary|game-changing|cutting-edge|best-in-class)\b\s*", ""),
    (r"\b(?:unparalleled|groundbreaking|next-generation|state-of-the-art)\b\s*", ""),
    (r"\bunlock the (?:full )?potential of\b", "improve"),
    (r"\bseamless(?:ly)?\b\s*", ""),
    (r"\bleverage\b", "use"),
]
_NARRATIVE = [(r"\b(?:in conclusion|as a reminder)\b[, ]*", "")]
MODE_RULES = {"business": _FORMAL, "essay": _FORMAL + _ESSAY, "marketing": _MARKETING, "fiction": _NARRATIVE, "worldbuilding": _NARRATIVE}


def substitute(c: Column, rules: list[tuple[str, str]], flags: str = "(?iU)") -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, flags + r[0], r[1]), rules, c)


def capitalised(c: Column) -> Column:
    """The first letter in upper case, if it is lower case."""
    return F.when(T.matches(c, r"^\p{Ll}"), F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))).otherwise(c)


_STACKED = ["very", "really", "quite", "rather", "somewhat", "truly", "basically"]
#: What a sentence holds if any filler or intensifier can go from it.
_LOADED = T.words_pattern([*(p for phrases, _, _ in L.FILLERS for p in phrases), *_STACKED])


def cleanup_sentence(sentence: Column) -> Column:
    """A sentence without fillers and stacked intensifiers, with dashes between words as commas; never empty."""
    any_of = "|".join(_STACKED)
    stacked = rf"\b(?:{any_of})\b\s+\b({any_of})\b"
    sloppy = rf"\b(?:very|really|truly|quite)\s+({'|'.join(L.SLOPPY_ADJECTIVES)})\b"
    fillers = [(rf"\b(?:{'|'.join(p)})\b{after}", new) for p, after, new in L.FILLERS]
    lighter = F.when(T.matches(sentence, _LOADED), substitute(sentence, [*fillers, (stacked, "$1"), (sloppy, "$1")])).otherwise(sentence)
    c = substitute(lighter, [(r"(\w)\s*—\s*(\w)", "$1, $2"), (r"(\w)\s*--\s*(\w)", "$1, $2"), (r"\s+,", ","), (r",\s*,", ", "), (r"[ \t]{2,}", " ")], "(?U)")
    c = substitute(T.strip(c), [(r"^\s*,\s*", ""), (r"\s+([.?!,;:])", "$1")], "(?U)")
    return T.let(c, lambda x: F.when(x == "", sentence).otherwise(capitalised(x)))


def contraction_rate(text: Column) -> Column:
    return T.let(T.tokens(text), lambda w: F.round(T.how_many(w, lambda x: F.contains(x, F.lit("'"))) / F.greatest(F.size(w), F.lit(1)), 4))


def contraction_bias(text: Column, target: Column) -> Column:
    """Contract or expand where the text's rate is 0.012 or more off the target's; case is lost as it goes."""
    contract = [(rf"\b{a}\b", b) for a, b in L.CONTRACTIONS]
    expand = [(rf"\b{b}\b", a) for a, b in L.CONTRACTIONS]
    # one look for any of them before each is looked for
    holds = lambda rules: T.matches(text, "(?iU)" + "|".join(r for r, _ in rules))

    def biased(rate: Column) -> Column:
        goal = F.coalesce(target, rate)
        return F.when((goal >= rate + 0.012) & holds(contract), substitute(text, contract)).when((goal <= rate - 0.012) & holds(expand), substitute(text, expand)).otherwise(text)

    return T.let(contraction_rate(text), biased)


def align_lengths(paragraph: Column, target: Column) -> Column:
    """Split sentences that are far longer than the target, merge short neighbours; one pass from the left."""

    def parted(s: Column) -> Column:
        """The two halves at the first marker that stands well inside, else null."""
        options = []
        for marker in (", but ", ", and ", "; ", ": "):
            at = F.instr(F.lower(s), marker) - 1
            left = F.rtrim(T.strip(F.substr(s, F.lit(1), at)), F.lit(",;:"))
            right = T.strip(F.substr(s, at + 1 + len(marker)))
            halves = F.array(F.concat(left, F.lit(".")), F.concat(F.upper(F.left(right, F.lit(1))), F.substr(right, F.lit(2))))
            options.append(F.when((at > 8) & (at < F.length(s) - 8) & (left != "") & (right != ""), halves))
        return F.coalesce(*options)

    def step(s: Column, i: Column) -> Column:
        """Whether sentence i is merged with the next, and what comes of it."""
        own, n, after = F.get(s, i)["s"], F.get(s, i)["n"], F.get(s, i + 1)
        short = (n < F.greatest(F.lit(4.0), target - 9)) & after.isNotNull() & (after["n"] < F.greatest(F.lit(8.0), target - 5)) & ~F.endswith(own, F.lit("?")) & ~F.contains(own, F.lit('"'))
        merged = F.array(F.concat(F.rtrim(own, F.lit(".!?")), F.lit(", "), F.lower(F.left(after["s"], F.lit(1))), F.substr(after["s"], F.lit(2))))

        def of(halves: Column) -> Column:
            merge = halves.isNull() & F.coalesce(short, F.lit(False))
            return F.struct(merge.alias("merge"), F.when(merge, merged).otherwise(F.coalesce(halves, F.array(own))).alias("more"))

        return T.let(F.when(n > target + 10, parted(own)), of)

    def joined(s: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: step(s, i))
        # what is merged into the one before it takes no step: of neighbours that would all merge, every second one
        taken = F.transform(T.runs(steps, lambda _, before: ~before["merge"]), lambda r: F.flatten(F.transform(F.filter(r, lambda _, j: j % 2 == 0), lambda x: x["more"])))
        return F.when(F.size(s) == 0, F.lit("")).otherwise(F.array_join(F.flatten(taken), " "))

    return T.let(F.transform(T.sentences(paragraph), lambda s: F.struct(s.alias("s"), F.size(T.tokens(s)).alias("n"))), joined)


def document_mode_bias(text: Column, mode: Column) -> Column:
    out = text
    for name, rules in MODE_RULES.items():
        out = F.when(mode == name, substitute(text, rules)).otherwise(out)
    tidy = substitute(out, [(r"[ \t]{2,}", " "), (r"\s+([.?!,;:])", "$1")], "(?U)")
    return T.let(tidy, lambda x: T.strip(capitalised(x)))


def blocks(text: Column) -> Column:
    """array<struct<prose, text>>: runs of prose lines, and every other line on its own, in order.

    Lines between code fences, structural lines and blank lines are not prose.
    """
    def marked(line: Column) -> Column:
        return T.let(T.strip(line), lambda bare: F.struct(line.alias("line"), F.startswith(bare, F.lit("```")).alias("fence"), (~T.is_structural_line(bare) & (bare != "")).alias("prose")))

    def of_section(section: Column, k: Column, first: Column) -> Column:
        """A fence and what follows it, or what is before the first fence."""
        code = (k + first) % 2 == 1
        told = F.transform(section, lambda x: F.struct(x["line"].alias("line"), (x["prose"] & ~x["fence"] & ~code).alias("prose")))
        parts = T.runs(told, lambda x, before: ~(x["prose"] & before["prose"]))
        return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0))["prose"].alias("prose"), F.array_join(F.transform(p, lambda x: x["line"]), "\n").alias("text")))

    def of(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))["fence"].cast("int")
        return F.flatten(F.transform(T.runs(lines, lambda x, _: x["fence"]), lambda s, k: of_section(s, k, first)))

    return T.let(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), marked), of)


def _revised(block: Column, target: Column, budget: Column) -> Column:
    """struct<text, changed> of a prose block, which has no blank line and so is one paragraph."""

    def of_sentences(s: Column) -> Column:
        def flagged(tokens: Column) -> Column:
            flags = lambda mono, same: F.transform(s, lambda x, i: reduce(lambda a, b: a | b, signals.found(x, F.get(tokens, i), F.get(mono, i), F.get(same, i))))
            mono = T.let(F.transform(tokens, lambda t: F.size(t)), T.monotonous)
            return T.let(mono, lambda m: T.let(T.let(T.starts(tokens), T.repeated), lambda r: flags(m, r)))

        def cleaned(flags: Column) -> Column:
            # an annotated text is flagged wherever it stands
            texts = F.filter(s, lambda x, i: F.get(flags, i))
            return T.let(texts, lambda t: F.transform(s, lambda x: F.when(F.array_contains(t, x), cleanup_sentence(x)).otherwise(x)))

        every = F.transform(s, cleanup_sentence)
        return F.when(budget == "minimal", T.let(T.let(F.transform(s, T.tokens), flagged), cleaned)).otherwise(every)

    def built(s: Column) -> Column:
        def joined(new: Column) -> Column:
            prose = contraction_bias(align_lengths(T.strip(F.array_join(new, " ")), target["avg_sentence_length"]), target["contraction_rate"])
            changed = F.size(F.filter(F.zip_with(s, new, lambda a, b: a != b), lambda x: x))
            return F.struct(F.regexp_replace(prose, r"[ \t]{2,}", " ").alias("text"), changed.alias("changed"))

        return T.let(of_sentences(s), joined)

    return T.let(T.sentences(T.strip(block)), built)


def rewrite(df: DataFrame, text: str, target: str, budget: str, out: str = "rewrite") -> DataFrame:
    """df with `out`: struct<text, change_count>, before any quality guard.

    target: a voice profile column; budget: a column of BUDGETS, of which only minimal differs.
    """
    df = df.withColumn("__b", blocks(F.coalesce(F.col(text), F.lit(""))))
    keep = lambda b: F.struct(b["text"].alias("text"), F.lit(0).alias("changed"))
    df = df.withColumn("__r", F.transform("__b", lambda b: F.when(b["prose"], _revised(b["text"], F.col(target), F.col(budget))).otherwise(keep(b))))
    revised = T.strip(F.regexp_replace(F.array_join(F.transform("__r", lambda r: r["text"]), "\n"), "\n{3,}", "\n\n"))
    changes = F.aggregate("__r", F.lit(0), lambda a, r: a + r["changed"])
    any_prose = F.exists("__b", lambda b: b["prose"])
    return df.withColumn(out, F.struct(F.when(any_prose, revised).otherwise(F.col(text)).alias("text"), F.when(any_prose, changes).otherwise(0).alias("change_count"))).drop("__b", "__r")


def guarded(df: DataFrame, text: str, target: str, budget: str, original: str = "original_analysis") -> DataFrame:
    """df with revised_text, change_count, revised_analysis; the original where quality and risk both got worse.

    original: the analysis of the text. The guard compares rounded scores, by more than 2.
    """
    df = rewrite(df, text, target, budget, "__rw")
    df = signals.analyse(df.withColumn("__rt", F.col("__rw.text")), "__rt", "__ra")
    o, r = F.col(original), F.col("__ra")
    worse = (r["quality_score"] < o["quality_score"] - 2) & (r["detector_risk"] > o["detector_risk"] + 2)
    df = df.withColumns({"revised_text": F.when(worse, F.col(text)).otherwise(F.col("__rt")), "change_count": F.when(worse, 0).otherwise(F.col("__rw.change_count")), "revised_analysis": F.when(worse, o).otherwise(r)})
    return df.drop("__rw", "__rt", "__ra")
