"""Signals, annotations and scores of a document.

Everything about a document is worked out inside its row: sentences and tokens are arrays made once and
used by higher-order functions, so analysing a corpus shuffles nothing however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions import text as T
from quillspark.operators import voice

ANNOTATION = "struct<type:string,severity:int,original:string,reason:string,sentence:int,rule:int>"
FILLER = T.words_pattern(p for phrases, _, _ in L.FILLERS for p in phrases)
FLAGGED = 55

# Type, severity and reason of each rule, in the order in which they are tried.
RULES = [
    ("filler", 72, "The sentence leans on transitional or explanatory filler that slows it down."),
    ("register", 58, "Stacked intensifiers make the prose feel inflated rather than precise."),
    ("filler", 45, "Progressive construction ('started to') can often be replaced with the simple past tense."),
    ("fiction-tell", 68, "The phrasing reaches for a familiar effect instead of giving a sharper image."),
    ("rhythm", 52, "The em dash lands like a reveal beat and can read as synthetic cadence."),
    ("rhythm", 61, "This sits inside a run of similarly sized sentences, which flattens the rhythm."),
    ("structure", 63, "The sentence repeats the same opening pattern as its neighbours, which feels mechanical."),
    ("structure", 54, "The sentence carries a lot of weight at once and is a good candidate for compression."),
    ("structure", 48, "Passive construction distances the reader from the action. Consider active voice."),
]


def segment(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __t (text, never null), __s (sentences), __w (tokens), __st (tokens a sentence), __len, __start."""
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"__s": T.sentences(F.col("__t")), "__w": T.tokens(F.col("__t")), "__low": F.lower("__t")})
    df = df.withColumn("__st", F.transform("__s", T.tokens))
    return df.withColumns({"__len": F.transform("__st", lambda t: F.size(t)), "__start": T.starts(F.col("__st"))})


def found(s: Column, own: Column, mono: Column, same: Column) -> list[Column]:
    """Whether each rule holds for sentence s with tokens `own` that ends such runs."""
    low = F.lower(s)
    return [
        T.matches(s, FILLER),
        T.how_many(own, lambda w: w.isin(L.INTENSIFIERS)) >= 2,
        T.matches(low, r"(?U)\b(?:started|began) to\b"),
        T.matches(low, "|".join(L.CLICHES)),
        T.matches(s, "—|--"),
        mono,
        same,
        F.size(own) >= 34,
        T.matches(s, T.PASSIVE),
    ]


def annotate(df: DataFrame, text: str = "text", segmented: bool = False) -> DataFrame:
    """segment(df) with __ann: the annotations in order, the first of each type and sentence text only."""
    df = df if segmented else segment(df, text)
    df = df.withColumns({"__mono": T.monotonous(F.col("__len")), "__same": T.repeated(F.col("__start"))})

    # all that belongs to a sentence travels with it: a column named in a lambda could be worked out for every element
    def of_sentence(z: Column, i: Column) -> Column:
        s = z["__s"]
        rows = [F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), s.alias("original"), F.lit(reason).alias("reason"), i.alias("sentence"), F.lit(n).alias("rule"))) for n, ((kind, severity, reason), hit) in enumerate(zip(RULES, found(s, z["__st"], z["__mono"], z["__same"]), strict=True))]
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    def firsts(rows: Column) -> Column:
        keys = F.transform(rows, lambda a: F.concat_ws("\u0001", a["type"], a["original"]))
        return T.let(keys, lambda k: F.filter(rows, lambda a, i: F.array_position(k, F.get(k, i)) == i + 1))

    every = F.flatten(F.transform(F.arrays_zip("__s", "__st", "__mono", "__same"), of_sentence))
    return df.withColumn("__ann", T.let(every, firsts).cast(f"array<{ANNOTATION}>"))


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """annotate(df) with the counts of all signals, as columns."""
    df = annotate(df, text)
    w, low, t = F.col("__w"), F.col("__low"), F.col("__t")
    of_type = lambda kind: F.size(F.filter("__ann", lambda a: a["type"] == kind))
    return df.withColumns(
        {
            "filler_hits": of_type("filler"),
            "rhythm_hits": of_type("rhythm"),
            "modifier_hits": T.how_many(w, T.is_modifier),
            "transition_hits": T.count(low, T.words_pattern(L.TRANSITIONS)),
            "cliche_hits": sum((F.contains(low, F.lit(p)).cast("int") for p in L.CLICHES), F.lit(0)),
            "generic_hits": T.how_many(w, lambda x: x.isin(L.GENERIC_WORDS)),
            "abstract_hits": T.how_many(w, lambda x: x.isin(L.ABSTRACT_WORDS)),
            "repeated_starts": T.truths(T.repeated(F.filter("__start", lambda s: s != ""))),
            "monotonous_runs": T.truths(F.col("__mono")),
            "passive_hits": T.count(t, T.PASSIVE),
            "dashes": T.count_literal(t, "—") + T.count_literal(t, "--"),
            "sentence_count": F.size("__s"),
            "word_count": F.size(w),
            "__ld": T.lexical_diversity(w),
            "__sd": T.stdev(F.col("__len")),
        }
    )


AXES = ["directness", "density", "rhythm", "authenticity", "specificity"]
SIGNALS = ["filler_hits", "modifier_hits", "transition_hits", "cliche_hits", "generic_hits", "abstract_hits", "repeated_starts", "monotonous_runs", "passive_hits"]


def scores(df: DataFrame, text: str = "text") -> DataFrame:
    """signals(df) with the five axes, quality_score and detector_risk, one decimal each."""
    df, c = signals(df, text), F.col
    short = lambda limit: F.greatest(F.lit(0.0), limit - c("__ld"))
    axis = {
        "directness": 100 - c("filler_hits") * 8 - c("transition_hits") * 4 - c("generic_hits") * 1.5 - c("passive_hits") * 5,
        "density": 100 - c("filler_hits") * 7 - c("modifier_hits") * 1.6 - c("generic_hits") * 1.8,
        "rhythm": 100 - c("rhythm_hits") * 8 - c("monotonous_runs") * 6 - F.greatest(F.lit(0.0), 7 - c("__sd")) * 4,
        "authenticity": 100 - c("cliche_hits") * 9 - c("transition_hits") * 5 - c("abstract_hits") * 2 - c("repeated_starts") * 7 - c("filler_hits") * 4,
        "specificity": 100 - c("generic_hits") * 3 - c("abstract_hits") * 2 - short(0.48) * 150,
    }
    df = df.withColumns({f"__{k}": T.clamp(v.cast("double")) for k, v in axis.items()})
    risk = c("filler_hits") * 7 + c("modifier_hits") * 1.3 + c("transition_hits") * 5 + c("cliche_hits") * 9 + c("repeated_starts") * 7 + c("monotonous_runs") * 6 + c("passive_hits") * 4 + short(0.72) * 70 + c("dashes") * 4
    # means of shares fall a little short of a half or go beyond it, by the order in which they are summed
    out = {k: T.rounded(c(f"__{k}"), 1) for k in AXES}
    out |= {"quality_score": T.rounded(sum((c(f"__{k}") for k in AXES[1:]), c(f"__{AXES[0]}")) / 5, 1), "detector_risk": T.rounded(T.clamp(risk.cast("double")), 1)}
    return df.withColumns(out)


def unflagged(df: DataFrame) -> DataFrame:
    """annotate(df) with __clean: the text without its flagged sentences, or all of it if none would be left."""
    flag = F.array_distinct(F.transform(F.filter("__ann", lambda a: a["severity"] >= FLAGGED), lambda a: T.strip(a["original"])))

    def clean(flag: Column) -> Column:
        kept = F.transform(T.paragraphs(F.col("__t")), lambda p: F.array_join(F.filter(T.sentences(p), lambda s: ~F.array_contains(flag, T.strip(s))), " "))
        left = T.strip(F.array_join(F.filter(kept, lambda p: p != ""), "\n\n"))
        return F.when(F.size(flag) == 0, F.col("__t")).otherwise(F.coalesce(F.nullif(left, F.lit("")), F.col("__t")))

    return df.withColumn("__clean", T.let(flag, clean))


def analyse(df: DataFrame, text: str = "text", out: str = "analysis") -> DataFrame:
    """df with `out`: annotations, scores, signals, voice profile, counts; profile of the unflagged text."""
    columns = df.columns
    row = df.select(F.struct(*[F.col(f"`{x}`") for x in columns]).alias("__row"), F.col(text).alias("__text"))
    d = unflagged(scores(row, "__text"))
    d = voice.profiled(d, "__clean", "__voice")
    analysis = F.struct(
        F.col("__ann").alias("annotations"), "quality_score", "detector_risk", F.struct(*AXES).alias("scores"), F.struct(*SIGNALS).alias("signals"), F.col("__voice").alias("voice_profile"), "sentence_count", "word_count",
    )
    return d.select(*[F.col("__row")[x].alias(x) for x in columns if x != out], analysis.alias(out))
