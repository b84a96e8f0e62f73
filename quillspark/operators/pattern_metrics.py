"""Metrics, scores and profiles of the pattern engine. A document's figures never leave its row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import pattern_lexicons as L
from quillspark.functions import pattern_text as P
from quillspark.functions import text as T

PROFILE = list(L.PROFILE_SCALE)
METRICS = [
    "word_count", "sentence_count", "paragraph_count", "avg_sentence", "avg_paragraph", "sentence_spread", "paragraph_spread", "lexical_diversity", "contraction_rate", "dialogue_density", "em_dash_rate", "semicolon_rate",
    "question_rate", "exclamation_rate", "fragment_rate", "long_sentence_rate", "repetition_rate", "modifier_density", "concrete_density", "abstract_density", "filler_hits", "structure_hits", "fiction_hits", "register_hits",
]


#: Words of which densities are made. They are plain words, so a text's tokens tell how often they are there.
_COUNTED = {*L.MODIFIERS, *L.CONCRETE, *L.ABSTRACT, *L.DERIVED_CONCRETE, *L.DERIVED_ABSTRACT}


def segment(c: Column) -> Column:
    """What the metrics are made from: struct of words by paragraph and by sentence, and of counts of words."""
    at_least_one = lambda parts: F.transform(parts, lambda s: F.greatest(P.word_count(s), F.lit(1)))
    repeats = lambda w: F.size(F.filter(w, lambda x, i: F.when(i > 0, x == F.get(w, F.greatest(i - 1, F.lit(0)))).otherwise(False)))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("unique"), repeats(w).alias("repeats"))
    return F.struct(at_least_one(P.paragraphs(c)).alias("par"), at_least_one(P.sentences(c)).alias("sent"), T.let(F.transform(P.words(c), F.lower), of_words).alias("w"), P.tokens_of(c, _COUNTED).alias("k"))


def measured(c: Column) -> Column:
    """struct of the metrics of a text, quality_score and detector_risk among them."""

    def of(x: Column) -> Column:
        par, sent = x["seg"]["par"], x["seg"]["sent"]
        words, sentences = F.greatest(x["seg"]["w"]["n"], F.lit(1)), F.greatest(F.size(sent), F.lit(1))
        share = lambda n: n / sentences
        density = lambda of: T.how_many(x["seg"]["k"], lambda w: w.isin(of)) / words
        hits = lambda *lists: reduce(add, (P.phrase_hits(x["low"], x["b"], phrases) for phrases in lists))
        values = {
            "word_count": words,
            "sentence_count": F.size(sent),
            "paragraph_count": F.size(par),
            "avg_sentence": T.mean(sent),
            "avg_paragraph": T.mean(par),
            "sentence_spread": T.stdev(sent),
            "paragraph_spread": T.stdev(par),
            "lexical_diversity": x["seg"]["w"]["unique"] / words,
            "contraction_rate": F.when(F.contains(c, F.lit("'")), T.count(c, P.CONTRACTION)).otherwise(0) / words,
            "dialogue_density": T.count(c, '["“”]') / 2 / F.greatest(F.size(par), F.lit(1)),
            "em_dash_rate": share(T.count_literal(c, "—")),
            "semicolon_rate": share(T.count_literal(c, ";")),
            "question_rate": share(T.count_literal(c, "?")),
            "exclamation_rate": share(T.count_literal(c, "!")),
            "fragment_rate": share(T.how_many(sent, lambda n: n < 5)),
            "long_sentence_rate": share(T.how_many(sent, lambda n: n > 24)),
            "repetition_rate": x["seg"]["w"]["repeats"] / words,
            "modifier_density": density(L.MODIFIERS),
            "concrete_density": density(L.CONCRETE),
            "abstract_density": density(L.ABSTRACT),
            "filler_hits": hits(L.FILLER, L.TRANSITIONS),
            "structure_hits": hits(L.STRUCTURE),
            "fiction_hits": hits(L.FICTION_TELL),
            "register_hits": hits(L.REGISTER),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def scored(m: Column) -> Column:
        over = lambda name, limit: F.greatest(F.lit(0.0), m[name] - limit)
        hits = lambda *weights: reduce(add, (w * m[n] for n, w in zip(("filler_hits", "structure_hits", "fiction_hits", "register_hits"), weights, strict=True)))
        quality = 100 - (hits(5, 3, 4, 5) + 120 * m["repetition_rate"] + 1.2 * F.abs(m["avg_sentence"] - 18) + 0.7 * m["sentence_spread"] + 0.05 * m["paragraph_spread"] + 28 * over("long_sentence_rate", 0.15) + 20 * over("fragment_rate", 0.1))
        risk = 16 + hits(7.5, 4.5, 5, 6) + 140 * m["repetition_rate"] + 100 * m["modifier_density"] + 24 * over("long_sentence_rate", 0.16) + 18 * over("fragment_rate", 0.15)
        return F.struct(*[m[k].alias(k) for k in METRICS], T.clamp(quality).alias("quality_score"), T.clamp(risk).alias("detector_risk"))

    return T.let(T.let(F.struct(segment(c).alias("seg"), F.lower(c).alias("low"), P.beginnings(F.lower(c), [*L.FILLER, *L.TRANSITIONS, *L.STRUCTURE, *L.FICTION_TELL, *L.REGISTER]).alias("b")), of), scored)


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with measured() of its texts, as columns."""
    return T.bound(df, __m=measured(F.col(text))).select(*df.columns, "__m.*")


def figures(c: Column) -> Column:
    """struct of the metrics that the hit detector makes for itself, by its own word lists."""

    def of(seg: Column) -> Column:
        words, sentences = F.greatest(seg["n"], F.lit(1)), F.greatest(F.size(seg["sent"]), F.lit(1))
        blocks = F.size(F.filter(F.split(c, "\n{2,}"), lambda b: b != ""))
        density = lambda of: T.how_many(seg["k"], lambda w: w.isin(of)) / words
        values = {
            "word_count": words, "sentence_count": F.size(seg["sent"]), "avg_sentence": T.mean(seg["sent"]), "sentence_spread": T.stdev(seg["sent"]),
            "dialogue_density": T.count(c, '["“”]') / 2 / F.greatest(blocks, F.lit(1)), "question_rate": T.count_literal(c, "?") / sentences,
            "modifier_density": density(L.MODIFIERS), "concrete_density": density(L.DERIVED_CONCRETE), "abstract_density": density(L.DERIVED_ABSTRACT),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    sent = F.transform(P.sentences(c), lambda s: F.greatest(P.word_count(s), F.lit(1)))
    return T.let(F.struct(P.word_count(c).alias("n"), sent.alias("sent"), P.tokens_of(c, _COUNTED).alias("k")), of)


def derived(df: DataFrame, text: str = "text") -> DataFrame:
    """df with figures() of its texts, as columns."""
    return T.bound(df, derived=figures(F.col(text))).select(*df.columns, "derived.*")


def profile(df: DataFrame) -> DataFrame:
    """metrics() as a profile: the 15 figures of PROFILE, each cut to 0..1."""
    return df.withColumns({k: T.clamp(F.col(k) * scale, 0.0, 1.0) for k, scale in L.PROFILE_SCALE.items()})


def profile_of(m: Column) -> Column:
    """profile() of a struct of metrics, as a struct."""
    return F.struct(*[T.clamp(m[k] * scale, 0.0, 1.0).alias(k) for k, scale in L.PROFILE_SCALE.items()])


def centroid(profiles: DataFrame, *keys: str) -> DataFrame:
    """keys, then the mean of each figure, pre-aggregated in every task."""
    return profiles.groupBy(*keys).agg(*[F.avg(k).alias(k) for k in PROFILE])


def distance(left: str, right: str) -> Column:
    """Mean absolute difference of two profiles, given as struct columns; 0 if either is missing."""
    gaps = reduce(add, (F.abs(F.col(left)[k] - F.col(right)[k]) for k in PROFILE)) / len(PROFILE)
    return F.when(F.col(left).isNull() | F.col(right).isNull(), 0.0).otherwise(gaps)


def blend(left: str, right: str, weight: Column) -> Column:
    """Two profiles mixed, `weight` being the right one's; the other one where one is missing."""
    a, b = F.col(left), F.col(right)
    mixed = F.struct(*[(a[k] * (1 - weight) + b[k] * weight).alias(k) for k in PROFILE])
    return F.when(a.isNotNull() & b.isNotNull(), mixed).otherwise(F.coalesce(a, b))


def by_name(name: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def target_weight(mode: Column) -> Column:
    return by_name(mode, {k: w for k, (w, _) in L.TARGET_WEIGHTS.items()}, L.OTHER_WEIGHTS[0])


def intensity(mode: Column, budget: Column) -> Column:
    return by_name(mode, L.MODE_INTENSITY, 1.0) * by_name(budget, L.BUDGET_INTENSITY, 1.0)


def target(voice_mode: Column, mode: Column, batch: str, sample: str) -> Column:
    """The profile that a batch aims at: its own, its voice sample's or a blend of them."""
    own, of_sample = F.col(batch), F.coalesce(F.col(sample), F.col(batch))
    return F.when(voice_mode.isin("voice_pack_only", "frozen_project_voice"), of_sample).when(voice_mode == "hybrid", blend(batch, sample, target_weight(mode))).otherwise(own)


def assessment(profile_: str, batch: str, target_: str, mode: Column) -> dict[str, Column]:
    """Distances, similarities and the weighted voice score of a document within its batch."""
    near = lambda d: T.clamp(100 - 160 * d)
    to_batch, to_target, w = distance(profile_, batch), distance(profile_, target_), target_weight(mode)
    return {"batch_distance": to_batch, "target_distance": to_target, "batch_similarity": near(to_batch), "target_similarity": near(to_target), "voice_score": T.clamp(near(to_target) * w + near(to_batch) * (1 - w))}
