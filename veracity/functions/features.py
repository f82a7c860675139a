"""Features of a (prompt, answer) pair, the closed-form score and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as X
from . import text as T


def text_features(df: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds the seven text features. Token sets are made in an inner projection, so none is made twice."""
    p, a = F.col(prompt), F.col(answer)
    sets = df.withColumn("_s", F.struct(
        F.lower(T.text(p)).alias("low"), T.content_tokens(p).alias("pc"), T.content_tokens(a).alias("ac"), T.entity_tokens(p).alias("pe"), T.entity_tokens(a).alias("ae"),
        T.number_tokens(p).alias("pn"), T.number_tokens(a).alias("an"), F.size(T.words(a)).cast("double").alias("w"),
    ))
    s = lambda n: F.col(f"_s.{n}")
    ratios = sets.select(
        "*", s("w").alias("answer_len_words"), T.share_in(s("pc"), s("ac")).alias("prompt_overlap_ratio"), T.share_in(s("pe"), s("ae")).alias("prompt_entity_coverage"),
        T.share_in(s("pn"), s("an")).alias("prompt_number_coverage"), T.share_out(s("pc"), s("ac")).alias("answer_new_content_ratio"), T.share_out(s("pn"), s("an")).alias("answer_new_number_ratio"),
    )
    return ratios.withColumn("question_type_mismatch", mismatch(s("low"), s("w"), F.size(s("ae")), F.size(s("an")), F.col("answer_new_content_ratio"), F.col("prompt_overlap_ratio"))).drop("_s")


def mismatch(low: Column, w: Column, entities: Column, numbers: Column, new: Column, overlap: Column) -> Column:
    """How badly the answer misses the kind of question; penalties of all hints add up, to 1 at most."""

    def rule(hints: tuple[str, ...], missing: Column, base: float, extra: float, longest: int, most: float) -> Column:
        parts = F.when(missing, base).otherwise(0.0) + F.when((w > longest) | (new > most), extra).otherwise(0.0)
        return F.when(T.has_any(low, hints), parts).otherwise(0.0)

    total = (
        rule(X.WHO, entities == 0, 0.75, 0.25, 18, 0.72)
        + rule(X.WHEN_FEATURES, numbers == 0, 0.8, 0.2, 16, 0.65)
        + rule(X.WHERE, entities == 0, 0.7, 0.15, 20, 0.75)
        + rule(X.COUNT, numbers == 0, 0.85, 0.15, 18, 0.7)
    )
    return F.when(total != 0, F.least(F.lit(1.0), total)).when((w > 48) & (overlap < 0.2), 0.35).when((new > 0.85) & (w > 10), 0.25).otherwise(0.0)


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def full_features(audit: str = "audit") -> Column:
    """The ten audit features and the seven text features as one array<float>."""
    a = lambda k: F.col(f"{audit}.{k}")
    risks = [a("h"), a("n"), a("e"), 1 - a("r"), a("u"), a("c"), a("x"), 1 - a("q"), 1 - a("s"), a("m")]
    return F.array(*(c.cast("float") for c in risks), *(F.col(c).cast("float") for c in X.TEXT_FEATURES))


def heuristic_proba() -> Column:
    """The closed-form classifier over the text features."""
    f = dict(zip("wocnkbm", map(F.col, X.TEXT_FEATURES), strict=True))
    score = 0.12 * clip(f["w"] / 32) + 0.24 * clip(1 - f["o"]) + 0.14 * clip(1 - f["c"]) + 0.12 * clip(1 - f["n"]) + 0.14 * f["k"] + 0.08 * f["b"] + 0.16 * f["m"]
    return clip(1 / (1 + F.exp(-4 * (score - 0.35))))


def verdict(proba: Column) -> Column:
    return clip(proba) >= 0.5


def format_result(prompt: Column, answer: Column, proba: Column) -> Column:
    """(verdict text, probability rounded to six places); blank input has no score."""
    blank = (T.trim(prompt) == "") | (T.trim(answer) == "")
    return F.struct(
        F.when(blank, "Input required").when(verdict(proba), "Hallucination").otherwise("Likely factual").alias("verdict"),
        F.when(~blank, F.bround(proba, 6)).alias("predict_proba"),
    )
