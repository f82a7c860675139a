"""Quality predicates on (reference answer, candidate) and the joins that look references up.

The cheap rules are plain columns and filter first; the similarity ratio, which has no built-in, is a pandas UDF
that only sees the rows they leave.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.probe import let
from .dedup import last_wins


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; it depends on the order of its arguments."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _same(f: Callable[[Column], Column], ref: Column, cand: Column) -> Column:
    """Whether both have the same tokens, each made once."""
    return let(F.struct(f(ref).alias("a"), f(cand).alias("b")), lambda s: T.same_set(s["a"], s["b"]))


def _same_tokens(ref: Column, cand: Column) -> Column:
    return _same(T.salient_tokens, ref, cand) & _same(T.number_tokens, ref, cand) & _same(T.symbol_tokens, ref, cand)


def _sentence_end(c: Column) -> Column:
    t = T.trim(c)
    return t.endswith(".") | t.endswith("!") | t.endswith("?")


def _drift(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def negative_cheap(ref: Column, cand: Column) -> Column:
    """The rules of a good negative but for the ratio."""
    r, c = T.split_count(ref), T.split_count(cand)
    long = (T.count_of(cand, ",") > T.count_of(ref, ",") + 1) & (c > r + 6)
    return (c >= 2) & (c <= F.greatest(F.lit(14), F.floor(r * 1.45) + 2)) & ~long & (T.normalised(ref) != T.normalised(cand)) & ~_same_tokens(ref, cand)


def negative_ratio_fails(ref: Column, cand: Column, ratio: Column) -> Column:
    drift = let(F.struct(T.salient_tokens(ref).alias("a"), T.salient_tokens(cand).alias("b")), lambda s: _drift(s["a"], s["b"]))
    return (ratio >= 0.96) & _same(T.number_tokens, ref, cand) & (drift <= 1)


def drift_cheap(ref: Column, cand: Column) -> Column:
    """The rules of a good drifting negative but for the ratio."""
    r, c = T.split_count(ref), T.split_count(cand)
    flat = (T.count_of(cand, ",") == 0) & (T.count_of(cand, ".") <= T.count_of(ref, "."))
    new = F.size(F.array_except(T.salient_tokens(cand), T.salient_tokens(ref))) > 0
    return (c >= F.greatest(F.lit(4), r + 2)) & (c <= F.greatest(F.lit(28), F.floor(r * 3.0) + 12)) & ~flat & _sentence_end(cand) & new & (T.normalised(ref) != T.normalised(cand)) & ~_same_tokens(ref, cand)


def supported_positive(ref: Column, cand: Column) -> Column:
    """A longer answer that keeps the reference's facts."""
    r, c = T.split_count(ref), T.split_count(cand)
    kept = let(T.salient_tokens(ref), lambda own: (F.size(own) == 0) | (T.share_in(own, T.salient_tokens(cand)) >= 0.6))
    inside = lambda f: F.size(F.array_except(f(ref), f(cand))) == 0
    flat = (T.count_of(cand, ",") == 0) & (T.count_of(cand, ".") == 0)
    return (
        (T.trim(cand) != "") & (T.trim(ref) != T.trim(cand)) & (c > r + 2) & (c <= F.greatest(F.lit(22), F.floor(r * 2.6) + 8))
        & ~flat & _sentence_end(cand) & kept & inside(T.number_tokens) & inside(T.symbol_tokens)
    )


def drift_gate(ref: Column, cand: Column) -> Column:
    return (T.split_count(cand) > T.split_count(ref) + 2) & ((T.count_of(cand, ",") > 0) | (T.count_of(cand, ".") > T.count_of(ref, ".")))


def expansion_ok(answer: Column, out: Column) -> Column:
    """A rewritten answer that is neither empty, unchanged nor much longer."""
    return (T.trim(out) != "") & (T.trim(out) != T.trim(answer)) & (T.split_count(out) <= F.greatest(F.lit(4), F.floor(T.split_count(answer) * 1.35) + 2))


def reference_answers(records: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The last label-0 answer of each prompt."""
    base = records.where(F.coalesce("label", F.lit(1)) == 0)
    if without:
        base = base.where(~F.coalesce("variant_type", F.lit("")).isin(*without))
    return last_wins(base, ["prompt"], "answer", "_ord").withColumnRenamed("answer", "reference")


def _checked(records: DataFrame, refs: DataFrame, rules: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Rows that no rule concerns pass; a concerned row must pass its cheap rules, and then the ratio must not fail it."""
    joined = records.join(refs, "prompt", "left")
    has = F.coalesce(F.col("reference"), F.lit("")) != ""
    concerned, cheap, fails = F.lit(False), F.lit(True), F.lit(False)
    for on, ok, bad in rules:
        concerned, cheap, fails = concerned | (has & on), F.when(has & on, ok).otherwise(cheap), F.when(has & on, bad).otherwise(fails)
    free = joined.where(~concerned)
    rest = joined.where(concerned).where(cheap).withColumn("_ratio", sequence_ratio(T.normalised(F.col("reference")), T.normalised(F.col("answer")))).where(~fails).drop("_ratio")
    return free.unionByName(rest).select(records.columns)


def filter_negatives(records: DataFrame) -> DataFrame:
    """Drops bad external negatives; rows without a reference stay."""
    ref, cand = F.col("reference"), F.col("answer")
    on = F.coalesce("variant_type", F.lit("")) == "groq_negative"
    return _checked(records, reference_answers(records), [(on, negative_cheap(ref, cand), negative_ratio_fails(ref, cand, F.col("_ratio")))])


def filter_augmented(records: DataFrame) -> DataFrame:
    """Drops bad supported positives and drifting negatives; supported positives are no reference."""
    ref, cand = F.col("reference"), F.col("answer")
    variant = F.coalesce("variant_type", F.lit(""))
    return _checked(records, reference_answers(records, ("groq_supported_positive",)), [
        (variant == "groq_supported_positive", supported_positive(ref, cand), F.lit(False)),
        (variant == "groq_drift_negative", drift_cheap(ref, cand), F.col("_ratio") >= 0.985),
    ])


def augmentation_sources(records: DataFrame) -> DataFrame:
    return records.where((F.coalesce("label", F.lit(1)) == 0) & ~F.coalesce("variant_type", F.lit("")).startswith("fever_"))
