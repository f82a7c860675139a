"""Deterministic samples by key hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T


#: Up to this many rows a group, Spark limits each partition before it shuffles (spark.sql.optimizer.windowGroupLimitThreshold).
FEW = 1_000


def rank_by(df: DataFrame, group: Column, key: str) -> DataFrame:
    """Numbers the rows of each group in ``_rn`` by their keys, which are hexadecimal digests. A group is ranked in 4096 bins by the
    first three digits, so no task sorts a whole group."""
    own = df.withColumns({"_g": group, "_bin": F.substring(key, 1, 3)})
    bins = own.groupBy("_g", "_bin").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(F.col("_g").alias("_h"), F.col("_bin").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    out = own.join(bins, F.col("_g").eqNullSafe(F.col("_h")) & F.col("_bin").eqNullSafe(F.col("_b")))
    return out.withColumn("_rn", F.col("_before") + F.row_number().over(Window.partitionBy("_g", "_bin").orderBy(key))).select(*df.columns, "_rn")


def top_by(df: DataFrame, group: Column, key: str, k: int, digest: bool = True) -> DataFrame:
    """Of each group the k rows with the smallest keys, numbered in ``_rn``. Spark limits each partition to k rows a group
    before it shuffles while k is small; beyond that the keys, if they are digests, are ranked in bins."""
    if k > FEW and digest:
        return rank_by(df, group, key).where(F.col("_rn") <= k)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    return ranked.where(F.col("_rn") <= k)


def _quota(df: DataFrame, group: Column, key: str, limit: int) -> DataFrame:
    """Of each group the rows with the smallest keys: its share of the limit, half-even, one at least."""
    counts = df.groupBy(group.alias("_g")).count().collect()  # one row a variant and label, or a label
    total = sum(r["count"] for r in counts)
    share = {r["_g"]: max(1, round(limit * r["count"] / total)) for r in counts}
    allowed = F.lit(0)
    for g, k in share.items():
        allowed = F.when(group.eqNullSafe(F.lit(g)), k).otherwise(allowed)
    return top_by(df, group, key, max(share.values(), default=1)).where(F.col("_rn") <= allowed).drop("_rn")


def stratified_sample(records: DataFrame, limit: int | None) -> DataFrame:
    """Proportional by variant and label, then the smallest keys overall. May give fewer rows than the limit."""
    if limit is None or records.count() <= limit:
        return records
    keyed = records.withColumn("_key", T.key_digest(F.col("variant_type"), F.col("label"), F.col("prompt"), F.col("answer")))
    group = T.group_key(F.col("variant_type"), F.col("label"))
    return _quota(keyed, group, "_key", limit).orderBy("_key").limit(limit).drop("_key")


def dev_slice(df: DataFrame, size: int, salt: str = "balanced") -> DataFrame:
    """Proportional by label; labels in order, then keys. Without a label column the smallest keys."""
    labelled = "is_hallucination" in df.columns
    label = F.col("is_hallucination") if labelled else F.lit(None).cast("string")
    keyed = df.withColumn("_key", T.key_digest(F.lit(salt), F.col("prompt"), F.col("model_answer"), label))
    if not labelled:
        return keyed.orderBy("_key").limit(size).drop("_key")
    return _quota(keyed, label, "_key", size).orderBy("is_hallucination", "_key").limit(size).drop("_key")


def typed_dev_slice(df: DataFrame, size: int) -> DataFrame:
    """Questions of a known kind first, filled up with others. Without any other rows it gives the known ones."""
    kind = T.profile_evaluation(F.col("prompt"))
    typed, generic = df.where(kind != "generic"), df.where(kind == "generic")
    n = typed.count()
    if n >= size:
        return dev_slice(typed, size, "typed")
    if n == 0:
        return dev_slice(df, size, "typed")
    both = typed.unionByName(dev_slice(generic, size - n, "typed-fill"))
    return dev_slice(both, min(size, both.count()), "typed")


def round_robin(records: DataFrame, limit: int) -> DataFrame:
    """One of each question profile in turn, by key within a profile."""
    key = T.key_digest(F.col("prompt"), F.col("answer"), F.col("source"), F.col("variant_type"))
    keyed = records.withColumn("_p", T.profile_building(F.col("prompt"))).withColumn("_key", key)
    turn = F.array_position(F.array(*map(F.lit, X.PROFILES)), F.col("_p"))
    return top_by(keyed, F.col("_p"), "_key", limit).orderBy("_rn", turn).limit(limit).drop("_p", "_key", "_rn")


def per_label_limit(df: DataFrame, limit: int) -> DataFrame:
    """A proportional sample by label in the order of a salted hash; the random generator of numpy has no counterpart here."""
    return dev_slice(df, limit, "random")


def allotted(counts: dict, total: int) -> dict:
    """Shares of a total in proportion to the counts: whole parts first, the rest by the largest fractions, ties by name."""
    n = sum(counts.values())
    exact = {k: total * c / n for k, c in counts.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, stratum: str, key: Column, share: float = 0.2) -> DataFrame:
    """Adds ``is_validation``: exactly ``share`` of all rows, rounded up, dealt to the strata in proportion; within each those of
    the smallest digests of the key. A stratum of two rows or more keeps one on each side where the share allows it."""
    keyed = df.withColumn("_key", T.key_digest(F.lit("split"), key))
    counts = {r[0]: r[1] for r in keyed.groupBy(stratum).count().collect()}  # a row a stratum
    total = sum(counts.values())
    own = allotted(counts, math.ceil(share * total)) if total else {}
    allowed = F.lit(0)
    for s, n in own.items():
        allowed = F.when(F.col(stratum).eqNullSafe(F.lit(s)), n).otherwise(allowed)
    return rank_by(keyed, F.col(stratum), "_key").withColumn("is_validation", F.col("_rn") <= allowed).drop("_key", "_rn")


def random_split(df: DataFrame, key: Column, share: float = 0.3) -> DataFrame:
    """Adds ``is_test``: the rest of the first 1 - ``share`` of all rows, half-even, in the order of the key's digests."""
    keyed = df.withColumn("_key", T.key_digest(F.lit("holdout"), key))
    n = round((1 - share) * df.count())
    return rank_by(keyed, F.lit(0), "_key").withColumn("is_test", F.col("_rn") > n).drop("_key", "_rn")


def spec_cap(df: DataFrame, spec: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each spec."""
    return top_by(df, F.col(spec), order, cap, digest=False).drop("_rn")
