"""Counts, weights, latency and average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..sources.scratch import Scratch


def variant_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("variant_type", F.lit("unknown")).alias("variant_type")).agg(F.count("*").alias("n"))


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(df: DataFrame, value: str, by: list[str] | None = None, bins: int = 4096) -> DataFrame:
    """Mean and interpolated percentiles; zeros where there is no value.

    Equal values of a group are counted first; the counts cumulate within bins of the group's range and across the bins' totals,
    and the rows at the ranks wanted are picked, so no task holds or sorts all values of a group.
    """
    by = by or []
    own = df.select(*by, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_all"))
    keys = by or ["_all"]
    same = lambda left, right: [left[k].eqNullSafe(right[k]) for k in keys]
    groups = own.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("_n"))
    per = own.where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_m"))
    left, right = per.alias("l"), groups.select(*keys, "_low", "_high", "_n").alias("r")
    width = F.nullif((F.col("_high") - F.col("_low")) / bins, F.lit(0.0))
    per = left.join(right, same(per, groups)).select("l.*", "_n", F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(0))).cast("int").alias("_bin"))
    totals = per.groupBy(*keys, "_bin").agg(F.sum("_m").alias("_b"))
    before = F.coalesce(F.sum("_b").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_before", before)
    joined = per.alias("l").join(totals.alias("r"), [*same(per, totals), per["_bin"] == totals["_bin"]]).select("l.*", "_before")
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = joined.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_m"))
    at = lambda q, f: f(q * (F.col("_n") - 1))
    here = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    picked = placed.groupBy(*keys).agg(F.max("_n").alias("_k"), *(here(at(q, f)).alias(f"_{n}_{e}") for n, q in QUANTILES.items() for e, f in (("a", F.floor), ("b", F.ceil))))

    def between(name: str, q: float) -> Column:
        rank = q * (F.col("_k") - 1)
        return F.col(f"_{name}_a") + (F.col(f"_{name}_b") - F.col(f"_{name}_a")) * (rank - F.floor(rank))

    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = groups.alias("l").join(picked.alias("r"), same(groups, picked), "left").select(*(F.col(f"l.{k}") for k in by), z(F.col("mean")).alias("mean"), *(z(between(n, q)).alias(n) for n, q in QUANTILES.items()))
    if by:
        return out
    empty = df.sparkSession.range(1).select(*(F.lit(0.0).alias(c) for c in ("mean", *QUANTILES)))
    return out if not df.isEmpty() else empty


def precision_steps(df: DataFrame, score: str, label: str, bins: int = 4096) -> DataFrame:
    """(score, n, tp, cumulative n and tp by falling score), one row a distinct score.

    Distinct scores are first summed, then cumulated within bins of the score's range and across the bins' totals, so
    no task orders all scores.
    """
    per = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("tp"))
    per = Scratch(df.sparkSession).save(per, "per")  # read three times, and what makes the scores may be dear
    low, high = per.agg(F.min("score"), F.max("score")).first()
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    per = per.withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.lit(high or 0.0) - F.col("score")) / width)).cast("int"))
    totals = per.groupBy("_bin").agg(F.sum("n").alias("bn"), F.sum("tp").alias("btp"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    totals = totals.select("_bin", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("btp").over(before), F.lit(0)).alias("tp0"))
    w = Window.partitionBy("_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(totals), "_bin")
    return out.select("score", "n", "tp", (F.col("n0") + F.sum("n").over(w)).alias("cum_n"), (F.col("tp0") + F.sum("tp").over(w)).alias("cum_tp"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise average precision with ties together; 0 without positives."""
    steps = precision_steps(df, score, label)
    return steps.agg((F.coalesce(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")) / F.nullif(F.sum("tp"), F.lit(0)), F.lit(0.0))).alias("average_precision"))


def variant_weight(variant: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in X.VARIANT_WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(variant, F.lit("unknown"))), F.lit(1.0))


def normalised_weights(df: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``weight``: the variant's weight over the mean weight of its split; ones where that is not positive."""
    w = df.withColumn("_w", variant_weight(F.col("variant_type")))
    if by is None:
        mean = F.lit(w.agg(F.avg("_w")).first()[0] or 0.0)
        return w.withColumn("weight", F.when(mean > 0, F.col("_w") / mean).otherwise(1.0)).drop("_w")
    means = w.groupBy(F.col(by).alias("_s")).agg(F.avg("_w").alias("_m"))  # a row a split
    out = w.join(means, F.col(by).eqNullSafe(F.col("_s")))
    return out.withColumn("weight", F.when(F.col("_m") > 0, F.col("_w") / F.col("_m")).otherwise(1.0)).drop("_w", "_m", "_s")


def stratify_labels(df: DataFrame) -> DataFrame:
    """Adds ``stratum``: variant__label, or the label alone where that pair is rare."""
    key = T.group_key(F.col("variant_type"), F.col("label"))
    counts = df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))  # a row a variant and label
    out = df.withColumn("_key", key).join(counts, F.col("_key") == F.col("_k"))
    return out.withColumn("stratum", F.when(F.col("_n") >= 2, F.col("_key")).otherwise(F.col("label").cast("string"))).drop("_k", "_n", "_key")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes present * count), a row a class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.withColumn("class_weight", F.lit(float(total or 0)) / (F.lit(classes or 1) * F.col("n")))


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation, 1 for a constant."""
    row = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in columns}


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    found = moments(df, columns)
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in found.items()})


def rate_window(df: DataFrame, key: str, ts: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Requests and tokens of the last ``seconds``, the row itself included and an entry of just that age not.

    A row's window lies in its own span of that many seconds and the one before, so each row is dealt to its span and
    to the next: a task sorts two spans of a key at most, however many rows the key has.
    """
    us = F.unix_micros(F.to_timestamp(F.col(ts)))
    span = F.floor(us / (seconds * 1_000_000))
    dealt = df.withColumn("_span", F.explode(F.array(span, span + 1)))
    w = Window.partitionBy(key, "_span").orderBy(us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    out = dealt.withColumn("requests", F.count("*").over(w)).withColumn("token_sum", F.sum(tokens).over(w))
    return out.where(F.col("_span") == span).drop("_span")


def probe_stats(df: DataFrame, values: str) -> DataFrame:
    """Statistics of an array of log-probabilities: mean, min, max, sample deviation (0 for one), perplexity, n, first."""
    v = F.col(values)
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    mean = total / n
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean))
    top = F.slice(F.sort_array(v, asc=False), 1, 5)
    return df.withColumns({
        "mean_lp": mean, "min_lp": F.array_min(v).cast("double"), "max_lp": F.array_max(v).cast("double"), "std_lp": F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0),
        "perplexity": F.exp(-mean), "n_tokens": n, "first_lp": F.get(v, F.lit(0)).cast("double"), "top5_mass": F.aggregate(top, F.lit(0.0), lambda a, x: a + x.cast("double")),
    })


def estimate(seed: int, synthetic: int, bench: int, planned: int, per_minute: float = 30.0) -> dict[str, float]:
    """Projected rows and API minutes of a build."""
    minutes = lambda n: n / per_minute if n > 0 and per_minute > 0 else 0.0
    return {"projected_rows": max(synthetic, 2 * seed + planned), "negatives_min": minutes(planned), "bench_min": minutes(bench)}
