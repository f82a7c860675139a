"""Keyed union, exclusion and upsert. Order is a column: Spark's rows have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least order of each key. Pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns))


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def exclude(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known; null keys equal each other."""
    return df.join(known.select([F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct(), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")


def merge_unique(current: DataFrame, extra: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` whole, duplicates included, then the first row of each new key of ``extra``."""
    return current.unionByName(exclude(first_wins(extra, keys, order), current, keys).select(current.columns))


def upsert(current: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    every = current.unionByName(changes)
    rest = [c for c in every.columns if c != key]
    best = F.max(F.struct(F.col(at).alias("_t"), *rest)).alias("_b")
    return every.groupBy(key).agg(best).select(*(F.col(c) if c == key else F.col(f"_b.{c}").alias(c) for c in every.columns))


def ring_negatives(df: DataFrame, group: str, question: str, answer: str, order: str) -> DataFrame:
    """Within a group, sorted by question, each row gets the next row's answer, the last the first's; rows alone in
    their group or given their own answer drop out.

    The rows are range-sorted and written, so a group of any size lies over as many parts as it needs; the next row is sought
    within a part, and what ends a part takes the first row of the group's next one, of which there is one a part.
    """
    laid = Scratch(df.sparkSession).save(df.repartitionByRange(group, question, order).withColumn("_part", F.spark_partition_id()), "laid")
    run = Window.partitionBy("_part", group).orderBy(question, order)
    heads = laid.groupBy("_part", group).agg(F.min(F.struct(question, order, F.col(answer).alias("a"))).alias("_head"), F.count("*").alias("_n"))
    ring = Window.partitionBy(group).orderBy("_part")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_head.a").over(ring), F.first("_head.a").over(every))
    heads = heads.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), after.alias("_after"), F.sum("_n").over(every).alias("_n"))
    out = laid.withColumn("_next", F.lead(answer).over(run)).withColumn("_end", F.lead(F.lit(True)).over(run).isNull())
    out = out.join(heads, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    out = out.withColumn("negative", F.when(F.col("_end"), F.col("_after")).otherwise(F.col("_next")))
    return out.where((F.col("_n") >= 2) & (F.col("negative") != F.col(answer))).select(*df.columns, "negative")
