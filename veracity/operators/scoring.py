"""Scores of question-answer pairs: audits joined from a cache, misses verified, two classifiers, one verdict."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audit as Q
from ..functions import features as X
from ..functions import text as T
from ..sources.cache import AuditCache
from ..sources.scratch import Scratch
from .dedup import exclude
from .ml import Classifier

#: A verifier adds ``raw`` (JSON text, null on failure), ``status`` and ``t_model_sec`` to pairs; it gets cache misses only.
Verifier = Callable[[DataFrame], DataFrame]


def offline(pairs: DataFrame) -> DataFrame:
    """The stub without a network: neutral audits, status ``disabled``."""
    return pairs.withColumns({"raw": F.lit(None).cast("string"), "status": F.lit("disabled"), "t_model_sec": F.lit(0.0)})


def cache_key(model: str, version: str, mode: str) -> Column:
    return T.key_digest(F.lit(model), F.lit(version), F.col("prompt"), F.col("answer"), F.lit(mode))


def audits(pairs: DataFrame, cache: DataFrame | AuditCache | None, verifier: Verifier = offline, *, model: str = "offline", version: str = "v1", mode: str = "runtime") -> DataFrame:
    """Adds ``audit``, ``cached`` and ``t_model_sec``. Known keys come from the cache (key, value) by one join; each
    missing key is verified once. A cache that can be written gets every answer that is JSON or was meant to be; failed calls are
    asked again next time. The answers are written first, so nobody is asked twice whatever is done with the result."""
    store = cache if isinstance(cache, AuditCache) else None
    cache = store.read() if store else cache
    if verifier is offline and cache is None:  # nothing to look up, nothing to ask
        joined = pairs.withColumns({"_raw": F.lit(None).cast("string"), "_status": F.lit("disabled"), "_t": F.lit(0.0), "cached": F.lit(False), "key": F.lit("")})
    else:
        keyed = pairs.withColumn("key", cache_key(model, version, mode))
        missing = keyed.select("key", "prompt", "answer").dropDuplicates(["key"])
        if cache is not None:
            missing = exclude(missing, cache, ["key"])
        asked = verifier(missing).select("key", F.col("raw").alias("_raw"), F.col("status").alias("_status"), F.col("t_model_sec").alias("_t"))
        if store:
            asked = Scratch(pairs.sparkSession).save(asked, "asked")
            cache = Scratch(pairs.sparkSession).save(cache.select("key", "value"), "known")  # the cache's next version may replace the files read here
            store.put(asked.where(F.col("_raw").isNotNull()).select("key", F.col("_raw").alias("value"), F.lit(time.time()).alias("created_at")))
        every = asked.withColumn("cached", F.lit(False))
        if cache is not None:
            every = every.unionByName(cache.select("key", F.col("value").alias("_raw"), F.lit(None).cast("string").alias("_status"), F.lit(0.0).alias("_t"), F.lit(True).alias("cached")))
        joined = keyed.join(every, "key", "left")
    parsed = Q.normalise(F.col("_raw"))
    failed = F.struct(*(F.lit(Q.ABSENT[k]).alias(k) for k in Q.ABSENT), F.lit(False).alias("ok"), F.coalesce("_status", F.lit("invalid_json")).alias("status"))
    return joined.withColumn("audit", F.when(F.col("_raw").isNull(), failed).otherwise(parsed)).withColumn("t_model_sec", F.coalesce("_t", F.lit(0.0))).drop("_raw", "_status", "_t", "key")


def use_fallback(timeout: float) -> Column:
    return ~F.col("audit.ok") | (F.col("t_model_sec") > timeout)


def score(pairs: DataFrame, *, cache: DataFrame | AuditCache | None = None, verifier: Verifier = offline, main: Classifier | None = None, timeout: float = 0.45) -> DataFrame:
    """Adds features, audit, probability and verdict. Where the audit failed or came late the closed form over the text
    features decides; else the main model, or 0.5 without one."""
    full = X.text_features(audits(pairs, cache, verifier)).withColumn("features", X.full_features())
    if main is not None:
        full = main.predict(full).withColumn("_main", F.col("proba")).drop("proba", "margin")
    else:
        full = full.withColumn("_main", F.lit(0.5))
    proba = X.clip(F.when(use_fallback(timeout), X.heuristic_proba()).otherwise(F.col("_main")))
    return full.withColumn("is_hallucination_proba", proba).withColumn("pred_is_hallucination", X.verdict(F.col("is_hallucination_proba"))).drop("_main")


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """A user's turn with the assistant's next turn."""
    user = conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = conversations.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


def resume(pairs: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be scored, by row key rather than by position."""
    return exclude(pairs, scored, keys)
