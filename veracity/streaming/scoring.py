"""The offline score over a stream of pairs: the same column expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import features as X


def score_stream(pairs: DataFrame) -> DataFrame:
    out = X.text_features(pairs).withColumn("is_hallucination_proba", X.heuristic_proba())
    return out.withColumn("pred_is_hallucination", X.verdict(F.col("is_hallucination_proba")))


def start(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores what has come and stops; run again, it goes on where it stopped."""
    return score_stream(pairs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
