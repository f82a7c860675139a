"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again before the next
stage begins; all but the last return the columns of the documents they were given. Null and empty texts,
repeated rows, ties and empty tables are handled as the operators state.

1. quality: documents to which the classifier gives less than 0.7 go. It learns from labels of the documents
   it is given, never from held-out rows.
2. exact: of equal texts one row stays.
3. near: of documents linked by a word 5-gram similarity of 0.8 or more one row stays.
4. secrets: secrets in the texts become a marker; n_chars, if there, follows the text.
5. packing: pieces of sequences of 4096 tokens with their ids, near documents together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.common import Scratch
from veracity.llm.exact_dedup import exact_dedup
from veracity.llm.ngram_join import ngram_join
from veracity.llm.packing import pack
from veracity.llm.quality_classifier import fit_quality, quality_score
from veracity.llm.secrets import masked

KEEP_FROM = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch=scratch)
    return docs.where(quality_score(model, docs) >= KEEP_FROM)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return exact_dedup(docs, carry=docs.columns, scratch=scratch).kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return ngram_join(docs, carry=docs.columns, scratch=scratch).kept


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    new = "_" + "_".join(docs.columns)  # a name that no column has
    out = docs.withColumn(new, masked())
    if "n_chars" in docs.columns:
        size = F.char_length(new).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(new) != F.col("text"), size).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)


#: Without a scratch folder of the caller's a stage makes its own, which stays until the driver ends.
STAGES: list[tuple[str, Callable[..., DataFrame]]] = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: A trained classifier, MinHash candidates and a tokenizer are beyond SQL; tests/llm compares every stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written in the shared folder and read again, and then what the stage
    needed, and what it was given, goes."""
    docs, between = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        own = Scratch(spark)
        try:
            docs = between.save(stage(spark, docs, sf_dir, scratch=own), name)
        finally:
            own.drop()
        if k:
            between.drop(STAGES[k - 1][0])
    return docs
