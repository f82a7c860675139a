"""Readers and writers with fixed schemas. Files have an order, so readers add ``_ord``."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "prompt string, answer string, answer_type string, source string"
RECORD = "prompt string, answer string, label int, source string, variant_type string"
BENCH = "prompt string, model_answer string, is_hallucination int"
FEVER = "claim string, label string"
POPQA = "question string, possible_answers string, prop string"
CACHE = "key string, value string, created_at double"
BINDING = "spec string, binding map<string, string>"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Only a local session, which has no other
    machines, gets a temporary one where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="veracity-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ordered(df: DataFrame) -> DataFrame:
    """Row numbers that rise in file order; not gapless."""
    return df.withColumn("_ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, a malformed line fails the read."""
    return ordered(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, path, schema) if exists(spark, path) else ordered(spark.createDataFrame([], schema))


def stream_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def read_csv(spark: SparkSession, path: str, schema: str = BENCH) -> DataFrame:
    """Header, quoted fields over several lines."""
    return ordered(spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def read_popqa(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return ordered(raw.select("question", "possible_answers", "prop"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keeps null fields and leaves other scripts unescaped."""
    df.drop("_ord").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.drop("_ord").write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_scored(df: DataFrame, path: str) -> None:
    """A checkpoint adds files and rewrites none."""
    df.write.mode("append").parquet(path)


def write_summary(path: str, summary: dict) -> None:
    """A small JSON object on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(summary, f, ensure_ascii=False, indent=2)
