"""The queries op1 to op10: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .exact_dedup import exact_dedup
from .lm_scoring import lm_scores
from .ngram_join import ngram_join
from .packing import pack
from .quality_classifier import fit_quality, quality_score
from .quality_rules import quality_rules
from .secrets import secret_scan
from .segmentation import segment
from .toxicity import fit_toxicity, severity
from .wavelet import read_shards, write_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(_table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).decisions


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return severity(fit_toxicity(docs, _table(spark, sf_dir, "labels")), docs)


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents")).classes


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece_nbest, op3_secret_scan, op4_lm_scoring, op5_exact_dedup, op6_toxicity, op7_hilbert_packing, op8_quality_classifier, op9_ngram_join, op10_wavelet_tokens)}

#: DuckDB's statement of a query's rows, where SQL can express it.
SQL: dict[str, str] = {
    "op4_lm_scoring": r"""
        WITH t AS (
            SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        g AS (
            SELECT doc_id, i, w AS c, lag(w) OVER p AS b, lag(w, 2) OVER p AS a
            FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        n AS (
            SELECT doc_id, i,
                   count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS n1,
                   count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) AS n2,
                   count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS n3,
                   count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
            FROM g),
        m AS (
            SELECT *, lag(n1) OVER p AS m1, lag(n2) OVER p AS m2, least(i - 1, 2) AS longest
            FROM n WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        s AS (
            SELECT doc_id, CASE
                WHEN i >= 3 AND n3 > 0 THEN log10(n3 / m2)
                WHEN i >= 2 AND n2 > 0 THEN log10(n2 / m1) + (longest - 1) * log10(0.4)
                WHEN n1 > 0 THEN log10(n1 / rest) + longest * log10(0.4)
                ELSE log10(1 / greatest(rest, 1)) + (longest + 1) * log10(0.4) END AS v
            FROM m)
        SELECT d.doc_id, count(v) AS n_words, round(coalesce(sum(v), 0), 4) AS log10_score
        FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY k) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(k) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)""",
}

#: DuckDB's statement of the base columns of queries whose verdict it can't express; tests hold the queries against it.
BASE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
        g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n >= 2),
        h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        b AS (
            SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
            FROM w LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
}
