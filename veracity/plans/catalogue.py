"""Every operator as a query over the driver's tables, with DuckDB's independent statement of its rows.

The tables hold no Cyrillic, so literal rows stand beside them, the same on both sides. Token lists are compared by
count and MD5 of their sorted members.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import audit as Q
from ..functions import features as X
from ..functions import lexicon as L
from ..functions import probe as P
from ..functions import text as T
from ..functions.mutate import mutate
from ..operators import dedup, ingest, metrics, ml, quality, sampling, scoring
from ..sources import io
from ..streaming.limiter import admit
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_q = S.q

PAIRS = (
    (-1, 1, "В каком году был основан Санкт-Петербург?", "Санкт-Петербург был основан в 1703 году."),
    (-1, 3, "В каком году был основан Санкт-Петербург?", "Город был основан Петром I, великим императором России."),
    (-2, 1, "Кто написал роман Преступление и наказание?", "Роман написал Фёдор Достоевский."),
    (-2, 3, "Кто написал роман Преступление и наказание?", "Это очень известная книга, которую читали многие люди в разных странах и городах по всему миру много лет подряд."),
    (-3, 1, "Где находится Эйфелева башня?", "Эйфелева башня находится в Париже, Франция."),
    (-3, 3, "Where is the Eiffel Tower?", "it is somewhere over there"),
    (-4, 1, "Сколько планет в Солнечной системе?", "В Солнечной системе 8 планет, примерно 3,5 миллиарда лет."),
    (-4, 3, "How many moons does Mars have in 2020?", "Mars has two moons."),
    (-5, 1, "Tell me, who wrote it and when, and how much?", "Anna Smith-Jones wrote it in 1999 for 12.50 dollars."),
    (-5, 3, "", ""),
    (-6, 1, "What year did it end?", "The war of nations and of people ended " + "after many long battles over wide lands " * 8),
    (-7, 1, "12 apples?", "H2O and CO2, état-major d2d 3d 4.5.6 1,2,3 _x_ a-b- -c 20 000"),
)
ANSWERS = (
    "Он родился в 1879 году.", "12 января 1900-го", "Событие было 12  МАРТА.", "30 мая", "Длина 10 км", "Масса 3,5 кг и 7", "5", "0", "Их было два или три", "ДЕСЯТЬ негритят", "Столица — Москва.", "Нильс Бор",
    "Фёдор Достоевский", "Символ Au", "Формула H2O", "Это DNA", "просто слова без чисел", "слово", "", "   ", "2100 и 2101", "x1999 1999x 1999", "99 12.0", "a  b\tc d",
)
VARIANTS = tuple(L.VARIANT_WEIGHTS)[:9]


def query(sql: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows, names: str) -> str:
    cell = lambda v: _q(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(list(PAIRS), "conv_id long, turn long, prompt string, answer string")
    return scoring.qa_pairs(table(spark, sf_dir, "conversations")).unionByName(own)


QA = f"""SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant' UNION ALL SELECT conv_id, turn, prompt, answer FROM {values(PAIRS, 'conv_id, turn, prompt, answer')}"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    variant = F.element_at(F.array(*map(F.lit, VARIANTS)), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    return joined.select(F.col("doc_id").alias("_ord"), F.concat_ws(" ", "lang", "source").alias("prompt"), F.col("text").alias("answer"), F.col("toxic").alias("label"), "source", variant.alias("variant_type"))


RECORDS = f"SELECT doc_id AS _ord, lang || ' ' || source AS prompt, text AS answer, toxic AS label, source, {S.stop(VARIANTS)}[1 + doc_id % 9] AS variant_type FROM documents JOIN labels USING (doc_id)"


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select("conv_id", "turn", "prompt", F.col("answer").alias("model_answer"), ((F.abs("conv_id") + F.col("turn")) % 3 == 0).cast("int").alias("is_hallucination"))


BENCH = f"SELECT conv_id, turn, prompt, answer AS model_answer, ((abs(conv_id) + turn) % 3 = 0)::INT AS is_hallucination FROM ({QA})"


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


R6 = ", ".join(f"round({n}, 6) AS {n}" for n in L.TEXT_FEATURES)


def _scored_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_features(qa(spark, sf_dir)).withColumn("proba", X.heuristic_proba())


# --- scoring -------------------------------------------------------------------------------------------------------


@query(f"WITH {S.features(QA, 'conv_id, turn')}, p AS (SELECT *, {S.HEURISTIC} AS proba FROM f) SELECT conv_id, turn, {R6}, round(proba, 6) AS proba, proba >= 0.5 AS is_hallucination FROM p")
def qa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(qa(spark, sf_dir)).withColumn("proba", F.col("is_hallucination_proba"))
    return out.select("conv_id", "turn", *r6(*L.TEXT_FEATURES, "proba"), F.col("pred_is_hallucination").alias("is_hallucination"))


@query(f"WITH {S.features(QA, 'conv_id, turn')} SELECT conv_id, turn, {R6} FROM f")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_features(qa(spark, sf_dir)).select("conv_id", "turn", *r6(*L.TEXT_FEATURES))


@query(f"WITH {S.features(QA, 'conv_id, turn')} SELECT question_type_mismatch, count(*) AS n FROM (SELECT round(question_type_mismatch, 6) AS question_type_mismatch FROM f) GROUP BY 1")
def mismatch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_features(qa(spark, sf_dir)).groupBy(*r6("question_type_mismatch")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {S.features(QA, 'conv_id, turn')}, p AS (SELECT *, {S.HEURISTIC} AS proba FROM f),
    b AS (SELECT *, {S.trim('prompt')} = '' OR {S.trim('answer')} = '' AS blank FROM p)
    SELECT conv_id, turn, CASE WHEN blank THEN 'Input required' WHEN proba >= 0.5 THEN 'Hallucination' ELSE 'Likely factual' END AS verdict, CASE WHEN NOT blank THEN round_even(proba, 6) END AS predict_proba FROM b"""
)
def result_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_qa(spark, sf_dir).withColumn("_r", X.format_result(F.col("prompt"), F.col("answer"), F.col("proba"))).select("conv_id", "turn", "_r.verdict", "_r.predict_proba")


@query(
    f"""WITH c AS (SELECT conv_id, turn, prompt, answer FROM ({QA})),
    f0 AS (SELECT *, conv_id % 2 = 0 AS hit, (abs(conv_id) % 10) / 10.0 AS h FROM c)
    SELECT conv_id, turn, CASE WHEN hit THEN round(h, 6) ELSE 0.0 END::DOUBLE AS h, CASE WHEN hit THEN 'partial_json' ELSE 'disabled' END AS status, hit AS cached, NOT hit AS fallback FROM f0"""
)
def audit_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of half the pairs come from a cache; the others go to the offline verifier and fall back."""
    pairs = qa(spark, sf_dir)
    known = pairs.where(F.col("conv_id") % 2 == 0)
    value = F.concat(F.lit('{"h": 0.'), (F.abs("conv_id") % 10).cast("string"), F.lit(', "r": 1}'))
    cache = known.groupBy(scoring.cache_key("offline", "v1", "runtime").alias("key")).agg(F.max(value).alias("value"))
    # equal pairs of different conversations share a key, so the audit is compared by pair
    keyed = pairs.withColumn("_pair", F.struct("prompt", "answer"))
    out = scoring.audits(keyed, cache)
    return out.select("conv_id", "turn", F.col("audit.h").alias("h"), F.col("audit.status").alias("status"), "cached", scoring.use_fallback(0.45).alias("fallback"))


# --- tokens --------------------------------------------------------------------------------------------------------


def _digest(c: Column, name: str) -> list[Column]:
    return [F.size(c).cast("long").alias(f"n_{name}"), F.md5(F.concat_ws(" ", F.array_sort(c))).alias(f"{name}_md5")]


def _digest_sql(e: str, name: str) -> str:
    return f"len({e}) AS n_{name}, md5(array_to_string(list_sort({e}), ' ')) AS {name}_md5"


TEXTS = f"SELECT doc_id, text FROM documents UNION ALL SELECT -1000 * turn + conv_id, answer FROM {values(PAIRS, 'conv_id, turn, prompt, answer')}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1000 * t + c, a) for c, t, _, a in PAIRS], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)


for _name, _spark, _sql in (("words", T.words, S.words), ("numbers", T.number_tokens, S.numbers), ("entities", T.entity_tokens, S.entities), ("symbols", T.symbol_tokens, S.symbols), ("content", T.content_tokens, S.content), ("salient", T.salient_tokens, S.salient)):

    def _tokens(spark: SparkSession, sf_dir: str, name=_name, tokens=_spark) -> DataFrame:
        return texts(spark, sf_dir).withColumn("_t", tokens(F.col("text"))).select("doc_id", *_digest(F.col("_t"), name))

    QUERIES[f"tokens_{_name}"] = _tokens
    SQL[f"tokens_{_name}"] = f"SELECT doc_id, {_digest_sql('t', _name)} FROM (SELECT doc_id, {_sql('text')} AS t FROM ({TEXTS}))"


@query(f"SELECT doc_id, len({S.split('text')}) AS n_parts, {S.count_of('text', ',')} AS n_commas, {S.count_of('text', '.')} AS n_periods, length({S.trim('text')}) AS n_trimmed, md5({S.normalised('text')}) AS normalised_md5 FROM ({TEXTS})")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    long = lambda x, n: x.cast("long").alias(n)
    return texts(spark, sf_dir).select("doc_id", long(T.split_count(c), "n_parts"), long(T.count_of(c, ","), "n_commas"), long(T.count_of(c, "."), "n_periods"), long(F.length(T.trim(c)), "n_trimmed"), F.md5(T.normalised(c)).alias("normalised_md5"))


@query(f"SELECT DISTINCT word, {S.stem('word', L.SUFFIXES_FEATURES)} AS stem_features, {S.stem('word', L.SUFFIXES_BUILDING)} AS stem_building FROM (SELECT unnest({S.words('text')}) AS word FROM ({TEXTS}))")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = texts(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return word.select("word", T.stem(F.col("word"), L.SUFFIXES_FEATURES).alias("stem_features"), T.stem(F.col("word"), L.SUFFIXES_BUILDING).alias("stem_building"))


@query(f"SELECT conv_id, turn, {S.profile('prompt', 'verifier')} AS verifier, {S.profile('prompt', 'evaluation')} AS evaluation, {S.profile('prompt', 'building')} AS building FROM ({QA})")
def question_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prompt")
    return qa(spark, sf_dir).select("conv_id", "turn", T.profile_verifier(p).alias("verifier"), T.profile_evaluation(p).alias("evaluation"), T.profile_building(p).alias("building"))


@query(f"SELECT {S.profile('prompt', 'evaluation')} AS profile, count(*) AS n FROM ({QA}) GROUP BY 1")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).groupBy(T.profile_evaluation(F.col("prompt")).alias("profile")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {S.digest('lang', 'NULL', 'doc_id', 'text')} AS digest FROM documents")
def key_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.key_digest(F.col("lang"), F.lit(None), F.col("doc_id"), F.col("text")).alias("digest"))


_TOTAL = "(length(prompt) + length(answer))"
_PARTS = f"len({S.split('answer')})"


@query(
    f"""SELECT conv_id, turn, greatest(32, {_TOTAL} // 4 + 32) AS verify_tokens, greatest(48, {_TOTAL} // 4 + 48) AS mutate_tokens, greatest(64, {_TOTAL} // 4 + 80) AS augment_tokens,
    least(96, greatest(20, 3 * {_PARTS} + 4)) AS mutate_budget, least(96, greatest(40, 5 * {_PARTS} + 18)) AS augment_budget,
    md5('type:' || ({S.profile('prompt', 'verifier')}) || chr(10) || 'Q:' || prompt || chr(10) || 'A:' || answer || chr(10) || 'Judge factual fit to the question and return JSON only.') AS message_md5 FROM ({QA})"""
)
def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = F.col("prompt"), F.col("answer")
    numbers = {"verify_tokens": T.token_estimate(p, a, 32, 32), "mutate_tokens": T.token_estimate(p, a, 48, 48), "augment_tokens": T.token_estimate(p, a, 64, 80), "mutate_budget": T.mutate_budget(a), "augment_budget": T.augment_budget(a)}
    return qa(spark, sf_dir).select("conv_id", "turn", *(c.cast("long").alias(n) for n, c in numbers.items()), F.md5(T.audit_message(p, a)).alias("message_md5"))


# --- audits --------------------------------------------------------------------------------------------------------

#: Audit texts of every kind, from an event's number and value: whole, partial, wrapped, coerced, broken.
_AUDIT_SPARK = """CASE event_id % 8
    WHEN 0 THEN concat('{"h": ', k / 100, ', "n": 0.1, "e": -1, "r": 2, "u": 0.5, "c": ', k / 20, ', "x": ', k / 100, ', "q": 0.3, "s": 0.4, "m": 0.6}')
    WHEN 1 THEN concat('{"h": ', k / 100, ', "x": 1, "m": 0.6}')
    WHEN 2 THEN concat('Sure: {"h": "', k / 100, '", "r": null, "q": null, "s": "bad"} ok')
    WHEN 3 THEN 'not-json'
    WHEN 4 THEN '{"h": true, "r": "x", "c": 2.5}'
    WHEN 5 THEN '[1, 2]'
    WHEN 6 THEN '} {'
    ELSE concat('{"a": ', k, '}') END"""


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    return k.select("event_id", F.expr(_AUDIT_SPARK).alias("raw")).withColumn("a", Q.normalise(F.col("raw"))).select("event_id", "a.*")


def _audit_sql() -> str:
    raw = _AUDIT_SPARK
    present = lambda k: f"list_contains(json_keys(j), '{k}')"
    parts = []
    for k in L.AUDIT_KEYS:
        v = f"CASE WHEN NOT {present(k)} THEN {Q.ABSENT[k]} WHEN json_type(j, '$.{k}') = 'BOOLEAN' THEN (j->>'$.{k}')::BOOLEAN::INT ELSE coalesce(try_cast(j->>'$.{k}' AS DOUBLE), {0.5 if k == 'r' else 0.0}) END::DOUBLE"
        v = f"least(3.0, greatest(0.0, round_even({v}, 0)))" if k == "c" else f"CASE WHEN {v} >= 0.5 THEN 1.0 ELSE 0.0 END" if k == "x" else S.clip(v)
        parts.append(f"(CASE WHEN j IS NULL THEN {Q.ABSENT[k]} ELSE {v} END)::DOUBLE AS {k}")
    full = " AND ".join(map(present, L.AUDIT_KEYS))
    return f"""WITH e AS (SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events), r AS (SELECT event_id, {raw} AS raw FROM e),
        i AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE regexp_extract(raw, '(?s)[{{].*[}}]') END AS inner_ FROM r),
        p AS (SELECT event_id, CASE WHEN json_valid(inner_) AND json_type(inner_) = 'OBJECT' THEN inner_::JSON END AS j FROM (SELECT event_id, CASE WHEN json_valid(inner_) THEN inner_ END AS inner_ FROM i))
        SELECT event_id, {', '.join(parts)}, j IS NOT NULL AS ok, CASE WHEN j IS NULL THEN 'invalid_json' WHEN {full} THEN 'ok' ELSE 'partial_json' END AS status FROM p"""


@query(_audit_sql())
def audit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({_audit_sql()}) GROUP BY 1")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


# --- building data -------------------------------------------------------------------------------------------------

_MUTABLE = f"SELECT -1 - i AS doc_id, answer AS text FROM {values(list(enumerate(ANSWERS)), 'i, answer')} UNION ALL SELECT doc_id, text FROM documents"


@query(f"SELECT doc_id, md5({S.mutation('t')}) AS mutated_md5 FROM (SELECT doc_id, {S.trim('text')} AS t FROM ({_MUTABLE}))")
def rule_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, a) for i, a in enumerate(ANSWERS)], "doc_id long, text string")
    every = own.unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return every.select("doc_id", F.md5(mutate(F.col("text"))).alias("mutated_md5"))


@query(
    f"""SELECT conv_id, turn, length(prompt) BETWEEN 12 AND 220 AND length(answer) BETWEEN 8 AND 260 AND NOT regexp_matches(prompt || ' ' || answer, 'https?://')
    AND NOT regexp_matches(prompt, {_q(f'(?:^|[^{L.WC}])[QP]' + chr(92) + 'p{Nd}+' + f'(?:[^{L.WC}]|$)')}) AS usable FROM ({QA})"""
)
def seed_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select("conv_id", "turn", A.seed_usable(F.col("prompt"), F.col("answer")).alias("usable"))


_POSSIBLE = "CASE p_partkey % 4 WHEN 0 THEN '[\"' || p_brand || '\", \"x\"]' WHEN 1 THEN '[\" \", \"' || p_name || ' 1984\"]' WHEN 2 THEN '[\"' || p_size || '\"]' ELSE 'no json' END"


@query(
    f"""WITH l AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 4 = 3 THEN [] ELSE list_filter(list_transform(({_POSSIBLE})::JSON::VARCHAR[], lambda x: {S.trim('x')}), lambda x: x <> '') END AS a FROM part),
    c AS (SELECT *, coalesce(list_filter(a, lambda x: len({S.split('x')}) BETWEEN 1 AND 8 AND length(x) <= 80)[1], a[1], '') AS chosen FROM l)
    SELECT p_partkey, len(a) AS n, chosen, CASE WHEN regexp_matches(chosen, '^\\d{{4}}$') THEN 'year' WHEN regexp_matches(chosen, '\\d') THEN 'number' WHEN p_type IN ('place of birth', 'country', 'capital') THEN 'place' ELSE 'entity' END AS answer_type FROM c"""
)
def primary_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.possible_answers(F.expr(_POSSIBLE))
    out = table(spark, sf_dir, "part").select("p_partkey", "p_type", found.alias("a")).withColumn("chosen", A.primary_answer(F.col("a")))
    return out.select("p_partkey", F.size("a").cast("long").alias("n"), "chosen", A.answer_type(F.col("chosen"), F.col("p_type")).alias("answer_type"))


_RING = """SELECT * FROM (SELECT p_partkey, p_type, p_brand, coalesce(lead(p_brand) OVER w, first_value(p_brand) OVER w) AS negative, count(*) OVER (PARTITION BY p_type) AS n
    FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_name, p_partkey)) WHERE n >= 2 AND negative <> p_brand"""


@query(f"SELECT p_partkey, p_type, negative FROM ({_RING})")
def ring_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ring_negatives(table(spark, sf_dir, "part"), "p_type", "p_name", "p_brand", "p_partkey").select("p_partkey", "p_type", "negative")


_POPQA = """g AS (SELECT p_name AS prompt, p_brand AS answer, p_type AS prop, p_partkey AS o FROM part),
    r AS (SELECT prompt, answer, prop, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS negative, count(*) OVER (PARTITION BY prop) AS n, o FROM g WINDOW w AS (PARTITION BY prop ORDER BY prompt, o)),
    k AS (SELECT * FROM r WHERE n >= 2 AND negative <> answer)"""


def _popqa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.to_json(F.array("p_brand")).alias("possible_answers"), F.col("p_type").alias("prop"), F.col("p_partkey").alias("_ord"))


QUERY_POPQA = f"WITH {_POPQA} SELECT prompt, answer, 0 AS label, 'popqa:' || prop AS source, 'popqa_positive' AS variant_type FROM k UNION SELECT prompt, negative, 1, 'popqa:' || prop, 'popqa_negative' FROM k"


@query(QUERY_POPQA)
def popqa_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.popqa(_popqa_rows(spark, sf_dir)).drop("_ord")


@query(f"WITH {_POPQA} SELECT DISTINCT prompt, answer, CASE WHEN regexp_matches(answer, '^\\d{{4}}$') THEN 'year' WHEN regexp_matches(answer, '\\d') THEN 'number' WHEN prop IN ('place of birth', 'country', 'capital') THEN 'place' ELSE 'entity' END AS answer_type, 'popqa:' || prop AS source FROM k")
def popqa_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.popqa_seeds(_popqa_rows(spark, sf_dir)).drop("_ord")


_CLAIM = "CASE item_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END"


@query(f"SELECT DISTINCT {_q(ingest.CLAIM_PROMPT)} AS prompt, {S.trim('text')} AS answer, (label <> 'SUPPORTS')::INT AS label, 'fever' AS source, 'fever_' || replace(lower(label), ' ', '_') AS variant_type FROM (SELECT text, {_CLAIM} AS label FROM benchmark)")
def fever_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "benchmark").select(F.col("text").alias("claim"), F.expr(_CLAIM).alias("label"), F.col("item_id").alias("_ord"))
    return ingest.fever(claims, include_nei=True).drop("_ord")


@query(
    f"""WITH s AS (SELECT prompt, answer, row_number() OVER (ORDER BY conv_id, turn) AS o FROM ({QA})),
    b AS (SELECT prompt, answer, 0 AS label, 'seed' AS source, 'positive' AS variant_type FROM s UNION ALL SELECT prompt, {S.mutation('t')}, 1, 'seed', 'rule_negative' FROM (SELECT prompt, {S.trim('answer')} AS t FROM s))
    SELECT DISTINCT * FROM b"""
)
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = qa(spark, sf_dir).select("prompt", "answer", ((F.col("conv_id") + 1000) * 1000 + F.col("turn")).alias("_ord"))
    return ingest.build(seeds).drop("_ord").select(ingest.RECORD)


@query(
    """SELECT prompt, answer, 'place' AS answer_type, 'wikidata:country_capital' AS source FROM (
    SELECT 'Как называется столица ' || n_name || '?' AS prompt, 'Столица ' || n_name || ' — ' || r_name || '.' AS answer, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation JOIN region ON r_regionkey = n_regionkey) WHERE rn <= 20"""
)
def harvest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap per spec is the operator's own."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    binding = F.create_map(F.lit("countryLabel"), F.concat(F.lit(" "), "n_name"), F.lit("capitalLabel"), F.col("r_name"))
    return ingest.harvest(rows.select(F.lit("country_capital").alias("spec"), binding.alias("binding"), F.col("n_nationkey").cast("long").alias("_ord")), 20).drop("_ord")


# --- joins and keys ------------------------------------------------------------------------------------------------

_REFS = f"(SELECT prompt, arg_max(answer, _ord) AS reference FROM ({RECORDS}) WHERE label = 0 GROUP BY prompt)"


@query(f"SELECT r._ord, md5(coalesce(f.reference, '')) AS reference_md5 FROM ({RECORDS}) r LEFT JOIN {_REFS} f USING (prompt)")
def reference_answer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    return own.join(quality.reference_answers(own), "prompt", "left").select("_ord", F.md5(F.coalesce("reference", F.lit(""))).alias("reference_md5"))


def _supported_sql() -> str:
    a, b = "a", "b"
    return f"""WITH p AS (SELECT r._ord, f.reference AS a, r.answer AS b FROM ({RECORDS}) r JOIN {_REFS} f USING (prompt) UNION ALL SELECT _ord, a, b FROM {values(SUPPORTED, '_ord, a, b')}),
        s AS (SELECT *, {S.salient(a)} AS sa, {S.salient(b)} AS sb, {S.numbers(a)} AS na, {S.numbers(b)} AS nb, {S.symbols(a)} AS ya, {S.symbols(b)} AS yb, len({S.split(a)}) AS wa, len({S.split(b)}) AS wb FROM p)
        SELECT _ord, {S.trim(b)} <> '' AND {S.trim(a)} <> {S.trim(b)} AND wb > wa + 2 AND wb <= greatest(22, floor(wa * 2.6) + 8) AND (len(sa) = 0 OR {S.share_in('sa', 'sb')} >= 0.6)
            AND {S.missing('nb', 'na')} = 0 AND {S.missing('yb', 'ya')} = 0 AND NOT ({S.count_of(b, ',')} = 0 AND {S.count_of(b, '.')} = 0) AND regexp_matches({S.trim(b)}, '[.!?]$') AS ok,
            wb > wa + 2 AND ({S.count_of(b, ',')} > 0 OR {S.count_of(b, '.')} > {S.count_of(a, '.')}) AS drifts FROM s"""


SUPPORTED = (
    (-1, "Столица Франции — Париж.", "Столица Франции — Париж, крупный город на реке Сена."),
    (-2, "Столица Франции — Париж.", "Столица Франции — Париж."),
    (-3, "Основан в 1703 году.", "Город, как известно, был основан в 1704 году царём."),
    (-4, "Символ Au", "Химический символ золота — Au, оно тяжёлое."),
    (-5, "Hi", ""),
)


@query(_supported_sql())
def supported_positive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    pairs = own.join(quality.reference_answers(own), "prompt").select("_ord", F.col("reference").alias("a"), F.col("answer").alias("b"))
    pairs = pairs.unionByName(spark.createDataFrame(list(SUPPORTED), "_ord long, a string, b string"))
    return pairs.select("_ord", quality.supported_positive(F.col("a"), F.col("b")).alias("ok"), quality.drift_gate(F.col("a"), F.col("b")).alias("drifts"))


@query("SELECT s_nationkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) WHERE rn = 1")
def merge_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("_ord"))
    extra = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("_ord"))
    return dedup.merge_unique(current, extra, ["k"], "_ord").select("k", "name")


@query("SELECT o_custkey AS k, o_orderkey AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first_order")), ["k"], "first_order")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.resume(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT key, value, created_at FROM (SELECT user_id AS key, props AS value, epoch(ts) AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) AS rn FROM events) WHERE rn = 1")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("created_at"))
    even = F.crc32("value") % 2 == 0
    return dedup.upsert(log.where(even), log.where(~even), "key", "created_at")


# --- samples -------------------------------------------------------------------------------------------------------


def _share_sql(source: str, group: str, key: str, size: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY k) AS rn, greatest(1, round_even({size} * count(*) OVER (PARTITION BY {group}) / count(*) OVER ()::DOUBLE, 0)) AS quota FROM (SELECT *, {key} AS k FROM ({source}))) WHERE rn <= quota"""


@query(f"SELECT _ord, label, variant_type FROM ({_share_sql(RECORDS, 'variant_type, label', S.digest('variant_type', 'label', 'prompt', 'answer'), 100)}) ORDER BY k LIMIT 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(records(spark, sf_dir), 100).select("_ord", "label", "variant_type")


def _slice_sql(source: str, size: str, salt: str) -> str:
    return f"SELECT conv_id, turn, prompt, model_answer, is_hallucination FROM ({_share_sql(source, 'is_hallucination', S.digest(_q(salt), 'prompt', 'model_answer', 'is_hallucination'), size)}) ORDER BY is_hallucination, k LIMIT {size}"


# pairs that occur more than once have equal keys, so slices are compared by their contents
@query(f"SELECT prompt, model_answer, is_hallucination FROM ({_slice_sql(f'SELECT min(conv_id) AS conv_id, min(turn) AS turn, prompt, model_answer, is_hallucination FROM ({BENCH}) GROUP BY ALL', 40, 'balanced')})")
def dev_slice_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dev_slice(bench(spark, sf_dir).select("prompt", "model_answer", "is_hallucination").distinct(), 40)


@query(f"SELECT prompt, model_answer, is_hallucination FROM ({_slice_sql(f'SELECT min(conv_id) AS conv_id, min(turn) AS turn, prompt, model_answer, is_hallucination FROM ({BENCH}) WHERE ({S.profile("prompt", "evaluation")}) <> {_q("generic")} GROUP BY ALL', 6, 'typed')})")
def dev_slice_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.typed_dev_slice(bench(spark, sf_dir).select("prompt", "model_answer", "is_hallucination").distinct(), 6)


@query(
    f"""WITH c AS (SELECT *, {S.profile('prompt', 'building')} AS p, {S.digest('prompt', 'answer', 'source', 'variant_type')} AS k FROM ({RECORDS}) WHERE label = 0 AND NOT starts_with(variant_type, 'fever_')),
    r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) AS rn, list_position({S.stop(L.PROFILES)}, p) AS i FROM c) SELECT _ord FROM r ORDER BY rn, i LIMIT 60"""
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(quality.augmentation_sources(records(spark, sf_dir)), 60).select("_ord")


# --- weights and metrics -------------------------------------------------------------------------------------------


@query(f"SELECT variant_type, count(*) AS n FROM ({RECORDS}) GROUP BY 1")
def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variant_counts(records(spark, sf_dir))


@query(f"SELECT _ord, CASE WHEN count(*) OVER (PARTITION BY variant_type, label) >= 2 THEN variant_type || '__' || label ELSE label::VARCHAR END AS stratum FROM ({RECORDS})")
def stratify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stratify_labels(records(spark, sf_dir)).select("_ord", "stratum")


_WEIGHT = "CASE variant_type " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in L.VARIANT_WEIGHTS.items()) + " ELSE 1.0 END::DOUBLE"


@query(f"SELECT _ord, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT _ord, {_WEIGHT} AS w FROM ({RECORDS}))")
def variant_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.normalised_weights(records(spark, sf_dir)).select("_ord", *r6("weight"))


@query(f"SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS class_weight FROM (SELECT label, count(*) AS n FROM ({RECORDS}) GROUP BY 1)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(records(spark, sf_dir), "label").select("label", "n", *r6("class_weight"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", *r6("mean", "p50", "p95", "p99"))


@query(
    f"""WITH {S.features(RECORDS, '_ord, label')}, p AS (SELECT label, round({S.HEURISTIC}, 6) AS score FROM f), g AS (SELECT score, count(*) AS n, count(*) FILTER (label = 1) AS tp FROM p GROUP BY 1),
    c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(tp * ctp / cn::DOUBLE) / sum(tp), 6) AS average_precision FROM c"""
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = X.text_features(records(spark, sf_dir)).select("label", F.round(X.heuristic_proba(), 6).alias("score"))
    return metrics.average_precision(scored, "score", "label").select(*r6("average_precision"))


@query(f"WITH {S.features(QA, 'conv_id, turn')} SELECT conv_id, turn, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in L.TEXT_FEATURES) + " FROM f")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.standardise(X.text_features(qa(spark, sf_dir)), list(L.TEXT_FEATURES)).select("conv_id", "turn", *r6(*L.TEXT_FEATURES))


@query("SELECT event_id, count(*) OVER w AS requests, (sum(length(props)) OVER w)::BIGINT AS token_sum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("_tokens", F.length("props").cast("long"))
    return metrics.rate_window(log, "user_id", "ts", "_tokens").select("event_id", "requests", "token_sum")


@query(f"SELECT greatest((SELECT count(*) FROM ({RECORDS})), 2 * (SELECT count(*) FROM ({QA})) + 300) AS projected_rows, 10.0::DOUBLE AS negatives_min, round((SELECT count(*) FROM ({BENCH})) / 30.0, 6)::DOUBLE AS bench_min")
def pipeline_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = qa(spark, sf_dir).count()
    e = metrics.estimate(n, records(spark, sf_dir).count(), n, 300)
    return spark.createDataFrame([(int(e["projected_rows"]), e["negatives_min"], round(e["bench_min"], 6))], "projected_rows long, negatives_min double, bench_min double")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT vec_id, round(list_avg(v), 6) AS mean_lp, round(list_min(v), 6) AS min_lp, round(list_max(v), 6) AS max_lp, round(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) ELSE 0.0 END, 6) AS std_lp,
    round(exp(-list_avg(v)), 6) AS perplexity, len(v) AS n_tokens, round(v[1], 6) AS first_lp, round(list_sum(list_reverse_sort(v)[1:5]), 6) AS top5_mass FROM v"""
)
def probe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.probe_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("vec_id", *r6("mean_lp", "min_lp", "max_lp", "std_lp", "perplexity"), F.col("n_tokens").cast("long").alias("n_tokens"), *r6("first_lp", "top5_mass"))


_LOGITS = "list_transform(range(0, (len(embedding) + 15) // 16), lambda i: list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: x::DOUBLE))"
_STATS = (
    ("mean_lp", "list_avg(lp)"), ("min_lp", "list_min(lp)"), ("max_lp", "list_max(lp)"), ("std_lp", "CASE WHEN len(lp) > 1 THEN list_stddev_samp(lp) ELSE 0.0 END"), ("mean_entropy", "list_avg(e)"), ("max_entropy", "list_max(e)"),
    ("std_entropy", "CASE WHEN len(e) > 1 THEN list_stddev_samp(e) ELSE 0.0 END"), ("perplexity", "exp(-list_avg(lp))"), ("first_lp", "lp[1]"), ("mean_top1", "list_avg(list_transform(p, lambda r: list_max(r)))"),
    ("mean_top5", "list_avg(list_transform(p, lambda r: list_sum(list_reverse_sort(r)[1:5])))"), ("prompt_norm", "sqrt(list_sum(list_transform(z[1], lambda x: x * x)))"), ("answer_norm", "list_avg(list_transform(z, lambda r: sqrt(list_sum(list_transform(r, lambda x: x * x)))))"),
)


@query(
    f"""WITH z AS (SELECT vec_id, {_LOGITS} AS z FROM embeddings),
    s AS (SELECT *, list_transform(z, lambda r: list_sum(list_transform(r, lambda x: exp(x - list_max(r))))) AS d FROM z),
    p AS (SELECT *, list_transform(z, lambda r, i: list_transform(r, lambda x: exp(x - list_max(r)) / d[i])) AS p, list_transform(z, lambda r, i: r[1 + (vec_id + i - 1) % len(r)] - list_max(r) - ln(d[i])) AS lp FROM s),
    e AS (SELECT *, list_transform(p, lambda r: -list_sum(list_transform(r, lambda x: x * ln(x + 1e-10)))) AS e FROM p)
    SELECT vec_id, len(lp) AS n_tokens, {', '.join(f'round({v}, 6) AS {k}' for k, v in _STATS)} FROM e"""
)
def probe_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as rows of 16 logits; the chosen tokens go round with the row."""
    rows = _probe_rows(spark, sf_dir)
    out = P.uncertainty(rows, "z", "ids").withColumns(P.layer_summary(F.get("z", F.lit(0)), F.col("z")))
    return out.select("vec_id", F.col("n_tokens").cast("long").alias("n_tokens"), *r6(*(n for n, _ in _STATS)))


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 16 logits, the last one shorter if need be, and a chosen token of each."""
    t = table(spark, sf_dir, "embeddings")
    rows = t.select("vec_id", F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 16).cast("int") - 1), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double"))).alias("z"))
    return rows.withColumn("ids", F.transform("z", lambda r, i: F.pmod(F.col("vec_id") + i, F.size(r)).cast("int")))


# --- sources and sinks ---------------------------------------------------------------------------------------------


def _place(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return f"{io.shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"


@query(f"SELECT prompt, answer, 0 AS label, NULL::VARCHAR AS source, 'positive' AS variant_type FROM ({QA})")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    io.write_jsonl(qa(spark, sf_dir).select("prompt", "answer", F.lit(0).alias("label"), F.lit(None).cast("string").alias("source"), F.lit("positive").alias("variant_type")), at)
    return io.read_jsonl(spark, at, io.RECORD).drop("_ord")


@query(f"SELECT prompt || chr(10) || '\"q\"' AS prompt, model_answer || ',x' AS model_answer, is_hallucination FROM ({BENCH})")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    io.write_csv(bench(spark, sf_dir).select(F.concat("prompt", F.lit('\n"q"')).alias("prompt"), F.concat("model_answer", F.lit(",x")).alias("model_answer"), "is_hallucination"), at)
    return io.read_csv(spark, at).drop("_ord")


@query(QUERY_POPQA)
def popqa_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions by way of a tab-separated file."""
    at = _place(spark)
    rows = _popqa_rows(spark, sf_dir).orderBy("_ord").drop("_ord").withColumn("other", F.lit("x"))
    rows.coalesce(1).write.option("header", True).option("sep", "\t").option("escape", '"').csv(at)  # such a file is one, in order
    return ingest.popqa(io.read_popqa(spark, at)).drop("_ord")


@query(f"""WITH c AS (SELECT doc_id, lang, {S.digest("'holdout'", 'doc_id')} AS k FROM documents) SELECT doc_id, row_number() OVER (ORDER BY k) > round_even(0.7 * count(*) OVER (), 0) AS is_test FROM c""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query(
    f"""WITH c AS (SELECT doc_id, quality, {S.digest("'split'", 'doc_id')} AS k FROM labels),
    n AS (SELECT quality, count(*) AS m, sum(count(*)) OVER () AS total FROM c GROUP BY 1),
    x AS (SELECT *, ceil(0.2::DOUBLE * total) * m / total AS exact, ceil(0.2::DOUBLE * total) AS want FROM n),
    a AS (SELECT quality, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, quality::VARCHAR) <= want - sum(floor(exact)) OVER ())::INT AS allowed FROM x)
    SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY k) <= allowed AS is_validation FROM c JOIN a USING (quality)"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", F.col("doc_id"))


@query(f"SELECT prompt, model_answer, is_hallucination FROM ({_slice_sql(f'SELECT min(conv_id) AS conv_id, min(turn) AS turn, prompt, model_answer, is_hallucination FROM ({BENCH}) GROUP BY ALL', 30, 'random')})")
def label_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_label_limit(bench(spark, sf_dir).select("prompt", "model_answer", "is_hallucination").distinct(), 30)


_RISKS = (("h", "0.0"), ("n", "0.0"), ("e", "0.0"), ("inv_r", "0.5"), ("u", "0.0"), ("c", "0.0"), ("x", "0.0"), ("inv_q", "0.5"), ("inv_s", "0.5"), ("m", "0.0"))


@query(f"WITH {S.features(QA, 'conv_id, turn')} SELECT conv_id, turn, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in _RISKS)}, {', '.join(f'round({n}::FLOAT::DOUBLE, 5) AS {n}' for n in L.TEXT_FEATURES)} FROM f")
def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(qa(spark, sf_dir))
    return out.select("conv_id", "turn", *(F.round(F.get("features", F.lit(i)).cast("double"), 5).alias(n) for i, n in enumerate((*L.AUDIT_FEATURES, *L.TEXT_FEATURES))))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'http_' || (400 + event_id % 200) WHEN event_id % 7 < 5 THEN ['timeout', 'connection_error', 'missing_api_key', 'local_rate_limited', 'disabled'][1 + event_id % 7] ELSE 'invalid_json' END AS status FROM events")
def error_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("timeout", "connection_error", "missing_api_key", "local_rate_limited", "disabled", "something else", "")))
    code = F.when(F.col("event_id") % 4 == 0, 400 + F.col("event_id") % 200)
    return table(spark, sf_dir, "events").select("event_id", Q.error_status(code, F.get(kinds, (F.col("event_id") % 7).cast("int"))).alias("status"))


@query(f"SELECT doc_id, {_digest_sql('t', 'years')} FROM (SELECT doc_id, {S.runs('text', L.YEAR)} AS t FROM ({TEXTS}))")
def tokens_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("_t", T.years(F.col("text"))).select("doc_id", *_digest(F.col("_t"), "years"))


#: What a nation stands for in each kind of binding: names as SQL expressions of (name, region, key).
_BOUND = {"countryLabel": "n_name", "capitalLabel": "r_name", "currencyLabel": "r_name", "languageLabel": "r_name", "personLabel": "n_name", "workLabel": "n_name", "authorLabel": "r_name", "elementLabel": "n_name", "symbol": "substr(n_name, 1, 2)"}


def _harvest_sql() -> str:
    parts = []
    for i, (name, kind, prompt, answer) in enumerate(ingest.SPECS):
        def filled(t: str) -> str:
            t = _q(t)
            for k, e in {**_BOUND, "dob_year": "(1900 + n_nationkey)::VARCHAR", "dod_year": "(1950 + n_nationkey)::VARCHAR"}.items():
                t = t.replace("{" + k + "}", f"' || {e} || '")
            return t
        parts.append(f"SELECT {i} AS spec, n_nationkey AS o, {filled(prompt)} AS prompt, {filled(answer)} AS answer, '{kind}' AS answer_type, 'wikidata:{name}' AS source FROM nation JOIN region ON r_regionkey = n_regionkey")
    return f"""WITH a AS ({' UNION ALL '.join(parts)}),
        u AS (SELECT * FROM a WHERE length(prompt) BETWEEN 12 AND 220 AND length(answer) BETWEEN 8 AND 260 AND prompt NOT IN (SELECT 'Как называется столица ' || n_name || '?' FROM nation WHERE n_regionkey = 0)),
        f AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY spec, o) AS first FROM u),
        c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) AS rn FROM f WHERE first = 1)
        SELECT prompt, answer, answer_type, source FROM c WHERE rn <= 12"""


@query(_harvest_sql())
def harvest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight kinds of bindings, with dates cut to years, prompts that are known already, and a cap."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    date = lambda year: F.concat((F.lit(year) + F.col("n_nationkey")).cast("string"), F.lit("-03-14T00:00:00Z"))
    binding = F.create_map(*(x for k, e in _BOUND.items() for x in (F.lit(k), F.expr(e))), F.lit("dob"), date(1900), F.lit("dod"), date(1950))
    spec = F.explode(F.array(*(F.lit(x[0]) for x in ingest.SPECS))).alias("spec")
    known = rows.where("n_regionkey = 0").select(F.concat(F.lit("Как называется столица "), "n_name", F.lit("?")).alias("prompt"))
    return ingest.harvest(rows.select(spec, binding.alias("binding"), F.col("n_nationkey").cast("long").alias("_ord")), 12, known).drop("_ord")


_LAYERS = 4


@query(
    f"""WITH z AS (SELECT vec_id, {_LOGITS} AS z FROM embeddings),
    l AS (SELECT vec_id, list_transform(range(1, {_LAYERS} + 1), lambda i: z[1 + (i - 1) % len(z)]) AS z FROM z),
    n AS (SELECT vec_id, z, list_transform(z, lambda r: sqrt(list_sum(list_transform(r, lambda x: x * x)))) AS n,
        list_transform(z, lambda r: list_sum(list_transform(r, lambda x: exp(x - list_max(r))))) AS d FROM l),
    e AS (SELECT vec_id, n, list_transform(z, lambda r, i: -list_sum(list_transform(r, lambda x: exp(x - list_max(r)) / d[i] * ln(exp(x - list_max(r)) / d[i] + 1e-10)))) AS e FROM n)
    SELECT vec_id, {', '.join(f'round(n[{i}], 6) AS p{i}, round((n[{i}] + n[{i % _LAYERS + 1}]) / 2, 6) AS a{i}, round(e[{i}], 6) AS e{i}' for i in range(1, _LAYERS + 1))}, round(e[1] - e[{_LAYERS}], 6) AS drop, round(e[{_LAYERS}] / (e[1] + 1e-10), 6) AS ratio FROM e"""
)
def probe_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 16 numbers stand for the layers: a layer's answer is its own row and the next layer's, its logits its row."""
    out = P.internal(_probe_layers(spark, sf_dir), "layers")
    names = [f"{n}{i}" for i in range(1, _LAYERS + 1) for n in "pae"] + ["drop", "ratio"]
    return out.select("vec_id", *(F.round(F.get("internal", F.lit(i)), 6).alias(n) for i, n in enumerate(names)))


def _probe_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probe_rows(spark, sf_dir)
    at = lambda i: F.get("z", (i % F.size("z")).cast("int"))
    layer = lambda i: F.struct(at(i).alias("prompt"), F.array(at(i), at((i + 1) % _LAYERS)).alias("answers"), F.array(at(i)).alias("lens"))
    return rows.withColumn("layers", F.transform(F.sequence(F.lit(0), F.lit(_LAYERS - 1)), layer))


_LIVE = "list_filter(s.log, lambda x: e.ts - x.ts < 60)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch(ts) AS ts, event_id AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (
        SELECT key, ts, tokens, rn, 0.0::DOUBLE AS delay, [{{'ts': ts, 'n': tokens}}] AS log FROM e WHERE rn = 1
        UNION ALL
        SELECT key, ts, tokens, rn, delay, CASE WHEN delay = 0 THEN list_append(live, {{'ts': ts, 'n': tokens}}) ELSE live END FROM (
            SELECT key, ts, tokens, rn, live, CASE WHEN len(live) < 30 AND (len(live) = 0 OR used + tokens <= 6000) THEN 0.0 ELSE greatest(0.0,
                CASE WHEN len(live) >= 30 THEN 60 - (ts - live[1].ts) ELSE 0.0 END,
                CASE WHEN len(live) > 0 AND used + tokens > 6000 THEN coalesce(60 - (ts - live[list_filter(range(1, len(live) + 1), lambda i: used - list_sum(list_transform(live[1:i], lambda x: x.n)) + tokens <= 6000)[1]].ts), 60.0) ELSE 0.0 END) END::DOUBLE AS delay
            FROM (SELECT *, coalesce(list_sum(list_transform(live, lambda x: x.n)), 0) AS used FROM (SELECT e.key, e.ts, e.tokens, e.rn, {_LIVE} AS live FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))))
    SELECT key, round(ts, 6) AS ts, tokens, round(delay, 5) AS delay FROM s"""
)
def limiter_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("ts"), F.col("event_id").alias("tokens"))
    return admit(log, 30, 6000).select("key", *r6("ts"), "tokens", F.round("delay", 5).alias("delay"))


# --- without an SQL form -------------------------------------------------------------------------------------------


@query()
def quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_negatives(records(spark, sf_dir)).select("_ord", "variant_type")


@query()
def quality_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_augmented(records(spark, sf_dir)).select("_ord", "variant_type")


def _rewrite(df: DataFrame, mode: str) -> DataFrame:
    """Stands for a model: changes the fact by rule, or adds a clause, or gives nothing to every seventh."""
    odd = F.crc32(F.concat("prompt", "answer"))
    plain = F.regexp_replace("answer", r"[.!?]\s*$", "")
    made = {"negative": mutate(F.col("answer")), "supported_positive": F.concat(plain, F.lit(", as the record of that time and place says.")), "drift_negative": F.concat(mutate(plain), F.lit(", which few people in Norway or Chile have heard of."))}
    return df.withColumn("rewritten", F.when(odd % 7 > 0, made[mode]))


def _qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select("prompt", "answer", F.lit(0).alias("label"), F.lit("qa").alias("source"), F.lit("positive").alias("variant_type"), ((F.col("conv_id") + 1000) * 1000 + F.col("turn")).alias("_ord"))


@query()
def model_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota and attempt budget are the operator's own."""
    return ingest.model_negatives(_qa_records(spark, sf_dir), _rewrite, 40).drop("_ord")


@query()
def targeted_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.augment(_qa_records(spark, sf_dir), _rewrite, 20).drop("_ord")


@query()
def probe_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the vector, internal and uncertainty numbers together."""
    unc = ("mean_lp", "min_lp", "max_lp", "std_lp", "mean_entropy", "max_entropy", "std_entropy", "perplexity", "n_tokens", "first_lp", "mean_top1", "mean_top5")
    rows = P.uncertainty(P.internal(_probe_layers(spark, sf_dir), "layers"), "z", "ids").withColumn("uncertainty", F.array(*(F.col(c).cast("double") for c in unc)))
    rows = rows.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") > 0).cast("int").alias("label")), "vec_id")
    rows = ml.probe_features(rows, "embedding", ["internal", "uncertainty"], 8).select("vec_id", "label", "features").cache()
    size = rows.agg(F.max(F.size("features"))).first()[0]
    model = ml.fit(rows, rows, indices=tuple(range(size)), calibration="none", max_iter=100)
    return model.predict(rows).select("vec_id", "label", F.round("proba", 6).alias("proba"))


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(records(spark, sf_dir)).select("_ord", "label", "variant_type", "features")
    return sampling.stratified_split(metrics.normalised_weights(out), "label", F.col("_ord")).cache()


def _scores(calibration: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _featured(spark, sf_dir)
        model = ml.fit(rows.where(~F.col("is_validation")), rows.where("is_validation"), weight="weight", calibration=calibration, max_iter=100)
        return model.predict(rows).select("_ord", "label", "is_validation", F.round("proba", 6).alias("proba"))

    return run


QUERIES |= {"lr_scores": _scores("none"), "isotonic_scores": _scores("isotonic"), "sigmoid_scores": _scores("sigmoid")}


@query()
def variant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _featured(spark, sf_dir)
    best, _, found = ml.select_variant(rows.where(~F.col("is_validation")), rows.where("is_validation"), weight="weight")
    return spark.createDataFrame([(n, float(v), n == best) for n, v in found.items()], "variant string, average_precision double, selected boolean")


@query()
def pca_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.centred_pca(table(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", (F.col("label") > 0).cast("int").alias("label"), F.col("pca").alias("features")).cache()
    model = ml.fit(rows, rows, indices=tuple(range(8)), calibration="none", max_iter=100)
    return model.predict(rows).select("vec_id", "label", F.round("proba", 6).alias("proba"))
