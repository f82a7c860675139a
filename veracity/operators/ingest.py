"""Building labelled data: records from seeds, question files, claim files and knowledge-base bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..functions.mutate import mutate
from .dedup import exclude, first_wins, merge_unique, ring_negatives
from .quality import augmentation_sources, drift_cheap, drift_gate, expansion_ok, filter_negatives, negative_cheap, negative_ratio_fails, sequence_ratio, supported_positive
from .sampling import round_robin, spec_cap

RECORD = ["prompt", "answer", "label", "source", "variant_type"]
#: Harvest specs: name, answer type, prompt and answer templates. Fixed values.
SPECS = (
    ("country_capital", "place", "Как называется столица {countryLabel}?", "Столица {countryLabel} — {capitalLabel}."),
    ("country_currency", "entity", "Какая валюта используется в {countryLabel}?", "В {countryLabel} используется валюта {currencyLabel}."),
    ("country_language", "entity", "Какой официальный язык у {countryLabel}?", "Официальный язык {countryLabel} — {languageLabel}."),
    ("person_birth_year", "year", "В каком году родился {personLabel}?", "{personLabel} родился в {dob_year} году."),
    ("person_death_year", "year", "В каком году умер {personLabel}?", "{personLabel} умер в {dod_year} году."),
    ("person_citizenship", "place", "Гражданином какой страны был {personLabel}?", "{personLabel} был гражданином {countryLabel}."),
    ("book_author", "person", "Кто написал книгу «{workLabel}»?", "Книгу «{workLabel}» написал {authorLabel}."),
    ("element_symbol", "entity", "Какой химический символ у элемента {elementLabel}?", "Химический символ элемента {elementLabel} — {symbol}."),
)


def positives(seeds: DataFrame) -> DataFrame:
    source = F.coalesce("source", F.lit("seed")) if "source" in seeds.columns else F.lit("seed")
    return seeds.select("prompt", "answer", F.lit(0).alias("label"), source.alias("source"), F.lit("positive").alias("variant_type"), "_ord")


def rule_negatives(seeds: DataFrame) -> DataFrame:
    return positives(seeds).withColumn("answer", mutate(F.col("answer"))).withColumn("label", F.lit(1)).withColumn("variant_type", F.lit("rule_negative"))


def build(seeds: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A positive and a rule negative of every seed, first wins by (prompt, answer, variant), known keys left out."""
    both = positives(seeds).withColumn("_ord", 2 * F.col("_ord")).unionByName(rule_negatives(seeds).withColumn("_ord", 2 * F.col("_ord") + 1))
    fresh = first_wins(both, ["prompt", "answer", "variant_type"], "_ord")
    return fresh if existing is None else existing.unionByName(exclude(fresh, existing, ["prompt", "answer", "variant_type"]).select(existing.columns))


def _popqa_ring(rows: DataFrame, limit: int | None) -> DataFrame:
    """Usable questions (prompt, answer, prop, _ord) with another question's answer of the same property as ``negative``. A
    property with one question, and a question that would get its own answer, drop out."""
    prop = F.coalesce(F.nullif(T.trim(F.col("prop")), F.lit("")), F.lit("unknown"))
    picked = rows.select(T.trim(F.col("question")).alias("prompt"), A.primary_answer(A.possible_answers(F.col("possible_answers"))).alias("answer"), prop.alias("prop"), F.col("_ord"))
    picked = picked.where(A.popqa_usable(F.col("prompt"), F.col("answer")))
    if limit is not None:
        picked = picked.orderBy("_ord").limit(limit)
    return ring_negatives(picked, "prop", "prompt", "answer", "_ord")


def popqa(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """A positive and a negative of every question of the rings."""
    ring = _popqa_ring(rows, limit)
    source = F.concat(F.lit("popqa:"), "prop").alias("source")
    good = ring.select("prompt", "answer", F.lit(0).alias("label"), source, F.lit("popqa_positive").alias("variant_type"), (2 * F.col("_ord")).alias("_ord"))
    bad = ring.select("prompt", F.col("negative").alias("answer"), F.lit(1).alias("label"), source, F.lit("popqa_negative").alias("variant_type"), (2 * F.col("_ord") + 1).alias("_ord"))
    return first_wins(good.unionByName(bad), RECORD, "_ord")


def popqa_seeds(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The questions of the rings as seeds, with the kind of their answer."""
    ring = _popqa_ring(rows, limit)
    kind = A.answer_type(F.col("answer"), F.col("prop")).alias("answer_type")
    return first_wins(ring.select("prompt", "answer", kind, F.concat(F.lit("popqa:"), "prop").alias("source"), "_ord"), ["prompt", "answer", "source"], "_ord")


#: What a claim's record asks. Fixed value.
CLAIM_PROMPT = "Assess whether the following claim is factually correct."


def fever(claims: DataFrame, limit: int | None = None, include_nei: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Claims as answers to a fixed question; what is not supported has label 1. Known records are left out before the limit."""
    ok = claims.where(A.fever_label_usable(F.col("label"), include_nei))
    out = ok.select(F.lit(CLAIM_PROMPT).alias("prompt"), T.trim(F.col("claim")).alias("answer"), (F.col("label") != "SUPPORTS").cast("int").alias("label"), F.lit("fever").alias("source"), A.fever_variant(F.col("label")).alias("variant_type"), "_ord")
    out = first_wins(out, RECORD, "_ord")
    if known is not None:
        out = exclude(out, known, RECORD)
    return out if limit is None else out.orderBy("_ord").limit(limit)


def merge_external(main: DataFrame, extra: DataFrame, seeds: bool) -> DataFrame:
    """Keyed union: seeds by prompt, answer and source; records by label and variant too."""
    return merge_unique(main, extra, ["prompt", "answer", "source"] if seeds else RECORD, "_ord")


def harvest(bindings: DataFrame, per_spec: int, known: DataFrame | None = None) -> DataFrame:
    """Seeds from fetched bindings (spec, binding map<string,string>, _ord): trimmed, years taken from dates, templates
    filled, checked, first of each prompt, capped per spec. A binding with an empty value is dropped."""
    trimmed = bindings.withColumn("_b", F.transform_values("binding", lambda _, v: T.trim(v))).where(~F.exists(F.map_values("_b"), lambda v: v == ""))
    out = None
    for i, (name, kind, prompt, answer) in enumerate(SPECS):
        own = trimmed.where(F.col("spec") == name)
        value = lambda k: F.try_element_at("_b", F.lit(k))
        names = {x.partition("}")[0] for x in (prompt + answer).split("{")[1:]}
        values = {k: F.nullif(A.binding_year(value(k.removesuffix("_year"))), F.lit("")) if k.endswith("_year") else value(k) for k in names}
        part = own.select(T.trim(A.fill(prompt, **values)).alias("prompt"), T.trim(A.fill(answer, **values)).alias("answer"), F.lit(kind).alias("answer_type"), F.lit(f"wikidata:{name}").alias("source"), (F.col("_ord") + i * 10_000_000).alias("_ord"))
        out = part if out is None else out.unionByName(part)
    usable = first_wins(out.where(A.seed_usable(F.col("prompt"), F.col("answer"))), ["prompt"], "_ord")
    if known is not None:
        usable = exclude(usable, known, ["prompt"])
    return spec_cap(usable, "source", "_ord", per_spec)


def quota(candidates: DataFrame, transform, keep, limit: int | None, attempts: int | None) -> DataFrame:
    """Produce until a quota is met, within an attempt budget: the first ``attempts`` rows are transformed and checked,
    the first ``limit`` that pass stay."""
    tried = candidates if attempts is None else candidates.orderBy("_ord").limit(attempts)
    passed = keep(transform(tried))
    return passed if limit is None else passed.orderBy("_ord").limit(limit)


#: (rows with prompt and answer, mode) -> the rows with ``rewritten``, null where the model gave nothing. Modes: negative,
#: supported_positive, drift_negative.
Rewrite = Callable[[DataFrame, str], DataFrame]


def model_negatives(seeds: DataFrame, rewrite: Rewrite, limit: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Negatives that a model wrote from the seeds in order, until ``limit`` are made or max(25, 4 * limit) seeds tried. A rewrite
    that is empty, unchanged, much longer or no good negative counts as tried; so does one whose key exists."""
    keys = ["prompt", "answer", "variant_type"]

    def keep(df: DataFrame) -> DataFrame:
        ref, new = F.col("answer"), T.trim(F.col("rewritten"))
        ok = df.where(expansion_ok(ref, new) & negative_cheap(ref, new)).withColumn("_ratio", sequence_ratio(T.normalised(ref), T.normalised(new)))
        ok = ok.where(~negative_ratio_fails(ref, new, F.col("_ratio")))
        fresh = first_wins(positives(ok.withColumn("answer", new)).withColumns({"label": F.lit(1), "variant_type": F.lit("groq_negative")}), keys, "_ord")
        return fresh if existing is None else exclude(fresh, existing, keys)

    return quota(seeds, lambda df: rewrite(df, "negative"), keep, limit, None if limit is None else max(25, 4 * limit))


def augment(records: DataFrame, rewrite: Rewrite, limit: int) -> DataFrame:
    """Adds up to ``limit`` supported positives and as many drifting negatives, each with its own quota.

    Candidates are drawn from factual records in turn by question
    profile, at most max(25, 3 * limit). What passes its quality rules and has a new key is added, and bad external
    negatives go from the whole.
    """
    base = augmentation_sources(records)
    drawn = round_robin(base, max(25, 3 * limit))
    out = records
    for positive, variant in ((True, "groq_supported_positive"), (False, "groq_drift_negative")):
        cand = rewrite(drawn, "supported_positive" if positive else "drift_negative").where(F.col("rewritten").isNotNull() & (T.trim(F.col("rewritten")) != "") & (F.col("rewritten") != F.col("answer")))
        ref, new = F.col("answer"), F.col("rewritten")
        if positive:
            cand = cand.where(supported_positive(ref, new))
        else:
            cand = cand.where(drift_cheap(ref, new) & drift_gate(ref, new)).withColumn("_ratio", sequence_ratio(T.normalised(ref), T.normalised(new))).where("_ratio < 0.985").drop("_ratio")
        fresh = cand.select("prompt", new.alias("answer"), F.lit(0 if positive else 1).alias("label"), "source", F.lit(variant).alias("variant_type"), "_ord")
        keys = ["prompt", "answer", "label", "source", "variant_type"]
        fresh = exclude(first_wins(fresh, keys, "_ord"), records, keys).orderBy("_ord").limit(limit)
        out = out.unionByName(fresh.select(records.columns))
    return filter_negatives(out)
