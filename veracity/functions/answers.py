"""Scalars of data ingestion: seed checks, answer lists, answer types, bindings, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X
from . import text as T


def seed_usable(prompt: Column, answer: Column) -> Column:
    link = prompt.contains("http://") | prompt.contains("https://") | answer.contains("http://") | answer.contains("https://")
    entity_id = prompt.rlike(rf"(?:^|[^{X.WC}])[QP]\p{{Nd}}+(?:[^{X.WC}]|$)")
    return F.length(prompt).between(12, 220) & F.length(answer).between(8, 260) & ~link & ~entity_id


def popqa_usable(question: Column, answer: Column) -> Column:
    return F.length(question).between(1, 220) & F.length(answer).between(1, 120)


def fever_label_usable(label: Column, include_nei: bool = False) -> Column:
    return label.isin("SUPPORTS", "REFUTES", *(["NOT ENOUGH INFO"] if include_nei else []))


def fever_variant(label: Column) -> Column:
    return F.concat(F.lit("fever_"), F.replace(F.lower(label), F.lit(" "), F.lit("_")))


def possible_answers(raw: Column) -> Column:
    """The trimmed, non-empty strings of a JSON array; bad JSON gives none."""
    strict = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, "array<string>"))
    return F.filter(F.transform(F.coalesce(strict, F.array().cast("array<string>")), T.trim), lambda x: x != "")


def primary_answer(answers: Column) -> Column:
    """The first of one to eight words and at most 80 characters, else the first, else empty."""
    short = F.filter(answers, lambda a: T.split_count(a).between(1, 8) & (F.length(a) <= 80))
    return F.coalesce(F.get(short, F.lit(0)), F.get(answers, F.lit(0)), F.lit(""))


def answer_type(answer: Column, prop: Column) -> Column:
    return (
        F.when(answer.rlike(r"^\p{Nd}{4}$"), "year").when(answer.rlike(r"\p{Nd}"), "number")
        .when(F.coalesce(prop, F.lit("")).isin("place of birth", "country", "capital"), "place").otherwise("entity")
    )


def binding_year(raw: Column) -> Column:
    return F.regexp_extract(raw, T.bounded(r"(\p{Nd}{4})"), 1)


def fill(template: str, **values: Column) -> Column:
    """A template with {names}; a null value makes the whole null."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))
