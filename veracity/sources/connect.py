"""Fetching what the builders read: a knowledge base's bindings, and question and claim files over HTTP.

An ``Opener`` turns (url, headers, seconds) into an iterable of lines, so tests use fakes and a cluster without a network reads files
that were fetched elsewhere. Rows are fetched on the driver: a spec's bindings and the first rows of a file, both bounded by a limit.
"""

from __future__ import annotations

import csv
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from . import io

Opener = Callable[[str, dict[str, str], float], Iterable[str]]

ENDPOINT = "https://query.wikidata.org/sparql"
#: By spec: the class of the subject, the property, and the names of subject and object. Fixed values.
RELATIONS = {
    "country_capital": ("Q6256", "P36", "country", "capital"),
    "country_currency": ("Q6256", "P38", "country", "currency"),
    "country_language": ("Q6256", "P37", "country", "language"),
    "person_birth_year": ("Q5", "P569", "person", "dob"),
    "person_death_year": ("Q5", "P570", "person", "dod"),
    "person_citizenship": ("Q5", "P27", "person", "country"),
    "book_author": ("Q571", "P50", "work", "author"),
    "element_symbol": ("Q11344", "P246", "element", "symbol"),
}
PLAIN = ("dob", "dod", "symbol")  # values rather than things, so they have no label


def over_http(url: str, headers: dict[str, str], seconds: float) -> Iterator[str]:
    """The lines of a response, as they come."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as response:
        for line in response:
            yield line.decode("utf-8").rstrip("\r\n")


def sparql(spec: str, limit: int) -> str:
    """The query of a spec: labels in Russian, else English, in the order of the subject's label."""
    kind, relation, subject, value = RELATIONS[spec]
    shown = value if value in PLAIN else f"{value}Label"
    return f'SELECT ?{subject}Label ?{shown} WHERE {{ ?{subject} wdt:P31 wd:{kind}; wdt:{relation} ?{value}. SERVICE wikibase:label {{ bd:serviceParam wikibase:language "ru,en". }} }} ORDER BY ?{subject}Label LIMIT {limit}'


def bindings(spark: SparkSession, specs: Iterable[str] = tuple(RELATIONS), *, per_spec: int = 100, opener: Opener = over_http, endpoint: str = ENDPOINT, seconds: float = 20.0) -> DataFrame:
    """(spec, binding map<string,string>, _ord) of the specs; a spec whose call fails gives no row."""
    rows = []
    for spec in specs:
        url = f"{endpoint}?{urllib.parse.urlencode({'query': sparql(spec, per_spec), 'format': 'json'})}"
        try:
            found = json.loads("\n".join(opener(url, {"Accept": "application/sparql-results+json", "User-Agent": "veracity"}, seconds)))["results"]["bindings"]
        except (OSError, ValueError, KeyError):
            continue
        rows += [(spec, {k: str(v.get("value", "")) for k, v in b.items()}, len(rows) + i) for i, b in enumerate(found)]
    return spark.createDataFrame(rows, f"{io.BINDING}, _ord long")


def popqa(spark: SparkSession, url: str, *, opener: Opener = over_http, seconds: float = 60.0) -> DataFrame:
    """(question, possible_answers, prop, _ord) of a tab-separated file with a header; other columns are ignored."""
    rows = csv.DictReader(opener(url, {}, seconds), delimiter="\t")
    return spark.createDataFrame([(r.get("question"), r.get("possible_answers"), r.get("prop"), i) for i, r in enumerate(rows)], f"{io.POPQA}, _ord long")


def claims(spark: SparkSession, url: str, limit: int, *, include_nei: bool = False, opener: Opener = over_http, seconds: float = 60.0) -> DataFrame:
    """(claim, label, _ord) of a file of JSON lines. Reading stops at the ``limit``-th different usable claim; the rest is never fetched."""
    usable = {"SUPPORTS", "REFUTES", *(["NOT ENOUGH INFO"] if include_nei else [])}
    rows, seen = [], set()
    for line in opener(url, {}, seconds):
        if len(seen) >= limit:
            break
        item = json.loads(line) if line.strip() else {}
        if item.get("label") in usable:
            rows.append((str(item["claim"]), item["label"], len(rows)))
            seen.add((str(item["claim"]).strip(), item["label"]))
    return spark.createDataFrame(rows, f"{io.FEVER}, _ord long")
