"""Rule-based mutation of a factual answer into a wrong one: one cascade, the first rule that fits holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X
from . import text as T
from .probe import let

YEAR = r"1[5-9]\d{2}|20\d{2}|2100"
DATE = rf"(\d{{1,2}})\s+((?iu:{'|'.join(X.MONTH_SWAPS)}))"


def _around(t: Column, pattern: str, inner: int = 0) -> tuple[Column, Column, Column, list[Column]]:
    """(found, before, after, [match, inner groups...]) of the first whole-word match. The text is searched once to tell whether
    there is one; the parts are cut out only where they are used."""
    p = T.bounded(pattern)
    part = lambda i: F.regexp_extract(t, p, i)
    at = F.regexp_instr(t, F.lit(p))
    return t.rlike(p), F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(part(0)), F.length(t)), [part(i) for i in range(inner + 1)]


def _swap_first(t: Column, source: str, target: str) -> Column:
    at = F.instr(t, source)
    return F.concat(F.substr(t, F.lit(1), at - 1), F.lit(target), F.substr(t, at + len(source), F.length(t)))


def mutate(answer: Column) -> Column:
    """A year three on; a day five on and another month; a number a fifth or tenth up; else a number word, name or
    symbol by table order; else a hedge after the second word. A blank answer stays blank."""
    return let(T.trim(answer), _cascade)  # every rule reads the trimmed text


def _cascade(t: Column) -> Column:
    """Rules come in groups behind one cheap test each; a group without a hit is null."""
    hit, before, after, (year,) = _around(t, YEAR)
    numeric = F.when(hit, F.concat(before, (year.try_cast("int") + 3).cast("string"), after))
    hit, before, after, (_, day, month) = _around(t, DATE, 2)
    months = F.create_map(*(F.lit(x) for kv in X.MONTH_SWAPS.items() for x in kv))
    numeric = numeric.when(hit, F.concat(before, F.least(day.try_cast("int") + 5, F.lit(31)).cast("string"), F.lit(" "), F.coalesce(F.try_element_at(months, F.lower(month)), month), after))
    hit, before, after, (raw,) = _around(t, X.NUMBER)
    raw = F.replace(raw, F.lit(","), F.lit("."))
    grown = F.rtrim(F.bround(raw.try_cast("double") * 1.2, 2).try_cast("decimal(30,2)").cast("string"), F.lit("0"))
    whole = raw.try_cast("decimal(38,0)")
    more = (whole + F.greatest(F.lit(1), F.floor(whole / 10))).cast("decimal(38,0)").cast("string")
    numeric = numeric.when(hit, F.concat(before, F.coalesce(F.when(raw.contains("."), F.rtrim(grown, F.lit("."))).otherwise(more), raw), after))
    word = None
    for source, target in X.NUMBER_WORD_SWAPS.items():
        hit, before, after, _ = _around(t, f"(?iu:{source})")
        made = F.concat(before, F.lit(target), after)
        word = F.when(hit, made) if word is None else word.when(hit, made)
    named = None
    for source, target in {**X.ENTITY_SWAPS, **X.SYMBOL_SWAPS}.items():
        has, made = t.contains(source), _swap_first(t, source, target)
        named = F.when(has, made) if named is None else named.when(has, made)
    hedged = let(T.split(t), lambda parts: F.concat_ws(" ", F.slice(parts, 1, 2), F.array(F.lit(X.FILLER)), F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))))
    words = f"(?iu:{'|'.join(X.NUMBER_WORD_SWAPS)})"
    return F.when(t == "", t).otherwise(F.coalesce(F.when(t.rlike(r"\d"), numeric), F.when(t.rlike(words), word), named, hedged))
