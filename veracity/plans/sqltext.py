"""DuckDB expressions that state the text functions independently, for the oracle queries."""

from __future__ import annotations

from ..functions import lexicon as X


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, {q(X.WORD)})"


def stop(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def stem(w: str, suffixes: tuple[str, ...]) -> str:
    return f"regexp_replace(lower({w}), {q(X.stem_pattern(suffixes))}, '\\1')"


def stemmed(found: str, without: tuple[str, ...], suffixes: tuple[str, ...], least: int) -> str:
    kept = f"list_filter({found}, lambda w: length(w) >= {least} AND NOT list_contains({stop(without)}, lower(w)))"
    return f"list_distinct(list_transform({kept}, lambda w: {stem('w', suffixes)}))"


def content(c: str) -> str:
    return stemmed(words(c), X.STOPWORDS, X.SUFFIXES_FEATURES, 2)


def salient(c: str) -> str:
    return stemmed(words(c), X.NOISE_TOKENS, X.SUFFIXES_BUILDING, 2)


def runs(c: str, pattern: str) -> str:
    """Runs of word characters that match whole; RE2 has no look-around."""
    return f"list_filter(regexp_extract_all({c}, {q(X.RUN)}), lambda w: regexp_full_match(w, {q(pattern)}))"


def entities(c: str) -> str:
    return stemmed(runs(c, X.CAPITALISED), X.STOPWORDS, X.SUFFIXES_FEATURES, 1)


def symbols(c: str) -> str:
    return f"list_distinct({runs(c, X.SYMBOL)})"


def numbers(c: str) -> str:
    shadow = f"regexp_replace({c}, '\\p{{L}}', 'x', 'g')"
    return f"list_distinct(list_transform(regexp_extract_all({shadow}, '\\b\\d+(?:[.,]\\d+)?\\b'), lambda w: replace(w, ',', '.')))"


def normalised(c: str) -> str:
    return f"array_to_string(list_transform({words(c)}, lambda w: {stem('w', X.SUFFIXES_BUILDING)}), ' ')"


def trim(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^[{X.WS}]+|[{X.WS}]+$')}, '', 'g')"


def split(c: str) -> str:
    return f"regexp_extract_all({c}, {q(f'[^{X.WS}]+')})"


def missing(a: str, b: str) -> str:
    """How many of b are not in a."""
    return f"len(list_filter({b}, lambda w: NOT list_contains({a}, w)))"


def share_in(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda w: list_contains({b}, w)))::DOUBLE / greatest(1, len({a}))"


def share_out(a: str, b: str) -> str:
    return f"{missing(a, b)}::DOUBLE / greatest(1, len({b}))"


def same(a: str, b: str) -> str:
    return f"({missing(a, b)} = 0 AND {missing(b, a)} = 0)"


def any_of(low: str, hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(h)})" for h in hints) + ")"


def profile(c: str, kind: str) -> str:
    low = f"lower({c})"
    spaced = {"who": " who", "when": " when", "where": " where"} if kind == "building" else {}
    who, when, where = (any_of(low, tuple(spaced.get(h, h) for h in hints)) for hints in (X.WHO, X.WHEN, X.WHERE))
    count = any_of(low, X.COUNT) + (f" OR regexp_matches({low}, {q(f'(?:^|[^{X.WC}])' + chr(92) + 'p{Nd}')})" if kind == "verifier" else "")
    return f"CASE WHEN {who} THEN 'who' WHEN {when} THEN 'when' WHEN {where} THEN 'where' WHEN {count} THEN 'count' ELSE 'generic' END"


def digest(*parts: str) -> str:
    return "sha256(" + " || '||' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")"


def clip(c: str) -> str:
    return f"least(1.0, greatest(0.0, {c}))"


def count_of(c: str, char: str) -> str:
    return f"(length({c}) - length(replace({c}, {q(char)}, '')))"


def features(source: str, keep: str) -> str:
    """A chain of CTEs that ends in ``f``: the columns ``keep``, prompt, answer and the seven features."""

    def rule(hints: tuple[str, ...], none: str, base: float, extra: float, longest: int, most: float) -> str:
        return f"CASE WHEN {any_of('low', hints)} THEN (CASE WHEN {none} = 0 THEN {base} ELSE 0.0 END + CASE WHEN w > {longest} OR answer_new_content_ratio > {most} THEN {extra} ELSE 0.0 END)::DOUBLE ELSE 0.0 END"

    total = " + ".join([rule(X.WHO, "len(ae)", 0.75, 0.25, 18, 0.72), rule(X.WHEN_FEATURES, "len(an)", 0.8, 0.2, 16, 0.65), rule(X.WHERE, "len(ae)", 0.7, 0.15, 20, 0.75), rule(X.COUNT, "len(an)", 0.85, 0.15, 18, 0.7)])
    return f"""
        s AS (SELECT {keep}, prompt, answer, lower(prompt) AS low, {content('prompt')} AS pc, {content('answer')} AS ac, {entities('prompt')} AS pe, {entities('answer')} AS ae,
                     {numbers('prompt')} AS pn, {numbers('answer')} AS an, len({words('answer')})::DOUBLE AS w FROM ({source}) x),
        r AS (SELECT *, w AS answer_len_words, {share_in('pc', 'ac')} AS prompt_overlap_ratio, {share_in('pe', 'ae')} AS prompt_entity_coverage, {share_in('pn', 'an')} AS prompt_number_coverage,
                     {share_out('pc', 'ac')} AS answer_new_content_ratio, {share_out('pn', 'an')} AS answer_new_number_ratio FROM s),
        m AS (SELECT *, {total} AS total FROM r),
        f AS (SELECT {keep}, prompt, answer, answer_len_words, prompt_overlap_ratio, prompt_entity_coverage, prompt_number_coverage, answer_new_content_ratio, answer_new_number_ratio,
                     (CASE WHEN total <> 0 THEN least(1.0, total) WHEN w > 48 AND prompt_overlap_ratio < 0.2 THEN 0.35 WHEN answer_new_content_ratio > 0.85 AND w > 10 THEN 0.25 ELSE 0.0 END)::DOUBLE AS question_type_mismatch FROM m)"""


HEURISTIC = clip(
    "1 / (1 + exp(-4 * (0.12 * " + clip("answer_len_words / 32") + " + 0.24 * " + clip("1 - prompt_overlap_ratio") + " + 0.14 * " + clip("1 - prompt_entity_coverage")
    + " + 0.12 * " + clip("1 - prompt_number_coverage") + " + 0.14 * answer_new_content_ratio + 0.08 * answer_new_number_ratio + 0.16 * question_type_mismatch - 0.35)))"
)


def mutation(c: str) -> str:
    """The mutation cascade."""
    from ..functions.mutate import YEAR

    date = rf"(\d{{1,2}})\s+((?i:{'|'.join(X.MONTH_SWAPS)}))"
    part = lambda p, i: f"regexp_extract(t, {q(X.first(p))}, {i})"
    hit = lambda p: f"regexp_matches(t, {q(X.first(p))})"
    raw = f"replace({part(X.NUMBER, 2)}, ',', '.')"
    month = part(date, 4)
    months = "CASE lower(" + month + ") " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.MONTH_SWAPS.items()) + f" ELSE {month} END"
    big = f"try_cast({raw} AS HUGEINT)"
    rows = [
        (hit(YEAR), f"{part(YEAR, 1)} || (try_cast({part(YEAR, 2)} AS INT) + 3)::VARCHAR || {part(YEAR, 3)}"),
        (hit(date), f"{part(date, 1)} || least(try_cast({part(date, 3)} AS INT) + 5, 31)::VARCHAR || ' ' || {months} || {part(date, 5)}"),
        (hit(X.NUMBER), f"{part(X.NUMBER, 1)} || coalesce(CASE WHEN contains({raw}, '.') THEN rtrim(rtrim(try_cast(round_even(try_cast({raw} AS DOUBLE) * 1.2, 2) AS DECIMAL(30, 2))::VARCHAR, '0'), '.') ELSE ({big} + greatest(1, {big} // 10))::VARCHAR END, {raw}) || {part(X.NUMBER, 3)}"),
        *((hit(f"(?i:{k})"), f"{part(f'(?i:{k})', 1)} || {q(v)} || {part(f'(?i:{k})', 3)}") for k, v in X.NUMBER_WORD_SWAPS.items()),
        *((f"contains(t, {q(k)})", f"substr(t, 1, instr(t, {q(k)}) - 1) || {q(v)} || substr(t, instr(t, {q(k)}) + {len(k)})") for k, v in {**X.ENTITY_SWAPS, **X.SYMBOL_SWAPS}.items()),
        ("t = ''", "t"),
    ]
    parts = split("t")
    last = f"array_to_string(list_concat(list_concat({parts}[1:2], [{q(X.FILLER)}]), {parts}[3:]), ' ')"
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rows) + f" ELSE {last} END"
