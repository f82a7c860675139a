"""Audit JSON of an external verifier: parse, default, coerce, clamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X
from .probe import let

ABSENT = {k: 0.5 if k in "rqs" else 0.0 for k in X.AUDIT_KEYS}


def neutral(status: str, ok: bool) -> Column:
    return F.struct(*(F.lit(ABSENT[k]).alias(k) for k in X.AUDIT_KEYS), F.lit(ok).alias("ok"), F.lit(status).alias("status"))


def payload(raw: Column) -> Column:
    """The strict JSON object in a response: the whole text, or what lies between the first and last brace; else null."""
    is_object = lambda c: F.try_parse_json(c).isNotNull() & F.json_object_keys(c).isNotNull()

    def inside(raw: Column) -> Column:
        start, end = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
        inner = F.when((start > 0) & (F.instr(raw, "}") > 0) & (end > start), F.substr(raw, start, end - start + 1))
        return F.when(F.try_parse_json(raw).isNull(), let(inner, lambda x: F.when(is_object(x), x)))

    return let(F.coalesce(raw, F.lit("")), lambda x: F.when(is_object(x), x).otherwise(inside(x)))


def normalise(raw: Column) -> Column:
    """Struct of the ten values, ok and status.

    An absent key has its default; a present value that is no number is 0.5 for r and 0 for all others, so a bad
    q or s differs from an absent one. c is rounded half to even and clamped to 0..3, x is 1 from a half on, others
    are clamped to 0..1. A payload that is no object, or whose c is no finite number, is invalid_json. The payload, its keys and
    its values are each made once.
    """

    def values(json: Column, keys: Column, data: Column) -> Column:
        found = []
        for k in X.AUDIT_KEYS:
            v = F.coalesce(F.try_variant_get(data, f"$.{k}", "double"), F.lit(0.5 if k == "r" else 0.0))
            v = F.when(F.array_contains(keys, k), v).otherwise(F.lit(ABSENT[k]))
            if k == "c":
                v = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.bround(v, 0)))
            elif k == "x":
                v = F.when(v >= 0.5, 1.0).otherwise(0.0)
            else:
                v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
            found.append(v.alias(k))
        full = F.size(F.array_except(F.array(*map(F.lit, X.AUDIT_KEYS)), keys)) == 0
        good = F.struct(*found, F.lit(True).alias("ok"), F.when(full, "ok").otherwise("partial_json").alias("status"))
        return F.when(json.isNull(), neutral("invalid_json", False)).otherwise(good)

    parsed = lambda json: F.struct(json.alias("json"), F.json_object_keys(json).alias("keys"), F.try_parse_json(json).alias("data"))
    return let(payload(raw), lambda json: let(parsed(json), lambda p: values(p["json"], p["keys"], p["data"])))


def error_status(code: Column, kind: Column) -> Column:
    """Status of a failed call: by HTTP code, or by the kind of failure (timeout, connection_error, missing_api_key,
    local_rate_limited, disabled); anything else is invalid_json."""
    named = F.array(*map(F.lit, ("timeout", "connection_error", "missing_api_key", "local_rate_limited", "disabled")))
    return F.when(code.isNotNull(), F.concat(F.lit("http_"), code.cast("string"))).when(F.array_contains(named, kind), kind).otherwise("invalid_json")
