"""A verifier that calls an external model, for cache misses only: retries, statuses, rate limit."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.config import ApiSettings
from ..streaming.limiter import Limiter

#: Given (prompt, answer), the response text. May raise TimeoutError, ConnectionError, or HttpError with a code.
Call = Callable[[str, str], str]


class HttpError(Exception):
    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


def is_object(raw: str) -> bool:
    """Whether the text, or what its first and last brace hold, is a JSON object."""
    for part in (raw, raw[raw.find("{") : raw.rfind("}") + 1]):
        try:
            return isinstance(json.loads(part), dict)
        except ValueError:
            continue
    return False


def ask(call: Call, prompt: str, answer: str, settings: ApiSettings) -> tuple[str | None, str]:
    """(response, status). Only a response that is no JSON object is asked for again."""
    raw = None
    for _ in range(settings.max_retries + 1):
        try:
            raw = call(prompt, answer)
        except TimeoutError:
            return None, "timeout"
        except HttpError as e:
            return None, f"http_{e.code}"
        except ConnectionError:
            return None, "connection_error"
        if is_object(raw):
            return raw, "ok"
    return raw, "invalid_json"


def calling(call: Call, settings: ApiSettings, *, has_key: bool = True, wait: bool = False, tasks: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A verifier for ``scoring.audits``. The account's limits are shared out over ``tasks`` partitions, each of which keeps to
    its part: beyond it a row waits, or without ``wait`` gets ``local_rate_limited``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(max(1, settings.requests_per_minute // tasks), max(1, settings.tokens_per_minute // tasks))
        for pdf in batches:
            rows = []
            for prompt, answer in zip(pdf["prompt"].fillna(""), pdf["answer"].fillna(""), strict=True):
                need = max(32, (len(prompt) + len(answer)) // 4 + 32)
                while has_key and (delay := limiter.reserve(time.monotonic(), need)) and wait:
                    time.sleep(delay)
                if not has_key or delay:
                    rows.append((None, "local_rate_limited" if has_key else "missing_api_key", 0.0))
                    continue
                began = time.monotonic()
                rows.append((*ask(call, prompt, answer, settings), time.monotonic() - began))
            yield pdf.assign(**{n: pd.Series([r[i] for r in rows], index=pdf.index, dtype=k) for i, (n, k) in enumerate((("raw", "object"), ("status", "object"), ("t_model_sec", "float64")))})

    def verify(pairs: DataFrame) -> DataFrame:
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema]
        return pairs.repartition(tasks).mapInPandas(run, ", ".join([*kinds, "raw string", "status string", "t_model_sec double"]))

    return verify
