"""Admission by a sliding 60-second window of requests and tokens, exact, as a stateful stream or over a table."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = 60.0
OUT = "key string, ts double, tokens long, delay double"


@dataclass
class Limiter:
    """Denied requests are not recorded. A request larger than the token limit passes when nothing is in the window."""

    requests: int
    tokens: int
    log: deque[tuple[float, int]] = field(default_factory=deque)

    def reserve(self, now: float, tokens: int) -> float:
        """0.0 if admitted, else the seconds to wait."""
        while self.log and now - self.log[0][0] >= WINDOW:
            self.log.popleft()
        waits = []
        if len(self.log) >= self.requests:
            waits.append(WINDOW - (now - self.log[0][0]))
        used = sum(t for _, t in self.log)
        if self.log and used + tokens > self.tokens:
            waits.append(WINDOW)
            for ts, t in self.log:
                used -= t
                if used + tokens <= self.tokens:
                    waits[-1] = WINDOW - (now - ts)
                    break
        if waits:
            return max(0.0, *waits)
        self.log.append((now, tokens))
        return 0.0


def admit(df: DataFrame, requests: int, tokens: int) -> DataFrame:
    """Over a table (key, ts seconds, tokens): each row with its delay. A key's rows are replayed in order of time, in
    batches, with a window's worth of state, so no key is held whole."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = None, Limiter(requests, tokens)
        for pdf in batches:
            delays = []
            for k, ts, n in zip(pdf["key"], pdf["ts"], pdf["tokens"], strict=True):
                if k != key:
                    key, limiter = k, Limiter(requests, tokens)
                delays.append(limiter.reserve(float(ts), int(n)))
            yield pdf.assign(delay=pd.Series(delays, index=pdf.index, dtype="float64"))

    rows = df.select(F.col("key").cast("string"), F.col("ts").cast("double"), F.col("tokens").cast("long"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "tokens").mapInPandas(replay, OUT)


def admit_stream(stream: DataFrame, requests: int, tokens: int) -> DataFrame:
    """The same over a stream; the window's log is the state of a key."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(requests, tokens)
        if state.exists:
            times, sizes = state.get
            limiter.log.extend(zip(times, sizes, strict=True))
        rows = pd.concat(list(batches)).sort_values(["ts", "tokens"])
        rows["delay"] = [limiter.reserve(float(t), int(n)) for t, n in zip(rows["ts"], rows["tokens"], strict=True)]
        state.update(([t for t, _ in limiter.log], [n for _, n in limiter.log]))
        yield rows[["key", "ts", "tokens", "delay"]]

    rows = stream.select(F.col("key").cast("string"), F.col("ts").cast("double"), F.col("tokens").cast("long"))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, "times array<double>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)
