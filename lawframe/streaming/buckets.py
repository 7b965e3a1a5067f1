"""Token buckets: one per key, filled at a rate up to a capacity; a request takes one token or is told how long to wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "key long, at timestamp, id long, wait double"


def settle(tokens: float, seconds: float, capacity: float, per_second: float) -> tuple[float, float | None]:
    """Tokens after a request that comes `seconds` after the last one, and the wait in seconds, None where it may go on."""
    tokens = min(capacity, tokens + seconds * per_second)
    return (tokens, max(1.0, (1.0 - tokens) / per_second)) if tokens < 1.0 else (tokens - 1.0, None)


def limited(requests: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """requests (key, at, id) with `wait`, in the order of (at, id) within a key. A batch; a key's bucket starts full.

    A key's requests are folded in order, which no split of the key can do; keys are dealt over tasks by hash, and
    a task holds one batch of sorted rows and one bucket at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, capacity, None
        for b in batches:
            waits = []
            for k, at in zip(b["key"], b["at"], strict=True):
                if k != key:
                    key, tokens, last = k, capacity, at
                tokens, wait = settle(tokens, (at - last).total_seconds(), capacity, per_second)
                last = at
                waits.append(wait)
            yield b.assign(wait=pd.Series(waits, dtype="float64", index=b.index))

    return requests.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(fold, SCHEMA)
