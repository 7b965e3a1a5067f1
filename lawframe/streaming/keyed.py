"""Token buckets as keyed state of a stream: requests wait for the watermark, timers settle them in order and sweep full buckets.

The rules of a bucket are those of `buckets.settle`. A request that comes out of order must not be settled before an earlier
one of its key, so each waits until no earlier one can come (the watermark has passed it). A key's state is its bucket and
what waits, and goes when the bucket is full again. Each look at the state is a call to the JVM, so a key's bucket and its
waiting requests are one value; of a key with more than FEW of them, they lie in slots of time, of which one at a time is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .buckets import settle

#: Where large keyed state lives; transformWithState asks for this one.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT = 86_400_000_000
CHUNK = 100_000
FEW = 4_096


class Settle(StatefulProcessor):
    """One bucket per key. Rows in: key, at, us (at in microseconds), id. Rows out: key, us, id, wait."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.per_second = capacity, per_second

    def init(self, handle) -> None:
        self.handle = handle
        # waiting: (us, id) of requests, unless they lie in slots; timer: the next time that is registered
        self.state = handle.getValueState("state", "tokens double, last long, waiting binary, slots boolean, timer long")
        self.slots = handle.getMapState("waiting", "slot long", "requests binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, asked, held = None, ((r.us, r.id) for r in rows if r.id is not None), None
        while chunk := list(islice(asked, CHUNK)):
            came = np.array(chunk, np.int64)
            if held is None:
                held = self.state.get() or (self.capacity, None, b"", False, None)
                tokens, last, waiting, slotted, timer = held
                waiting = bytes(waiting)
            low = int(came[:, 0].min())
            first = low if first is None else min(first, low)
            waiting += came.tobytes()
            if slotted or len(waiting) > 16 * FEW:
                self.put(np.frombuffer(waiting, np.int64).reshape(-1, 2))
                waiting, slotted = b"", True
        if first is not None:
            if timer is None or first // 1000 + 1 < timer:
                timer = first // 1000 + 1
                self.handle.registerTimer(timer)
            self.state.update((tokens, last, waiting, slotted, timer))
        return iter(())

    def put(self, came: np.ndarray) -> None:
        slots = came[:, 0] // SLOT
        for slot in np.unique(slots).tolist():
            held = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else None
            self.slots.updateValue((slot,), ((bytes(held[0]) if held else b"") + came[slots == slot].tobytes(),))

    def due(self, waiting: bytes, slotted: bool, until: int) -> Iterator[tuple[np.ndarray, int | None, bytes]]:
        """Stretches of what the watermark has passed, in order, and what is left then: the earliest, and those outside of slots."""
        if not slotted:
            here = np.frombuffer(waiting, np.int64).reshape(-1, 2)
            here = here[np.lexsort((here[:, 1], here[:, 0]))]
            n = int(np.searchsorted(here[:, 0], until, "right"))
            yield here[:n], int(here[n, 0]) if n < len(here) else None, here[n:].tobytes()
            return
        for slot in sorted(k[0] for k in self.slots.keys()):
            if slot * SLOT > until:
                yield np.empty((0, 2), np.int64), slot * SLOT, b""
                return
            here = np.frombuffer(bytes(self.slots.getValue((slot,))[0]), np.int64).reshape(-1, 2)
            here = here[np.lexsort((here[:, 1], here[:, 0]))]
            n = int(np.searchsorted(here[:, 0], until, "right"))
            if n == len(here):
                self.slots.removeKey((slot,))
            elif n:
                self.slots.updateValue((slot,), (here[n:].tobytes(),))
            yield here[:n], int(here[n, 0]) if n < len(here) else None, b""
            if n < len(here):
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get()
        if held is None:  # settled and swept by another of the key's timers
            return
        tokens, last, waiting, slotted, timer = held
        rest, left = None, b""
        for due, rest, left in self.due(bytes(waiting), slotted, until):
            for us, ident in due.tolist():
                tokens, wait = settle(tokens, 0.0 if last is None else (us - last) / 1e6, self.capacity, self.per_second)
                last = us
                yield Row(key=key[0], us=us, id=ident, wait=wait)
        slotted = slotted and rest is not None
        if rest is None and (last is None or tokens + (until - last) / 1e6 * self.per_second >= self.capacity):
            self.state.clear()
            return
        following = max(rest // 1000 if rest is not None else int((last + (self.capacity - tokens) / self.per_second * 1e6) // 1000), until // 1000) + 1
        if timer is None or timer * 1000 <= until or following < timer:
            timer = following
            self.handle.registerTimer(timer)
        self.state.update((tokens, last, left, slotted, timer))


def limited(requests: DataFrame, capacity: float, per_second: float, delay: str) -> DataFrame:
    """(key, at, id, wait) of a stream of requests (key, at, id), as `buckets.limited` gives them for the whole table.

    A request is answered once the watermark, the newest `at` less `delay`, has passed it. Rows without a key, time or id are
    no requests, but one with a null id moves the watermark on; those that come later than `delay` are dropped by Spark. A repeated row is a request of its own.
    """
    rows = requests.select("key", "at", F.unix_micros("at").alias("us"), "id").where("key IS NOT NULL AND at IS NOT NULL")
    settled = rows.withWatermark("at", delay).groupBy("key").transformWithState(Settle(capacity, per_second), "key long, us long, id long, wait double", "Append", "EventTime")
    return settled.select("key", F.timestamp_micros("us").alias("at"), "id", "wait")


def drained(rows: DataFrame, out: str, state: str) -> int:
    """Runs a stream over what there is, as Parquet rows in `out`, and stops; the number of input rows. The next call goes on from `state`."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        return sum(p["numInputRows"] for p in run.recentProgress)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def walked(step, most: int) -> list[int]:
    """Calls `step`, which loads and returns a number of rows, until it loads none or has been called `most` times; the numbers."""
    loaded = []
    while len(loaded) < most and (not loaded or loaded[-1]):
        loaded.append(step())
    return loaded


def drop(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """A delivery: rows join the files of a folder that a stream reads."""
    rows.write.mode("append").parquet(folder)
