"""A cache of validations in stream state, bounded in age and in size.

Each cache (a worker, a folder, whatever ``cache`` says) keeps its newest entries in map state: an asset that it holds is a
hit, any other is a miss and is entered. Entries go when they are older than ``ttl`` and, beyond ``size`` of them, the oldest
first. State is kept in Spark's state store, so a stream goes on from its checkpoint with the cache as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "cache string, path string, ts timestamp, hit boolean, evicted long"


class SizedCache(StatefulProcessor):
    """Map state path -> time of entry in microseconds; a timer wakes a cache without lookups when its oldest entry is due."""

    def __init__(self, size: int, ttl_seconds: int):
        self.size, self.ttl = size, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "path string", "at long")

    def expire(self, held: dict[str, int], now: int) -> int:
        old = [p for p, at in held.items() if now - at > self.ttl]
        for p in old:
            del held[p]
        return len(old)

    def held(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.entries.iterator()}

    def keep(self, before: dict[str, int], held: dict[str, int]) -> None:
        for p in before.keys() - held.keys():
            self.entries.removeKey((p,))
        for p, at in held.items():
            if before.get(p) != at:
                self.entries.updateValue((p,), (at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ts", "path"], kind="stable")
        before = self.held()
        held, out = dict(before), []
        for path, ts in zip(asked["path"].tolist(), asked["ts"].tolist()):
            now = int(pd.Timestamp(ts).value // 1000)
            gone = self.expire(held, now)
            hit = path in held
            if not hit and path is not None:
                held[path] = now
                while len(held) > self.size:
                    del held[min(held, key=lambda p: (held[p], p))]
                    gone += 1
            out.append((key[0], path, ts, hit, gone))
        self.keep(before, held)
        if held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer((min(held.values()) + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["cache", "path", "ts", "hit", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.held()
        held = dict(before)
        self.expire(held, timerValues.getCurrentWatermarkInMs() * 1000)
        self.keep(before, held)
        if held:
            self.handle.registerTimer((min(held.values()) + self.ttl) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def cached_lookups(lookups: DataFrame, size: int = 20, ttl_seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """Rows of OUT for a stream of (cache string, path string, ts timestamp): whether each lookup is a hit, and the entries that went with it.

    Within a batch lookups are taken in order of ts, then path; a null path is a miss and is not entered, and rows later than
    ``late`` are left out, as the watermark has them. The stream needs a state store with column families (RocksDB).
    """
    marked = lookups.select("cache", "path", "ts").withWatermark("ts", late)
    return marked.groupBy("cache").transformWithStateInPandas(SizedCache(size, ttl_seconds), OUT, outputMode="append", timeMode="EventTime")
