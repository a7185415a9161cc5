"""Rests of a stream in any order within the watermark: state with timers, kept in RocksDB, gone when a song is over.

A song's facts wait in its state until the watermark has passed them; then a timer takes them in the order of their
onsets, so what comes out doesn't depend on how the stream was cut into batches.  A song without facts for ``idle`` is
forgotten: its state is cleared, and if it comes again it starts anew, at the onset of its first fact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "song_id long, onset long, duration long"


class Rests(StatefulProcessor):
    """State of a song: its reach, and the facts that wait; timers are at the first of these, and at the end of idleness.

    A timer takes all facts that the watermark has passed, so the waiting ones are read once for each move of the watermark.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reach = handle.getValueState("reach", "reach long, last long")
        self.waiting = handle.getListState("waiting", "at long, onset long, duration long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["ts"].astype("int64") // (10**9 if "[s" in str(part["ts"].dtype) else 10**3 if "[us" in str(part["ts"].dtype) else 10**6)
            self.waiting.appendList(list(zip(at.tolist(), part["onset"].tolist(), part["duration"].tolist())))
            first = at.min() if first is None else min(first, at.min())
        if first is not None:
            self.handle.registerTimer(int(max(first, timerValues.getCurrentWatermarkInMs() + 1)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        state = self.reach.get() if self.reach.exists() else None
        reach, last = (state[0], state[1]) if state else (None, None)
        facts = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = bisect_right(facts, now, key=lambda f: f[0])
        out = []
        for t, onset, duration in facts[:due]:
            if last is not None and t > last + self.idle:
                reach = None
            if reach is not None and onset > reach:
                out.append((key[0], reach, onset - reach))
            reach, last = max(reach if reach is not None else onset, onset + duration), t
        if due:
            if due < len(facts):
                self.waiting.put(facts[due:])
                self.handle.registerTimer(int(facts[due][0]))
            else:
                self.waiting.clear()
        if last is not None and now >= last + self.idle:
            self.reach.clear()
        elif due:
            self.reach.update((int(reach), int(last)))
            self.handle.registerTimer(int(last + self.idle))
        yield pd.DataFrame(out, columns=["song_id", "onset", "duration"])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State beyond an executor's memory, with its changes alone written at each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def timed_rests(facts: DataFrame, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Rests between the facts (song_id, ts, onset, duration) of each song; facts behind the watermark are left out."""
    use_state_store(facts.sparkSession)
    rows = facts.withWatermark("ts", late).select("song_id", "ts", "onset", "duration")
    return rows.groupBy("song_id").transformWithStateInPandas(Rests(idle_ms), OUT, "Append", "EventTime")
