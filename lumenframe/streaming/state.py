"""Keyed state over streams: latest terminal messages and heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from lumenframe.operators.sessions import HEARTBEAT_SECONDS, RESULT_TTL_SECONDS, TERMINAL

MICROS = 1_000_000


def _by_task(messages: DataFrame, watermark: str | None = None) -> DataFrame:
    timed = messages.withColumn("emitted_at", F.col("emitted_at").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("emitted_at", watermark)
    return timed.select("task_id", "seq", "emitted_at", "status", F.unix_micros("emitted_at").alias("at"))


class LatestTerminal(StatefulProcessor):
    """Newest finished message per task; the state expires after its time to live."""

    def __init__(self, ttl_seconds: int):
        self.ttl_seconds = ttl_seconds

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long, seq long, status string", self.ttl_seconds * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        before = best
        for pdf in rows:
            done = pdf[pdf["status"].isin(TERMINAL)]
            if len(done):
                row = done.sort_values(["at", "seq"]).iloc[-1]
                found = (int(row["at"]), int(row["seq"]), str(row["status"]))
                best = max(best, found, key=lambda r: r[:2]) if best else found
        if best is not None and best != before:
            self.last.update(best)
            yield pd.DataFrame({"task_id": [key[0]], "seq": [best[1]], "status": [best[2]], "at": [best[0]]})

    def close(self) -> None:
        pass


def stream_latest_terminal(messages: DataFrame, ttl_seconds: int = RESULT_TTL_SECONDS) -> DataFrame:
    return _by_task(messages).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=LatestTerminal(ttl_seconds), outputStructType="task_id string, seq long, status string, at long",
        outputMode="Update", timeMode="ProcessingTime")


class Heartbeats(StatefulProcessor):
    """Counts the heartbeats of every silence of a task. A timer closes a silence that nothing ends."""

    def __init__(self, every_seconds: int):
        self.every = every_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, status string, told long")

    def _row(self, key, seq, beats, until) -> dict:
        return {"task_id": key[0], "seq": seq, "heartbeats": beats, "until": until}

    def _beats(self, last, until) -> int:
        return 0 if last[2] in TERMINAL else max(0, (until - last[0]) // (self.every * MICROS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        found = []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, seq, status in batch[["at", "seq", "status"]].itertuples(index=False):
            if last is not None:
                found.append(self._row(key, last[1], self._beats(last, at) - last[3], at))
            last = (int(at), int(seq), str(status), 0)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.last.update(last)
            if last[2] not in TERMINAL:
                self.handle.registerTimer(last[0] // 1000 + self.every * 1000)
        if found:
            yield pd.DataFrame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        last = tuple(self.last.get())
        now = timerValues.getCurrentWatermarkInMs() * 1000
        beats = self._beats(last, now)
        if beats > last[3]:
            yield pd.DataFrame([self._row(key, last[1], beats - last[3], now)])
            self.last.update((*last[:3], beats))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.every * 1000)

    def close(self) -> None:
        pass


def stream_heartbeats(messages: DataFrame, every: int = HEARTBEAT_SECONDS, watermark: str = "1 day") -> DataFrame:
    """``(task_id, seq, heartbeats, until)``: heartbeats after message ``seq``; several rows of one message add up."""
    return _by_task(messages, watermark).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Heartbeats(every), outputStructType="task_id string, seq long, heartbeats long, until long",
        outputMode="Append", timeMode="EventTime")
