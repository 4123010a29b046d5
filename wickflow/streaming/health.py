"""Heartbeats as they come: a bot that falls silent, and the progress of the engine's own queries.

A keyed timer per bot is set by each beat and runs by the clock; when it fires
before the next beat, the bot is stale, once, until it beats again. The listener
turns the progress of streaming queries into heartbeats of the same form, so one
watch covers both.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from wickflow.schemas import HEARTBEAT
from wickflow.scratch import ship, ship_to_driver
from wickflow.streaming.trading import use_rocksdb

#: Fixed value: silence after which a bot counts as stale.
STALE_SECONDS = 90
WATCH = "bot_id string, state string, ts bigint, pid int, silent_ms bigint"


class Watch(StatefulProcessor):
    """A timer per bot: rows ``alive`` when a bot is new or back, ``stale`` when its time is up."""

    def __init__(self, seconds: float) -> None:
        self.limit = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint, pid int, seen bigint, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beat = max(((int(r.ts), int(r.pid) if r.pid == r.pid and r.pid is not None else 0) for f in rows for r in f.itertuples()))
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.last.get() if self.last.exists() else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.limit)
        beat = max(beat, held[:2]) if held else beat
        self.last.update((*beat, now, False))
        if held is None or held[3]:
            yield pd.DataFrame([(key[0], "alive", *beat, 0)], columns=[c.split()[0] for c in WATCH.split(", ")], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, pid, seen, _ = self.last.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if now - seen >= self.limit:
            self.last.update((ts, pid, seen, True))
            yield pd.DataFrame([(key[0], "stale", ts, pid, now - seen)], columns=[c.split()[0] for c in WATCH.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def watch(heartbeats: DataFrame, seconds: float = STALE_SECONDS) -> DataFrame:
    """Streamed heartbeats to changes of state: a row when a bot appears, falls silent for ``seconds`` and comes back."""
    use_rocksdb(heartbeats.sparkSession)
    ship(heartbeats.sparkSession)
    ship_to_driver(heartbeats.sparkSession)
    return heartbeats.select(*[c.split()[0] for c in HEARTBEAT.split(", ")]).groupBy("bot_id").transformWithStateInPandas(Watch(seconds), WATCH, "append", "ProcessingTime")


class Beats(StreamingQueryListener):
    """Hands ``put`` a heartbeat for every start, batch and end of a streaming query."""

    def __init__(self, put: Callable[[dict], None], clock: Callable[[], int]) -> None:
        self.put, self.clock = put, clock

    def _beat(self, query: str, status: str, note: dict) -> None:
        self.put({"bot_id": query, "ts": self.clock(), "pid": 0, "status": status, "note": json.dumps(note)})

    def onQueryStarted(self, event) -> None:
        self._beat(event.name or str(event.id), "started", {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._beat(p.name or str(p.id), "running", {"batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._beat(str(event.id), "idle", {})

    def onQueryTerminated(self, event) -> None:
        self._beat(str(event.id), "failed" if event.exception else "stopped", {"error": (event.exception or "")[:500]})
