"""Due windows on a stream: each game's run windows, announced once, when event time reaches them.

Rows say when a game starts; a later row may move it.  The state of a game is its start and what was announced; a
timer stands at the opening of its next window, so nothing is looked at until the watermark comes there.  A window
that had closed before event time reached it is told as missed.  State of a game ends with its last window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldmark.operators.logs import RUN_WINDOWS

TOLD = "game_id string, run_type string, status string, opens timestamp, closes timestamp, told_at timestamp"
#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (run type, opens, closes): milliseconds before the start.
SPANS = [(name, int(opens.total_seconds() * 1000), int(closes.total_seconds() * 1000)) for name, opens, closes in RUN_WINDOWS]


class DueWindows(StatefulProcessor):
    """Announces the windows of one game."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at long, said long")
        self.told = handle.getMapState("told", "run_type string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.start.get() if self.start.exists() else None
        newest = (held[1], held[0]) if held is not None else None
        for frame in rows:
            said = frame["said_at"].astype("datetime64[ms]").astype("int64")
            at = frame["kickoff_utc"].astype("datetime64[ms]").astype("int64")
            newest = max([*zip(said, at, strict=True), *([newest] if newest else [])])
        if newest is None:
            return
        if held is None or held[0] != newest[1]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.start.update((int(newest[1]), int(newest[0])))
        yield from self._announce(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._announce(key, timerValues.getCurrentWatermarkInMs())

    def _announce(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Tell what has opened by now, and set a timer for what opens next."""
        if not self.start.exists():
            return
        start = int(self.start.get()[0])
        out, following = [], []
        for name, ahead, until in SPANS:
            if self.told.containsKey((name,)):
                continue
            opens, closes = start - ahead, start - until
            if now < opens:
                following.append(opens)
                continue
            self.told.updateValue((name,), (now,))
            out.append((key[0], name, "due" if now < closes else "missed", opens, closes, now))
        if following:
            self.handle.registerTimer(min(following))
        if out:
            frame = pd.DataFrame(out, columns=["game_id", "run_type", "status", "opens", "closes", "told_at"])
            for c in ("opens", "closes", "told_at"):
                frame[c] = pd.to_datetime(frame[c], unit="ms")
            yield frame

    def close(self) -> None:
        pass


def due_windows_stream(schedule: DataFrame, late: str = "0 seconds") -> DataFrame:
    """TOLD of a stream of (game_id, kickoff_utc, said_at); said_at is event time and may be late by `late`."""
    spark = schedule.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = schedule.select("game_id", "kickoff_utc", "said_at").withWatermark("said_at", late)
    return timed.groupBy("game_id").transformWithStateInPandas(DueWindows(), TOLD, "append", "EventTime")


def schedule_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Schedule rows as they are appended under the path, `files` files a batch."""
    return spark.readStream.schema("game_id string, kickoff_utc timestamp, said_at timestamp").option("maxFilesPerTrigger", files).json(path)
