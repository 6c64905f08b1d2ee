"""Utterances of a stream of recognised texts, with timers that end what nothing follows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zeitband.operators.utterances import UTTERANCES, Open, Rules, ordered

from .state import needs_rocksdb

OPEN = "start long, seq long, at long, text string, seen long"


class UtteranceProcessor(StatefulProcessor):
    """The open utterance of a session, and a timer at the moment from which it counts as idle."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", OPEN)

    def _row(self, key: Any, made: tuple) -> Row:
        seq, start, end, text, why = made
        return Row(session=key[0], seq=seq, start_ms=start, end_ms=end, text=text, ended_by=why)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = Open(*self.state.get()) if self.state.exists() else None
        # Spark's own filter of late rows and its timers go by older watermarks in this call; the newest one decides.
        passed = timerValues.getCurrentWatermarkInMs()
        if now:
            self.handle.deleteTimer(now.seen + self.rules.idle_ms)
            if passed >= now.seen + self.rules.idle_ms:
                yield self._row(key, now.cut("idle"))
                now = None
        for r in sorted((r for r in rows if r["ts_ms"] > passed), key=lambda r: (r["ts_ms"], r["seq"])):
            made, now = self.rules.take(now, r["seq"], r["ts_ms"], r["text"], r["is_final"], r["is_end"])
            yield from (self._row(key, m) for m in made)
        if now:
            self.state.update(tuple(now))
            self.handle.registerTimer(now.seen + self.rules.idle_ms)
        else:
            self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            yield self._row(key, Open(*self.state.get()).cut("idle"))
            self.state.clear()

    def close(self) -> None:
        pass


def stream_spoken(results: DataFrame, longest_ms: int = 6000, shortest_ms: int = 100, idle_ms: int = 6000, late: str = "1 second", white: str | None = None) -> DataFrame:
    """What ``operators.utterances.spoken`` gives, of a stream (ts_ms in milliseconds since 1970).

    An open utterance is cut as soon as the watermark (``late`` behind the newest text of any session) passes the last
    sign of its session by ``idle_ms``, whether anything more comes in that session or not, or at once by a text with
    ``is_end``. Texts that the watermark has passed are dropped (it begins at 1970). What is open when the stream stops stays in the state.
    """
    needs_rocksdb(results.sparkSession)
    timed = ordered(results).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy("session").transformWithState(UtteranceProcessor(Rules(longest_ms, shortest_ms, idle_ms, white)), UTTERANCES, "Append", "EventTime")
