"""Progress of a job as it runs: totals that Spark observes on the way, in batch and in streams, without a pass of their own."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def totals(order: str) -> dict[str, Column]:
    """What is observed of rows: their number, and the first and the last value of the column that orders them."""
    return {"rows": F.count(F.lit(1)), "first": F.min(order), "last": F.max(order)}


def observed(frame: DataFrame, name: str, order: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, Observation | None]:
    """frame as it is, and its totals, which the next action on it fills in; `more` adds aggregates of one's own.

    Of a stream, the totals of each micro-batch come to a `StreamProgress` under that name instead. Rows of null order count; an
    empty table has 0 rows and null ends. A frame that the action doesn't read whole (a limit) counts what was read.
    """
    wanted = [c.alias(n) for n, c in {**totals(order), **(more or {})}.items()]
    if frame.isStreaming:
        return frame.observe(name, *wanted), None
    watch = Observation(name)
    return frame.observe(watch, *wanted), watch


class StreamProgress(StreamingQueryListener):
    """The running totals of a stream that is observed under a name: rows are added up over micro-batches, ends are widened.

    A listener of the session: spark.streams.addListener(it). `share` tells how far a job of a known number of rows has come, from 0 to 100.
    """

    def __init__(self, name: str):
        self.name, self.rows, self.first, self.last, self.batches = name, 0, None, None, 0
        self.ended = threading.Event()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        with self.lock:
            self.batches += 1
            self.rows += found["rows"]
            ends = [v for v in (self.first, found["first"]) if v is not None]
            self.first = min(ends) if ends else None
            ends = [v for v in (self.last, found["last"]) if v is not None]
            self.last = max(ends) if ends else None

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def share(self, expected: int) -> int:
        """Whole percent of the expected rows, 99 at most until all have come."""
        with self.lock:
            return 100 if self.rows >= expected else min(99, self.rows * 100 // max(1, expected))
