"""How far a stream lags behind: reports when the rows that wait grow, and when they are fewer again."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger("tidebook.streaming")


class Backlog:
    """Says when a number passes ``factor`` times the last one reported, upwards, or falls below that part of it."""

    def __init__(self, factor: float = 1.25, least: int = 1000):
        self.factor, self.least, self.reported = factor, least, 0

    def feed(self, waiting: int) -> bool:
        up = waiting >= self.least and waiting > self.reported * self.factor
        down = self.reported >= self.least and waiting * self.factor < self.reported
        if up or down:
            self.reported = waiting
        return up or down


class BacklogListener(StreamingQueryListener):
    """Reports, per query, the rows that its state and watermark hold back, with its input and processing rates.

    Add it with ``spark.streams.addListener``. ``report(name, waiting, input rate, processing rate)`` logs by default.
    """

    def __init__(self, factor: float = 1.25, least: int = 1000, report: Callable[[str, int, float, float], None] | None = None):
        self.make = lambda: Backlog(factor, least)
        self.report = report or (lambda name, waiting, came, went: log.warning("%s: %d rows wait, %.0f come and %.0f go a second", name, waiting, came, went))
        self.queries: dict[str, Backlog] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.queries[str(event.id)] = self.make()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        waiting = sum(s.numRowsTotal for s in p.stateOperators)
        if self.queries.setdefault(str(p.id), self.make()).feed(waiting):
            self.report(p.name or str(p.id), waiting, p.inputRowsPerSecond, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.queries.pop(str(event.id), None)
