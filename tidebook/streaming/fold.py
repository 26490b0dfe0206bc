"""The sequential kernels on streams: the same classes as in batch, behind a reordering buffer."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string


def stream_fold(rows: DataFrame, key: list[str], time: str, order: list[str], feed: list[str], make: Callable, schema: str, delay: str = "2 minutes", grace_seconds: float = 0, idle_seconds: float | None = None) -> DataFrame:
    """key, late_us and what the kernel says, for a stream: rows wait until the watermark has passed them, then go in order.

    Rows wait for ``delay``. A row that comes when later ones have gone is a dead letter: it gives a row with its time in
    late_us and nulls, for up to ``grace_seconds`` more, which is how far Spark's watermark lies behind; what comes later
    still is dropped by Spark. late_us is null for what the kernel says.

    A key's state is its kernel and the rows that wait, so it is bounded by the kernel and the delay, not the stream. With
    ``idle_seconds`` a key that had no row for so long ends: what the kernel says at its end is given, and its state goes.
    ``order`` breaks ties of time, such as a priority of trades before book events.
    """
    out = StructType([*(rows.schema[k] for k in key), *_parse_datatype_string("late_us long, " + schema).fields])
    names = out.names
    width = len(order) + 1
    grace = round(grace_seconds * 1e6)
    nothing = (None,) * (len(names) - len(key) - 1)

    def step(now: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel, waiting, gone, last = pickle.loads(state.get[0]) if state.exists else (make(), [], -(1 << 62), -(1 << 62))
        made = []
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in frame[["_us", *order, *feed]].itertuples(index=False, name=None):
                if row[0] <= gone:
                    made.append((*now, row[0], *nothing))
                else:
                    waiting.append(row)
                    last = max(last, row[0])
        mark = state.getCurrentWatermarkMs() * 1000 + grace
        waiting.sort(key=lambda r: r[:width])
        ready = 0
        while ready < len(waiting) and waiting[ready][0] <= mark:
            gone = waiting[ready][0]
            made += [(*now, None, *m) for m in kernel.feed(tuple(waiting[ready][width:]))]
            ready += 1
        del waiting[:ready]
        if idle_seconds is not None and not waiting and mark > last + round(idle_seconds * 1e6):
            made += [(*now, None, *m) for m in kernel.end()]
            state.remove()
        else:
            state.update((pickle.dumps((kernel, waiting, gone, last)),))
            wake = waiting[0][0] if waiting else None if idle_seconds is None else last + round(idle_seconds * 1e6)
            if wake is not None:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (wake - grace) // 1000 + 1))
        if made:
            yield pd.DataFrame(made, columns=names).astype({"late_us": "Int64"})

    timed = rows.withColumn("_us", F.unix_micros(time)).withWatermark(time, f"{parse_seconds(delay) + grace_seconds} seconds")
    return timed.groupBy(*key).applyInPandasWithState(step, out, "body binary", "append", GroupStateTimeout.EventTimeTimeout)


def parse_seconds(delay: str) -> float:
    """Seconds of a delay such as 2 minutes."""
    number, unit = delay.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


class Release:
    """A kernel that only gives back what it gets: the reordering buffer alone."""

    def feed(self, row: tuple) -> list[tuple]:
        return [row]

    def end(self) -> list[tuple]:
        return []


class Assembly:
    """Rows of a flat book stream (us, order_id, price, amount) with the episode they belong to.

    An episode is a run of changes and the deletions after them: the next change after a deletion begins a new one.
    Its time is the last row's, and never before the episode before it.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.deleting, self.last = False, 0

    def feed(self, row: tuple) -> list[tuple]:
        out = []
        if row[2] != 0 and self.deleting:
            out = self.end()
        self.deleting = row[2] == 0 and bool(self.rows)
        self.rows.append(row)
        return out

    def end(self) -> list[tuple]:
        if not self.rows:
            return []
        self.last = max(self.last, max(r[0] for r in self.rows))
        out = [(self.last, n + 1, *r[1:]) for n, r in enumerate(self.rows)]
        self.rows, self.deleting = [], False
        return out


class Sessions:
    """The era of each row (us, ...): a new one begins after a gap of over ``seconds``."""

    def __init__(self, seconds: float) -> None:
        self.gap, self.era, self.last = round(seconds * 1e6), None, None

    def feed(self, row: tuple) -> list[tuple]:
        if self.last is None or row[0] - self.last > self.gap:
            self.era = row[0]
        self.last = row[0]
        return [(self.era, *row)]

    def end(self) -> list[tuple]:
        return []


class Chain:
    """An order's events linked as they come: rows (us, price, amount, deleted) to (us, event_no, price, amount, fill, status).

    The order's state is its last event; a deletion that follows nothing is dropped.
    """

    def __init__(self) -> None:
        self.number, self.price, self.amount = 0, None, None

    def feed(self, row: tuple) -> list[tuple]:
        us, price, amount, deleted = row
        if deleted:
            if not self.number:
                return []
            out = (us, self.number + 1, self.price, self.amount, None, "deleted")
            self.number, self.price, self.amount = 0, None, None
            return [out]
        self.number += 1
        fill = None if self.number == 1 else self.amount - amount
        self.price, self.amount = price, amount
        return [(us, self.number, price, amount, fill, "open")]

    def end(self) -> list[tuple]:
        return []


def sampled_levels(changes: DataFrame, seconds: int, delay: str = "2 minutes") -> DataFrame:
    """The last volume of each level per grid cell of a stream of level changes; empty cells give nothing."""
    cell = F.window("ts", f"{seconds} seconds")
    out = changes.withWatermark("ts", delay).groupBy(cell, "exchange", "pair", "side", "price").agg(F.max_by("volume", "ts").alias("volume"))
    return out.select("exchange", "pair", F.col("window.end").alias("ts"), "side", "price", "volume")
