"""Sequential kernels: plain Python state machines, the same for batch and streaming.

Each has ``feed(row) -> list of outputs`` and ``end() -> list of outputs``; all state is in the object's fields.
Prices and volumes of the book kernels are whole numbers of 1e-8; times are microseconds.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque

UNIT = 100_000_000
#: Amounts that are looked up one by one; of more that are near enough, the fills are gone through in order.
NEAR = 32


class Levels:
    """Volume per price of both sides, prices in order."""

    def __init__(self) -> None:
        self.volume: dict[str, dict[int, int]] = {"bid": {}, "ask": {}}
        self.prices: dict[str, list[int]] = {"bid": [], "ask": []}

    def put(self, side: str, price: int, volume: int) -> None:
        have, prices = self.volume[side], self.prices[side]
        if volume > 0:
            if price not in have:
                insort(prices, price)
            have[price] = volume
        elif have.pop(price, None) is not None:
            del prices[bisect_left(prices, price)]

    def best(self, side: str) -> int | None:
        p = self.prices[side]
        return (p[-1] if side == "bid" else p[0]) if p else None

    def outward(self, side: str):
        """(price, volume) from the best price on."""
        have = self.volume[side]
        for p in reversed(self.prices[side]) if side == "bid" else iter(self.prices[side]):
            yield p, have[p]


class Episodes:
    """Feeds level rows (ts, seed, side, price, volume) to a book; asks ``view`` after each episode.

    Seed rows set the book as it stood before the first episode; nothing is emitted for them.
    """

    def __init__(self, view) -> None:
        self.book, self.view, self.ts = Levels(), view, None
        self.ready = False

    def feed(self, row: tuple) -> list[tuple]:
        ts, seed, side, price, volume = row
        out = []
        if seed:
            self.book.put(side, price, volume)
            return out
        if not self.ready:
            self.view.begin(self.book)
            self.ready = True
        if self.ts is not None and ts != self.ts:
            out = self.view.after(self.ts, self.book)
        self.ts = ts
        self.book.put(side, price, volume)
        return out

    def end(self) -> list[tuple]:
        return self.view.after(self.ts, self.book) if self.ts is not None else []


class Spread:
    """(ts, bid price, bid volume, ask price, ask volume) whenever one of them changes."""

    def __init__(self) -> None:
        self.last: tuple = (None,) * 4

    def now(self, book: Levels) -> tuple:
        b, a = book.best("bid"), book.best("ask")
        return b, b and book.volume["bid"][b], a, a and book.volume["ask"][a]

    def begin(self, book: Levels) -> None:
        self.last = self.now(book)

    def after(self, ts: int, book: Levels) -> list[tuple]:
        now = self.now(book)
        if now == self.last:
            return []
        self.last = now
        return [(ts, *now)]


def effective_price(levels, volume: float) -> float | None:
    """The mean price of taking ``volume`` from the levels, the best first: 0 the best price, infinite all of them.

    None if the side is empty or doesn't hold that much.
    """
    if volume == 0:
        return next((p / UNIT for p, _ in levels), None)
    left, paid, taken = volume, 0.0, 0.0
    for p, v in levels:
        v = v / UNIT
        part = v if v < left else left
        paid += part * (p / UNIT)
        taken += part
        left -= part
        if left <= 0:
            return paid / taken
    return paid / taken if math.isinf(volume) and taken else None


class TradingPeriod:
    """(ts, bid price, ask price) to sell and buy ``volume``, whenever one moves by ``tolerance`` or more."""

    def __init__(self, volume: float = 0, tolerance: float = 1e-5) -> None:
        self.volume, self.tolerance, self.last = volume, tolerance, (0.0, 0.0)

    def now(self, book: Levels) -> tuple:
        return tuple(effective_price(book.outward(s), self.volume) for s in ("bid", "ask"))

    def begin(self, book: Levels) -> None:
        if book.prices["bid"] or book.prices["ask"]:
            self.last = self.now(book)

    def after(self, ts: int, book: Levels) -> list[tuple]:
        now = self.now(book)
        if all((a is None and b is None) or (a is not None and b is not None and abs(a - b) < self.tolerance) for a, b in zip(now, self.last, strict=True)):
            return []
        self.last = now
        return [(ts, *now)]


class Queues:
    """(ts, bid price, ask price, bid volumes, ask volumes) of the ticks ``first`` to ``last`` from the other side's best.

    Bid tick i covers [up(ask - i tick), up(ask - (i - 1) tick)) and ask tick i (down(bid + (i - 1) tick),
    down(bid + i tick)]; ``log`` measures ticks on the logarithm of the price. Without the other side all are zero.
    Prices are aligned to the tick, the bid downwards and the ask upwards.
    """

    def __init__(self, tick: float, first: int = 1, last: int = 3, log: bool = False) -> None:
        self.first, self.last, self.log, self.tick = first, last, log, tick

    def place(self, price: int) -> float:
        return math.log(price / UNIT) if self.log else price / UNIT

    def side(self, book: Levels, side: str) -> list[float]:
        n = self.last - self.first + 1
        out = [0.0] * n
        other = book.best("ask" if side == "bid" else "bid")
        if other is None:
            return out
        guard = 1e-9
        best = self.place(other)
        for p, v in book.outward(side):
            away = (best - self.place(p)) if side == "bid" else (self.place(p) - best)
            i = math.ceil(away / self.tick - guard)
            if i > self.last:
                break
            if i >= self.first:
                out[i - self.first] += v / UNIT
        return out

    def begin(self, book: Levels) -> None:
        pass

    def after(self, ts: int, book: Levels) -> list[tuple]:
        b, a = book.best("bid"), book.best("ask")
        down = lambda p: p if p is None else math.floor(p / UNIT / self.tick + 1e-6) * self.tick if not self.log else p / UNIT
        up = lambda p: p if p is None else math.ceil(p / UNIT / self.tick - 1e-6) * self.tick if not self.log else p / UNIT
        return [(ts, down(b), up(a), self.side(book, "bid"), self.side(book, "ask"))]


class Strategy:
    """The ideal positions over quotes (ts, bid, ask): commission ``phi`` each way, interest ``rho`` a second.

    Differences are of log prices. A long position opens at the lowest ask since the last one, once the bid covers
    interest and both commissions; it grows while the bid's gain beats the interest, and closes when turning short pays
    or holding costs more than opening again. Shorts mirror this. Crossed and half quotes are skipped.
    """

    def __init__(self, phi: float = 0.0, rho: float = 0.0) -> None:
        self.both, self.rho = 2 * max(phi, 0.0), max(rho, 0.0)
        self.long_start = self.short_start = self.long_end = self.short_end = None
        self.position = ""

    def cost(self, a: tuple, b: tuple) -> float:
        return self.rho * abs(a[0] - b[0]) / 1e6

    def feed(self, row: tuple) -> list[tuple]:
        ts, bid, ask = row
        if bid is None or ask is None or bid != bid or ask != ask or bid > ask or bid <= 0:
            return []
        bid, ask = (ts, math.log(bid), bid), (ts, math.log(ask), ask)
        if self.long_start is None:
            self.long_start, self.short_start = ask, bid
            return []
        out = []
        if self.position == "":
            if bid[1] - self.long_start[1] > self.cost(bid, self.long_start) + self.both:
                self.position, self.long_end, self.short_start = "long", bid, bid
            elif self.short_start[1] - ask[1] > self.cost(self.short_start, ask) + self.both:
                self.position, self.short_end, self.long_start = "short", ask, ask
            else:
                self.lower(ask)
                self.raise_(bid)
        elif self.position == "long":
            self.raise_(bid)
            if bid[1] - self.long_end[1] > self.cost(bid, self.long_end):
                self.long_end = self.short_start = bid
            elif self.short_start[1] - ask[1] > self.cost(self.short_start, ask) + self.both:
                out.append(self.closed())
                self.position, self.short_end, self.long_start = "short", ask, ask
            elif self.cost(ask, self.long_end) > self.both - (self.long_end[1] - ask[1]):
                out.append(self.closed())
                self.position, self.long_start = "", ask
        else:
            self.lower(ask)
            if self.short_end[1] - ask[1] > self.cost(self.short_end, ask):
                self.short_end = self.long_start = ask
            elif bid[1] - self.long_start[1] > self.cost(bid, self.long_start) + self.both:
                out.append(self.closed())
                self.position, self.long_end, self.short_start = "long", bid, bid
            elif self.cost(bid, self.short_end) > self.both - (bid[1] - self.short_end[1]):
                out.append(self.closed())
                self.position, self.short_start = "", bid
        return out

    def lower(self, ask: tuple) -> None:
        if ask[1] - self.long_start[1] < self.cost(ask, self.long_start):
            self.long_start = ask

    def raise_(self, bid: tuple) -> None:
        if self.short_start[1] - bid[1] < self.cost(self.short_start, bid):
            self.short_start = bid

    def closed(self) -> tuple:
        a, b = (self.long_start, self.long_end) if self.position == "long" else (self.short_start, self.short_end)
        return returns(a[0], a[2], b[0], b[2])

    def end(self) -> list[tuple]:
        return [self.closed()] if self.position else []


def returns(t0: int, p0: float, t1: int, p1: float) -> tuple:
    """(opened, open price, closed, close price, bps return, rate a second, log return)."""
    log = abs(math.log(p1) - math.log(p0))
    seconds = (t1 - t0) / 1e6
    rate = None if seconds <= 0 else math.expm1(log / seconds) if log / seconds < 700 else math.inf
    return t0, p0, t1, p1, round((p1 - p0) / p0 * 10000, 2), rate, log


class Draws:
    """Rises and falls of a price path (ts, price): a draw ends when the price turns by over ``epsilon`` in log terms.

    By default a turn's confirming price is no turning point of the next draw, and the last draw ends at the last
    price seen; ``strict`` takes the published definition, where draws meet at their extremes. With ``theta`` the turn
    that ends a draw falls with the seconds since the draw's last extreme, to epsilon / (1 + theta * seconds).
    """

    def __init__(self, epsilon: float, strict: bool = False, theta: float = 0.0) -> None:
        self.epsilon, self.strict, self.theta = epsilon, strict, theta
        self.start = self.turn = self.last = None

    def feed(self, row: tuple) -> list[tuple]:
        ts, price = row
        if price is None or price != price or price <= 0:
            return []
        now = (ts, price)
        if self.start is None:
            self.start = self.turn = self.last = now
            return []
        self.last = now
        if price == self.turn[1]:
            return []
        if self.turn == self.start or (price > self.turn[1]) == (self.turn[1] > self.start[1]):
            self.turn = now
        elif abs(math.log(price) - math.log(self.turn[1])) > self.epsilon / (1 + self.theta * (ts - self.turn[0]) / 1e6):
            out = [returns(*self.start, *self.turn)]
            self.start = self.turn
            self.turn = now if self.strict else self.start
            return out
        return []

    def end(self) -> list[tuple]:
        if self.start is None:
            return []
        stop = self.turn if self.strict else self.last
        return [returns(*self.start, *stop)] if stop != self.start else []


class Pending:
    """Fills of one side that wait, with the best price first and, within a price, the oldest.

    Prices are negated where the highest is best. Each fill lies in the queue of its price and in that of its amount and
    price; the queues drop at their heads what has met another or is too old, and fills of no price meet none.
    """

    def __init__(self, sign: int, age: int, unit: float) -> None:
        self.sign, self.age, self.unit = sign, age, unit
        self.line: deque[list] = deque()  # [row, place, waits], in order of arrival
        self.queues: dict[float, deque[list]] = {}
        self.keys: list[float] = []
        self.sized: dict[float | None, tuple[list[float], dict[float, deque[list]]]] = {}
        self.sizes: list[float] = []
        self.place = 0

    def put(self, row: tuple) -> None:
        key, size = self.sign * row[4], row[5]
        entry = [row, self.place, True]
        self.place += 1
        self.line.append(entry)
        if size not in self.sized:
            self.sized[size] = ([], {})
            if size is not None:
                insort(self.sizes, size)
        for keys, queues in ((self.keys, self.queues), self.sized[size]):
            if key not in queues:
                queues[key] = deque()
                insort(keys, key)
            queues[key].append(entry)

    def take(self, entry: list) -> None:
        entry[2] = False
        key, size = self.sign * entry[0][4], entry[0][5]
        for keys, queues in ((self.keys, self.queues), self.sized[size]):
            queue = queues[key]
            while queue and not queue[0][2]:
                queue.popleft()
            if not queue:
                del queues[key], keys[bisect_left(keys, key)]
        if not self.sized[size][0]:
            del self.sized[size]
            if size is not None:
                del self.sizes[bisect_left(self.sizes, size)]

    def expire(self, ts: int) -> None:
        while self.line and not (self.line[0][2] and ts - self.line[0][0][0] < self.age):
            entry = self.line.popleft()
            if entry[2]:
                self.take(entry)

    def fits(self, row: tuple, entry: list) -> bool:
        p = entry[0]
        maker = p if (p[7], p[1]) <= (row[7], row[1]) else row
        return row[5] is None or p[5] is None or abs(row[5] - p[5]) * maker[4] <= self.unit

    def first(self, row: tuple, keys: list[float], queues: dict[float, deque[list]], limit: float) -> list | None:
        """The best one of some queues that the row can meet up to a limit of the price."""
        for key in keys:
            if key > limit:
                return None
            for entry in queues[key]:
                if entry[2] and self.fits(row, entry):
                    return entry
        return None

    def best(self, row: tuple) -> list | None:
        """The entry that the row meets, if any."""
        limit, size = self.sign * row[4], row[5]
        if not self.keys or self.keys[0] > limit:
            return None
        if size is None:
            return self.first(row, self.keys, self.queues, limit)
        # the least price that can value a difference of amounts bounds it; fits() decides
        low = min(row[4], self.sign * self.keys[0])
        reach = self.unit / low if low > 0 else math.inf
        slack = reach * 1e-9 + abs(size) * 1e-9
        low, high = bisect_left(self.sizes, size - reach - slack), bisect_right(self.sizes, size + reach + slack)
        if high - low > NEAR:  # most of them fit, so the first that does comes early
            return self.first(row, self.keys, self.queues, limit)
        near: list[float | None] = self.sizes[low:high]
        if None in self.sized:
            near.append(None)
        found = None
        for s in near:
            entry = self.first(row, *self.sized[s], limit)
            if entry is not None:
                at = (self.sign * entry[0][4], entry[1])
                if found is None or at < found[0]:
                    found, limit = (at, entry), at[0]
        return found and found[1]


class Inference:
    """Trades from fills alone, rows (ts, order_id, event_no, side, price, fill, created): opposite fills paired greedily.

    A fill meets pending fills of the other side that are at most ``seconds`` old, reachable at its price, and equal to
    within one unit of the price scale in value: the best price first, then the oldest. An unknown fill meets any.
    The trade is at the maker's price; the maker is the order that was priced first.
    """

    def __init__(self, seconds: float = 0.5, scale: int = 2) -> None:
        age, unit = round(seconds * 1e6), 10.0**-scale
        self.pending = {"b": Pending(-1, age, unit), "s": Pending(1, age, unit)}

    def feed(self, row: tuple) -> list[tuple]:
        ts, order_id, event_no, side, price, fill, created, price_ts = row
        if price is None or not ((fill is not None and fill > 0) or (fill is None and not created)):
            return []
        for waiting in self.pending.values():
            waiting.expire(ts)
        other = self.pending["s" if side == "b" else "b"]
        entry = other.best(row)
        if entry is None:
            self.pending[side].put(row)
            return []
        other.take(entry)
        best = entry[0]
        maker, taker = (best, row) if (best[7], best[1]) <= (price_ts, order_id) else (row, best)
        amount = fill if fill is not None else best[5]
        buy, sell = (row, best) if side == "b" else (best, row)
        return [(ts, maker[4], amount, taker[3], buy[1], buy[2], sell[1], sell[2])]

    def end(self) -> list[tuple]:
        return []
