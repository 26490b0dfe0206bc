"""The client: one object over stored level-3 events and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import grid as G
from tidebook.operators import analysis, book, depth, events, repair, replay

#: Instruments: decimals of price and amount. Fixed values.
PAIRS = {
    "BTCUSD": (2, 8), "LTCUSD": (2, 8), "ETHUSD": (2, 8), "XRPUSD": (5, 8), "BCHUSD": (2, 8), "BTCEUR": (2, 8), "LTCBTC": (8, 8), "ETHBTC": (8, 8),
}
#: How far a microtimestamp may be moved forward, in seconds.
MAX_MOVE = {"bitstamp": 45, "bitfinex": 5}


#: Months and seconds that a ranged spread may span at most. A fixed value.
LONGEST = (1, 60)
DEPTH_FRAME = {"ts": ("timestamp",), "price": ("decimal", "double", "float", "int", "bigint"), "volume": ("decimal", "double", "float", "int", "bigint"), "side": ("string",)}
PERIOD_FRAME = {"ts": ("timestamp",), "bid_price": ("decimal", "double", "float"), "ask_price": ("decimal", "double", "float")}


def moment(t) -> Column:
    """A column, a datetime, or text in UTC."""
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp") if not isinstance(t, str) else F.lit(t + ("" if t.endswith("Z") else "Z")).cast("timestamp")


def check_frequency(seconds: float | None) -> None:
    if seconds is not None and not (0 < seconds < 3600 or seconds % 60 == 0 and seconds > 0):
        raise ValueError("a frequency is under an hour, or whole minutes")


def check_range(what: str, start, end) -> Column:
    """True, or an error of the query: a range ends after its start and spans a month and a minute at most."""
    start, end = moment(start), moment(end)
    month, minute = LONGEST
    longest = F.add_months(start, month).cast("timestamp") + (start - F.date_trunc("day", start)) + F.expr(f"interval {minute} seconds")
    wrong = F.concat(F.lit(f"{what}: "), start.cast("string"), F.lit(" to "), end.cast("string"), F.lit(" is longer than a month and a minute"))
    return F.when(longest < end, F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))


def check_frame(rows: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows, if they have these columns of these kinds."""
    kinds = dict(rows.dtypes)
    for name, fine in columns.items():
        if name not in kinds or not kinds[name].startswith(fine):
            raise TypeError(f"{name} must be {' or '.join(fine)}, not {kinds.get(name, 'missing')}")
    return rows


class Engine:
    """Queries of one exchange and pair over a range. level3 as chains.build gives it, matches as an exchange reports trades.

    eras(exchange, pair, era) is the catalogue; without it the eras are looked up among all events. Ranged queries read
    the book at the start and the range's events, whose filters reach the scan.
    """

    def __init__(self, level3: DataFrame, matches: DataFrame | None = None, eras: DataFrame | None = None):
        self.level3, self.matches, self.eras = level3, matches, eras

    @staticmethod
    def open(spark: SparkSession, path: str) -> Engine:
        """Over a folder that holds level3, and matches and eras if there are any, as the store writes them."""
        from tidebook.sources import store

        there = lambda name: store.exists(spark, f"{path}/{name}")
        rows = lambda name: store.scan(spark, f"{path}/{name}") if there(name) else None
        return Engine(store.scan(spark, f"{path}/level3"), rows("matches"), spark.read.parquet(f"{path}/eras") if there("eras") else None)

    @staticmethod
    def _pick(rows: DataFrame, exchange: str | None, pair: str | None) -> DataFrame:
        if exchange:
            rows = rows.where(F.col("exchange") == exchange.lower())
        if pair:
            rows = rows.where(F.col("pair") == pair.upper())
        return rows

    def _of(self, exchange: str | None, pair: str | None) -> DataFrame:
        return self._pick(self.level3, exchange, pair)

    def _eras(self, exchange, pair) -> DataFrame | None:
        return None if self.eras is None else self._pick(self.eras, exchange, pair)

    def _changes(self, exchange, pair, frequency) -> DataFrame:
        check_frequency(frequency)
        rows = depth.continuous(self._of(exchange, pair), frequency)
        return rows.withColumn("side", G.side_label(F.col("side")))

    def _view(self, view, source, pair, start, end, frequency) -> DataFrame:
        """A view of the book over a frame of level changes, or over an exchange and pair, all of it or a range."""
        if isinstance(source, DataFrame):
            rows = view(check_frame(source, DEPTH_FRAME))
            return rows if start is None else self._within(rows, start, end)
        check_frequency(frequency)
        if start is None:
            return view(self._changes(source, pair, frequency))
        rows = replay.within(view, self._of(source, pair), moment(start), moment(end), frequency, self._eras(source, pair))
        return rows if frequency else self._within(rows, start, end)

    @staticmethod
    def _within(rows: DataFrame, start, end, column: str = "ts") -> DataFrame:
        return rows.where((F.col(column) >= moment(start)) & (F.col(column) < moment(end)))

    def available_exchanges(self) -> DataFrame:
        return self.level3.select("exchange").distinct()

    def available_pairs(self, exchange: str) -> DataFrame:
        return self._of(exchange, None).select("pair").distinct()

    def available_period(self, exchange: str, pair: str) -> DataFrame:
        return self._of(exchange, pair).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))

    def data_overview(self, exchange: str | None = None, pair: str | None = None, r: int = 3) -> DataFrame:
        return events.data_overview(events.era_table(self._of(exchange, pair)), r)

    def intervals(self, exchange: str, pair: str, start=None, end=None, least_seconds: float = 0) -> DataFrame:
        rows = events.availability(events.era_table(self._of(exchange, pair)), least_seconds)
        if start is not None:
            rows = rows.where(F.col("interval_end") > moment(start)).withColumn("interval_start", F.greatest("interval_start", moment(start)))
        if end is not None:
            rows = rows.where(F.col("interval_start") < moment(end)).withColumn("interval_end", F.least("interval_end", moment(end)))
        return rows

    def depth(self, exchange: str, pair: str, start, end, frequency: float | None = None) -> DataFrame:
        check_frequency(frequency)
        return depth.depth(self._of(exchange, pair), moment(start), moment(end), frequency, eras=self._eras(exchange, pair))

    def order_book(self, exchange: str, pair: str, at, max_levels: int | None = None, bps_range: float | None = None, min_bid=None, max_ask=None) -> tuple[DataFrame, DataFrame]:
        """(bids, asks)."""
        rows = book.order_book(self._of(exchange, pair), moment(at), max_levels, bps_range, min_bid, max_ask)
        return rows.where("side = 'b'"), rows.where("side = 's'")

    def spread(self, source: DataFrame | str, pair: str | None = None, start=None, end=None, frequency: float | None = None, skip_crossed: bool = True, complete_cases: bool = True) -> DataFrame:
        """Of a frame of level changes, or of an exchange and pair: its changes in a range, or with a start alone the spread just before it."""
        if start is not None and end is None:
            rows = depth.starting_spread(self._of(source, pair), moment(start), frequency, self._eras(source, pair))
        else:
            rows = self._view(replay.spread, source, pair, start, end, frequency)
            if start is not None:
                rows = rows.where(check_range("spread", start, end))
        if complete_cases:
            rows = rows.dropna(subset=["best_bid_price", "best_ask_price"])
        return rows.where(~F.coalesce(F.col("best_bid_price") > F.col("best_ask_price"), F.lit(False))) if skip_crossed else rows

    def trading_period(self, source: DataFrame | str, pair: str | None = None, start=None, end=None, volume: float = 0, frequency: float | None = None) -> DataFrame:
        return self._view(lambda rows: replay.trading_period(rows, volume), source, pair, start, end, frequency)

    def queues(self, source: DataFrame | str, pair: str | None = None, start=None, end=None, tick: float = 1.0, first: int = 1, last: int = 3, log: bool = False, frequency: float | None = None) -> DataFrame:
        rows = self._view(lambda rows: replay.queues(rows, tick, first, last, log), source, pair, start, end, frequency)
        return rows.select("exchange", "pair", "ts", "bid_price", "ask_price", *(F.col(s)[i].alias(f"{s}{first + i}") for s in "ba" for i in range(last - first + 1)))

    def trading_strategy(self, source: DataFrame | str, pair: str | None = None, start=None, end=None, phi: float = 0, rho: float = 0, volume: float = 0, mode: str = "bid-ask", frequency: float | None = None) -> DataFrame:
        quotes = check_frame(source, PERIOD_FRAME) if isinstance(source, DataFrame) else self.trading_period(source, pair, start, end, volume, frequency)
        return replay.trading_strategy(quotes, phi, rho, mode)

    def epsilon_drawupdowns(self, quotes: DataFrame, epsilon: float, strict: bool = False) -> DataFrame:
        return replay.drawupdowns(check_frame(quotes, PERIOD_FRAME), epsilon, strict)

    def depth_changes(self, rows: DataFrame) -> DataFrame:
        check_frame(rows, DEPTH_FRAME)
        quotes = replay.spread(rows)
        return events.last_known(depth.chain_ids(depth.signed_changes(rows)), quotes, ["best_bid_price", "best_ask_price"])

    def depth_resample(self, rows: DataFrame, tick=0, frequency: float | None = None, start=None, end=None) -> DataFrame:
        return depth.resample(rows, tick, frequency, None if start is None else moment(start), None if end is None else moment(end))

    def depth_summary(self, exchange: str, pair: str, start, end, frequency: float | None = None, step: int = 25, most: int = 500) -> DataFrame:
        """Bands of the book after each episode of the range, one row each; of episodes within 10 microseconds the last."""
        check_frequency(frequency)
        scale = PAIRS.get(pair.upper(), (2, 8))[0]
        rows = replay.changes_from(self._of(exchange, pair), moment(start), moment(end), frequency, self._eras(exchange, pair))
        bands = depth.summary_by_episode(rows, step, most, scale).where(F.col("ts") >= G.floor_to(moment(start), frequency))
        return depth.summary_pivot(depth.last_per_instant(bands), step, most)

    def events(self, exchange: str, pair: str, start, end) -> DataFrame:
        rows, eras = self._of(exchange, pair), self._eras(exchange, pair)
        spread = replay.spread_between(rows, moment(start), F.timestamp_micros(F.unix_micros(moment(end)) + 1), None, eras)
        matches = None if self.matches is None else self._pick(self.matches, exchange, pair)
        return events.classify(rows, spread, moment(start), moment(end), matches, eras).orderBy("event_id")

    def trades(self, exchange: str, pair: str, start, end) -> DataFrame:
        if self.matches is None:
            raise ValueError("this engine has no trades")
        return events.trades(self._pick(self.matches, exchange, pair), moment(start), moment(end))

    def export(self, exchange: str, pair: str, start, end) -> DataFrame:
        return events.export(self._of(exchange, pair), moment(start), moment(end))

    def position_trellis(self, positions: DataFrame, quotes: DataFrame, around_seconds: int = 0) -> DataFrame:
        return analysis.position_trellis(positions, quotes, around_seconds)

    def time_jumps(self, rows: DataFrame, exchange: str) -> DataFrame:
        """Events of an exchange (ts, original_ts) that were moved back, or further forward than it allows."""
        return repair.time_jumps(rows.where(F.col("exchange") == exchange.lower()), MAX_MOVE[exchange.lower()])

    def repaired(self, raw: DataFrame, exchange: str) -> DataFrame:
        """Raw events of an exchange with its crossed books mended, moving events no further than it allows."""
        return repair.fix_crossed_orders(raw.where(F.col("exchange") == exchange.lower()), MAX_MOVE[exchange.lower()])
