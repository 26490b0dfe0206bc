"""Runs kernels over ordered rows, a state per key, in bounded memory; and books in time chunks, all in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidebook.functions import grid as G
from tidebook.operators import depth
from tidebook.operators import kernels as K

UNIT = K.UNIT


def fold(rows: DataFrame, key: list[str], order: list, feed: list[str], make: Callable, schema: str) -> DataFrame:
    """key and what the kernel says, for each key's rows in order.

    Rows are dealt by the key and sorted in Spark (which spills); the kernel sees them one after the other, so a task
    holds a state and a batch, never a key's rows.
    """
    out = StructType([*(rows.schema[k] for k in key), *_parse_datatype_string(schema).fields])
    columns = [*key, *feed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(out)
        state, now, made = None, None, []
        width = len(key)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:width] != now:
                    if state is not None:
                        made += [now + x for x in state.end()]
                    now, state = row[:width], make()
                made += [now + x for x in state.feed(row[width:])]
            if made:
                yield batch_of(made, kind)
                made = []
        if state is not None and (last := [now + x for x in state.end()]):
            yield batch_of(last, kind)

    def batch_of(made: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kind, strict=True)], schema=kind)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).select(*columns).mapInArrow(run, out)


def seeded(rows: DataFrame, chunk_seconds: int) -> DataFrame:
    """Level changes with ``chunk`` (of time) and, for each chunk, seed rows: the levels that stand when it begins.

    A level's last volume in a chunk is carried to every later chunk up to that of its next change.
    """
    key = ["exchange", "pair", "side", "price"]
    chunk = F.floor(F.unix_micros("ts") / F.lit(chunk_seconds * 1_000_000)).cast("long")
    rows = rows.select(*key, "ts", "volume").withColumn("chunk", chunk)
    last = rows.groupBy(*key, "chunk").agg(F.max_by("volume", "ts").alias("volume"))
    ends = rows.groupBy("exchange", "pair").agg(F.max("chunk").alias("_end"))
    w = Window.partitionBy(*key).orderBy("chunk")
    last = last.withColumn("_next", F.lead("chunk").over(w)).where("volume > 0").join(ends, ["exchange", "pair"])
    last = last.withColumn("_to", F.coalesce("_next", "_end")).where("_to > chunk")
    seeds = last.select(*key, F.explode(F.sequence(F.col("chunk") + 1, F.col("_to"))).alias("chunk"), "volume", F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("seed"))
    return rows.withColumn("seed", F.lit(False)).unionByName(seeds)


def over_books(rows: DataFrame, view: Callable, schema: str, chunk_seconds: int = 86_400) -> DataFrame:
    """What a view of the book says after each episode of level changes (exchange, pair, ts, side, price, volume).

    Chunks of time run in parallel from their own seeds, and give the same rows whatever their length. A chunk without
    changes gives none.
    """
    scaled = lambda c: F.round(F.col(c) * UNIT).cast("long")
    rows = seeded(rows, chunk_seconds).select("exchange", "pair", "chunk", F.unix_micros("ts").alias("us"), "seed", "side", scaled("price").alias("price"), scaled("volume").alias("volume"))
    out = fold(rows, ["exchange", "pair", "chunk"], [F.col("seed").desc(), "us", "side", "price"], ["us", "seed", "side", "price", "volume"], lambda: K.Episodes(view()), schema)
    return out.drop("chunk")


def _unscale(c: str) -> Column:
    return (F.col(c).cast("decimal(20,0)") * F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(18,8)").alias(c)


def spread(rows: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """exchange, pair, ts, best_bid_price, best_bid_volume, best_ask_price, best_ask_volume whenever one changes."""
    names = ["best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume"]
    out = over_books(rows, K.Spread, "us long, " + ", ".join(f"{c} long" for c in names), chunk_seconds)
    return out.select("exchange", "pair", F.timestamp_micros("us").alias("ts"), *map(_unscale, names))


def changes_from(level3: DataFrame, start: Column, end: Column, frequency: float | None = None, eras: DataFrame | None = None) -> DataFrame:
    """Level changes of a range (side bid or ask) behind the levels that stand at its start, put 1 microsecond before it.

    What a view of the book says over these rows from ``start`` on is what it says over all history, and only the book
    at the start and the events of the range are read.
    """
    begin = G.floor_to(start, frequency)
    # sampled, the range's first cell holds the events before its instant, and changes begin a cell earlier
    standing = depth.at(level3, begin - F.expr(f"interval {round(frequency * 1e6)} microseconds"), False, eras) if frequency else depth.at(level3, begin, True, eras)
    opening = standing.drop("era").withColumn("ts", begin - F.expr("interval 1 microsecond"))
    rows = depth.between(level3, start, end, frequency, eras).drop("era").unionByName(opening)
    return rows.withColumn("side", G.side_label(F.col("side")))


def within(view: Callable[[DataFrame], DataFrame], level3: DataFrame, start: Column, end: Column, frequency: float | None = None, eras: DataFrame | None = None) -> DataFrame:
    """What a view says in a range of level-3 events, such as ``spread`` or a trading period; it sees no other events."""
    return view(changes_from(level3, start, end, frequency, eras)).where(F.col("ts") >= G.floor_to(start, frequency))


def spread_between(level3: DataFrame, start: Column, end: Column, frequency: float | None = None, eras: DataFrame | None = None) -> DataFrame:
    """spread() of [start, end)."""
    return within(spread, level3, start, end, frequency, eras)


def trading_period(rows: DataFrame, volume: float = 0, tolerance: float = 1e-5, chunk_seconds: int = 86_400) -> DataFrame:
    """exchange, pair, ts, bid_price, ask_price: the effective prices to sell and buy ``volume``."""
    out = over_books(rows, lambda: K.TradingPeriod(volume, tolerance), "us long, bid_price double, ask_price double", chunk_seconds)
    return out.select("exchange", "pair", F.timestamp_micros("us").alias("ts"), "bid_price", "ask_price")


def queues(rows: DataFrame, tick: float, first: int = 1, last: int = 3, log: bool = False, chunk_seconds: int = 86_400) -> DataFrame:
    """exchange, pair, ts, bid_price, ask_price, b and a (volumes per tick), one row per episode."""
    out = over_books(rows, lambda: K.Queues(tick, first, last, log), "us long, bid_price double, ask_price double, b array<double>, a array<double>", chunk_seconds)
    return out.select("exchange", "pair", F.timestamp_micros("us").alias("ts"), "bid_price", "ask_price", "b", "a")


POSITION = "opened_us long, open_price double, closed_us long, close_price double, bps_return double, rate double, log_return double"


def _positions(out: DataFrame) -> DataFrame:
    return out.withColumn("opened_at", F.timestamp_micros("opened_us")).withColumn("closed_at", F.timestamp_micros("closed_us")).drop("opened_us", "closed_us")


def trading_strategy(quotes: DataFrame, phi: float = 0.0, rho: float = 0.0, mode: str = "bid-ask") -> DataFrame:
    """Ideal positions over quotes(exchange, pair, ts, bid_price, ask_price); mode ``mid-price`` trades at the mean."""
    if mode not in ("bid-ask", "mid-price"):
        raise ValueError("mode is bid-ask or mid-price")
    bid, ask = F.col("bid_price"), F.col("ask_price")
    if mode == "mid-price":
        bid = ask = (F.col("bid_price") + F.col("ask_price")) / 2
    rows = quotes.select("exchange", "pair", F.unix_micros("ts").alias("us"), bid.cast("double").alias("bid"), ask.cast("double").alias("ask"))
    return _positions(fold(rows, ["exchange", "pair"], ["us"], ["us", "bid", "ask"], lambda: K.Strategy(phi, rho), POSITION))


def drawupdowns(quotes: DataFrame, epsilon: float, strict: bool = False, theta: float = 0.0) -> DataFrame:
    """Rises and falls of the mid price of quotes(exchange, pair, ts, bid_price, ask_price); ``theta`` lets the threshold fall with time."""
    rows = quotes.select("exchange", "pair", F.unix_micros("ts").alias("us"), ((F.col("bid_price") + F.col("ask_price")) / 2).cast("double").alias("price"))
    return _positions(fold(rows, ["exchange", "pair"], ["us"], ["us", "price"], lambda: K.Draws(epsilon, strict, theta), POSITION))


def infer_trades(level3: DataFrame, seconds: float = 0.5, scale: int = 2) -> DataFrame:
    """Trades from the fills of level-3 events alone.

    A venue's fills are one sequence, since each may meet any that is pending: a task per venue, in memory that follows
    the fills of the last ``seconds``. A fill is looked up by its amount and price among the pending ones, so its time
    doesn't follow their number. Events without a fill don't come along, nor those without a price.
    """
    level3 = level3.where("price is not null").where((F.col("fill") > 0) | F.col("fill").isNull() & ~((F.col("event_no") == 1) & ~F.col("deleted")))
    rows = level3.select(
        "exchange", "pair", F.unix_micros("ts").alias("us"), "order_id", "event_no", "side", F.col("price").cast("double").alias("price"),
        F.col("fill").cast("double").alias("fill"), ((F.col("event_no") == 1) & ~F.col("deleted")).alias("created"), F.unix_micros("price_ts").alias("price_us"),
    )
    out = fold(
        rows, ["exchange", "pair"], ["us", "order_id", "event_no"], ["us", "order_id", "event_no", "side", "price", "fill", "created", "price_us"],
        lambda: K.Inference(seconds, scale), "us long, price double, amount double, side string, buy_order_id long, buy_event_no int, sell_order_id long, sell_event_no int",
    )
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")
