"""Order-book snapshots: the orders alive at an instant, their maker and crossed flags, and liquidity by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import AMOUNT, PRICE, tick_ceil, tick_floor
from tidebook.operators.depth import era_at, standing

BOOK = ("exchange", "pair", "era")


def snapshot(level3: DataFrame, ts: Column, before: bool = False, eras: DataFrame | None = None) -> DataFrame:
    """The events that stand in the book at ts (``before``: just before it), of the era that holds ts."""
    return standing(level3, ts, before).join(era_at(level3 if eras is None else eras, ts), ["exchange", "pair", "era"])


def with_flags(book: DataFrame, strict: bool = False) -> DataFrame:
    """book with is_maker and is_crossed, within each exchange, pair and era.

    A bid is a maker if no ask whose price was set before or with it is below it (``strict``: below or equal); asks
    alike. It is crossed if an ask set after or with it is below it. The order is (price_ts, ts), peers included.
    """
    w = Window.partitionBy(*BOOK)
    earlier, later = w.orderBy("price_ts", "ts"), w.orderBy(F.col("price_ts").desc(), F.col("ts").desc())
    ask = F.when((F.col("side") == "s") & (F.col("amount") > 0), F.col("price"))
    bid = F.when((F.col("side") == "b") & (F.col("amount") > 0), F.col("price"))
    best_ask, best_bid = F.min(ask).over(earlier), F.max(bid).over(earlier)
    above = (F.col("price") < best_ask) if strict else (F.col("price") <= best_ask)
    below = (F.col("price") > best_bid) if strict else (F.col("price") >= best_bid)
    maker = F.coalesce(F.when(F.col("side") == "b", above).otherwise(below), F.lit(True))
    crossed = F.when(F.col("side") == "b", F.col("price") > F.min(ask).over(later)).otherwise(F.col("price") < F.max(bid).over(later))
    return book.withColumn("is_maker", maker).withColumn("is_crossed", F.coalesce(crossed, F.lit(False)))


def as_arrays(book: DataFrame) -> DataFrame:
    """One row per book: ts (of its last event) and its orders in price-time order."""
    order = F.struct("price", "ts", "order_id", "event_no", "side", "amount")
    return book.groupBy(*BOOK).agg(F.max("ts").alias("ts"), F.sort_array(F.collect_list(order)).alias("orders"))


def order_book(level3: DataFrame, ts: Column, max_levels: int | None = None, bps_range: float | None = None, min_bid=None, max_ask=None, before: bool = False) -> DataFrame:
    """Makers at ts with liquidity (volume summed from the best price), bps from the best, and the level's number."""
    makers = with_flags(snapshot(level3, ts, before)).where("is_maker and amount > 0")
    bid = F.col("side") == "b"
    key = F.when(bid, -F.col("price")).otherwise(F.col("price"))
    side = Window.partitionBy(*BOOK, "side")
    way = side.orderBy(key, "price_ts", "ts", "order_id")
    best = F.when(bid, F.max("price").over(side)).otherwise(F.min("price").over(side))
    rows = makers.withColumn("best", best).withColumn("liquidity", F.sum("amount").over(way.rowsBetween(Window.unboundedPreceding, 0)).cast(AMOUNT))
    rows = rows.withColumn("bps", F.round(F.abs(F.col("price") - F.col("best")) / F.col("best") * 10000, 2).cast("double"))
    rows = rows.withColumn("level", F.dense_rank().over(side.orderBy(key)))
    if max_levels is not None:
        rows = rows.where(F.col("level") <= max_levels)
    if bps_range is not None:
        rows = rows.where(F.col("bps") <= bps_range)
    if min_bid is not None:
        rows = rows.where(~bid | (F.col("price") >= F.lit(min_bid)))
    if max_ask is not None:
        rows = rows.where(bid | (F.col("price") <= F.lit(max_ask)))
    return rows


def check_takers(book: DataFrame) -> DataFrame:
    """book, failing if an order that isn't a maker stays: takers must be deleted or changed in their own episode."""
    wrong = ~F.col("is_maker") & (F.col("status") != "deleted") & (F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts")))
    return book.where(F.when(wrong, F.raise_error(F.concat(F.lit("taker stays in the book: "), F.col("order_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def tick_volume(levels: DataFrame, tick) -> DataFrame:
    """Volume per tick bucket: bids in [p, p + tick), asks in (p - tick, p]."""
    bucket = F.when(F.col("side") == "bid", tick_floor(F.col("price"), tick)).otherwise(tick_ceil(F.col("price"), tick)).cast(PRICE)
    return levels.groupBy("exchange", "pair", "side", bucket.alias("price")).agg(F.sum("volume").cast(AMOUNT).alias("volume"))
