"""Books of orders per episode: the running book as an array, and depth of makers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import AMOUNT, side_label
from tidebook.operators.book import with_flags
from tidebook.operators.depth import spread_of_orders


def books(level3: DataFrame, instants: DataFrame) -> DataFrame:
    """level3 rows standing at each instant (exchange, pair, era, at), with ``at``: an order's event holds until its next.

    Instants meet events through hour cells of the event's life span. For every episode take the events' own times.
    """
    hour = lambda c: F.floor(F.unix_micros(c) / F.lit(3_600_000_000)).cast("long")
    last = instants.groupBy("exchange", "pair", "era").agg(F.max("at").alias("_last"))
    rows = level3.where(~F.col("deleted")).join(last, ["exchange", "pair", "era"]).where("ts <= _last")
    rows = rows.withColumn("_to", F.coalesce("next_ts", F.col("_last") + F.expr("interval 1 second")))
    rows = rows.withColumn("_h", F.explode(F.sequence(hour("ts"), F.greatest(hour("ts"), hour("_to")))))
    asked = instants.select("exchange", "pair", "era", "at", hour("at").alias("_h"))
    met = rows.join(asked, ["exchange", "pair", "era", "_h"]).where("ts <= at and at < _to")
    return met.drop("_h", "_to", "_last")


def episodes(level3: DataFrame) -> DataFrame:
    """exchange, pair, era, at: every instant that has events."""
    return level3.select("exchange", "pair", "era", F.col("ts").alias("at")).distinct()


def order_book_by_episode(level3: DataFrame, instants: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """exchange, pair, era, ts, orders: the book after each episode as an array in the order of price and time, with flags."""
    rows = books(level3, episodes(level3) if instants is None else instants)
    # flags are per book: the instant takes the era's place in their windows
    flagged = with_flags(rows.withColumn("_era", F.col("era")).withColumn("era", F.col("at")), strict).withColumn("era", F.col("_era")).drop("_era")
    order = F.struct("price", "ts", "order_id", "event_no", "side", "amount", "is_maker", "is_crossed")
    out = flagged.groupBy("exchange", "pair", "era", "at").agg(F.sort_array(F.collect_list(order)).alias("orders"))
    return out.withColumnRenamed("at", "ts")


def maker_depth(level3: DataFrame, instants: DataFrame, strict: bool = True) -> DataFrame:
    """exchange, pair, ts, side, price, volume of the makers' orders at each instant."""
    rows = books(level3, instants)
    flagged = with_flags(rows.withColumn("era", F.col("at")), strict).where("is_maker")
    return flagged.groupBy("exchange", "pair", F.col("at").alias("ts"), side_label(F.col("side")).alias("side"), "price").agg(F.sum("amount").cast(AMOUNT).alias("volume"))


def spread_by_episode(level3: DataFrame, instants: DataFrame | None = None, only_different: bool = True, with_order_book: bool = False) -> DataFrame:
    """exchange, pair, era, ts and the spread of the book of orders after each episode; ``with_order_book`` adds the book.

    ``only_different`` leaves out episodes whose spread is that of the episode before them in their era.
    """
    key = ["exchange", "pair", "era", "at"]
    instants = episodes(level3) if instants is None else instants
    rows = instants.join(spread_of_orders(books(level3, instants), *key), key, "left")
    names = [f"best_{s}_{c}" for s in ("bid", "ask") for c in ("price", "volume")]
    if only_different:
        w = Window.partitionBy("exchange", "pair", "era").orderBy("at")
        now = F.struct(*names)
        rows = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", now.eqNullSafe(F.lag(now).over(w)))
        rows = rows.where("_first or not _same").drop("_first", "_same")
    rows = rows.withColumnRenamed("at", "ts")
    if with_order_book:
        rows = rows.join(order_book_by_episode(level3, instants).withColumnRenamed("orders", "order_book"), ["exchange", "pair", "era", "ts"], "left")
    return rows
