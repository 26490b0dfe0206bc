"""Event and trade queries, and the catalogue of eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import direction_label, event_id
from tidebook.operators.book import snapshot


def last_known(rows: DataFrame, known: DataFrame, columns: list[str], before: bool = True) -> DataFrame:
    """rows with the columns of the latest ``known`` row of their exchange and pair: an as-of join.

    Both are put in one order and the last value is carried on, per exchange, pair and day; the day's first value is
    carried from the days before, which leaves a day's rows to a task. ``before``: rows of the same instant don't count.
    """
    rank = F.lit(0 if before else 1)
    a = rows.withColumn("_k", rank).withColumn("_kept", F.lit(True))
    b = known.select("exchange", "pair", "ts", *(F.struct(F.col(c)).alias(c) for c in columns)).withColumn("_k", F.lit(1 if before else 0)).withColumn("_kept", F.lit(False))
    both = a.select(*a.columns, *(F.lit(None).cast(b.schema[c].dataType).alias(f"_v{c}") for c in columns)).unionByName(b.select("exchange", "pair", "ts", "_k", "_kept", *(F.col(c).alias(f"_v{c}") for c in columns)), allowMissingColumns=True)
    both = both.withColumn("_day", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)))
    days = both.groupBy("exchange", "pair", "_day").agg(*(F.max_by(f"_v{c}", F.when(F.col(f"_v{c}").isNotNull(), F.struct("ts", "_k"))).alias(f"_d{c}") for c in columns))
    past = Window.partitionBy("exchange", "pair").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("exchange", "pair", "_day", *(F.last(f"_d{c}", ignorenulls=True).over(past).alias(f"_d{c}") for c in columns))
    w = Window.partitionBy("exchange", "pair", "_day").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.join(days, ["exchange", "pair", "_day"])
    for c in columns:
        both = both.withColumn(c, F.coalesce(F.last(f"_v{c}", ignorenulls=True).over(w), F.col(f"_d{c}"))[c])
    return both.where("_kept").select(*rows.columns, *columns)


def classify(level3: DataFrame, spread: DataFrame, start: Column, end: Column, matches: DataFrame | None = None, eras: DataFrame | None = None) -> DataFrame:
    """Events of (start, end] and the book at start, with what they did, whom they met, and their order's type.

    spread is that of the range. An event's best prices are those before the last change of the spread that isn't later
    than it; without one, or in a one-sided book, it is no aggressor. An event aggresses if its price reaches the other
    side's best. Flags of an order are over all its rows here; types go by the first that fits: pacman (its price
    changed), flashed-limit and resting-limit (rested only, deleted or not, and unfilled), resting-limit (rested and was
    filled), market (aggressed only, filled and deleted), flashed-limit (the same unfilled), market-limit (aggressed and
    rested, or stays), unknown. Aggressiveness is in whole basis points of the best ask; a fill that isn't positive is 0.

    matches(exchange, pair, ts, buy_order_id, buy_event_no, sell_order_id, sell_event_no) connect events at their very
    instant: such an event has an event_id, and its counterpart's in matching_event, a row for each match.
    """
    venue = ["exchange", "pair"]
    now = level3.where((F.col("ts") > start) & (F.col("ts") <= end)).withColumn("_gone", F.col("deleted"))
    rows = now.where(~((F.col("amount") == 0) & (F.col("event_no") == 1) & ~F.col("deleted")))
    rows = rows.unionByName(snapshot(level3, start, eras=eras).withColumn("_gone", F.lit(False)))
    w = Window.partitionBy(*venue).orderBy("ts")
    quotes = spread.select(*venue, F.lead("ts").over(w).alias("ts"), "best_bid_price", "best_ask_price").where("ts is not null")
    rows = last_known(rows, quotes, ["best_bid_price", "best_ask_price"], before=False)
    bid = F.col("side") == "b"
    reach = F.when(bid, F.col("price") >= F.col("best_ask_price")).otherwise(F.col("price") <= F.col("best_bid_price"))
    rows = rows.withColumn("is_aggressor", F.coalesce(reach, F.lit(False)))
    order = Window.partitionBy(*venue, "order_id")
    flags = {
        "is_created": F.bool_or((F.col("event_no") == 1) & ~F.col("_gone")), "is_ever_resting": F.bool_or(~F.col("is_aggressor")), "is_ever_aggressor": F.bool_or("is_aggressor"),
        "is_ever_filled": F.bool_or(F.coalesce(F.col("fill") > 0, F.lit(False))), "is_deleted": F.bool_or("_gone"),
    }
    for name, flag in flags.items():
        rows = rows.withColumn(name, flag.over(order))
    rows = rows.withColumn("is_price_ever_changed", F.min("price").over(order) != F.max("price").over(order))
    rested, aggressed, filled, gone = (F.col(c) for c in ("is_ever_resting", "is_ever_aggressor", "is_ever_filled", "is_deleted"))
    kind = (
        F.when(F.col("is_price_ever_changed"), "pacman")
        .when(rested & ~aggressed & ~filled & gone, "flashed-limit")
        .when(rested & ~aggressed, "resting-limit")
        .when(~rested & aggressed & gone & filled, "market")
        .when(~rested & aggressed & gone, "flashed-limit")
        .when(aggressed, "market-limit")
        .otherwise("unknown")
    )
    action = F.when(F.col("_gone"), "deleted").when(F.col("event_no") == 1, "created").otherwise("changed")
    # bids, too, are measured against the best ask
    against = F.when(bid, F.col("price") - F.col("best_bid_price")).otherwise(F.col("best_ask_price") - F.col("price"))
    bps = F.round(10000 * against.cast("double") / F.col("best_ask_price").cast("double")) + F.lit(0.0)  # no negative zero
    key = [*venue, "ts", "order_id", "event_no"]
    if matches is None:
        rows = rows.withColumn("_met", F.lit(None).cast("string")).withColumn("_known", F.lit(False))
    else:
        m = matches.where((F.col("ts") >= start) & (F.col("ts") <= end))
        end_of = lambda mine, other: m.select(*venue, "ts", F.col(f"{mine}_order_id").alias("order_id"), F.col(f"{mine}_event_no").alias("event_no"), event_id(F.col("ts"), F.col(f"{other}_order_id"), F.col(f"{other}_event_no"), F.col("exchange"), F.col("pair")).alias("_met"))
        met = end_of("buy", "sell").unionByName(end_of("sell", "buy")).withColumn("_known", F.lit(True))
        rows = rows.join(met, key, "left")
    own = event_id(F.col("ts"), F.col("order_id"), F.col("event_no"), F.col("exchange"), F.col("pair"))
    return rows.select(
        F.when(F.col("_known"), own).alias("event_id"), F.col("order_id").alias("id"), F.col("ts").alias("timestamp"), F.col("price_ts").alias("exchange_timestamp"), "price", F.col("amount").alias("volume"),
        action.alias("action"), F.when(bid, "bid").otherwise("ask").alias("direction"), F.when(F.col("fill") > 0, F.col("fill")).otherwise(0).cast("decimal(28,8)").alias("fill"), F.col("_met").alias("matching_event"),
        kind.alias("type"), bps.alias("aggressiveness_bps"), "event_no", "is_aggressor", *flags, "is_price_ever_changed", "best_bid_price", "best_ask_price",
    )


def export(level3: DataFrame, start: Column, end: Column) -> DataFrame:
    """The flat event list: id, timestamp and exchange_timestamp in milliseconds, price, volume, action, direction."""
    action = F.when(F.col("deleted"), "deleted").when(F.col("event_no") == 1, "created").otherwise("changed")
    ms = F.floor(F.unix_micros("ts") / 1000)
    rows = level3.where((F.col("ts") >= start) & (F.col("ts") < end) & ~((F.col("amount") == 0) & (F.col("event_no") == 1) & ~F.col("deleted")))
    return rows.select(F.col("order_id").alias("id"), ms.alias("timestamp"), ms.alias("exchange_timestamp"), "price", F.round("amount", 8).alias("volume"), action.alias("action"), F.when(F.col("side") == "b", "bid").otherwise("ask").alias("direction"), "event_no")


def trades(matches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Trades of [start, end] with direction, and maker and taker, orders and events, by the side that took."""
    bought = F.col("side") == "b"
    uuid = lambda who: event_id(F.col("ts"), F.col(f"{who}_order_id"), F.col(f"{who}_event_no"), F.col("exchange"), F.col("pair"))
    by_side = lambda of: (F.when(bought, of("sell")).otherwise(of("buy")), F.when(bought, of("buy")).otherwise(of("sell")))
    maker, taker = by_side(lambda who: F.col(f"{who}_order_id"))
    maker_event, taker_event = by_side(uuid)
    rows = matches.where((F.col("ts") >= start) & (F.col("ts") <= end))
    return rows.select(
        "exchange", "pair", F.col("ts").alias("timestamp"), "price", F.col("amount").alias("volume"), direction_label(F.col("side")).alias("direction"), maker_event.alias("maker_event_id"), taker_event.alias("taker_event_id"),
        maker.alias("maker"), taker.alias("taker"), "exchange_trade_id",
    )


def market_orders(trades: DataFrame) -> DataFrame:
    """Trades of one taker, direction and instant as one market order: volume, levels hit, mean price."""
    return trades.groupBy("exchange", "pair", "timestamp", "taker", "direction").agg(F.sum("volume").alias("volume"), F.countDistinct("price").alias("levels"), (F.sum(F.col("volume") * F.col("price")) / F.sum("volume")).alias("mean_price"))


def era_table(level3: DataFrame) -> DataFrame:
    """exchange, pair, era, last_ts."""
    return level3.groupBy("exchange", "pair", "era").agg(F.max("ts").alias("last_ts"))


def data_overview(eras: DataFrame, latest: int) -> DataFrame:
    """The latest eras of each exchange and pair, numbered from the last, with the next era's start."""
    w = Window.partitionBy("exchange", "pair")
    rows = eras.withColumn("r", F.row_number().over(w.orderBy(F.col("era").desc()))).withColumn("next_era", F.lead("era").over(w.orderBy("era")))
    return rows.where(F.col("r") <= latest)


def availability(eras: DataFrame, least_seconds: float = 0) -> DataFrame:
    """exchange, pair, interval_start, interval_end, status: G where an era has events, R for the gaps between."""
    w = Window.partitionBy("exchange", "pair").orderBy("era")
    e = eras.withColumn("next_era", F.lead("era").over(w))
    green = e.select("exchange", "pair", F.col("era").alias("interval_start"), F.col("last_ts").alias("interval_end"), F.lit("G").alias("status"))
    red = e.where("next_era is not null").select("exchange", "pair", F.col("last_ts").alias("interval_start"), F.col("next_era").alias("interval_end"), F.lit("R").alias("status"))
    return green.unionByName(red).where((F.unix_micros("interval_end") - F.unix_micros("interval_start")) >= F.lit(round(least_seconds * 1e6)))


def era_summary(level3: DataFrame, matches: DataFrame, eras: DataFrame) -> DataFrame:
    """Per era: events, created, changed, deletions, trades, events and trades a second, and first and last event."""
    e = level3.groupBy("exchange", "pair", "era").agg(
        F.count("*").alias("events"), F.count(F.when((F.col("event_no") == 1) & ~F.col("deleted"), 1)).alias("created"), F.count(F.when((F.col("event_no") > 1) & ~F.col("deleted"), 1)).alias("changed"),
        F.count(F.when(F.col("deleted"), 1)).alias("deletions"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
    )
    w = Window.partitionBy("exchange", "pair").orderBy("era")
    ends = eras.select("exchange", "pair", "era", F.lead("era").over(w).alias("_end"))
    m = matches.join(ends, ["exchange", "pair"]).where((F.col("ts") >= F.col("era")) & (F.col("_end").isNull() | (F.col("ts") < F.col("_end")))).groupBy("exchange", "pair", "era").agg(F.count("*").alias("trades"))
    rows = e.join(m, ["exchange", "pair", "era"], "left").na.fill(0, ["trades"])
    seconds = (F.unix_micros("last_event") - F.unix_micros("first_event")) / 1e6
    for c in ("events", "trades"):
        rows = rows.withColumn(f"{c}_per_second", F.when(seconds > 0, F.col(c) / seconds))
    return rows


def catalogue_id(names: DataFrame, name: str, value: str) -> DataFrame:
    """The rows of a catalogue of exchanges or pairs (id, name) whose name is ``value``: exchanges lower case, pairs upper."""
    return names.where(F.col(name) == (value.lower() if name == "exchange" else value.upper())).select("id")
