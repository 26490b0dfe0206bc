"""Analyses built on depth, spreads and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import ceil_to, floor_to
from tidebook.operators.ranks import numbered

VENUE = ["exchange", "pair"]


def power_law(values: DataFrame, column: str, cut: float) -> DataFrame:
    """n, sigma, exponent: the slope of log rank share against log size, for sizes in units of sigma from ``cut`` on.

    Only the tail is ranked, over ranges.
    """
    stats = values.agg(F.stddev_samp(column).alias("sigma"), F.count(column).alias("n"))
    rows = values.crossJoin(F.broadcast(stats)).withColumn("x", F.col(column) / F.col("sigma")).where(F.col("x") >= cut)
    ranked = numbered(rows, "rank", F.col("x").desc())
    share = F.ln(F.col("rank") / F.col("n"))
    return ranked.agg(F.max("n").alias("n"), F.max("sigma").alias("sigma"), F.count("*").alias("tail"), (-F.regr_slope(share, F.ln("x"))).alias("exponent"))


def sampled(spread: DataFrame, seconds: int) -> DataFrame:
    """exchange, pair, ts, mid: the last mid price of each grid cell."""
    rows = spread.withColumn("mid", (F.col("best_bid_price") + F.col("best_ask_price")).cast("double") / 2).where("mid is not null")
    return rows.groupBy(*VENUE, ceil_to(F.col("ts"), seconds).alias("cell")).agg(F.max_by("mid", "ts").alias("mid")).withColumnRenamed("cell", "ts")


def lead_lag(mids: DataFrame, seconds: int, first: str, second: str, lags: range = range(-5, 6)) -> DataFrame:
    """lag, correlation of log10 mid-price changes of two exchanges on a full grid, the second one shifted by ``lag`` cells."""
    ends = mids.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))
    wide = mids.where(F.col("exchange").isin(first, second)).groupBy("ts").pivot("exchange", [first, second]).agg(F.first("mid"))
    rows = grid.join(wide, "ts", "left")
    w = Window.orderBy("ts")
    held = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("ts", F.log10(held(first)).alias("x"), F.log10(held(second)).alias("y"))
    rows = rows.select("ts", (F.col("x") - F.lag("x").over(w)).alias("x"), (F.col("y") - F.lag("y").over(w)).alias("y"))
    shifted = rows.select("x", *(F.lag("y", k).over(w).alias(f"y{k + 100}") if k >= 0 else F.lead("y", -k).over(w).alias(f"y{k + 100}") for k in lags))
    wide = shifted.agg(*(F.corr("x", f"y{k + 100}").alias(f"c{k + 100}") for k in lags))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k + 100}").alias("correlation")) for k in lags))).alias("r")).select("r.*")


def jumps(prices: DataFrame, window: int = 270) -> DataFrame:
    """ts, log_return, bipower, statistic: returns over local volatility from products of neighbouring absolute returns.

    prices(exchange, pair, ts, mid). The statistic is |return| over the root of the mean of |r(i)||r(i-1)| of the
    ``window`` - 2 returns before it.
    """
    w = Window.partitionBy(*VENUE).orderBy("ts")
    rows = prices.withColumn("log_return", F.ln("mid") - F.lag(F.ln("mid")).over(w))
    rows = rows.withColumn("product", F.abs("log_return") * F.abs(F.lag("log_return").over(w)))
    past = w.rowsBetween(-(window - 2), -1)
    rows = rows.withColumn("bipower", F.when(F.count("product").over(past) == window - 2, F.sum("product").over(past) / (window - 2)))
    return rows.where("bipower > 0").withColumn("statistic", F.abs("log_return") / F.sqrt("bipower")).select(*VENUE, "ts", "log_return", "bipower", "statistic")


def jump_threshold(n: int, level: float = 0.01) -> float:
    """The largest statistic of n returns without jumps is below this with probability 1 - level (in units of bipower's root)."""
    from math import log, pi, sqrt

    c = sqrt(2 / pi)
    root = sqrt(2 * log(n))
    centre = root / c - (log(pi) + log(log(n))) / (2 * c * root)
    return centre - log(-log(1 - level)) / (c * root)


def ranges(prices: DataFrame, seconds: int) -> DataFrame:
    """exchange, pair, cell, log_range of the mid price in each grid cell."""
    return prices.groupBy(*VENUE, floor_to(F.col("ts"), seconds).alias("cell")).agg((F.ln(F.max("mid")) - F.ln(F.min("mid"))).alias("log_range"))


def top_spikes(positions: DataFrame, n: int) -> DataFrame:
    """The n positions of largest return in basis points, either way."""
    return positions.orderBy(F.abs("bps_return").desc(), "opened_at").limit(n)


def placements(signed: DataFrame, quotes: DataFrame) -> DataFrame:
    """Level changes with the best prices before them, kind (placement, marketable, cancellation) and distance in price.

    The distance is to the other side's best; a placement at or beyond it is marketable.
    """
    from tidebook.operators.events import last_known

    rows = last_known(signed.where("delta <> 0"), quotes, ["best_bid_price", "best_ask_price"])
    bid = F.col("side") == "bid"
    distance = F.when(bid, F.col("best_ask_price") - F.col("price")).otherwise(F.col("price") - F.col("best_bid_price"))
    kind = F.when(F.col("delta") < 0, "cancellation").when(distance <= 0, "marketable").otherwise("placement")
    return rows.withColumn("distance", distance).withColumn("kind", kind)


def without_market_orders(signed: DataFrame, trades: DataFrame) -> DataFrame:
    """Level changes less the volume that trades of the same instant and price took from the level."""
    took = trades.groupBy(*VENUE, F.col("ts"), "price", F.when(F.col("side") == "b", "ask").otherwise("bid").alias("side")).agg(F.sum("amount").alias("took"))
    rows = signed.join(took, [*VENUE, "ts", "price", "side"], "left")
    return rows.withColumn("delta", F.col("delta") + F.coalesce("took", F.lit(0))).drop("took").where("delta <> 0")


def arrival_rates(placed: DataFrame, tick: float, seconds: Column) -> DataFrame:
    """kind, ticks, events, rate a second by distance in ticks."""
    ticks = F.ceil(F.col("distance").cast("double") / tick - 1e-9).cast("int")
    return placed.groupBy("kind", ticks.alias("ticks")).agg(F.count("*").alias("events")).withColumn("rate", F.col("events") / seconds)


def rate_fit(rates: DataFrame) -> DataFrame:
    """Slope and intercept of log rate over log ticks."""
    rows = rates.where("ticks > 0 and rate > 0")
    return rows.groupBy("kind").agg(F.regr_slope(F.ln("rate"), F.ln("ticks")).alias("slope"), F.regr_intercept(F.ln("rate"), F.ln("ticks")).alias("intercept"))


def count_histogram(placed: DataFrame, seconds: int, start: Column, end: Column) -> DataFrame:
    """events, cells: how many grid cells of [start, end) have so many events, empty cells too."""
    cells = placed.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(floor_to(F.col("ts"), seconds).alias("cell")).agg(F.count("*").alias("events"))
    used = cells.groupBy("events").agg(F.count("*").alias("cells"))
    total = used.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("n")).select(F.lit(0).cast("long").alias("events"), ((F.unix_micros(end) - F.unix_micros(start)) / (seconds * 1_000_000) - F.col("n")).cast("long").alias("cells"))
    return used.unionByName(total)


def queue_profile(queues: DataFrame) -> DataFrame:
    """side, tick, mean volume of queue snapshots(b, a)."""
    each = queues.select(F.lit("bid").alias("side"), F.posexplode("b").alias("tick", "v")).unionByName(queues.select(F.lit("ask").alias("side"), F.posexplode("a").alias("tick", "v")))
    return each.groupBy("side", (F.col("tick") + 1).alias("tick")).agg(F.avg("v").alias("volume"))


def takers_levels(market_orders: DataFrame) -> DataFrame:
    """levels, orders, volume: how many market orders hit so many levels."""
    return market_orders.groupBy("levels").agg(F.count("*").alias("orders"), F.sum("volume").alias("volume"))


def quote_events(level3: DataFrame) -> DataFrame:
    """order_id, k, type (A added, C changed, D deleted), decrease of the volume."""
    w = Window.partitionBy("exchange", "pair", "era", "order_id", "segment").orderBy("event_no")
    kind = F.when(F.col("deleted"), "D").when(F.col("event_no") == 1, "A").otherwise("C")
    return level3.select("ts", "order_id", "segment", F.row_number().over(w).alias("k"), kind.alias("type"), F.when(F.col("deleted"), F.col("was")).otherwise(F.col("was") - F.col("amount")).alias("decrease"))


def position_trellis(positions: DataFrame, quotes: DataFrame, around_seconds: int = 0) -> DataFrame:
    """Each position's quotes, with the price as a log ratio to the opening price."""
    p = positions.withColumn("p", F.struct("opened_at", "closed_at", "open_price"))
    cell = lambda c: F.floor(F.unix_micros(c) / F.lit(3_600_000_000)).cast("long")
    pad = F.expr(f"interval {around_seconds} seconds")
    p = p.select(*VENUE, "opened_at", "closed_at", "open_price", F.explode(F.sequence(cell(F.col("opened_at") - pad), cell(F.col("closed_at") + pad))).alias("_c"))
    q = quotes.withColumn("_c", cell("ts"))
    met = p.join(q, [*VENUE, "_c"]).where((F.col("ts") >= F.col("opened_at") - pad) & (F.col("ts") <= F.col("closed_at") + pad))
    return met.select(*VENUE, "opened_at", "closed_at", "ts", F.ln(F.col("bid_price") / F.col("open_price")).alias("log_bid"), F.ln(F.col("ask_price") / F.col("open_price")).alias("log_ask"))


def segments(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``run``: numbers of stretches without a null in ``column``."""
    w = Window.partitionBy(*VENUE).orderBy("ts")
    return rows.withColumn("run", F.sum(F.col(column).isNull().cast("int")).over(w)).where(F.col(column).isNotNull())


def vary_threshold(gamma: float, theta: float, elapsed_seconds: Column) -> Column:
    """A turning threshold that falls with the time since the last turn: gamma / 100 / (1 + theta * elapsed)."""
    return F.lit(gamma) / 100 / (1 + F.lit(theta) * elapsed_seconds)
