"""Depth: volume per price level over time, by sums of what each event adds and takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import AMOUNT, PRICE, ceil_to, floor_to, side_label, tick_ceil, tick_floor
from tidebook.operators.ranks import numbered

LEVEL = ("exchange", "pair", "era", "side", "price")


def deltas(level3: DataFrame) -> DataFrame:
    """exchange, pair, era, ts, side, price, delta: an event adds its amount and takes back its predecessor's."""
    plus = F.when(~F.col("deleted"), F.struct(F.col("price"), F.col("amount").alias("delta")))
    minus = F.when(F.col("was").isNotNull(), F.struct(F.col("was_price").alias("price"), (-F.col("was")).cast(AMOUNT).alias("delta")))
    rows = level3.select("exchange", "pair", "era", "ts", "side", F.explode(F.array(plus, minus)).alias("d")).where("d is not null")
    return rows.select("exchange", "pair", "era", "ts", "side", "d.price", "d.delta")


def changes(level3: DataFrame, frequency: float | None = None) -> DataFrame:
    """exchange, pair, era, ts, side (b or s), price, volume: each level's new volume where an episode changes it.

    ``frequency`` moves events up to the time grid first, so that each cell is one episode. Deltas are summed per
    level and episode before the shuffle; the running sum is exact decimal arithmetic.
    """
    d = deltas(level3).withColumn("ts", ceil_to(F.col("ts"), frequency))
    net = d.groupBy(*LEVEL, "ts").agg(F.sum("delta").cast(AMOUNT).alias("net")).where("net <> 0")
    w = Window.partitionBy(*LEVEL).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return net.select(*LEVEL, "ts", F.sum("net").over(w).cast(AMOUNT).alias("volume"))


def era_at(eras: DataFrame, ts: Column) -> DataFrame:
    """exchange, pair, era of the newest era that doesn't begin after ts; eras has a row per era, or many."""
    return eras.where(F.col("era") <= ts).groupBy("exchange", "pair").agg(F.max("era").alias("era"))


def standing(level3: DataFrame, ts: Column, before: bool = False) -> DataFrame:
    """The events that are in the book at an instant (``before``: just before it), of any era."""
    now = (F.col("ts") < ts) if before else (F.col("ts") <= ts)
    later = (F.col("next_ts") >= ts) if before else (F.col("next_ts") > ts)
    return level3.where(now & (F.col("next_ts").isNull() | later) & (F.col("status") != "deleted"))


def at(level3: DataFrame, ts: Column, before: bool = False, eras: DataFrame | None = None) -> DataFrame:
    """The levels with volume at an instant (``before``: just before it), summed over the orders that are in the book.

    The book is that of the newest era that began by then, empty or not; ``eras``(exchange, pair, era) spares a look at
    all events for it.
    """
    live = standing(level3, ts, before).join(era_at(level3 if eras is None else eras, ts), ["exchange", "pair", "era"])
    return live.groupBy(*LEVEL).agg(F.sum("amount").cast(AMOUNT).alias("volume")).where("volume > 0")


def between(level3: DataFrame, start: Column, end: Column, frequency: float | None = None, eras: DataFrame | None = None) -> DataFrame:
    """continuous() of [start, end) alone (sampled: of the cells from start's up to the one that end falls in).

    Levels begin with their volume just before the range, and the range's events change them: nothing but the book at
    the start and the events of the range is read or summed, and the filters on ts reach the scan.
    """
    start, stop = floor_to(start, frequency), ceil_to(end, frequency)
    eras = (level3 if eras is None else eras).select("exchange", "pair", "era").distinct()
    # an event counts in the first cell that isn't before it
    back = F.expr(f"interval {round(frequency * 1e6)} microseconds") if frequency else None
    first = (F.col("ts") > start - back) if frequency else (F.col("ts") >= start)
    last = (F.col("ts") <= stop) if frequency else (F.col("ts") < stop)
    opening = standing(level3, start - back if frequency else start, not frequency)
    # no era that ended before the range plays a part
    newest = era_at(eras, start - back if frequency else start).withColumnRenamed("era", "_from")
    opening = opening.join(newest, ["exchange", "pair"]).where("era = _from").groupBy(*LEVEL).agg(F.sum("amount").cast(AMOUNT).alias("net")).where("net > 0")
    inside = deltas(level3.where(first & last)).withColumn("ts", ceil_to(F.col("ts"), frequency))
    net = inside.groupBy(*LEVEL, "ts").agg(F.sum("delta").cast(AMOUNT).alias("net")).where("net <> 0")
    rows = net.unionByName(opening.withColumn("ts", F.lit(None).cast("timestamp")))
    w = Window.partitionBy(*LEVEL).orderBy(F.col("ts").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*LEVEL, "ts", F.sum("net").over(w).cast(AMOUNT).alias("volume"))
    at_end = (F.col("ts") <= stop) if frequency else (F.col("ts") < stop)
    closed = closings(rows, eras).where((F.col("ts") >= start) & at_end)
    return rows.where("ts is not null").unionByName(closed)


def depth(level3: DataFrame, start: Column, end: Column, frequency: float | None = None, starting: bool = True, moving: bool = True, eras: DataFrame | None = None) -> DataFrame:
    """ts, side (bid or ask), price, volume of [start, end): the starting levels at the first instant, then changes.

    Sampled, both ends go outwards to the grid and the last cell is closed. Where an era begins, the levels of the one
    before end 1 microsecond earlier.
    """
    begin = floor_to(start, frequency)
    parts = []
    if starting:
        parts.append(at(level3, begin, True, eras).select(begin.alias("ts"), side_label(F.col("side")).alias("side"), "price", "volume", "exchange", "pair"))
    if moving:
        parts.append(between(level3, start, end, frequency, eras).select("ts", side_label(F.col("side")).alias("side"), "price", "volume", "exchange", "pair"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where("price is not null")


def continuous(level3: DataFrame, frequency: float | None = None) -> DataFrame:
    """changes() plus, 1 microsecond before each later era, a zero for every level the era before leaves."""
    rows = changes(level3, frequency)
    return rows.unionByName(closings(rows, level3.select("exchange", "pair", "era").distinct()))


def closings(rows: DataFrame, eras: DataFrame) -> DataFrame:
    """Level changes to zero, 1 microsecond before the next era, of the levels that an era leaves with volume."""
    w = Window.partitionBy("exchange", "pair").orderBy("era")
    begins = eras.withColumn("next_era", F.lead("era").over(w)).where("next_era is not null")
    left = rows.groupBy(*LEVEL).agg(F.max_by("volume", F.struct(F.col("ts").isNotNull(), "ts")).alias("volume")).where("volume > 0").drop("volume")
    return left.join(begins, ["exchange", "pair", "era"]).select(*LEVEL, (F.col("next_era") - F.expr("interval 1 microsecond")).alias("ts"), F.lit(0).cast(AMOUNT).alias("volume"))


def periods(eras: DataFrame, start: Column, end: Column, frequency: float | None = None) -> DataFrame:
    """exchange, pair, era, period_start, period_end, previous_period_end: the range cut to eras, on the grid.

    eras(exchange, pair, era, last_ts). A period starts at the first grid instant of its era and ends at the last one;
    empty ones go.
    """
    rows = eras.select("exchange", "pair", "era", F.greatest(ceil_to(F.col("era"), frequency), floor_to(start, frequency)).alias("period_start"), F.least(floor_to(F.col("last_ts"), frequency), ceil_to(end, frequency)).alias("period_end"))
    rows = rows.where("period_end > period_start")
    return rows.withColumn("previous_period_end", F.lag("period_end").over(Window.partitionBy("exchange", "pair").orderBy("era")))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """side, price, volume where two books (side, price, volume) differ; a level that is gone has volume 0."""
    a, b = before.select("side", "price", F.col("volume").alias("v0")), after.select("side", "price", F.col("volume").alias("v1"))
    both = a.join(b, ["side", "price"], "full_outer")
    return both.where(~F.col("v0").eqNullSafe(F.col("v1"))).select("side", "price", F.coalesce("v1", F.lit(0)).cast(AMOUNT).alias("volume"))


def apply_changes(book: DataFrame, change: DataFrame) -> DataFrame:
    """side, price, volume of a book after level changes; volume 0 removes a level."""
    a, b = book.select("side", "price", F.col("volume").alias("v0")), change.select("side", "price", F.col("volume").alias("v1"))
    return a.join(b, ["side", "price"], "full_outer").select("side", "price", F.coalesce("v1", "v0").alias("volume")).where("volume > 0")


def order_book_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Raw events that turn one raw book (order_id, price, amount with sign) into another; price 0 deletes."""
    a = before.select("order_id", F.col("price").alias("p0"), F.col("amount").alias("a0"))
    b = after.select("order_id", F.col("price").alias("p1"), F.col("amount").alias("a1"))
    both = a.join(b, "order_id", "full_outer").where(~(F.col("p0").eqNullSafe(F.col("p1")) & F.col("a0").eqNullSafe(F.col("a1"))))
    return both.select("order_id", F.coalesce("p1", F.lit(0).cast(PRICE)).alias("price"), F.coalesce("a1", F.signum("a0").cast("int")).alias("amount"))


def signed_changes(rows: DataFrame) -> DataFrame:
    """depth rows (exchange, pair, ts, side, price, volume) with ``delta`` and the best prices before the episode.

    delta is the change since the level's last row (from 0). The best prices at each episode's start are the largest
    bid and smallest ask with volume; they come from the spread kernel.
    """
    level = Window.partitionBy("exchange", "pair", "side", "price").orderBy("ts")
    return rows.withColumn("delta", (F.col("volume") - F.coalesce(F.lag("volume").over(level), F.lit(0))).cast(AMOUNT))


def chain_ids(signed: DataFrame) -> DataFrame:
    """signed changes with ``chain_id``: one number per side and size of change, by first appearance.

    Appearance is ordered by ts, side (ask first), and price from the best.
    """
    place = F.struct("ts", "side", F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price")))
    size = F.abs("delta")
    first = signed.where("delta <> 0").groupBy("side", size.alias("size")).agg(F.min(place).alias("first"))
    ids = numbered(first, "chain_id", F.col("first")).withColumn("chain_id", F.col("chain_id").cast("int")).select(F.col("side").alias("_s"), F.col("size").alias("_z"), "chain_id")
    return signed.join(ids, (F.col("side") == F.col("_s")) & (size == F.col("_z"))).drop("_s", "_z")


def resample(rows: DataFrame, tick=0, frequency: float | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """exchange, pair, ts, side, price, volume per grid cell and tick bucket that was touched in it.

    Times go up to the grid, bids down and asks up to the tick. A bucket's volume is the sum of its levels' last
    volumes; the first cell takes all that lies before ``start``; what comes after the last whole cell is left out.
    """
    key = ["exchange", "pair", "side", "bucket"]
    rows = rows.withColumn("cell", ceil_to(F.col("ts"), frequency))
    if start is not None:
        rows = rows.withColumn("cell", F.greatest(F.col("cell"), ceil_to(start, frequency)))
    if end is not None:
        rows = rows.where(F.col("cell") <= floor_to(end, frequency))
    elif frequency:
        last = rows.groupBy("exchange", "pair").agg(floor_to(F.max("ts"), frequency).alias("_end"))
        rows = rows.join(last, ["exchange", "pair"]).where("cell <= _end").drop("_end")
    bucket = F.when(F.col("side") == "bid", tick_floor(F.col("price"), tick)).otherwise(tick_ceil(F.col("price"), tick)).cast(PRICE)
    rows = rows.withColumn("bucket", bucket)
    last = rows.groupBy(*key, "price", "cell").agg(F.max_by("volume", "ts").alias("volume"))
    level = Window.partitionBy(*key, "price").orderBy("cell")
    last = last.withColumn("delta", F.col("volume") - F.coalesce(F.lag("volume").over(level), F.lit(0)))
    net = last.groupBy(*key, "cell").agg(F.sum("delta").alias("net"))
    w = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return net.select("exchange", "pair", F.col("cell").alias("ts"), "side", F.col("bucket").alias("price"), F.sum("net").over(w).cast(AMOUNT).alias("volume"))


def summary(levels: DataFrame, step: int = 25, most: int = 500, scale: int = 2) -> DataFrame:
    """Volume by basis points from the best price: levels(key.., ts, side bid/ask, price, volume) of whole books.

    A level counts in the band ceil(distance / best / step) * step; the band's price is best * (1 -+ bps / 10000).
    """
    w = Window.partitionBy("exchange", "pair", "ts", "side")
    bid = F.col("side") == "bid"
    rows = levels.withColumn("best", F.when(bid, F.max("price").over(w)).otherwise(F.min("price").over(w)))
    band = F.ceil(F.abs(F.col("price") - F.col("best")) / F.col("best") * 10000 / step) * step
    rows = rows.withColumn("bps_level", band.cast("int")).where(F.col("bps_level") <= most)
    ratio = F.when(bid, 1 - F.col("bps_level") / F.lit(10000.0)).otherwise(1 + F.col("bps_level") / F.lit(10000.0))
    rows = rows.withColumn("band_price", F.round(F.col("best").cast("double") * ratio, scale))
    return rows.groupBy("exchange", "pair", "ts", "side", "bps_level", F.col("band_price").alias("price")).agg(F.sum("volume").cast(AMOUNT).alias("volume"))


def summary_by_episode(rows: DataFrame, step: int = 25, most: int = 500, scale: int = 2) -> DataFrame:
    """summary() of the whole book after every episode of level changes (exchange, pair, side, price, ts, volume)."""
    instants = rows.select("exchange", "pair", F.col("ts").alias("at")).distinct()
    return summary(books_at(rows, instants), step, most, scale)


def last_per_instant(rows: DataFrame, micros: int = 10) -> DataFrame:
    """Of the rows of instants that agree to ``micros`` microseconds, those of the last instant."""
    w = Window.partitionBy("exchange", "pair", F.floor(F.unix_micros("ts") / F.lit(micros))).orderBy(F.col("ts").desc())
    return rows.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def spread_of(levels: DataFrame, *key: str) -> DataFrame:
    """key, best_bid_price, best_bid_volume, best_ask_price, best_ask_volume of books of levels (side bid or ask, price, volume).

    A side without levels is null; one without volume isn't a level.
    """
    side = lambda s, c: F.when((F.col("side") == s) & (F.col("volume") > 0), F.col(c))
    best = {"bid": (F.max, F.max_by), "ask": (F.min, F.min_by)}
    out = [x for s, (price, volume) in best.items() for x in (price(side(s, "price")).alias(f"best_{s}_price"), volume(side(s, "volume"), side(s, "price")).alias(f"best_{s}_volume"))]
    return levels.groupBy(*key).agg(*out)


def spread_of_orders(book: DataFrame, *key: str) -> DataFrame:
    """spread_of() a book of orders (side b or s, price, amount)."""
    levels = book.groupBy(*key, side_label(F.col("side")).alias("side"), "price").agg(F.sum("amount").cast(AMOUNT).alias("volume"))
    return spread_of(levels, *key)


def starting_spread(level3: DataFrame, start: Column, frequency: float | None = None, eras: DataFrame | None = None) -> DataFrame:
    """exchange, pair, ts and the spread of the book just before ``start``, which goes down to the grid."""
    start = floor_to(start, frequency)
    levels = at(level3, start, True, eras).withColumn("side", side_label(F.col("side")))
    return spread_of(levels, "exchange", "pair").withColumn("ts", start)


def in_window(rows: DataFrame, prices: tuple = (None, None), volumes: tuple = (None, None)) -> DataFrame:
    """Level changes with price and volume inside closed bounds (None: open); changes to nothing stay, whatever the volume bounds."""
    within = lambda c, low, high: F.lit(True) & (F.lit(True) if low is None else F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) <= high)
    return rows.where(within("price", *prices) & (within("volume", *volumes) | (F.col("volume") == 0)))


def summary_pivot(bands: DataFrame, step: int = 25, most: int = 500) -> DataFrame:
    """One row per ts: best prices and volumes, and bid_volNbps and ask_volNbps for each band, 0 where there is none."""
    labels = [f"{side}_vol{k}bps" for side in ("bid", "ask") for k in range(0, most + 1, step)]
    name = F.concat("side", F.lit("_vol"), F.col("bps_level").cast("string"), F.lit("bps"))
    wide = bands.withColumn("name", name).groupBy("exchange", "pair", "ts").pivot("name", labels).agg(F.sum("volume").cast("double")).na.fill(0.0, labels)
    best = bands.where("bps_level = 0").groupBy("exchange", "pair", "ts").agg(*(F.max(F.when(F.col("side") == s, F.col("price"))).alias(f"best_{s}_price") for s in ("bid", "ask")))
    return wide.join(best, ["exchange", "pair", "ts"], "left")


def books_at(rows: DataFrame, instants: DataFrame) -> DataFrame:
    """Whole books at each instant: the levels (volume > 0) of change rows (exchange, pair, side, price, ts, volume).

    instants(exchange, pair, at). A level's row holds until its next one; instants meet it through day cells.
    """
    w = Window.partitionBy("exchange", "pair", "side", "price").orderBy("ts")
    spans = rows.withColumn("until", F.lead("ts").over(w)).where("volume > 0")
    bounds = instants.groupBy("exchange", "pair").agg(F.max("at").alias("_last"))
    spans = spans.join(bounds, ["exchange", "pair"]).where("ts <= _last").withColumn("until", F.coalesce("until", F.col("_last") + F.expr("interval 1 second")))
    cell = lambda c: F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("long")
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell("ts"), cell("until"))))
    asked = instants.select("exchange", "pair", "at", cell("at").alias("_cell"))
    met = asked.join(spans, ["exchange", "pair", "_cell"]).where("ts <= at and at < until")
    return met.select("exchange", "pair", F.col("at").alias("ts"), "side", "price", "volume")
