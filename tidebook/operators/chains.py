"""Event chains: each order's events linked in time, from raw order messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOK = ("exchange", "pair", "era")


def build(raw: DataFrame) -> DataFrame:
    """raw(exchange, pair, era, ts, seq, order_id, side, price, amount, deleted) -> level-3 chains.

    Within an era an order's events follow each other by (ts, seq). A deletion ends a chain; later events of the order
    begin a new one (a resurrected order), and a deletion that follows nothing is dropped. A deletion carries its
    predecessor's price and amount. Added: segment, event_no, fill (decrease of the amount), next_ts, next_event_no,
    status (superseded, deleted, open), price_ts and price_event_no (where the present price was set).
    One shuffle: every window is over the same key.
    """
    order = Window.partitionBy(*BOOK, "order_id").orderBy("ts", "seq")
    rows = raw.withColumn("segment", F.coalesce(F.sum(F.col("deleted").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.lag("segment").over(order)
    rows = rows.withColumn("lone", F.col("deleted") & (before.isNull() | (before != F.col("segment")))).where("not lone").drop("lone")
    # what is left of a segment: its deletion, if any, is the last row
    chain = Window.partitionBy(*BOOK, "order_id").orderBy("ts", "seq")
    first = F.coalesce(F.lag("segment").over(chain) != F.col("segment"), F.lit(True))
    rows = rows.withColumn("first", first)
    prior = lambda c: F.when(~F.col("first"), F.lag(c).over(chain))
    rows = rows.withColumn("price", F.when(F.col("deleted"), prior("price")).otherwise(F.col("price")))
    rows = rows.withColumn("was", prior("amount")).withColumn("was_price", prior("price"))
    rows = rows.withColumn("amount", F.when(F.col("deleted"), F.col("was")).otherwise(F.col("amount")))
    up_to = Window.partitionBy(*BOOK, "order_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(chain))
    rows = rows.withColumn("start", F.last(F.when(F.col("first"), F.col("n")), ignorenulls=True).over(up_to))
    rows = rows.withColumn("event_no", (F.col("n") - F.col("start") + 1).cast("int"))
    priced = F.col("first") | (F.col("price") != F.col("was_price"))
    rows = rows.withColumn("price_event_no", F.last(F.when(priced, F.col("event_no")), ignorenulls=True).over(up_to))
    rows = rows.withColumn("price_ts", F.last(F.when(priced, F.col("ts")), ignorenulls=True).over(up_to))
    follows = F.coalesce(~F.lead("first").over(chain), F.lit(False))
    rows = rows.withColumn("next_ts", F.when(follows, F.lead("ts").over(chain))).withColumn("next_event_no", F.when(follows, F.col("event_no") + 1))
    status = F.when(F.col("deleted"), "deleted").when(F.col("next_ts").isNotNull(), "superseded").otherwise("open")
    rows = rows.withColumn("fill", F.when(~F.col("deleted"), F.col("was") - F.col("amount"))).withColumn("status", status)
    return rows.drop("n", "start", "first")


def session_eras(raw: DataFrame, gap_seconds: float, key: tuple[str, ...] = ("exchange", "pair")) -> DataFrame:
    """raw with ``era`` set: a new era begins after a gap of over ``gap_seconds`` without events.

    Rows are looked at day by day; a day's first gap and the era that it begins in come from a table of days.
    """
    rows = raw.drop("era").withColumn("_day", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)))
    day = Window.partitionBy(*key, "_day").orderBy("ts", "seq")
    past = Window.partitionBy(*key).orderBy("_day")
    last = rows.groupBy(*key, "_day").agg(F.max("ts").alias("_last")).select(*key, "_day", F.lag("_last").over(past).alias("_before"))
    rows = rows.join(last, [*key, "_day"])
    before = F.coalesce(F.lag("ts").over(day), F.col("_before"))
    new = before.isNull() | (F.unix_micros("ts") - F.unix_micros(before) > round(gap_seconds * 1e6))
    rows = rows.withColumn("_start", F.when(new, F.col("ts"))).drop("_before")
    begun = rows.groupBy(*key, "_day").agg(F.max("_start").alias("_begun"))
    begun = begun.select(*key, "_day", F.last("_begun", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1)).alias("_begun"))
    here = F.last("_start", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(begun, [*key, "_day"]).withColumn("era", F.coalesce(here, F.col("_begun"))).drop("_day", "_start", "_begun")


def assign_eras(raw: DataFrame, eras: DataFrame) -> DataFrame:
    """raw with the latest era of its exchange and pair that doesn't start after ts; earlier rows go.

    Also moves late events into the era they belong to. The eras' ends make it a join on exchange and pair.
    """
    ends = eras.select("exchange", "pair", "era", F.lead("era").over(Window.partitionBy("exchange", "pair").orderBy("era")).alias("_end"))
    r = raw.drop("era")
    on = (r.exchange == ends.exchange) & (r.pair == ends.pair) & (r.ts >= ends.era) & (ends["_end"].isNull() | (r.ts < ends["_end"]))
    return r.join(ends, on).select(r["*"], ends.era)


def without_duplicates(raw: DataFrame) -> DataFrame:
    """Keeps the first of repeated creations and deletions of an order: raw needs ``event`` created, changed, deleted."""
    w = Window.partitionBy(*BOOK, "order_id", "event").orderBy("ts", "seq")
    return raw.withColumn("_n", F.row_number().over(w)).where("event = 'changed' or _n = 1").drop("_n")


def renumber(level3: DataFrame, eras: DataFrame) -> DataFrame:
    """Chains cut anew at the given eras, such as one split in two: the pointers follow from the windows."""
    return build(assign_eras(level3.select("exchange", "pair", "ts", "seq", "order_id", "side", "price", "amount", "deleted"), eras))


def with_creations(raw: DataFrame) -> DataFrame:
    """raw(event) with a creation before every chain that begins with a change or a deletion, at the same time and place.

    What the order had before isn't known: the creation takes the event's own price and amount. A synthetic row's seq is
    that of its event less one half, so seq becomes a decimal.
    """
    order = Window.partitionBy(*BOOK, "order_id").orderBy("ts", "seq")
    starts = F.coalesce(F.lag("deleted").over(order), F.lit(True)) & (F.col("event") != "created")
    seq = F.col("seq").cast("decimal(21,1)")
    rows = raw.withColumn("_s", starts).withColumn("seq", seq)
    made = rows.where("_s").withColumn("event", F.lit("created")).withColumn("deleted", F.lit(False)).withColumn("seq", (F.col("seq") - F.lit("0.5").cast("decimal(2,1)")).cast("decimal(21,1)"))
    return rows.unionByName(made).drop("_s")
