"""Exchange messages (JSON lines with their time of receipt) as order events and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import PRICE

AMOUNT = "decimal(38,18)"
ORDER = "event string, channel string, data struct<id: bigint, order_type: int, price_str: string, amount_str: string, microtimestamp: string, datetime: string>"
TRADE = "event string, channel string, data struct<id: bigint, type: int, price_str: string, amount_str: string, buy_order_id: bigint, sell_order_id: bigint, microtimestamp: string>"


def _side(code: Column) -> Column:
    return F.when(code == 0, "b").when(code == 1, "s")


def bitstamp_orders(lines: DataFrame, pair: str) -> DataFrame:
    """lines(value, local_ts) -> order events; works on batches and streams. Other messages are left out."""
    m = lines.select(F.from_json("value", ORDER).alias("m"), "local_ts").where(F.col("m.event").isin("order_created", "order_changed", "order_deleted"))
    return m.select(
        F.lit("bitstamp").alias("exchange"), F.lit(pair).alias("pair"), F.timestamp_micros(F.col("m.data.microtimestamp").cast("long")).alias("ts"), F.col("m.data.id").alias("order_id"),
        F.regexp_extract("m.event", "order_(.*)", 1).alias("event"), _side(F.col("m.data.order_type")).alias("side"), F.col("m.data.price_str").cast(PRICE).alias("price"),
        F.col("m.data.amount_str").cast(AMOUNT).alias("amount"), (F.col("m.event") == "order_deleted").alias("deleted"), "local_ts",
    )


def bitstamp_trades(lines: DataFrame, pair: str) -> DataFrame:
    """lines(value, local_ts) -> trades with both orders' ids; works on batches and streams. Other messages are left out."""
    m = lines.select(F.from_json("value", TRADE).alias("m"), "local_ts").where("m.event = 'trade'")
    return m.select(
        F.lit("bitstamp").alias("exchange"), F.lit(pair).alias("pair"), F.timestamp_micros(F.col("m.data.microtimestamp").cast("long")).alias("ts"), F.col("m.data.id").alias("exchange_trade_id"),
        _side(F.col("m.data.type")).alias("side"), F.col("m.data.price_str").cast(PRICE).alias("price"), F.col("m.data.amount_str").cast(AMOUNT).alias("amount"),
        F.col("m.data.buy_order_id").alias("buy_order_id"), F.col("m.data.sell_order_id").alias("sell_order_id"), "local_ts",
    )


def _channel(lines: DataFrame, channel: int) -> DataFrame:
    return lines.withColumn("part", F.from_json("value", "array<string>")).where(F.element_at("part", 1).cast("int") == channel)


def bitfinex_book(lines: DataFrame, channel: int, pair: str) -> DataFrame:
    """Raw book rows of a channel: order_id, price (0 deletes), amount (negative for asks); snapshots row by row, heartbeats none."""
    rows = _channel(lines, channel).withColumn("body", F.element_at("part", 2)).where("body like '[%'")
    many = F.from_json("body", "array<array<string>>")
    one = F.array(F.from_json("body", "array<string>"))
    rows = rows.withColumn("snapshot", F.col("body").like("[[%")).withColumn("row", F.explode(F.when(F.col("snapshot"), many).otherwise(one)))
    get = lambda k: F.element_at("row", k)
    ms = F.element_at("part", -1).cast("long")
    return rows.select(F.lit("bitfinex").alias("exchange"), F.lit(pair).alias("pair"), F.timestamp_millis(ms).alias("exchange_ts"), get(1).cast("long").alias("order_id"), get(2).cast(PRICE).alias("price"), get(3).cast(AMOUNT).alias("amount"), "snapshot", "local_ts")


def bitfinex_trades(lines: DataFrame, channel: int, pair: str) -> DataFrame:
    """Executed trades of a channel: updates and the rows of the first snapshot, once per trade."""
    rows = _channel(lines, channel)
    kind = F.element_at("part", 2)
    update = rows.where(kind == "tu").select(F.from_json(F.element_at("part", 3), "array<string>").alias("row"), "local_ts")
    first = rows.where(kind.like("[[%")).select(F.explode(F.from_json(kind, "array<array<string>>")).alias("row"), "local_ts")
    get = lambda k: F.element_at("row", k)
    out = update.unionByName(first)
    qty = get(3).cast(AMOUNT)
    return out.select(F.lit("bitfinex").alias("exchange"), F.lit(pair).alias("pair"), F.timestamp_millis(get(2).cast("long")).alias("ts"), get(1).cast("long").alias("exchange_trade_id"), F.when(qty > 0, "b").otherwise("s").alias("side"), get(4).cast(PRICE).alias("price"), F.abs(qty).alias("amount"), "local_ts").dropDuplicates(["ts", "exchange_trade_id"])


def bitfinex_eras(book: DataFrame, gap_seconds: float = 2.0, price_digits: int | None = None, amount_digits: int | None = None) -> DataFrame:
    """Raw book rows (exchange, pair, ts, seq, order_id, price, amount, snapshot) with ``era``, as one run of changes per era.

    A snapshot begins a channel. It begins an era, too, if there is no episode before it, if the last one is over
    ``gap_seconds`` older or of another month. Else the era goes on, and the snapshot counts by what it changes: rows
    that repeat an order's last state go, and orders of the book that it leaves out are deleted there. Prices and
    amounts are rounded first. Rows before the first snapshot are of no era and go.
    """
    key = ["exchange", "pair"]
    rows = book if price_digits is None else book.withColumn("price", F.round("price", price_digits).cast(PRICE))
    rows = rows if amount_digits is None else rows.withColumn("amount", F.round("amount", amount_digits).cast(AMOUNT))
    by_time = Window.partitionBy(*key).orderBy("ts")
    e = rows.groupBy(*key, "ts").agg(F.bool_or("snapshot").alias("_snap"))
    before = F.lag("ts").over(by_time)
    far = before.isNull() | ((F.unix_micros("ts") - F.unix_micros(before)) > round(gap_seconds * 1e6)) | (F.trunc("ts", "month") != F.trunc(before, "month"))
    e = e.withColumn("_new", F.col("_snap") & far)
    e = e.withColumn("era", F.last(F.when(F.col("_new"), F.col("ts")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    # the next snapshot of the same era
    again = F.when(F.col("_snap") & ~F.col("_new"), F.col("ts"))
    e = e.where("era is not null").withColumn("_next", F.first(again, ignorenulls=True).over(Window.partitionBy(*key, "era").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.join(e.select(*key, "ts", "era", "_next", (F.col("_snap") & ~F.col("_new")).alias("_goes_on")), [*key, "ts"])
    # the last row of an order and episode counts
    last = Window.partitionBy(*key, "era", "ts", "order_id").orderBy(F.col("seq").desc())
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    order = Window.partitionBy(*key, "era", "order_id").orderBy("ts")
    same = F.coalesce((F.lag("price").over(order) == F.col("price")) & (F.lag("amount").over(order) == F.col("amount")), F.lit(False))
    rows = rows.withColumn("_same", F.col("_goes_on") & F.col("snapshot") & same)
    gone = (F.col("price") > 0) & F.col("_next").isNotNull() & (F.lead("ts").over(order).isNull() | (F.lead("ts").over(order) > F.col("_next")))
    rows = rows.withColumn("_gone", gone)
    deletions = rows.where("_gone").withColumn("ts", F.col("_next")).withColumn("price", F.lit(0).cast(PRICE)).withColumn("amount", F.signum("amount").cast(AMOUNT)).withColumn("snapshot", F.lit(False))
    return rows.where("not _same").unionByName(deletions).drop("_next", "_goes_on", "_r", "_same", "_gone")


def batch_window(rows: DataFrame, done: Column | None = None, delay_seconds: float = 120, most_seconds: float = 4 * 3600) -> DataFrame:
    """exchange, pair, start, end of the next batch: from ``done`` (or the first row) up to ``delay_seconds`` before the last one, ``most_seconds`` at most."""
    ends = rows.groupBy("exchange", "pair").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    start = F.col("first") if done is None else F.greatest("first", done)
    micro = lambda c, seconds: F.timestamp_micros(F.unix_micros(c) + round(seconds * 1e6))
    out = ends.select("exchange", "pair", start.alias("start"), micro("last", -delay_seconds).alias("_to"))
    return out.select("exchange", "pair", "start", F.least("_to", micro("start", most_seconds)).alias("end")).where("end > start")


def bitfinex_level3(book: DataFrame) -> DataFrame:
    """Raw events for chains.build from raw book rows with ``ts`` (their episode's time) and ``seq``: the last row of an order and episode counts."""
    last = Window.partitionBy("exchange", "pair", "era", "ts", "order_id").orderBy(F.col("seq").desc())
    rows = book.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    order = Window.partitionBy("exchange", "pair", "era", "order_id")
    sign = F.when(F.col("price") > 0, F.signum("amount"))
    side = F.first(sign, ignorenulls=True).over(order.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("side", F.when(side > 0, "b").when(side < 0, "s")).withColumn("deleted", F.col("price") == 0).withColumn("amount", F.abs("amount").cast("decimal(28,8)"))


def json_lines(spark, path: str, stream: bool = False) -> DataFrame:
    """Captured messages, one JSON object per line with the fields value and local_ts."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("value string, local_ts timestamp").json(path)


DEPTH_CSV = "t double, price double, volume double, side string"


def depth_csv(spark, path: str) -> DataFrame:
    """Level changes from CSV lines without a header: seconds since 1970, price, volume, side."""
    rows = spark.read.schema(DEPTH_CSV).csv(path, ignoreLeadingWhiteSpace=True)
    return rows.select(F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")).alias("ts"), F.col("price").cast(PRICE).alias("price"), F.col("volume").cast("decimal(28,8)").alias("volume"), F.trim("side").alias("side"))


LEVEL3_CSV = "microtimestamp string, order_id long, event_no int, side string, price decimal(18,8), amount decimal(28,8), fill decimal(28,8), next_microtimestamp string, next_event_no int"


def level3_csv(spark, path: str, more: str = "") -> DataFrame:
    """Level-3 events from CSV with a header; infinite next times become a null next_ts and a status."""
    rows = spark.read.csv(path, header=True, schema=LEVEL3_CSV + more, ignoreLeadingWhiteSpace=True, enforceSchema=False) if not more else spark.read.csv(path, header=True, schema=LEVEL3_CSV + more)
    at = F.col("next_microtimestamp")
    status = F.when(at == "-infinity", "deleted").when(at == "infinity", "open").otherwise("superseded")
    return rows.withColumn("ts", F.col("microtimestamp").cast("timestamp")).withColumn("status", status).withColumn("next_ts", F.when(~at.isin("infinity", "-infinity"), at).cast("timestamp")).drop("microtimestamp", "next_microtimestamp")
