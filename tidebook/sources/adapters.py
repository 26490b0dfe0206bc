"""Order events and trades from tables that hold none: deterministic views over ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import AMOUNT, PRICE

ERAS = ("2024-01-01", "2024-01-11", "2024-01-21")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str) -> Column:
    """A UTC instant, whatever the session's time zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp_ntz'{text}')"))


def in_utc(df: DataFrame, column: str) -> Column:
    """A column of wall-clock times read as UTC; instants stay."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{column}`)"))
    return F.col(column).cast("timestamp")


def raw_orders(spark: SparkSession, sf_dir: str, crossed: bool = False, eras: tuple[str, ...] = ERAS[:1], venues: int = 1) -> DataFrame:
    """exchange, pair, era, ts, seq, order_id, side, price, amount, deleted: a user's events as an order's.

    Even users bid below 1000 (``crossed``: below 1004), odd users ask above; an ``error`` event deletes the order.
    """
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    e = e.withColumn("ts", in_utc(e, "ts"))
    bid = F.col("user_id") % 2 == 0
    value = F.col("value").cast("decimal(12,2)")
    price = F.when(bid, F.lit(1004 if crossed else 1000) - value).otherwise(F.lit("1000.01").cast("decimal(12,2)") + value)
    era = F.lit(None).cast("timestamp")
    for start in eras:
        era = F.when(F.col("ts") >= instant(start), instant(start)).otherwise(era)
    venue = F.concat(F.lit("venue"), (F.col("user_id") % venues).cast("string"))
    return e.select(
        venue.alias("exchange"), F.lit("AB").alias("pair"), era.alias("era"), "ts", F.col("event_id").alias("seq"), F.col("user_id").alias("order_id"),
        F.when(bid, "b").otherwise("s").alias("side"), price.cast(PRICE).alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).cast(AMOUNT).alias("amount"),
        (F.col("event_type") == "error").alias("deleted"),
    ).where("era is not null")


def eras(spark: SparkSession, starts: tuple[str, ...] = ERAS, exchange: str = "venue0", pair: str = "AB") -> DataFrame:
    return spark.createDataFrame([(exchange, pair, s) for s in starts], "exchange string, pair string, era string").withColumn("era", F.col("era").cast("timestamp_ntz")).transform(lambda x: x.withColumn("era", in_utc(x, "era")))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trades: the buyer or seller is the user, the maker the nearest earlier event of the other side."""
    raw = raw_orders(spark, sf_dir)
    kind = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    rows = raw.join(kind, "seq").withColumn("taker_side", F.when(F.col("seq") % 2 == 0, "b").otherwise("s"))
    # the last order of each side before this event, within a day
    day = Window.partitionBy("exchange", "pair", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("order_id")), ignorenulls=True).over(day)
    rows = rows.withColumn("maker", F.when(F.col("taker_side") == "b", last("s")).otherwise(last("b")))
    return rows.where("event_type = 'purchase'").select("exchange", "pair", "ts", "price", "amount", F.col("taker_side").alias("side"), F.col("order_id").alias("taker"), "maker", F.col("seq").alias("exchange_trade_id"))


def matches(spark: SparkSession, sf_dir: str, level3: DataFrame) -> DataFrame:
    """trades() as an exchange reports them: buyer's and seller's order and event; the maker's event is its first."""
    t = trades(spark, sf_dir).join(level3.select(F.col("seq").alias("exchange_trade_id"), "event_no"), "exchange_trade_id", "left")
    bought = F.col("side") == "b"
    first = F.when(F.col("maker").isNotNull(), F.lit(1))
    return t.select(
        "exchange", "pair", "ts", "price", "amount", "side", "exchange_trade_id", F.when(bought, F.col("taker")).otherwise(F.col("maker")).alias("buy_order_id"), F.when(bought, F.col("event_no")).otherwise(first).alias("buy_event_no"),
        F.when(bought, F.col("maker")).otherwise(F.col("taker")).alias("sell_order_id"), F.when(bought, first).otherwise(F.col("event_no")).alias("sell_event_no"),
    )


def depth_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, side, price, volume: large daily episodes from ``lineitem``; returned lines empty their level."""
    li = table(spark, sf_dir, "lineitem")
    bid = F.col("l_linestatus") == "F"
    return (
        li.select(in_utc(li, "l_shipdate").alias("ts"), F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, 100000 - F.col("l_partkey")).otherwise(100000 + F.col("l_partkey")).cast(PRICE).alias("price"), F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity")).cast(AMOUNT).alias("q"))
        .groupBy("ts", "side", "price").agg(F.sum("q").cast(AMOUNT).alias("volume"))
        .withColumn("exchange", F.lit("venue0")).withColumn("pair", F.lit("AB"))
    )
