"""Trades matched to the order events that they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import PRICE, match_rule, truncate
from tidebook.operators.ranks import numbered

VENUE = ["exchange", "pair"]


def remaining_fill(events: DataFrame, matched: DataFrame) -> DataFrame:
    """events with ``left``: the fill that matched(event, amount) hasn't used."""
    used = matched.groupBy("event").agg(F.sum("amount").alias("_used"))
    return events.join(used, "event", "left").withColumn("left", F.col("fill") - F.coalesce("_used", F.lit(0))).drop("_used")


def exact(trades: DataFrame, events: DataFrame, delay_seconds: float = 1.0, digits: int | None = None) -> DataFrame:
    """trade, event of trades and makers' events that name each other first.

    trades(exchange, pair, trade, ts, price, amount, side of the taker), events(exchange, pair, event, ts, price, fill,
    side). A candidate has the price and amount, the other side, and comes up to the delay after its trade. Pairs whose
    event is the trade's earliest and whose trade is the event's earliest are matched. A trade meets events of its own
    second and the next ones only. ``digits`` compares prices cut to so many decimals.
    """
    if digits is not None:
        trades, events = (x.withColumn("price", truncate(F.col("price"), digits).cast(PRICE)) for x in (trades, events))
    step = max(1, round(delay_seconds * 1_000_000))
    cell = F.floor(F.unix_micros("ts") / F.lit(step)).cast("long")
    t = trades.select(*VENUE, "trade", F.col("ts").alias("t_ts"), "price", F.col("amount").alias("fill"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    e = events.select(*VENUE, "event", F.col("ts").alias("e_ts"), "price", "fill", "side", cell.alias("cell"))
    both = t.join(e, [*VENUE, "price", "fill", "side", "cell"])
    both = both.where((F.unix_micros("e_ts") >= F.unix_micros("t_ts")) & (F.unix_micros("e_ts") <= F.unix_micros("t_ts") + step))
    first = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    both = both.withColumn("r", first("trade", "e_ts", "event")).withColumn("q", first("event", "t_ts", "trade"))
    return both.where("r = 1 and q = 1").select("trade", "event")


def exact_all(trades: DataFrame, events: DataFrame, delay_seconds: float = 1.0, digits: int | None = None) -> DataFrame:
    """exact() again and again on what is left, until a pass finds nothing; each pass matches the earliest of every queue."""
    from tidebook.plans.session import cut

    found: list[DataFrame] = []
    while True:
        new = cut(exact(trades, events, delay_seconds, digits))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found, new)
        found.append(new)
        if len(found) % 8 == 0:  # a long queue takes many passes: plans stay short
            found = [cut(reduce(DataFrame.unionByName, found))]
        trades, events = cut(trades.join(new, "trade", "left_anti")), cut(events.join(new, "event", "left_anti"))


def sums(trades: DataFrame, gap_seconds: float = 1.0, most: int = 10) -> DataFrame:
    """group, members, ts, price, side, amount: what events may have been filled by, of up to three trades or all.

    Islands are a venue's trades of one side and price with gaps up to ``gap_seconds``. Every choice of one to three
    trades of an island of at most ``most`` is a group, and every island as a whole.
    """
    key = [*VENUE, "side", "price"]
    w = Window.partitionBy(*key).orderBy("ts", "trade")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    rows = trades.withColumn("new", (gap.isNull() | (gap > round(gap_seconds * 1e6))).cast("int")).withColumn("island", F.sum("new").over(w))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*key, "island")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key, "island").orderBy("ts", "trade")))
    at = [*key, "island"]
    one = rows.where(F.col("size") <= most).select(*at, "place", "size", F.array("trade").alias("members"), "ts", "amount")
    more = one.select(*at, F.col("place").alias("p2"), F.col("members").alias("m2"), F.col("ts").alias("t2"), F.col("amount").alias("a2"))

    def join(a: DataFrame) -> DataFrame:
        met = a.join(more, at).where("p2 > place")
        return met.select(*at, F.col("p2").alias("place"), "size", F.concat("members", "m2").alias("members"), F.greatest("ts", "t2").alias("ts"), (F.col("amount") + F.col("a2")).alias("amount"))

    two = join(one)
    three = join(two)
    whole = rows.where("size > 3").groupBy(*at).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "trade"))), lambda x: x["trade"]).alias("members"), F.max("ts").alias("ts"), F.sum("amount").alias("amount"))
    columns = [*key, "members", "ts", "amount"]
    return one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns)).unionByName(whole.select(*columns))


def by_sum(trades: DataFrame, events: DataFrame, delay_seconds: float = 1.0, gap_seconds: float = 1.0) -> DataFrame:
    """event, members: events whose fill is the sum of a group of trades; a trade goes to one event at most.

    Groups that share a trade with a better one are left out: earlier events first, then smaller groups, then their
    members in order.
    """
    groups = sums(trades, gap_seconds).where(F.size("members") > 1)
    e = events.select(*VENUE, "event", F.col("ts").alias("e_ts"), "price", F.col("fill").alias("amount"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"))
    step = round(delay_seconds * 1e6)
    met = groups.join(e, [*VENUE, "price", "amount", "side"]).where((F.unix_micros("e_ts") >= F.unix_micros("ts")) & (F.unix_micros("e_ts") <= F.unix_micros("ts") + step))
    order = ["e_ts", "n", "members", "event"]
    met = met.withColumn("n", F.size("members"))
    met = met.withColumn("k", F.struct(*order))
    flat = met.select("k", F.explode("members").alias("trade"))
    best = flat.groupBy("trade").agg(F.min("k").alias("best"))
    lost = flat.join(best, "trade").where("k <> best").select("k").distinct()
    kept = met.join(lost, "k", "left_anti")
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("event").orderBy("n", "members"))).where("r = 1")
    return kept.select("event", "members")


def by_price(trades: DataFrame, events: DataFrame, digits: int, delay_seconds: float = 1.0) -> DataFrame:
    """event, trades (array): exact matches, then sums, each with prices of ``digits`` decimals, then of one and two fewer.

    Each step works on the trades and events that the ones before it leave, until it finds no more.
    """
    from tidebook.plans.session import cut

    found = []

    def take(new: DataFrame) -> None:
        nonlocal trades, events
        found.append(new)
        used = new.select(F.explode("trades").alias("trade"))
        trades, events = cut(trades.join(used, "trade", "left_anti")), cut(events.join(new, "event", "left_anti"))

    precisions = range(digits, max(digits - 3, -1), -1)
    for k in precisions:
        take(cut(exact_all(trades, events, delay_seconds, k).select("event", F.array("trade").alias("trades"))))
    for k in precisions:
        while True:
            cut_off = lambda x: x.withColumn("price", truncate(F.col("price"), k).cast(PRICE))  # noqa: B023, E731
            new = cut(by_sum(cut_off(trades), cut_off(events), delay_seconds).select("event", F.col("members").alias("trades")))
            if new.isEmpty():
                break
            take(new)
    return reduce(DataFrame.unionByName, found)


def sequential(trades: DataFrame, events: DataFrame, tolerance: float = 1e-4, offset: int = 1) -> DataFrame:
    """trade, buy_event, sell_event, rules: an event and its offset-th successor that stand for a trade's two orders.

    trades(exchange, pair, trade, price, amount, buy_order_id, sell_order_id), events(exchange, pair, event, ts, order_id,
    amount, fill, action). Successors follow from the events' numbers in order, so no day or partition cuts them off.
    The two ways round are two equi-joins. An event serves its first trade only.
    """
    e = numbered(events.select(*VENUE, "ts", F.struct("event", "order_id", "amount", "fill", "action").alias("me")), "_n", *VENUE, "ts", F.col("me.event"))
    then = e.select(*VENUE, (F.col("_n") - offset).alias("_n"), F.col("me").alias("it"))
    e = e.join(then, [*VENUE, "_n"]).select(*VENUE, "ts", "me", "it")
    pairs = e.select(*VENUE, "ts", F.col("me").alias("b"), F.col("it").alias("s")).unionByName(e.select(*VENUE, "ts", F.col("it").alias("b"), F.col("me").alias("s")))
    pairs = pairs.withColumn("buy_order_id", F.col("b.order_id")).withColumn("sell_order_id", F.col("s.order_id"))
    rule = lambda x: match_rule(F.col("t_amount"), F.col("price"), F.col(f"{x}.amount"), F.col(f"{x}.fill"), F.col(f"{x}.action"), tolerance)
    t = trades.select(*VENUE, "trade", "price", F.col("amount").alias("t_amount"), "buy_order_id", "sell_order_id")
    met = t.join(pairs, [*VENUE, "buy_order_id", "sell_order_id"]).withColumn("buy_rule", rule("b")).withColumn("sell_rule", rule("s"))
    met = met.where("buy_rule is not null and sell_rule is not null").select("trade", F.col("b.event").alias("buy_event"), F.col("s.event").alias("sell_event"), "buy_rule", "sell_rule")
    rank = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    met = met.withColumn("r", rank("trade", "buy_event", "sell_event")).where("r = 1")
    met = met.withColumn("x", rank("buy_event", "trade")).withColumn("y", rank("sell_event", "trade"))
    return met.where("x = 1 and y = 1").select("trade", "buy_event", "sell_event", "buy_rule", "sell_rule")


def sequential_all(trades: DataFrame, events: DataFrame, tolerances: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0), offsets: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """sequential() with wider tolerances and further successors, each on the trades and events that are left."""
    from tidebook.plans.session import cut

    found = None
    for tolerance in tolerances:
        for offset in offsets:
            new = cut(sequential(trades, events, tolerance, offset))
            found = new if found is None else found.unionByName(new)
            trades = trades.join(new, "trade", "left_anti")
            used = new.select(F.explode(F.array("buy_event", "sell_event")).alias("event"))
            events = events.join(used, "event", "left_anti")
    return found


def coupling(changes: DataFrame, trades: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """trade, candidates: how many decreases of a level could be the trade's maker: price and side alike, volume enough, in time.

    changes(exchange, pair, ts, side bid/ask, price, delta); a trade without one has a hidden maker.
    """
    step = max(1, round(delay_seconds * 1_000_000))
    cell = F.floor(F.unix_micros("ts") / F.lit(step)).cast("long")
    c = changes.where("delta < 0").select(*VENUE, "side", "price", F.col("ts").alias("c_ts"), "delta", cell.alias("cell"))
    t = trades.select(*VENUE, "trade", F.when(F.col("side") == "b", "ask").otherwise("bid").alias("side"), "price", F.col("ts").alias("t_ts"), "amount", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = t.join(c, [*VENUE, "side", "price", "cell"], "left")
    fits = (F.abs(F.unix_micros("c_ts") - F.unix_micros("t_ts")) <= step) & (-F.col("delta") >= F.col("amount"))
    return met.groupBy("trade").agg(F.count(F.when(fits, 1)).alias("candidates"))
