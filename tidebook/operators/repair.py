"""Finding and mending what a capture got wrong: crossed books, missing fills, broken chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.grid import side_label
from tidebook.operators import chains

VENUE = ["exchange", "pair"]
BOOK = ["exchange", "pair", "era"]


def crossed_books(spread: DataFrame) -> DataFrame:
    """previous_uncrossed, first_crossed, next_uncrossed of each stretch of time with the best bid above the best ask."""
    w = Window.partitionBy(*VENUE).orderBy("ts")
    rows = spread.withColumn("crossed", F.coalesce(F.col("best_bid_price") > F.col("best_ask_price"), F.lit(False)))
    rows = rows.withColumn("previous", F.lag("ts").over(w)).withColumn("next", F.lead("ts").over(w)).withColumn("change", (F.col("crossed") != F.coalesce(F.lag("crossed").over(w), ~F.col("crossed"))).cast("int"))
    rows = rows.withColumn("island", F.sum("change").over(w)).where("crossed")
    return rows.groupBy(*VENUE, "island").agg(F.min_by("previous", "ts").alias("previous_uncrossed"), F.min("ts").alias("first_crossed"), F.max_by("next", "ts").alias("next_uncrossed")).drop("island")


def merge_episodes(raw: DataFrame, spans: DataFrame, most_seconds: float = 45) -> DataFrame:
    """raw with the events of each span [start, end) moved to its end, where that is ``most_seconds`` at most.

    spans(exchange, pair, start, end). An order that is deleted in the span and comes again moves its earlier life to
    that deletion instead, so the two lives stay apart.
    """
    s = spans.where((F.unix_micros("end") - F.unix_micros("start")) <= round(most_seconds * 1e6)).select(*VENUE, F.col("start").alias("_a"), F.col("end").alias("_b"))
    hour = lambda c: F.floor(F.unix_micros(c) / F.lit(3_600_000_000)).cast("long")
    s = s.withColumn("_h", F.explode(F.sequence(hour("_a"), hour("_b"))))
    r = raw.withColumn("_h", hour("ts"))
    hit = r.select(*VENUE, "seq", "ts", "_h").join(s, [*VENUE, "_h"]).where("ts >= _a and ts < _b").groupBy(*VENUE, "seq").agg(F.min("_a").alias("_a"), F.min("_b").alias("_b"))
    rows = r.drop("_h").join(hit, [*VENUE, "seq"], "left")
    later = Window.partitionBy(*VENUE, "order_id", "_a").orderBy("ts", "seq").rowsBetween(0, Window.unboundedFollowing)
    after = Window.partitionBy(*VENUE, "order_id", "_a").orderBy("ts", "seq").rowsBetween(1, Window.unboundedFollowing)
    death = F.min(F.when(F.col("deleted") & F.col("_again"), F.col("ts"))).over(later)
    rows = rows.withColumn("_again", F.count("seq").over(after) > 0)
    return rows.withColumn("ts", F.when(F.col("_a").isNull(), F.col("ts")).otherwise(F.coalesce(death, F.col("_b")))).drop("_a", "_b", "_again")


def fix_crossed_books(raw: DataFrame, spread_of, most_seconds: float = 45) -> DataFrame:
    """raw with crossed stretches merged into the episode that ends them, until a round moves no event.

    spread_of(raw) gives the spread of a set of raw events; each round writes its events to the shared folder. Events
    only ever move forward, and to the time of an event that is there, so rounds come to an end.
    """
    from tidebook.plans.session import cut

    while True:
        spans = crossed_books(spread_of(raw)).where("next_uncrossed is not null").select(*VENUE, F.col("first_crossed").alias("start"), F.col("next_uncrossed").alias("end"))
        spans = cut(spans.where((F.unix_micros("end") - F.unix_micros("start")) <= round(most_seconds * 1e6)))
        if spans.isEmpty():
            return raw
        moved = cut(merge_episodes(raw.withColumn("_before", F.col("ts")), spans, most_seconds))
        raw = moved.select(*raw.columns)
        if moved.where("ts <> _before").isEmpty():
            return raw


def deletions(orders: DataFrame, raw: DataFrame) -> DataFrame:
    """raw deletions of standing orders(.., at) at that instant, in raw's columns; the seq is behind all others."""
    columns = {"ts": F.col("at"), "seq": F.lit(10**17).cast(raw.schema["seq"].dataType), "price": F.lit(None).cast(raw.schema["price"].dataType), "amount": F.lit(None).cast(raw.schema["amount"].dataType), "deleted": F.lit(True)}
    first = orders.groupBy(*BOOK, "order_id").agg(F.min("at").alias("at"), F.first("side").alias("side"))
    return first.select(*((columns[f.name] if f.name in columns else F.col(f.name) if f.name in first.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in raw.schema))


def fix_crossed_orders(raw: DataFrame, most_seconds: float = 45) -> DataFrame:
    """raw after all repairs of crossed books, in the order in which they are tried, until none applies.

    Where a book gets crossed: orders that should have been taken and stay for ever are deleted; else episodes up to the
    next event of the takers are merged, if that is near; else crossed orders that stay for ever are deleted. A round
    applies the first of these that finds something, to all crossings at once. What is left goes to fix_crossed_books.
    """
    from tidebook.operators import depth, episodes, replay
    from tidebook.operators.book import with_flags
    from tidebook.plans.session import cut

    view = lambda l3: replay.spread(depth.changes(l3).withColumn("side", side_label(F.col("side"))))
    near = round(most_seconds * 1e6)
    while True:
        level3 = cut(chains.build(raw))
        crossed = crossed_books(view(level3)).select(*VENUE, F.col("first_crossed").alias("at"))
        eras = level3.select(*BOOK).distinct()
        instants = cut(crossed.join(eras, VENUE).where("era <= at").groupBy(*VENUE, "at").agg(F.max("era").alias("era")))
        if instants.isEmpty():
            return raw
        standing = episodes.books(level3, instants).withColumn("_era", F.col("era")).withColumn("era", F.col("at"))
        standing = cut(with_flags(standing).withColumn("era", F.col("_era")).drop("_era"))
        takers = standing.where(~F.col("is_maker"))
        eternal = takers.where("status = 'open'")
        if not eternal.isEmpty():
            raw = cut(raw.unionByName(deletions(eternal, raw)))
            continue
        soon = takers.where(F.col("next_ts").isNotNull() & ((F.unix_micros("next_ts") - F.unix_micros("ts")) <= near))
        spans = cut(soon.groupBy(*VENUE, F.col("at").alias("start")).agg(F.max("next_ts").alias("end")))
        if not spans.isEmpty():
            moved = cut(merge_episodes(raw.withColumn("_before", F.col("ts")), spans, most_seconds))
            if not moved.where("ts <> _before").isEmpty():
                raw = moved.select(*raw.columns)
                continue
        lasting = standing.where("is_crossed and status = 'open'")
        if lasting.isEmpty():
            return fix_crossed_books(raw, lambda rows: view(chains.build(rows)), most_seconds)
        raw = cut(raw.unionByName(deletions(lasting, raw)))


def missing_fills(level3: DataFrame, matched: DataFrame) -> DataFrame:
    """level3 with the amounts that matched(order_id, event_no, amount) trades reveal.

    An event without a fill that a trade was matched to had lost the trade's amount; so its chain's earlier events had
    that much more, each: a sum over the chain from its end. The first event of a chain needs none.
    """
    m = matched.groupBy("order_id", "event_no").agg(F.sum("amount").alias("_m"))
    rows = level3.join(m, ["order_id", "event_no"], "left")
    rows = rows.withColumn("_lost", F.when(F.col("fill").isNull() & (F.col("event_no") > 1), F.coalesce("_m", F.lit(0))).otherwise(F.lit(0)))
    later = Window.partitionBy(*BOOK, "order_id", "segment").orderBy("event_no").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("amount", F.col("amount") + F.coalesce(F.sum("_lost").over(later), F.lit(0)))
    return rows.withColumn("fill", F.when(F.col("fill").isNull() & F.col("_m").isNotNull(), F.col("_m")).otherwise(F.col("fill"))).drop("_m", "_lost")


def monotone(rows: DataFrame) -> DataFrame:
    """rows(order_id, event_no, ts) with times that never fall along a chain: each is the largest so far."""
    w = Window.partitionBy("order_id").orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ts", F.max("ts").over(w))


def aggressor_first(rows: DataFrame) -> DataFrame:
    """rows(order_id, event_no, ts) with each time the least of its own and its chain's later ones."""
    w = Window.partitionBy("order_id").orderBy("event_no").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("ts", F.min("ts").over(w))


def reveal_episodes(events: DataFrame, matches: DataFrame) -> DataFrame:
    """events(event, ts, price_ts) with both sides of a trade at the time of the later-priced one, its aggressor."""
    e = lambda side: events.select(F.col("event").alias(f"{side}_event"), F.col("price_ts").alias(f"{side}_ts"))
    m = matches.join(e("buy"), "buy_event").join(e("sell"), "sell_event").withColumn("at", F.greatest("buy_ts", "sell_ts"))
    at = m.select(F.explode(F.array("buy_event", "sell_event")).alias("event"), "at").groupBy("event").agg(F.min("at").alias("_at"))
    return events.join(at, "event", "left").withColumn("ts", F.coalesce("_at", "ts")).drop("_at")


def duplicate_events(raw: DataFrame) -> DataFrame:
    """exchange, pair, order_id, ts, copies of events that come more than once for an order and instant."""
    return raw.groupBy(*VENUE, "order_id", "ts").agg(F.count("*").alias("copies")).where("copies > 1")


def invalid_chains(level3: DataFrame) -> DataFrame:
    """Events whose pointer leads to no event, or that no pointer leads to though they aren't a chain's first."""
    key = [*BOOK, "order_id"]
    e = level3.select(*key, "ts", "event_no", "next_ts", "next_event_no")
    have = e.select(*key, F.col("ts").alias("next_ts"), F.col("event_no").alias("next_event_no"))
    lost = e.where("next_ts is not null").join(have, [*key, "next_ts", "next_event_no"], "left_anti").select(*key, "ts", "event_no", F.lit("no next event").alias("problem"))
    to = e.where("next_ts is not null").select(*key, F.col("next_ts").alias("ts"), F.col("next_event_no").alias("event_no"))
    orphan = e.where("event_no > 1").join(to, [*key, "ts", "event_no"], "left_anti").select(*key, "ts", "event_no", F.lit("no previous event").alias("problem"))
    return lost.unionByName(orphan)


def eternal_orders(level3: DataFrame, seconds: float) -> DataFrame:
    """The last events of orders that stay open though nothing of them was heard for ``seconds`` before their era's end."""
    ends = level3.groupBy(*BOOK).agg(F.max("ts").alias("_end"))
    rows = level3.where("status = 'open'").join(ends, BOOK)
    return rows.where((F.unix_micros("_end") - F.unix_micros("ts")) > round(seconds * 1e6)).drop("_end")


def fix_premature_deletes(raw: DataFrame, seconds: float) -> DataFrame:
    """raw without deletions that the order itself contradicts within ``seconds``: a next event of the same price."""
    w = Window.partitionBy(*VENUE, "order_id").orderBy("ts", "seq")
    again = F.lead("ts").over(w)
    same = (F.lead("price").over(w) == F.coalesce("price", F.lag("price").over(w))) & ~F.lead("deleted").over(w)
    soon = (F.unix_micros(again) - F.unix_micros("ts")) <= round(seconds * 1e6)
    return raw.withColumn("_w", F.coalesce(F.col("deleted") & same & soon, F.lit(False))).where("not _w").drop("_w")


def in_order(rows: DataFrame) -> DataFrame:
    """rows(order_id, event_no, ts, fill, matched) with times that never fall along a chain; fails where matched events forbid it.

    First events of chains, and unmatched ones that should have had a trade, move back to the events behind them; then
    unmatched ones move forward to the latest before them. Matched events stay.
    """
    chain = Window.partitionBy("order_id")
    can = (F.coalesce(F.col("fill") > 0, F.lit(True)) & ~F.col("matched")) | (F.col("event_no") == 1)
    rows = rows.withColumn("_stays", (~can).cast("int"))
    # an event that stays ends the run of those before it that can move back to it
    back = chain.orderBy(F.col("event_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_stays").over(back))
    run = Window.partitionBy("order_id", "_run").orderBy(F.col("event_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ts", F.min("ts").over(run))
    so_far = chain.orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ts", F.when(F.col("matched"), F.col("ts")).otherwise(F.max("ts").over(so_far)))
    wrong = F.col("ts") > F.min("ts").over(chain.orderBy("event_no").rowsBetween(0, Window.unboundedFollowing))
    message = F.concat(F.lit("events out of order: "), F.col("order_id").cast("string"))
    return rows.withColumn("_fine", F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).where("_fine").drop("_stays", "_run", "_fine")


def cleanse(level3: DataFrame, matches: DataFrame) -> DataFrame:
    """level3 after all repairs that matches(buy_order_id, buy_event_no, sell_order_id, sell_event_no, amount) allow.

    In turn: lost fills and amounts are put back, both sides of a trade go to the time of its aggressor, and times are
    put in order. Chains follow the new times: next_ts and price_ts are those of the events that they name.
    """
    side = lambda s: matches.select(F.col(f"{s}_order_id").alias("order_id"), F.col(f"{s}_event_no").alias("event_no"), "amount").where("order_id is not null and event_no is not null")
    rows = missing_fills(level3, side("buy").unionByName(side("sell")))
    named = rows.withColumn("event", F.struct("order_id", "event_no"))
    pairs = matches.select(F.struct(F.col("buy_order_id").alias("order_id"), F.col("buy_event_no").alias("event_no")).alias("buy_event"), F.struct(F.col("sell_order_id").alias("order_id"), F.col("sell_event_no").alias("event_no")).alias("sell_event"))
    met = pairs.select(F.explode(F.array("buy_event", "sell_event")).alias("event")).distinct().withColumn("matched", F.lit(True))
    rows = reveal_episodes(named, pairs).join(met, "event", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    rows = in_order(rows).drop("event", "matched")
    chain = Window.partitionBy(*BOOK, "order_id", "segment").orderBy("event_no")
    rows = rows.withColumn("next_ts", F.when(F.col("next_event_no").isNotNull(), F.lead("ts").over(chain)))
    priced = F.when(F.col("event_no") == F.col("price_event_no"), F.col("ts"))
    return rows.withColumn("price_ts", F.last(priced, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, 0)))


def fix_duplicate_events(level3: DataFrame) -> DataFrame:
    """level3 without first events that stay open, of orders that have an event number twice in an era."""
    key = [*BOOK, "order_id"]
    twice = level3.groupBy(*key, "event_no").agg(F.count("*").alias("_n")).where("_n > 1").select(*key).distinct().withColumn("_twice", F.lit(True))
    rows = level3.join(twice, key, "left")
    return rows.where("_twice is null or event_no > 1 or status <> 'open'").drop("_twice")


def fix_eternals(level3: DataFrame) -> DataFrame:
    """level3 whose open events lead to the orphan of their order that has the next number, if there is one."""
    key = [*BOOK, "order_id"]
    to = level3.where("next_ts is not null").select(*key, F.col("next_ts").alias("ts"), F.col("next_event_no").alias("event_no"))
    orphans = level3.where("event_no > 1").join(to, [*key, "ts", "event_no"], "left_anti")
    orphans = orphans.groupBy(*key, (F.col("event_no") - 1).cast("int").alias("event_no")).agg(F.min("ts").alias("_to"))
    rows = level3.join(orphans, [*key, "event_no"], "left").withColumn("_hit", (F.col("status") == "open") & F.col("_to").isNotNull())
    rows = rows.withColumn("next_ts", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("next_ts"))).withColumn("next_event_no", F.when(F.col("_hit"), F.col("event_no") + 1).otherwise(F.col("next_event_no")))
    return rows.withColumn("status", F.when(F.col("_hit"), "superseded").otherwise(F.col("status"))).select(*level3.columns)


def delete_events(level3: DataFrame, gone: DataFrame) -> DataFrame:
    """level3 without the events gone(exchange, pair, era, order_id, segment, event_no) and those behind them in their chains.

    What led to a deleted event stays open.
    """
    key = [*BOOK, "order_id", "segment"]
    first = gone.groupBy(*key).agg(F.min("event_no").alias("_cut"))
    rows = level3.join(first, key, "left").where("_cut is null or event_no < _cut")
    last = F.coalesce(F.col("event_no") == F.col("_cut") - 1, F.lit(False))
    for c in ("next_ts", "next_event_no"):
        rows = rows.withColumn(c, F.when(~last, F.col(c)))
    return rows.withColumn("status", F.when(last, "open").otherwise(F.col("status"))).select(*level3.columns)


def finished(level3: DataFrame, until: Column) -> DataFrame:
    """The chains that ended with a deletion at or before ``until``, whole: what may move on to the final store."""
    chain = Window.partitionBy(*BOOK, "order_id", "segment")
    rows = level3.withColumn("_end", F.max(F.when(F.col("deleted"), F.col("ts"))).over(chain))
    return rows.where(F.col("_end") <= until).drop("_end")


def month_eras(raw: DataFrame) -> DataFrame:
    """raw with a new era at the first event of each month of an era; orders that are open then are created anew in it.

    A chain never leads out of a month, so months are written and dropped alone. The creations carry the order's last
    price and amount, and come first at the new era's start: raw needs seq, which becomes a decimal.
    """
    month = F.trunc("ts", "month")
    first = raw.groupBy(*BOOK, month.alias("_month")).agg(F.min("ts").alias("_era"))
    starts = Window.partitionBy(*BOOK).orderBy("_month")
    first = first.withColumn("_number", F.row_number().over(starts)).withColumn("_era", F.when(F.col("_number") == 1, F.col("era")).otherwise(F.col("_era")))
    rows = raw.withColumn("_month", month).join(first, [*BOOK, "_month"]).withColumn("seq", F.col("seq").cast("decimal(21,1)"))
    order = Window.partitionBy(*BOOK, "order_id", "_month").orderBy(F.col("ts").desc(), F.col("seq").desc())
    last = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    # an order's state at the end of a month stands in all later ones up to its next event's
    until = F.lead("_number").over(Window.partitionBy(*BOOK, "order_id").orderBy("_number"))
    ends = first.groupBy(*BOOK).agg(F.max("_number").alias("_last"))
    carried = last.withColumn("_until", until).join(ends, BOOK).where("not deleted").withColumn("_to", F.coalesce("_until", "_last"))
    carried = carried.where("_to > _number").withColumn("_number", F.explode(F.sequence(F.col("_number") + 1, F.col("_to")))).drop("_era", "_month")
    carried = carried.join(first.select(*BOOK, "_number", "_era"), [*BOOK, "_number"]).withColumn("ts", F.col("_era")).withColumn("seq", F.lit("-0.5").cast("decimal(21,1)"))
    both = rows.select(*raw.columns, "_era").unionByName(carried.select(*raw.columns, "_era"))
    return both.withColumn("era", F.greatest("era", "_era")).drop("_era")


def time_jumps(rows: DataFrame, seconds: float) -> DataFrame:
    """Events whose corrected ts lies before the original_ts or more than ``seconds`` after it."""
    move = F.unix_micros("ts") - F.unix_micros("original_ts")
    return rows.where((move < 0) | (move > round(seconds * 1e6)))
