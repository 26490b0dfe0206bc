"""Registered queries of the order-book operators, over deterministic views of ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import grid as G
from tidebook.operators import analysis, book, chains, depth, episodes, events, matching, repair, replay
from tidebook.plans.session import cut
from tidebook.sources import adapters as A
from tidebook.sources.adapters import instant

START, MIDDLE, END = "2024-01-08", "2024-01-15 12:00:00", "2024-01-22"


def level3(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return chains.build(A.raw_orders(spark, sf_dir, **options))


def stored_level3(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Chains written once, as a store would hold them, for queries that read them more than once."""
    return cut(level3(spark, sf_dir, **options))


def labelled(rows: DataFrame) -> DataFrame:
    """Level changes with bid and ask for b and s, as the book kernels take them."""
    return rows.withColumn("side", G.side_label(F.col("side")))


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Times as microseconds and decimals as doubles, for comparing values."""
    kinds = dict(rows.dtypes)
    out = []
    for c in columns or rows.columns:
        if kinds[c] == "timestamp":
            out.append(F.unix_micros(c).alias(c if c.endswith("_us") else f"{c}_us"))
        elif kinds[c].startswith("decimal"):
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def level3_chain(spark, d):
    return shown(level3(spark, d), "ts", "order_id", "event_no", "side", "price", "amount", "fill", "next_ts", "next_event_no", "status", "price_ts", "price_event_no")


def depth_changes(spark, d):
    return shown(labelled(depth.changes(level3(spark, d))), "ts", "side", "price", "volume")


def depth_sampled_1h(spark, d):
    return shown(labelled(depth.changes(level3(spark, d), 3600)), "ts", "side", "price", "volume")


def depth_multi_era(spark, d):
    return shown(labelled(depth.continuous(stored_level3(spark, d, eras=A.ERAS))), "ts", "side", "price", "volume")


def starting_depth(spark, d):
    return shown(labelled(depth.at(level3(spark, d), instant(MIDDLE), before=True)), "side", "price", "volume")


def depth_at_ts(spark, d):
    return shown(labelled(depth.at(level3(spark, d, eras=A.ERAS), instant("2024-01-21 06:00:00"))), "side", "price", "volume")


def depth_range(spark, d):
    return shown(depth.depth(stored_level3(spark, d), instant(START), instant(END), 1800), "ts", "side", "price", "volume")


def periods_within_eras(spark, d):
    eras = events.era_table(level3(spark, d, eras=A.ERAS))
    return shown(depth.periods(eras, instant(START), instant(END), 3600), "era", "period_start", "period_end", "previous_period_end")


def events_intervals(spark, d):
    return shown(events.availability(events.era_table(level3(spark, d, eras=A.ERAS)), 60), "interval_start", "interval_end", "status")


def data_overview(spark, d):
    return shown(events.data_overview(events.era_table(level3(spark, d, eras=A.ERAS)), 2), "era", "last_ts", "next_era", "r")


def available_period(spark, d):
    return shown(level3(spark, d, venues=3).groupBy("exchange", "pair").agg(F.min("ts").alias("s"), F.max("ts").alias("e")))


def era_summary(spark, d):
    l3 = stored_level3(spark, d, eras=A.ERAS)
    rows = events.era_summary(l3, A.trades(spark, d), events.era_table(l3))
    for c in ("events_per_second", "trades_per_second"):
        rows = rows.withColumn(c, F.round(c, 9))
    return shown(rows, "era", "events", "created", "changed", "deletions", "trades", "events_per_second", "trades_per_second", "first_event", "last_event")


def book_snapshot(spark, d):
    return shown(book.snapshot(level3(spark, d), instant(MIDDLE)), "ts", "order_id", "event_no", "side", "price", "amount")


def book_flags(spark, d):
    return shown(book.with_flags(book.snapshot(level3(spark, d, crossed=True), instant(MIDDLE))), "order_id", "event_no", "side", "price", "is_maker", "is_crossed")


def book_liquidity(spark, d):
    return shown(book.order_book(level3(spark, d, crossed=True), instant(MIDDLE), max_levels=20, bps_range=500), "order_id", "side", "price", "amount", "liquidity", "bps", "level")


def _changes(spark, d, frequency=None, **options):
    return labelled(depth.changes(level3(spark, d, **options), frequency))


def spread(spark, d):
    return shown(replay.spread(_changes(spark, d)), "ts", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume")


def spread_sampled_1h(spark, d):
    return shown(replay.spread(_changes(spark, d, 3600)), "ts", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume")


def spread_uncrossed(spark, d):
    rows = replay.spread(_changes(spark, d, crossed=True)).dropna(subset=["best_bid_price", "best_ask_price"])
    return shown(rows.where("best_bid_price <= best_ask_price"), "ts", "best_bid_price", "best_ask_price")


def mid_price(spark, d):
    rows = replay.spread(_changes(spark, d)).dropna(subset=["best_bid_price", "best_ask_price"])
    return rows.select(F.unix_micros("ts").alias("ts_us"), F.round((F.col("best_bid_price") + F.col("best_ask_price")).cast("double") / 2, 4).alias("mid"))


def _daily_books(spark, d):
    rows = _changes(spark, d)
    days = spark.range(2, 30).select(F.lit("venue0").alias("exchange"), F.lit("AB").alias("pair"), F.timestamp_micros(F.unix_micros(instant("2024-01-01")) + F.col("id") * 86_400_000_000).alias("at"))
    return depth.books_at(rows, days)


def depth_summary_bps(spark, d):
    return shown(depth.summary(_daily_books(spark, d), 100, 1000), "ts", "side", "bps_level", "price", "volume")


def depth_summary_pivot(spark, d):
    wide = depth.summary_pivot(depth.summary(_daily_books(spark, d), 250, 1000), 250, 1000)
    return shown(wide.drop("exchange", "pair"))


def depth_resample_tick(spark, d):
    return shown(depth.resample(A.depth_updates(spark, d), 500, 30 * 86400), "ts", "side", "price", "volume")


def depth_signed_changes(spark, d):
    return shown(depth.signed_changes(A.depth_updates(spark, d)), "ts", "side", "price", "volume", "delta")


def chain_id(spark, d):
    return shown(depth.chain_ids(depth.signed_changes(A.depth_updates(spark, d))), "ts", "side", "price", "delta", "chain_id")


def queues_absolute(spark, d):
    q = replay.queues(_changes(spark, d, 86400), 25.0, 1, 4)
    return q.select(F.unix_micros("ts").alias("ts_us"), *(F.col(s)[i].alias(f"{s}{i + 1}") for s in "ba" for i in range(4)))


def trading_period_best(spark, d):
    return shown(replay.trading_period(_changes(spark, d)), "ts", "bid_price", "ask_price")


def _rounded(rows):
    return rows.select(F.unix_micros("ts").alias("ts_us"), F.round("bid_price", 4).alias("bid_price"), F.round("ask_price", 4).alias("ask_price"))


def trading_period_volume(spark, d):
    return _rounded(replay.trading_period(_changes(spark, d, 3600), 500.0))


def trading_period_infinite(spark, d):
    return _rounded(replay.trading_period(_changes(spark, d, 3600), float("inf")))


def _quotes(spark, d):
    return replay.trading_period(_changes(spark, d, 600))


def _positions(rows):
    return shown(rows.withColumn("rate", F.round("rate", 12)).withColumn("log_return", F.round("log_return", 12)))


def trading_strategy(spark, d):
    return _positions(replay.trading_strategy(_quotes(spark, d), 0.0005, 1e-10, mode="mid-price"))


def epsilon_drawupdowns(spark, d):
    return _positions(replay.drawupdowns(_quotes(spark, d), 0.002))


def events_classified(spark, d):
    l3 = stored_level3(spark, d, crossed=True)
    sp = replay.spread_between(l3, instant(START), F.timestamp_micros(F.unix_micros(instant(END)) + 1))
    return shown(events.classify(l3, sp, instant(START), instant(END), A.matches(spark, d, l3)))


def export_events(spark, d):
    return shown(events.export(level3(spark, d), instant(START), instant(END)))


def trades(spark, d):
    return shown(events.trades(A.matches(spark, d, level3(spark, d)), instant(START), instant(END)).drop("exchange", "pair"))


def _all_trades(spark, d):
    """The whole table: its least and greatest time are the range."""
    m = A.matches(spark, d, level3(spark, d))
    return events.trades(m, *(F.lit(t).cast("timestamp") for t in m.agg(F.min("ts"), F.max("ts")).first()))


def market_orders(spark, d):
    t = _all_trades(spark, d).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return events.market_orders(t).select(F.unix_micros("timestamp").alias("timestamp_us"), "taker", "direction", F.col("volume").cast("double").alias("volume"), "levels", F.round(F.col("mean_price").cast("double"), 4).alias("mean_price"))


def crossed_books(spark, d):
    return shown(repair.crossed_books(replay.spread(_changes(spark, d, crossed=True))), "previous_uncrossed", "first_crossed", "next_uncrossed")


def _fills(spark, d):
    return level3(spark, d).where("fill > 0").withColumn("event", F.col("seq"))


def match_exact_fill(spark, d):
    events_ = _fills(spark, d)
    late = F.timestamp_micros(F.unix_micros("ts") - (F.col("seq") % 4) * 400_000)
    trades_ = events_.select("exchange", "pair", F.col("seq").alias("trade"), late.alias("ts"), "price", F.col("fill").alias("amount"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"))
    return matching.exact(trades_, events_.select("exchange", "pair", "event", "ts", "price", "fill", "side"))


def match_sum_of_fill(spark, d):
    events_ = _fills(spark, d)
    half = (F.col("fill") / 2).cast("decimal(28,8)")
    part = F.explode(F.array(F.struct(F.lit(0).alias("k"), half.alias("a")), F.struct(F.lit(1).alias("k"), (F.col("fill") - half).alias("a"))))
    t = events_.withColumn("p", part)
    t = t.select("exchange", "pair", (F.col("seq") * 2 + F.col("p.k")).alias("trade"), F.timestamp_micros(F.unix_micros("ts") - 500_000 + F.col("p.k") * 300_000).alias("ts"), "price", F.col("p.a").alias("amount"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"))
    out = matching.by_sum(t, events_.select("exchange", "pair", "event", "ts", "price", "fill", "side"))
    return out.select("event", F.element_at("members", 1).alias("first_trade"), F.size("members").alias("members"))


def infer_trades(spark, d):
    return shown(replay.infer_trades(level3(spark, d, crossed=True), 3600.0, 0))


def dup_order_events(spark, d):
    raw = A.raw_orders(spark, d)
    return shown(repair.duplicate_events(raw.withColumn("ts", G.floor_to(F.col("ts"), 86400))), "order_id", "ts", "copies")


def invalid_chains(spark, d):
    return shown(repair.invalid_chains(level3(spark, d).where("seq % 17 <> 0")), "order_id", "ts", "event_no", "problem")


def eternal_orders(spark, d):
    return shown(repair.eternal_orders(level3(spark, d), 86400), "order_id", "ts", "event_no")


def merge_episodes(spark, d):
    raw = A.raw_orders(spark, d)
    spans = spark.range(1, 29).select(F.lit("venue0").alias("exchange"), F.lit("AB").alias("pair"), *(F.timestamp_micros(F.unix_micros(instant("2024-01-01")) + F.col("id") * 86_400_000_000 + k * 3_600_000_000).alias(c) for c, k in (("start", 1), ("end", 9))))
    return shown(repair.merge_episodes(raw, spans, 8 * 3600), "seq", "order_id", "ts")


def missing_fill_backprop(spark, d):
    l3 = level3(spark, d).withColumn("fill", F.when(F.col("seq") % 3 != 0, F.col("fill")))
    found = l3.where("fill is null and event_no > 1 and not deleted and seq % 2 = 1").select("order_id", "event_no", F.lit(2).cast("decimal(28,8)").alias("amount"), "segment", "seq")
    one = found.groupBy("order_id", "event_no").agg(F.max("amount").alias("amount"))
    return shown(repair.missing_fills(l3, one), "seq", "amount", "fill")


def session_eras(spark, d):
    raw = chains.session_eras(A.raw_orders(spark, d), 900)
    return shown(raw.groupBy("era").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts")))


def late_reassign(spark, d):
    raw = chains.assign_eras(A.raw_orders(spark, d), A.eras(spark))
    return shown(raw.groupBy("era").agg(F.count("*").alias("events"), F.countDistinct("order_id").alias("orders")))


def reincarnation_numbering(spark, d):
    return level3(spark, d).groupBy("order_id", "segment").agg(F.max("event_no").alias("events"))


def order_book_diff(spark, d):
    def raw_book(at):
        rows = book.snapshot(level3(spark, d), instant(at))
        return rows.select("order_id", "price", F.when(F.col("side") == "b", F.col("amount")).otherwise(-F.col("amount")).alias("amount"))

    return shown(depth.order_book_difference(raw_book(START), raw_book(MIDDLE)))


def asof_last_spread(spark, d):
    t = A.trades(spark, d)
    sp = cut(replay.spread(_changes(spark, d)))
    return shown(events.last_known(t, sp, ["best_bid_price", "best_ask_price"]), "exchange_trade_id", "best_bid_price", "best_ask_price")


def power_law_volume(spark, d):
    t = A.trades(spark, d).groupBy(G.ceil_to(F.col("ts"), 900).alias("cell")).agg(F.sum("amount").cast("double").alias("volume"))
    return analysis.power_law(t, "volume", 1.0).select("n", "tail", F.round("sigma", 6).alias("sigma"), F.round("exponent", 6).alias("exponent"))


def _mids(spark, d, seconds, **options):
    return analysis.sampled(replay.spread(_changes(spark, d, **options)), seconds)


def power_law_returns(spark, d):
    mids = _mids(spark, d, 900)
    r = analysis.jumps(mids, 4).select(F.abs("log_return").alias("r")).where("r > 0")
    return analysis.power_law(r, "r", 1.0).select("n", "tail", F.round("exponent", 5).alias("exponent"))


def lead_lag_corr(spark, d):
    out = analysis.lead_lag(_mids(spark, d, 3600, venues=3), 3600, "venue0", "venue1")
    return out.select("lag", F.round("correlation", 6).alias("correlation"))


def jump_test(spark, d):
    out = analysis.jumps(_mids(spark, d, 600), 30)
    return out.select(F.unix_micros("ts").alias("ts_us"), F.round("log_return", 9).alias("log_return"), F.round("statistic", 5).alias("statistic"))


def range_by_interval(spark, d):
    return analysis.ranges(_mids(spark, d, 600), 86400).select(F.unix_micros("cell").alias("cell_us"), F.round("log_range", 9).alias("log_range"))


def top_spikes(spark, d):
    return _positions(analysis.top_spikes(replay.drawupdowns(_quotes(spark, d), 0.001), 10))


def takers_levels(spark, d):
    t = _all_trades(spark, d).withColumn("timestamp", G.floor_to(F.col("timestamp"), 86400))
    return shown(analysis.takers_levels(events.market_orders(t)))


def _placed(spark, d):
    changes = cut(_changes(spark, d))
    return analysis.placements(depth.signed_changes(changes), cut(replay.spread(changes)))


def limit_placements(spark, d):
    return shown(_placed(spark, d), "ts", "side", "price", "delta", "kind", "distance")


def arrival_rate_by_distance(spark, d):
    rates = analysis.arrival_rates(_placed(spark, d), 25.0, F.lit(29 * 86400.0))
    return rates.select("kind", "ticks", "events", F.round("rate", 9).alias("rate"))


def placements_histogram(spark, d):
    return analysis.count_histogram(_placed(spark, d).where("kind = 'placement'"), 600, instant(START), instant(END))


def queue_profile(spark, d):
    q = analysis.queue_profile(replay.queues(_changes(spark, d, 86400), 25.0, 1, 4))
    return q.select("side", "tick", F.round("volume", 6).alias("volume"))


def quote_events(spark, d):
    return shown(analysis.quote_events(level3(spark, d)), "order_id", "segment", "k", "type", "decrease")


def position_trellis(spark, d):
    q = _quotes(spark, d)
    rows = analysis.position_trellis(replay.drawupdowns(q, 0.002), q, 600)
    return shown(rows.withColumn("log_bid", F.round("log_bid", 12)).withColumn("log_ask", F.round("log_ask", 12)))


def _levels_at(spark, d, when, **options):
    return labelled(depth.at(level3(spark, d, **options), instant(when))).drop("exchange", "pair", "era")


def depth_difference(spark, d):
    return shown(depth.difference(_levels_at(spark, d, START), _levels_at(spark, d, MIDDLE)), "side", "price", "volume")


def depth_applied(spark, d):
    before, after = _levels_at(spark, d, START), _levels_at(spark, d, MIDDLE)
    return shown(depth.apply_changes(before, depth.difference(before, after)), "side", "price", "volume")


def takers_checked(spark, d):
    return shown(book.check_takers(book.with_flags(book.snapshot(level3(spark, d), instant(MIDDLE)))), "order_id", "is_maker", "is_crossed")


def starting_spread(spark, d):
    rows = depth.starting_spread(level3(spark, d, eras=A.ERAS), instant(MIDDLE))
    return shown(rows, "ts", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume")


def _days(spark, era=None):
    days = spark.range(2, 30).select(F.lit("venue0").alias("exchange"), F.lit("AB").alias("pair"), F.timestamp_micros(F.unix_micros(instant("2024-01-01")) + F.col("id") * 86_400_000_000).alias("at"))
    return days.withColumn("era", instant(A.ERAS[0]))


def spread_by_episode(spark, d):
    rows = episodes.spread_by_episode(level3(spark, d, crossed=True), _days(spark))
    return shown(rows, "ts", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume")


def books_by_episode(spark, d):
    rows = episodes.order_book_by_episode(level3(spark, d, crossed=True), _days(spark))
    rows = rows.select(F.col("ts").alias("episode"), F.posexplode("orders").alias("place", "o")).select("episode", "place", "o.*")
    return shown(rows, "episode", "place", "order_id", "event_no", "side", "price", "amount", "is_maker", "is_crossed")


def maker_depth(spark, d):
    return shown(episodes.maker_depth(level3(spark, d, crossed=True), _days(spark)), "ts", "side", "price", "volume")


def depth_summary_range(spark, d):
    rows = replay.changes_from(level3(spark, d), instant(START), instant(MIDDLE), 3600)
    bands = depth.last_per_instant(depth.summary_by_episode(rows, 100, 1000))
    return shown(bands.where(F.col("ts") >= instant(START)), "ts", "side", "bps_level", "price", "volume")


def spread_range(spark, d):
    rows = replay.spread_between(stored_level3(spark, d, eras=A.ERAS), instant(START), instant(END))
    return shown(rows, "ts", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume")


def depth_range_multi_era(spark, d):
    return shown(depth.depth(stored_level3(spark, d, eras=A.ERAS), instant(START), instant(END)), "ts", "side", "price", "volume")


def depth_at_emptied_era(spark, d):
    """An era whose only order is deleted again has no book, though the era before leaves orders open."""
    raw = A.raw_orders(spark, d)
    late = raw.where("not deleted").limit(1).withColumn("order_id", F.lit(-1).cast("long")).withColumn("era", instant(END)).withColumn("ts", instant("2024-02-10"))
    gone = late.withColumn("ts", instant("2024-02-11")).withColumn("deleted", F.lit(True)).withColumn("seq", F.col("seq") + 1)
    l3 = chains.build(raw.unionByName(late).unionByName(gone))
    return shown(labelled(depth.at(l3, instant("2024-02-12"))), "side", "price", "volume")


def depth_window(spark, d):
    rows = depth.in_window(depth.changes(level3(spark, d)), (900, 1100), (2, 20))
    return shown(labelled(rows), "ts", "side", "price", "volume")


def _chained_fills(spark, d):
    return _fills(spark, d).select("exchange", "pair", "event", "ts", "order_id", "amount", "fill", F.lit("changed").alias("action"), "price")


def _chained_trades(rows):
    numbered = matching.numbered(rows, "n", "ts", "event")
    then = numbered.select((F.col("n") - 1).alias("n"), F.col("order_id").alias("_then"))
    met = numbered.join(then, "n").where("n % 2 = 0")
    up = F.col("event") % 2 == 0
    return met.select(
        "exchange", "pair", F.col("event").alias("trade"), "price", F.col("fill").alias("amount"),
        F.when(up, F.col("order_id")).otherwise(F.col("_then")).alias("buy_order_id"), F.when(up, F.col("_then")).otherwise(F.col("order_id")).alias("sell_order_id"),
    )


def match_sequential(spark, d):
    rows = cut(_chained_fills(spark, d))
    return matching.sequential(_chained_trades(rows), rows.drop("price"), 1e-4)


def match_rules(spark, d):
    rows = level3(spark, d)
    amount = F.coalesce("fill", "amount") + F.when(F.col("seq") % 3 == 0, F.lit("0.00000001").cast("decimal(28,8)")).when(F.col("seq") % 3 == 1, F.lit(0)).otherwise(F.lit(1))
    event = F.when(F.col("deleted"), "deleted").when(F.col("event_no") == 1, "created").otherwise("changed")
    fill = F.when(F.col("seq") % 5 != 0, F.col("fill"))
    return rows.select("seq", G.match_rule(amount, F.col("price"), F.col("amount"), fill, event, 1e-4).alias("rule"))


def remaining_fill(spark, d):
    rows = _fills(spark, d).select("event", "fill")
    used = rows.where("event % 2 = 0").select("event", F.explode(F.array((F.col("fill") / 4).cast("decimal(28,8)"), (F.col("fill") / 2).cast("decimal(28,8)"))).alias("amount"))
    return shown(matching.remaining_fill(rows, used), "event", "fill", "left")


def coupling_candidates(spark, d):
    l3 = stored_level3(spark, d)
    changes = depth.signed_changes(labelled(depth.changes(l3)))
    rows = l3.where("fill > 0")
    late = F.timestamp_micros(F.unix_micros("ts") - (F.col("seq") % 4) * 400_000)
    t = rows.select("exchange", "pair", F.col("seq").alias("trade"), late.alias("ts"), "price", F.col("fill").alias("amount"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"))
    return matching.coupling(changes, t)


def _shaken(spark, d):
    """Events of first lives whose times are out of order here and there."""
    rows = level3(spark, d).where("segment = 0")
    move = F.when(F.col("seq") % 3 == 0, F.col("seq") % 7 * 20_000_000_000).otherwise(0)
    return rows.select("order_id", "event_no", F.timestamp_micros(F.unix_micros("ts") + move).alias("ts"), "fill", "price_ts", "seq")


def monotone_times(spark, d):
    return shown(repair.monotone(_shaken(spark, d)), "order_id", "event_no", "ts")


def aggressor_first(spark, d):
    return shown(repair.aggressor_first(_shaken(spark, d)), "order_id", "event_no", "ts")


def times_in_order(spark, d):
    return shown(repair.in_order(_shaken(spark, d).withColumn("matched", F.lit(False))), "order_id", "event_no", "ts")


def revealed_episodes(spark, d):
    rows = cut(_shaken(spark, d).withColumn("event", F.col("seq")))
    m = rows.where("seq % 5 = 0").select(F.col("seq").alias("buy_event")).join(rows.where("seq % 5 = 1").select(F.col("seq").alias("sell_event")), F.expr("sell_event = buy_event + 1"))
    return shown(repair.reveal_episodes(rows, m), "event", "ts")


def synthetic_creations(spark, d):
    raw = A.raw_orders(spark, d)
    raw = raw.withColumn("event", F.when(F.col("deleted"), "deleted").when(F.col("seq") % 4 == 0, "created").otherwise("changed"))
    return shown(chains.build(chains.with_creations(raw)), "order_id", "segment", "event_no", "status", "price", "seq")


def transferred_chains(spark, d):
    return shown(repair.finished(level3(spark, d), instant(MIDDLE)), "order_id", "segment", "event_no", "ts")


def deleted_events(spark, d):
    l3 = stored_level3(spark, d)
    return shown(repair.delete_events(l3, l3.where("seq % 97 = 0")), "seq", "order_id", "event_no", "status", "next_ts", "next_event_no")


def reconnected_chains(spark, d):
    l3 = level3(spark, d).where("segment = 0")
    lost = (F.col("seq") % 13 == 0) & (F.col("status") == "superseded")
    l3 = cut(l3.withColumn("next_ts", F.when(~lost, F.col("next_ts"))).withColumn("next_event_no", F.when(~lost, F.col("next_event_no"))).withColumn("status", F.when(lost, "open").otherwise(F.col("status"))))
    return shown(repair.fix_eternals(l3), "seq", "status", "next_ts", "next_event_no")


def duplicates_fixed(spark, d):
    l3 = level3(spark, d).where("segment = 0")
    again = l3.where("event_no = 1 and order_id % 3 = 0").withColumn("status", F.lit("open")).withColumn("seq", -F.col("seq"))
    return repair.fix_duplicate_events(l3.unionByName(again)).select("seq", "order_id", "event_no", "status")


def queues_log(spark, d):
    q = replay.queues(_changes(spark, d, 86400), 0.01, 1, 4, log=True)
    return q.select(F.unix_micros("ts").alias("ts_us"), *(F.col(s)[i].alias(f"{s}{i + 1}") for s in "ba" for i in range(4)))


def rate_fit(spark, d):
    rates = analysis.arrival_rates(_placed(spark, d), 25.0, F.lit(29 * 86400.0))
    return analysis.rate_fit(rates).select("kind", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def raw_book_eras(spark, d):
    """Orders of the second week as raw book rows, with snapshots of what is there at some instants: a near one and a far one."""
    raw = A.raw_orders(spark, d).where((F.col("ts") >= instant(START)) & (F.col("ts") < instant(END)))
    sign = F.when(F.col("side") == "b", F.col("amount")).otherwise(-F.col("amount"))
    rows = raw.select("exchange", "pair", "ts", "seq", "order_id", F.when(F.col("deleted"), 0).otherwise(F.col("price")).cast("decimal(18,8)").alias("price"), sign.cast("decimal(28,8)").alias("amount"), (F.col("seq") % 100 == 0).alias("snapshot"))
    from tidebook.sources import messages

    return shown(messages.bitfinex_eras(rows, 180.0), "era", "ts", "order_id", "price", "amount")


def book_arrays(spark, d):
    rows = book.as_arrays(book.snapshot(level3(spark, d, crossed=True), instant(MIDDLE)))
    rows = rows.select("ts", F.size("orders").alias("n"), F.posexplode("orders").alias("place", "o"))
    return shown(rows.select("ts", "n", "place", "o.order_id", "o.price", "o.amount"))


def tick_levels(spark, d):
    return shown(book.tick_volume(_levels_at(spark, d, MIDDLE).withColumn("exchange", F.lit("venue0")).withColumn("pair", F.lit("AB")), 25), "side", "price", "volume")


def price_segments(spark, d):
    rows = analysis.segments(replay.trading_period(_changes(spark, d, 3600), 500.0), "bid_price")
    return rows.select(F.unix_micros("ts").alias("ts_us"), "run", F.round("bid_price", 4).alias("bid_price"))


def order_flow_without_trades(spark, d):
    signed = depth.signed_changes(labelled(depth.changes(level3(spark, d))))
    took = _fills(spark, d).where("seq % 2 = 0").select("exchange", "pair", "ts", "price", F.col("fill").alias("amount"), F.when(F.col("side") == "b", "s").otherwise("b").alias("side"))
    return shown(analysis.without_market_orders(signed, took), "ts", "side", "price", "delta")


def renumbered_chains(spark, d):
    rows = chains.renumber(level3(spark, d), A.eras(spark))
    return shown(rows, "era", "ts", "order_id", "event_no", "price", "amount", "status", "next_event_no")


def time_jumps(spark, d):
    rows = _shaken(spark, d).withColumn("original_ts", F.timestamp_micros(F.unix_micros("ts") - F.col("seq") % 5 * 10_000_000 + 10_000_000))
    return shown(repair.time_jumps(rows, 25), "seq", "ts")


def event_times(spark, d):
    return level3(spark, d).select("seq", G.since_2000(F.col("ts")).alias("since_2000"), G.in_milliseconds(F.col("ts")).alias("milliseconds"))


QUERIES = {
    f.__name__: f
    for f in (
        level3_chain, depth_changes, depth_sampled_1h, depth_multi_era, starting_depth, depth_at_ts, depth_range, periods_within_eras, events_intervals, data_overview, available_period,
        era_summary, book_snapshot, book_flags, book_liquidity, spread, spread_sampled_1h, spread_uncrossed, mid_price, depth_summary_bps, depth_summary_pivot, depth_resample_tick,
        depth_signed_changes, chain_id, queues_absolute, trading_period_best, trading_period_volume, trading_period_infinite, trading_strategy, epsilon_drawupdowns, events_classified,
        export_events, trades, market_orders, crossed_books, match_exact_fill, match_sum_of_fill, infer_trades, dup_order_events, invalid_chains, eternal_orders, merge_episodes,
        missing_fill_backprop, session_eras, late_reassign, reincarnation_numbering, order_book_diff, asof_last_spread, power_law_volume, power_law_returns, lead_lag_corr, jump_test,
        range_by_interval, top_spikes, takers_levels, limit_placements, arrival_rate_by_distance, placements_histogram, queue_profile, quote_events, position_trellis,
        depth_difference, depth_applied, takers_checked, starting_spread, spread_by_episode, books_by_episode, maker_depth, depth_summary_range, spread_range, depth_range_multi_era, depth_at_emptied_era,
        depth_window, match_sequential, match_rules, remaining_fill, coupling_candidates, monotone_times, aggressor_first, times_in_order, revealed_episodes, synthetic_creations, transferred_chains,
        deleted_events, reconnected_chains, duplicates_fixed, queues_log, rate_fit, raw_book_eras, book_arrays, tick_levels, price_segments, order_flow_without_trades, renumbered_chains, time_jumps, event_times,
    )
}
