"""Ranged reads, and repairs of what a capture got wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_order_book import at, instant, levels, raw
from tidebook.api import Engine, check_frame, check_range
from tidebook.functions import grid
from tidebook.operators import book, chains, depth, episodes, matching, repair, replay
from tidebook.sources import messages, store

LATER = at(1000)


@pytest.fixture(scope="module")
def two_eras(spark):
    """An order left open in the first era; the second one's only order is deleted again at 1200."""
    first = raw(spark, [(0, 1, "b", 99, 5), (5, 2, "s", 101, 4), (10, 1, "b", 99, 3), (700, 3, "b", 98, 1)])
    second = raw(spark, [(1000, 4, "b", 97, 2), (1100, 5, "s", 103, 1), (1150, 5, "s", 103, 2), (1200, 4, "b", None, None), (1200, 5, "s", None, None), (1500, 6, "b", 96, 1), (1600, 6, "b", None, None)], LATER)
    return chains.build(first.unionByName(second.withColumn("seq", F.col("seq") + 100))).cache()


def shown(rows):
    return sorted((r.ts, r.side, float(r.price), float(r.volume)) for r in rows.collect())


def test_an_emptied_era_has_no_book(two_eras):
    for when in (1250, 1700):
        assert depth.at(two_eras, instant(when)).count() == 0 and book.snapshot(two_eras, instant(when)).count() == 0
        assert depth.depth(two_eras, instant(when), instant(when + 100), moving=False).count() == 0
    assert [(r.price, r.volume) for r in depth.at(two_eras, instant(1050)).collect()] == [(97, 2)]
    assert {float(r.price) for r in depth.at(two_eras, instant(900)).collect()} == {99, 98, 101}


@pytest.mark.parametrize(("start", "end", "frequency"), [(3, 800, None), (0, 1000, None), (3, 1700, None), (1000, 1200, None), (1180, 1650, None), (7, 1130, 60), (999, 1001, 10), (1300, 1400, 30), (5, 5.5, None)])
def test_ranges_are_those_of_all_history(spark, two_eras, start, end, frequency):
    a, b = instant(start), instant(end)
    every = depth.continuous(two_eras, frequency)
    low, high = grid.floor_to(a, frequency), grid.ceil_to(b, frequency)
    expected = every.where((F.col("ts") >= low) & ((F.col("ts") <= high) if frequency else (F.col("ts") < high)))
    assert shown(depth.between(two_eras, a, b, frequency)) == shown(expected)
    eras = spark.createDataFrame([("x", "AB", at(0)), ("x", "AB", LATER)], "exchange string, pair string, era timestamp")
    assert shown(depth.between(two_eras, a, b, frequency, eras)) == shown(expected)
    for view in (replay.spread, replay.trading_period) if start in (7, 1180) else ():
        whole = view(every.withColumn("side", grid.side_label(F.col("side")))).where((F.col("ts") >= low) & ((F.col("ts") <= high) if frequency else (F.col("ts") < high)))
        assert sorted(map(str, replay.within(view, two_eras, a, b, frequency).collect())) == sorted(map(str, whole.collect()))


def test_range_filters_reach_the_scan(spark, two_eras, tmp_path):
    store.write_partitioned(two_eras, str(tmp_path / "level3"))
    eras = spark.createDataFrame([("x", "AB", at(0)), ("x", "AB", LATER)], "exchange string, pair string, era timestamp")
    eras.write.parquet(str(tmp_path / "eras"))
    engine = Engine.open(spark, str(tmp_path))
    rows = engine.depth("X", "ab", "2024-01-01 00:16:50", "2024-01-01 00:21:00")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "price#" in line]
    assert scans and all("PushedFilters: [IsNotNull(ts)" in x and "LessThan" in x and "exchange#" in x.split("PartitionFilters")[1] for x in scans)
    assert shown(rows) == shown(Engine(two_eras).depth("X", "ab", "2024-01-01 00:16:50", "2024-01-01 00:21:00")) != []
    assert engine.spread("x", "AB", "2024-01-01 00:18:30", complete_cases=False).first().best_ask_price == 103
    assert engine.matches is None and engine.spread("x", "AB", "2024-01-01 00:16:40", "2024-01-01 00:20:00").count() == 2


def test_ranges_and_frames_are_checked(spark, two_eras):
    engine = Engine(two_eras)
    one = lambda a, b: spark.range(1).where(check_range("spread", a, b)).count()
    assert one("2024-01-31 10:00:00", "2024-02-29 10:01:00") == 1 and one("2024-01-01 00:00:00", "2024-02-01 00:01:00") == 1
    for bad in (("2024-01-31 10:00:00", "2024-02-29 10:01:01"), ("2024-01-01 00:00:00", "2024-02-01 00:01:01")):
        with pytest.raises(Exception, match="longer than a month"):
            one(*bad)
    with pytest.raises(Exception, match="longer than a month"):
        engine.spread("x", "AB", "2024-01-01 00:00:00", "2024-03-01 00:00:00").collect()
    with pytest.raises(TypeError, match="volume"):
        engine.spread(levels(spark, [(0, "bid", 1, 1)]).drop("volume"))
    with pytest.raises(TypeError, match="bid_price"):
        check_frame(spark.range(1).select(F.lit(at(0)).alias("ts"), F.lit("a").alias("bid_price")), {"ts": ("timestamp",), "bid_price": ("double",)})
    wide = engine.depth_summary("x", "AB", "2024-01-01 00:16:40", "2024-01-01 00:20:00").orderBy("ts").collect()
    assert [(r.ts, r.bid_vol0bps, r.ask_vol0bps) for r in wide if r.ts >= LATER] == [(LATER, 2, 0), (at(1100), 2, 1), (at(1150), 2, 2)]


def test_spreads_of_books(spark, two_eras):
    got = depth.spread_of(levels(spark, [(0, "bid", 9, 1), (0, "bid", 8, 2), (0, "ask", 11, 3), (0, "ask", 10, 0)]), "exchange").first()
    assert tuple(map(float, got[1:])) == (9, 1, 11, 3)
    rows = {r.ts: r for r in episodes.spread_by_episode(two_eras, with_order_book=True).collect()}
    assert set(rows) == {at(s) for s in (0, 5, 10, 1000, 1100, 1150, 1200, 1500, 1600)} and len(rows[at(1150)].order_book) == 2
    assert rows[at(1200)].best_bid_price is None and rows[at(1200)].order_book is None and float(rows[at(1150)].best_ask_volume) == 2
    assert episodes.spread_by_episode(two_eras, only_different=False).count() == 10
    window = depth.in_window(levels(spark, [(0, "bid", 9, 1), (0, "bid", 8, 0), (0, "ask", 20, 0), (0, "ask", 10, 50)]), (8, 12), (1, 10))
    assert sorted(float(r.price) for r in window.collect()) == [8, 9]
    last = depth.last_per_instant(levels(spark, [(0.000001, "bid", 9, 1), (0.000004, "bid", 8, 1), (0.000004, "ask", 8, 1), (0.00002, "bid", 7, 1)]))
    assert sorted(float(r.price) for r in last.collect()) == [7, 8, 8]


def test_exact_matches_of_long_queues(spark):
    """More trades of one price and amount within the delay than any small number of passes would match."""
    n = 15
    t = spark.createDataFrame([("x", "AB", k, at(k * 0.01), 10.0, 1.0, "b") for k in range(n)], "exchange string, pair string, trade int, ts timestamp, price double, amount double, side string")
    e = spark.createDataFrame([("x", "AB", 100 + k, at(0.5 + k * 0.01), 10.0, 1.0, "s") for k in range(n)], "exchange string, pair string, event int, ts timestamp, price double, fill double, side string")
    assert sorted((r.trade, r.event) for r in matching.exact_all(t, e).collect()) == [(k, 100 + k) for k in range(n)]


def test_sequential_matches_cross_days(spark):
    midnight = 86400
    events_ = [("x", "AB", 1, at(midnight - 1), 11, 1.0, 1.0, "changed"), ("x", "AB", 2, at(midnight + 1), 12, 1.0, 1.0, "changed"), ("x", "AB", 3, at(5 * midnight), 13, 1.0, 1.0, "changed"), ("y", "AB", 4, at(5 * midnight + 1), 14, 1.0, 1.0, "changed")]
    e = spark.createDataFrame(events_, "exchange string, pair string, event int, ts timestamp, order_id int, amount double, fill double, action string")
    t = spark.createDataFrame([("x", "AB", 50, 10.0, 1.0, 11, 12), ("x", "AB", 51, 10.0, 1.0, 13, 12), ("x", "AB", 52, 10.0, 1.0, 13, 14)], "exchange string, pair string, trade int, price double, amount double, buy_order_id int, sell_order_id int")
    assert [(r.trade, r.buy_event, r.sell_event) for r in matching.sequential(t, e).collect()] == [(50, 1, 2)]
    assert [(r.trade, r.buy_event, r.sell_event) for r in matching.sequential(t, e, offset=2).collect()] == []
    assert sorted((r.trade, r.buy_event) for r in matching.sequential_all(t.where("trade = 51"), e.where("event > 1")).collect()) == [(51, 3)]


def test_matching_with_cut_prices(spark):
    t = spark.createDataFrame([("x", "AB", k, at(k), p, a, "b") for k, (p, a) in enumerate([("10.12", "1"), ("10.12", "2"), ("10.12", "3"), ("10.129", "4")])], "exchange string, pair string, trade int, ts timestamp, price string, amount string, side string")
    t = t.withColumn("price", F.col("price").cast("decimal(18,8)")).withColumn("amount", F.col("amount").cast("decimal(28,8)"))
    e = spark.createDataFrame([("x", "AB", 10, at(0.5), "10.12", "1", "s"), ("x", "AB", 11, at(2.5), "10.12", "5", "s"), ("x", "AB", 12, at(3.5), "10.12", "4", "s")], "exchange string, pair string, event int, ts timestamp, price string, fill string, side string")
    e = e.withColumn("price", F.col("price").cast("decimal(18,8)")).withColumn("fill", F.col("fill").cast("decimal(28,8)"))
    got = {r.event: list(r.trades) for r in matching.by_price(t, e, 3).collect()}
    assert got == {10: [0], 11: [1, 2], 12: [3]}


def test_crossed_orders_are_mended(spark):
    """A bid that should have been taken and stays for ever goes; one whose next event is near ends with it."""
    rows = raw(spark, [(0, 1, "s", 10, 1), (0, 2, "b", 9, 1), (5, 3, "b", 11, 1), (20, 4, "b", 12, 1), (22, 4, "b", None, None), (60, 5, "b", 8, 1)])
    view = lambda r: replay.spread(depth.changes(chains.build(r)).withColumn("side", grid.side_label(F.col("side"))))
    assert repair.crossed_books(view(rows)).count() == 1
    fixed = repair.fix_crossed_orders(rows)
    assert fixed.columns == rows.columns and repair.crossed_books(view(fixed)).count() == 0
    end = {r.order_id for r in book.snapshot(chains.build(fixed), instant(100)).collect()}
    assert end == {1, 2, 5}


def test_chains_are_mended(spark):
    rows = raw(spark, [(0, 1, "b", 10, 5), (1, 1, "b", 10, 3), (2, 1, "b", 10, 2), (3, 2, "s", 11, 1), (4, 2, "s", None, None)])
    l3 = chains.build(rows)
    broken = l3.withColumn("next_ts", F.when(F.col("seq") != 0, F.col("next_ts"))).withColumn("status", F.when(F.col("seq") == 0, "open").otherwise(F.col("status")))
    assert repair.invalid_chains(broken).count() == 1 and repair.invalid_chains(repair.fix_eternals(broken)).count() == 0
    again = l3.unionByName(l3.where("seq = 0").withColumn("status", F.lit("open")).withColumn("next_ts", F.lit(None).cast("timestamp")))
    assert repair.fix_duplicate_events(again).count() == l3.count()
    gone = repair.delete_events(l3, l3.where("seq = 1")).collect()
    assert sorted((r.seq, r.status, r.next_event_no) for r in gone) == [(0, "open", None), (3, "superseded", 2), (4, "deleted", None)]
    assert sorted(r.seq for r in repair.finished(l3, instant(4)).collect()) == [3, 4] and repair.finished(l3, instant(3)).count() == 0


ORDER = "order_id int, event_no int, ts timestamp, fill double, matched boolean"


def test_times_are_put_in_order(spark):
    rows = [(1, 1, at(5), None, False), (1, 2, at(3), 1.0, True), (1, 3, at(9), 1.0, False), (1, 4, at(7), 1.0, False), (2, 1, at(1), None, False), (2, 2, at(4), 0.0, False), (2, 3, at(2), 0.0, False)]
    got = {(r.order_id, r.event_no): r.ts for r in repair.in_order(spark.createDataFrame(rows, ORDER)).collect()}
    assert got == {(1, 1): at(3), (1, 2): at(3), (1, 3): at(7), (1, 4): at(7), (2, 1): at(1), (2, 2): at(4), (2, 3): at(4)}
    with pytest.raises(Exception, match="out of order"):
        repair.in_order(spark.createDataFrame([(1, 1, at(1), None, False), (1, 2, at(3), 1.0, True), (1, 3, at(2), 1.0, True)], ORDER)).collect()


def test_cleansing(spark):
    """A buyer's fill that was lost, and a seller's event that came too early."""
    rows = raw(spark, [(0, 1, "b", 10, 5), (1, 1, "b", 10, 3), (2, 2, "s", 10, 2), (3, 2, "s", 10, 1)])
    l3 = chains.build(rows).withColumn("fill", F.when(F.col("seq") != 1, F.col("fill")))
    matches = spark.createDataFrame([(1, 2, 2, 2, 1.0)], "buy_order_id long, buy_event_no int, sell_order_id long, sell_event_no int, amount double").withColumn("amount", F.col("amount").cast("decimal(28,8)"))
    got = {r.seq: r for r in repair.cleanse(l3, matches).collect()}
    assert [float(got[k].amount) for k in range(4)] == [6, 3, 2, 1] and float(got[1].fill) == 1
    assert got[1].ts == got[3].ts == at(2) and got[0].next_ts == at(2) and got[2].next_ts == at(2) and got[0].status == "superseded"


def test_months_are_eras(spark):
    start = dt.datetime(2024, 1, 31, 23, 0)
    hour = lambda h: (start + dt.timedelta(hours=h) - at(0)).total_seconds()
    rows = raw(spark, [(hour(0), 1, "b", 10, 5), (hour(0.5), 2, "s", 11, 1), (hour(0.7), 2, "s", None, None), (hour(2), 3, "b", 9, 1), (hour(24 * 40), 1, "b", 10, 4)])
    l3 = chains.build(repair.month_eras(rows))
    got = sorted((r.era, r.ts, r.order_id, r.event_no, float(r.amount)) for r in l3.collect())
    second, third = start + dt.timedelta(hours=2), start + dt.timedelta(hours=24 * 40)
    assert [g[1:4] for g in got if g[0] == at(0)] == [(start, 1, 1), (start + dt.timedelta(hours=0.5), 2, 1), (start + dt.timedelta(hours=0.7), 2, 2)]
    assert [g[1:] for g in got if g[0] == second] == [(second, 1, 1, 5.0), (second, 3, 1, 1.0)]
    assert [g[1:] for g in got if g[0] == third] == [(third, 1, 1, 5.0), (third, 1, 2, 4.0), (third, 3, 1, 1.0)]


RAW_BOOK = "exchange string, pair string, ts timestamp, seq long, order_id long, price double, amount double, snapshot boolean"


def test_raw_books_become_eras(spark):
    """A first snapshot, a near one that goes on with the era, and a far one that begins another."""
    rows = [
        (0, 1, 10, 1, True), (0, 2, 11.001, -1, True), (1, 1, 10, 3, False), (1, 1, 10, 2, False),
        (2, 1, 10, 2, True), (2, 3, 9, 1, True),  # order 2 is gone, order 1 as it was, order 3 new
        (60, 1, 10, 2, True), (61, 1, 0, 1, False), (62, 1, 10, 4, False),
    ]
    frame = spark.createDataFrame([("bitfinex", "AB", at(t), k, o, float(p), float(a), s) for k, (t, o, p, a, s) in enumerate(rows)], RAW_BOOK)
    run = messages.bitfinex_eras(frame, 2.0, 2, 8)
    got = sorted((r.era, r.ts, r.order_id, float(r.price), float(r.amount)) for r in run.collect())
    assert got == [(at(0), at(0), 1, 10, 1), (at(0), at(0), 2, 11, -1), (at(0), at(1), 1, 10, 2), (at(0), at(2), 2, 0, -1), (at(0), at(2), 3, 9, 1), (at(60), at(60), 1, 10, 2), (at(60), at(61), 1, 0, 1), (at(60), at(62), 1, 10, 4)]
    l3 = sorted((r.era, r.order_id, r.segment, r.event_no, r.side, r.status) for r in chains.build(messages.bitfinex_level3(run)).collect())
    assert l3 == [(at(0), 1, 0, 1, "b", "superseded"), (at(0), 1, 0, 2, "b", "open"), (at(0), 2, 0, 1, "s", "superseded"), (at(0), 2, 0, 2, "s", "deleted"), (at(0), 3, 0, 1, "b", "open"), (at(60), 1, 0, 1, "b", "superseded"), (at(60), 1, 0, 2, "b", "deleted"), (at(60), 1, 1, 1, "b", "open")]
    window = messages.batch_window(frame, delay_seconds=2, most_seconds=30).first()
    assert (window.start, window.end) == (at(0), at(30)) and messages.batch_window(frame, instant(61), 2).count() == 0


def test_interval_cache_outlives_its_object(spark, tmp_path):
    asked = []

    def compute(a, b):
        asked.append((a, b))
        return spark.range(a // 1_000_000, b // 1_000_000).select(F.timestamp_seconds("id").alias("ts"))

    s = 1_000_000
    for _ in range(2):
        cache = store.IntervalCache(spark, str(tmp_path), 10)
        assert cache.load("k/1", 0, 10 * s, compute, 100 * s).count() == 10
    assert asked == [(0, 10 * s)]
    # another session that didn't see the first interval wrote one that overlaps
    compute(5 * s, 20 * s).write.parquet(f"{cache.folder('k/1')}/{5 * s}_{20 * s}")
    assert cache.load("k/1", 0, 25 * s, compute, 100 * s).distinct().count() == 25 == cache.load("k/1", 0, 25 * s, compute, 100 * s).count()
    assert cache.periods("k/1") == [(0, 25 * s)] and cache.load("k/1", 98 * s, 99 * s, compute, 100 * s).count() == 1
    assert cache.load_seconds("k/1", 1_500_000, 3_500_000, compute, 100 * s).count() == 2
    assert [tuple(r) for r in cache.periods_frame(["k/1", "none"]).collect()] == [("k/1", dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 0, 0, 25))]


def test_an_era_is_deleted_from_the_store(spark, tmp_path):
    rows = levels(spark, [(t, "bid", p, 1) for p, t in enumerate((0, 80_000, 90_000, 170_000, 180_000, 400_000))])
    path = str(tmp_path / "s")
    store.write_partitioned(rows, path)
    assert store.drop_partition(spark, path, "x", "AB", "2024-01-09") is None and store.drop_partition(spark, path, "x", "AB", "2024-01-02").endswith("dt=2024-01-02")
    store.delete_era(spark, path, "x", "AB", instant(80_000), instant(180_000))
    assert sorted(float(r.price) for r in store.scan(spark, path).collect()) == [0, 4, 5]
    store.delete_era(spark, path, "x", "AB", instant(180_000))
    assert sorted(float(r.price) for r in store.scan(spark, path).collect()) == [0]
