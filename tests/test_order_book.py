import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebook.functions import grid
from tidebook.operators import analysis, book, chains, depth, episodes, events, kernels, matching, ranks, repair, replay

RAW = "exchange string, pair string, era timestamp, ts timestamp, seq long, order_id long, side string, price decimal(18,8), amount decimal(28,8), deleted boolean"
ERA = dt.datetime(2024, 1, 1)


def at(seconds):
    return ERA + dt.timedelta(seconds=seconds)


def raw(spark, rows, era=ERA):
    """rows of (seconds, order, side, price, amount or None for a deletion)."""
    from decimal import Decimal

    return spark.createDataFrame([("x", "AB", era, at(t), k, o, s, None if p is None else Decimal(str(p)), None if a is None else Decimal(str(a)), a is None) for k, (t, o, s, p, a) in enumerate(rows)], RAW)


def levels(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([("x", "AB", at(t), s, Decimal(str(p)), Decimal(str(v))) for t, s, p, v in rows], "exchange string, pair string, ts timestamp, side string, price decimal(18,8), volume decimal(28,8)")


def instant(seconds):
    return F.lit(at(seconds))


BOOK = [(0, 397, "s", 7990.4, 1), (0, 398, "s", 7992, 1), (0, 395, "b", 7989, 1)]
EPISODE = [(1, 397, "s", None, None), (1, 398, "s", 7992, 1), (1, 1174, "s", 7993, 1), (1, 395, "b", 7990, 1)]


def test_book_update_gives_changes_and_spreads(spark):
    l3 = chains.build(raw(spark, BOOK + EPISODE))
    got = {(r.side, float(r.price)): float(r.volume) for r in depth.changes(l3).where(F.col("ts") == instant(1)).collect()}
    assert got == {("b", 7989.0): 0, ("b", 7990.0): 1, ("s", 7990.4): 0, ("s", 7993.0): 1}
    rows = depth.changes(l3).withColumn("side", grid.side_label(F.col("side")))
    spread = [(float(r.best_bid_price), float(r.best_ask_price)) for r in replay.spread(rows).orderBy("ts").collect()]
    assert spread == [(7989.0, 7990.4), (7990.0, 7992.0)]


def test_chain_building(spark):
    rows = [(0, 1, "b", 10, 5), (1, 1, "b", 10, 3), (2, 1, "b", 11, 3), (3, 1, "b", None, None), (4, 1, "b", 12, 2), (5, 2, "s", None, None)]
    got = chains.build(raw(spark, rows)).orderBy("seq").collect()
    assert [r.event_no for r in got] == [1, 2, 3, 4, 1]
    assert [None if r.fill is None else float(r.fill) for r in got] == [None, 2, 0, None, None]
    assert [r.price_event_no for r in got] == [1, 1, 3, 3, 1]
    assert [r.status for r in got] == ["superseded"] * 3 + ["deleted", "open"]
    assert [r.next_event_no for r in got] == [2, 3, 4, None, None]
    assert len({(r.order_id, r.segment) for r in got}) == 2


@pytest.mark.parametrize("volume, price", [(0, 10), (2, 9.5), (3, 28 / 3), (4, None), (math.inf, 28 / 3)])
def test_effective_price(volume, price):
    unit = kernels.UNIT
    got = kernels.effective_price([(10 * unit, unit), (9 * unit, 2 * unit)], volume)
    assert got == price or abs(got - price) < 1e-12
    assert kernels.effective_price([], volume) is None


def test_queues():
    unit = kernels.UNIT
    b = kernels.Levels()
    for side, p, v in (("ask", 101, 5), ("ask", 102, 7), ("bid", 100, 1), ("bid", 99, 2), ("bid", 97, 4)):
        b.put(side, p * unit, v * unit)
    assert kernels.Queues(1.0).after(5, b) == [(5, 100.0, 101.0, [1, 2, 0], [5, 7, 0])]
    b.put("ask", 101 * unit, 0)
    b.put("ask", 102 * unit, 0)
    assert kernels.Queues(1.0).after(5, b)[0][3] == [0, 0, 0]
    assert kernels.Queues(0.02, 1, 2, True).after(5, b)[0][1] == 100


def test_resample(spark):
    rows = levels(spark, [(1, "bid", 100, 5), (4, "bid", 100, 3), (12, "ask", 101, 2)])
    show = lambda out: [(r.ts, r.side, float(r.price), float(r.volume)) for r in out.orderBy("ts").collect()]
    assert show(depth.resample(rows, 0, 10)) == [(at(10), "bid", 100, 3)]
    assert show(depth.resample(rows, 0, 10, end=instant(20))) == [(at(10), "bid", 100, 3), (at(20), "ask", 101, 2)]


def quotes(spark, prices):
    return spark.createDataFrame([("x", "AB", at(t), float(p), float(p)) for t, p in enumerate(prices)], "exchange string, pair string, ts timestamp, bid_price double, ask_price double")


@pytest.mark.parametrize("phi, rho, expected", [(0.01, 0, [(100, 110), (110, 105), (105, 120)]), (0.05, 0, [(100, 120)]), (0, 0.2, []), (0, 0.05, [(100, 110), (105, 120)])])
def test_strategy(spark, phi, rho, expected):
    got = replay.trading_strategy(quotes(spark, [100, 110, 105, 120]), phi, rho).orderBy("opened_at").collect()
    assert [(r.open_price, r.close_price) for r in got] == expected


@pytest.mark.parametrize("strict, expected", [(False, [(10, 20), (20, 16), (16, 18)]), (True, [(10, 20), (20, 15), (15, 18)])])
def test_draws(spark, strict, expected):
    got = replay.drawupdowns(quotes(spark, [10, 20, 15, 16, 18]), 0.1, strict).orderBy("opened_at").collect()
    assert [(r.open_price, r.close_price) for r in got] == expected


def test_thresholds_that_fall_with_time():
    path = [(0, 100.0), (1_000_000, 110.0), (2_000_000, 109.0), (500_000_000, 108.9), (501_000_000, 120.0)]
    run = lambda k: [d[:4] for row in path for d in k.feed(row)] + [d[:4] for d in k.end()]
    assert run(kernels.Draws(0.05, True)) == [(0, 100.0, 501_000_000, 120.0)]
    # after 499 seconds a fall of one per cent is a turn
    assert run(kernels.Draws(0.05, True, 0.1)) == [(0, 100.0, 1_000_000, 110.0), (1_000_000, 110.0, 500_000_000, 108.9), (500_000_000, 108.9, 501_000_000, 120.0)]


def test_sessions_cross_days(spark):
    rows = raw(spark, [(86_390, 1, "b", 1, 1), (86_410, 1, "b", 1, 1), (86_500, 1, "b", 1, 1), (400_000, 1, "b", 1, 1), (400_010, 2, "b", 1, 1), (600_000, 2, "b", 1, 1)])
    got = {r.seq: r.era for r in chains.session_eras(rows, 50).collect()}
    assert got == {0: at(86_390), 1: at(86_390), 2: at(86_500), 3: at(400_000), 4: at(400_000), 5: at(600_000)}


def test_bands(spark):
    rows = levels(spark, [(0, "ask", 100, 1), (0, "ask", 100.10, 2), (0, "ask", 100.30, 3)])
    got = sorted((r.bps_level, r.price, float(r.volume)) for r in depth.summary(rows).collect())
    assert got == [(0, 100.0, 1), (25, 100.25, 2), (50, 100.5, 3)]
    wide = depth.summary_pivot(depth.summary(rows)).first()
    assert wide.ask_vol25bps == 2 and wide.bid_vol0bps == 0 and float(wide.best_ask_price) == 100


def test_eras_close_the_book(spark):
    a = raw(spark, [(0, 1, "b", 100, 1)])
    b = raw(spark, [(100, 2, "b", 99, 2)], at(100))
    got = depth.continuous(chains.build(a.unionByName(b))).orderBy("ts").collect()
    assert [(r.ts, float(r.price), float(r.volume)) for r in got] == [(at(0), 100, 1), (at(100) - dt.timedelta(microseconds=1), 100, 0), (at(100), 99, 2)]


def test_crossed_stretches(spark):
    rows = spark.createDataFrame([("x", "AB", at(t), float(b), float(a)) for t, (b, a) in enumerate([(9, 10), (11, 10), (12, 10), (9, 10), (10, 10)], 1)], "exchange string, pair string, ts timestamp, best_bid_price double, best_ask_price double")
    got = repair.crossed_books(rows).collect()
    assert [(r.previous_uncrossed, r.first_crossed, r.next_uncrossed) for r in got] == [(at(1), at(2), at(4))]


def match_frames(spark):
    t = spark.createDataFrame([("x", "AB", f"T{k}", at(s), 10.0, 1.0, "b") for k, s in ((1, 0), (2, 0.2))], "exchange string, pair string, trade string, ts timestamp, price double, amount double, side string")
    e = spark.createDataFrame([("x", "AB", f"E{k}", at(s), 10.0, 1.0, "s") for k, s in ((1, 0.1), (2, 0.4), (3, 3))], "exchange string, pair string, event string, ts timestamp, price double, fill double, side string")
    return t, e


def test_exact_matches_in_passes(spark):
    t, e = match_frames(spark)
    assert [(r.trade, r.event) for r in matching.exact(t, e).collect()] == [("T1", "E1")] or [(r.trade, r.event) for r in matching.exact(t, e).orderBy("trade").collect()] == [("T1", "E1"), ("T2", "E2")]
    assert sorted((r.trade, r.event) for r in matching.exact_all(t, e).collect()) == [("T1", "E1"), ("T2", "E2")]
    assert matching.exact_all(t.limit(0), e).count() == 0


def test_sums_of_trades(spark):
    t, e = match_frames(spark)
    e = e.where("event = 'E2'").withColumn("fill", F.lit(2.0))
    assert [(r.event, r.members) for r in matching.by_sum(t, e).collect()] == [("E2", ["T1", "T2"])]
    assert matching.sums(t).count() == 3


def test_sequential_matches(spark):
    e = spark.createDataFrame([("x", "AB", 1, at(0), 7, 0.0, 2.0, "deleted"), ("x", "AB", 2, at(1), 8, 3.0, 2.0, "changed"), ("x", "AB", 3, at(2), 9, 3.0, 1.0, "changed")], "exchange string, pair string, event long, ts timestamp, order_id long, amount double, fill double, action string")
    t = spark.createDataFrame([("x", "AB", 50, 10.0, 2.0, 8, 7), ("x", "AB", 51, 10.0, 2.0, 9, 8)], "exchange string, pair string, trade long, price double, amount double, buy_order_id long, sell_order_id long")
    assert [(r.trade, r.buy_event, r.sell_event, r.buy_rule, r.sell_rule) for r in matching.sequential(t, e).collect()] == [(50, 2, 1, 0, 0)]
    assert matching.sequential_all(t, e, (1e-4,), (1, 2)).count() == 1


def test_inferred_trades_meet_opposite_fills(spark):
    rows = [(0, 1, "s", 10, 5), (1, 2, "b", 10, 5), (2, 1, "s", 10, 3), (2.1, 2, "b", 10, 3), (9, 3, "b", 9, 1)]
    got = replay.infer_trades(chains.build(raw(spark, rows))).collect()
    assert [(r.price, r.amount, r.side, r.buy_order_id, r.sell_order_id) for r in got] == [(10.0, 2.0, "b", 2, 1)]


def test_inference_compares_few_pending_fills(monkeypatch):
    """A fill is found by its amount and price: thousands that wait cost no comparison each, and the pairs stay."""
    compared = 0
    fits = kernels.Pending.fits

    def counted(self, row, entry):
        nonlocal compared
        compared += 1
        return fits(self, row, entry)

    monkeypatch.setattr(kernels.Pending, "fits", counted)
    k = kernels.Inference(3600.0, 0)
    asks = [(t, t, 1, "s", 100.0 + t % 50, 1.0 + t, False, t) for t in range(2000)]
    assert not [x for row in asks for x in k.feed(row)]
    got = [x for t in range(2000) for x in k.feed((10_000 + t, 5000 + t, 1, "b", 200.0, 1.0 + t, False, 10_000 + t))]
    assert [(x[1], x[2], x[3], x[4], x[6]) for x in got] == [(100.0 + t % 50, 1.0 + t, "b", 5000 + t, t) for t in range(2000)]
    assert compared <= 2000
    assert not k.pending["s"].keys and not k.pending["s"].sizes


def test_inference_takes_the_best_price_then_the_oldest():
    """An unknown amount meets any, amounts meet within a unit of value at the maker's price, fills without a price none."""
    k = kernels.Inference(1.0, 0)
    waiting = [(0, 1, 1, "s", None, 5.0, False, 0), (0, 2, 1, "s", 10.0, 5.0, False, 0), (1, 3, 1, "s", 9.0, 5.2, False, 1), (2, 4, 1, "s", 9.0, None, False, 2), (3, 5, 1, "s", 9.0, 5.1, False, 3)]
    assert not [x for row in waiting for x in k.feed(row)]
    met = [k.feed((t, 10 + t, 1, "b", 11.0, fill, False, t)) for t, fill in ((10, 5.0), (11, 5.0), (12, 5.0), (13, None), (14, 5.2), (1_000_020, 5.2))]
    assert [[(x[1], x[2], x[6]) for x in m] for m in met] == [[(9.0, 5.0, 4)], [(9.0, 5.0, 5)], [(10.0, 5.0, 2)], [(9.0, 5.2, 3)], [], []]


def test_order_types(spark):
    rows = [
        (0, 90, "b", 100, 1), (0, 91, "s", 110, 1),
        (1, 1, "b", 101, 1), (2, 1, "b", 102, 1),  # moved
        (3, 2, "s", 109, 1), (4, 2, "s", None, None),  # rested unfilled, gone
        (5, 3, "s", 108, 2), (6, 3, "s", 108, 1),  # rested, filled
        (7, 4, "b", 120, 2), (7.5, 4, "b", 120, 1), (8, 4, "b", None, None),
        (9, 5, "b", 125, 3),  # reaches and stays
    ]
    l3 = chains.build(raw(spark, rows))
    sp = replay.spread(depth.changes(l3).withColumn("side", grid.side_label(F.col("side"))))
    kinds = {r.id: r.type for r in events.classify(l3, sp, instant(0), instant(10)).collect()}
    assert kinds[1] == "pacman" and kinds[2] == "flashed-limit" and kinds[3] == "resting-limit" and kinds[5] == "market-limit"


def test_maker_and_crossed_flags(spark):
    l3 = chains.build(raw(spark, [(0, 1, "s", 10, 1), (1, 2, "b", 11, 1), (2, 3, "b", 10, 1), (3, 4, "b", 9, 1)]))
    flags = {r.order_id: (r.is_maker, r.is_crossed) for r in book.with_flags(book.snapshot(l3, instant(5))).collect()}
    assert flags == {1: (True, True), 2: (False, False), 3: (True, False), 4: (True, False)}
    strict = {r.order_id: r.is_maker for r in book.with_flags(book.snapshot(l3, instant(5)), strict=True).collect()}
    assert strict[3] is False
    with pytest.raises(Exception, match="taker stays"):
        book.check_takers(book.with_flags(book.snapshot(l3, instant(5)))).collect()


def test_book_differences(spark):
    a, b = levels(spark, [(0, "bid", 1, 5), (0, "bid", 2, 1)]), levels(spark, [(0, "bid", 1, 4), (0, "ask", 3, 2)])
    change = depth.difference(a, b)
    assert sorted((r.side, float(r.price), float(r.volume)) for r in change.collect()) == [("ask", 3, 2), ("bid", 1, 4), ("bid", 2, 0)]
    assert sorted((r.side, float(r.price), float(r.volume)) for r in depth.apply_changes(a, change).collect()) == [("ask", 3, 2), ("bid", 1, 4)]


def test_time_and_price_grids(spark):
    f = spark.createDataFrame([(at(10),), (at(10.000001),), (at(14.999999),)], "ts timestamp").select(grid.ceil_to(F.col("ts"), 5).alias("c"), grid.floor_to(F.col("ts"), 5).alias("f"), grid.ceil_to(F.col("ts"), None).alias("n"), "ts").collect()
    assert [r.c for r in f] == [at(10), at(15), at(15)] and [r.f for r in f] == [at(10)] * 3 and all(r.n == r.ts for r in f)
    one = spark.range(1).select(grid.truncate(F.lit(-1.239), 2).alias("t"), grid.event_id(F.lit(at(0)), F.lit(1), F.lit(2), F.lit("x"), F.lit("y")).alias("u"), grid.in_milliseconds(F.lit(at(0.00123))).alias("m")).first()
    assert one.t == -1.23 and [len(p) for p in one.u.split("-")] == [8, 4, 4, 4, 12] and one.m.endswith("1.23")


def test_repairs(spark):
    rows = raw(spark, [(0, 1, "b", 10, 1), (10, 1, "b", 10, 2), (20, 1, "b", None, None), (21, 1, "b", 10, 3), (30, 2, "s", 11, 1)])
    spans = spark.createDataFrame([("x", "AB", at(5), at(25))], "exchange string, pair string, start timestamp, end timestamp")
    moved = {r.seq: r.ts for r in repair.merge_episodes(rows, spans).collect()}
    assert moved == {0: at(0), 1: at(20), 2: at(20), 3: at(25), 4: at(30)}
    assert repair.fix_premature_deletes(rows, 5).count() == 4
    l3 = chains.build(rows)
    assert repair.invalid_chains(l3).count() == 0 and repair.invalid_chains(l3.where("seq <> 1")).count() == 2
    assert repair.eternal_orders(l3, 5).count() == 1
    assert repair.duplicate_events(rows.unionByName(rows)).count() == 5


def test_fixing_crossed_books_ends(spark):
    rows = raw(spark, [(0, 1, "s", 10, 1), (0, 2, "b", 9, 1), (5, 3, "b", 11, 1), (7, 3, "b", None, None), (9, 4, "b", 8, 1)])
    spread_of = lambda r: replay.spread(depth.changes(chains.build(r)).withColumn("side", grid.side_label(F.col("side"))))
    assert repair.crossed_books(spread_of(rows)).count() == 1
    assert repair.crossed_books(spread_of(repair.fix_crossed_books(rows, spread_of))).count() == 0


@pytest.mark.parametrize("chunk", [7, 60, 100_000])
def test_chunks_change_nothing(spark, chunk):
    r = random.Random(4)
    rows = levels(spark, [(t, "bid" if p < 100 else "ask", p, r.choice([0, 0, 1, 2, 3])) for t in range(300) for p in r.sample(range(90, 110), 2)])
    show = lambda out: sorted(map(str, out.collect()))
    assert show(replay.spread(rows, chunk)) == show(replay.spread(rows, 1_000_000))
    assert show(replay.trading_period(rows, 3.0, chunk_seconds=chunk)) == show(replay.trading_period(rows, 3.0, chunk_seconds=1_000_000))
    assert show(replay.queues(rows, 2.0, chunk_seconds=chunk)) == show(replay.queues(rows, 2.0, chunk_seconds=1_000_000))


def test_deltas_add_up_to_snapshots(spark):
    r = random.Random(8)
    rows = [(t, r.randint(1, 9), "b", r.randint(90, 95), r.choice([None, 1, 2, 3])) for t in range(200)]
    l3 = chains.build(raw(spark, rows)).cache()
    changes = depth.changes(l3).collect()
    assert all(c.volume >= 0 for c in changes)
    for t in (50, 120, 199):
        last = {}
        for c in sorted((c for c in changes if c.ts <= at(t)), key=lambda c: c.ts):
            last[c.price] = c.volume
        assert {p: v for p, v in last.items() if v} == {s.price: s.volume for s in depth.at(l3, instant(t)).collect()}
    l3.unpersist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1, 1000), min_size=2, max_size=40), st.floats(0.001, 0.5))
def test_strict_draws_alternate_and_meet(prices, epsilon):
    k = kernels.Draws(epsilon, True)
    out = [d for t, p in enumerate(prices) for d in k.feed((t, p))] + k.end()
    for a, b in zip(out, out[1:], strict=False):
        assert a[3] == b[1] and (a[3] > a[1]) != (b[3] > b[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1, 1000), min_size=2, max_size=40), st.floats(0, 0.05))
def test_positions_follow_each_other_and_pay(prices, phi):
    k = kernels.Strategy(phi)
    out = [d for t, p in enumerate(prices) for d in k.feed((t, p, p))] + k.end()
    assert all(a[2] <= b[0] for a, b in zip(out, out[1:], strict=False))
    assert all(p[6] >= 2 * phi - 1e-9 for p in out)


def test_empty_book(spark):
    l3 = chains.build(raw(spark, []))
    assert l3.count() == depth.changes(l3).count() == 0
    rows = depth.continuous(l3).withColumn("side", grid.side_label(F.col("side")))
    assert replay.spread(rows).count() == 0 and book.order_book(l3, instant(1)).count() == 0


def test_as_of_crosses_days(spark):
    left = spark.createDataFrame([("x", "AB", at(86400 * 3), 1), ("x", "AB", at(5), 2), ("x", "AB", at(10), 3)], "exchange string, pair string, ts timestamp, n int")
    right = spark.createDataFrame([("x", "AB", at(10), 7.0), ("x", "AB", at(20), None)], "exchange string, pair string, ts timestamp, v double")
    got = {r.n: r.v for r in events.last_known(left, right, ["v"]).collect()}
    assert got == {1: None, 2: None, 3: None}
    assert {r.n: r.v for r in events.last_known(left, right, ["v"], before=False).collect()}[3] == 7.0


def test_histogram_counts_empty_cells(spark):
    rows = spark.createDataFrame([(at(1),), (at(2),), (at(25),)], "ts timestamp")
    assert sorted(map(tuple, analysis.count_histogram(rows, 10, instant(0), instant(50)).collect())) == [(0, 3), (1, 1), (2, 1)]
    assert analysis.jump_threshold(1000) > analysis.jump_threshold(100)


def test_books_per_episode(spark):
    l3 = chains.build(raw(spark, [(0, 1, "s", 10, 1), (1, 2, "b", 11, 1), (2, 2, "b", None, None), (3, 3, "b", 9, 2), (4000, 3, "b", 9, 1)]))
    got = {r.ts: [(o.order_id, float(o.amount), o.is_maker) for o in r.orders] for r in episodes.order_book_by_episode(l3).collect()}
    assert got == {at(0): [(1, 1, True)], at(1): [(1, 1, True), (2, 1, False)], at(2): [(1, 1, True)], at(3): [(3, 2, True), (1, 1, True)], at(4000): [(3, 1, True), (1, 1, True)]}
    makers = episodes.maker_depth(l3, episodes.episodes(l3)).where(F.col("ts") == instant(1)).collect()
    assert [(r.side, float(r.price)) for r in makers] == [("ask", 10)]


def test_synthetic_creations(spark):
    rows = raw(spark, [(0, 1, "b", 10, 3), (1, 1, "b", 10, 2), (2, 2, "s", 11, None)]).withColumn("event", F.when(F.col("seq") == 2, "deleted").otherwise("changed"))
    got = chains.build(chains.with_creations(rows)).orderBy("order_id", "event_no").collect()
    assert [(r.order_id, r.event_no, r.status) for r in got][:3] == [(1, 1, "superseded"), (1, 2, "superseded"), (1, 3, "open")]


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.n == r.v + 1 for r in ranks.numbered(rows, "n", F.col("v")).collect())
