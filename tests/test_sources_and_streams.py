import datetime as dt
import importlib
import json
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.test_order_book import at, instant, levels, quotes, raw
from tidebook.api import Engine, check_frequency
from tidebook.operators import chains, kernels, replay
from tidebook.sources import messages, store
from tidebook.streaming import fold
from tidebook.streaming.metrics import Backlog, BacklogListener


def lines(spark, values):
    return spark.createDataFrame([(v, at(k)) for k, v in enumerate(values)], "value string, local_ts timestamp")


def test_bitstamp_messages(spark):
    order = {"event": "order_created", "data": {"id": 1, "order_type": 0, "price_str": "100.5", "amount_str": "2.0", "microtimestamp": "1574000000123456", "datetime": "1574000000"}}
    trade = {"event": "trade", "data": {"id": 9, "type": 1, "price_str": "100.5", "amount_str": "0.5", "buy_order_id": 1, "sell_order_id": 2, "microtimestamp": "1574000000223456"}}
    rows = lines(spark, [json.dumps(order), json.dumps(trade), '{"event": "bts:subscription_succeeded", "data": {}}', "no json"])
    o = messages.bitstamp_orders(rows, "BTCUSD").collect()
    assert [(r.order_id, r.event, r.side, float(r.price), float(r.amount), r.deleted) for r in o] == [(1, "created", "b", 100.5, 2.0, False)]
    assert o[0].ts == dt.datetime(2019, 11, 17, 14, 13, 20, 123456)
    t = messages.bitstamp_trades(rows, "BTCUSD").collect()
    assert [(r.exchange_trade_id, r.side, float(r.amount), r.buy_order_id, r.sell_order_id) for r in t] == [(9, "s", 0.5, 1, 2)]


def test_bitfinex_messages(spark):
    values = ["[17,[[1001,100.5,2.0],[1002,101.0,-1.0]],1574000000123]", "[17,[1001,100.5,1.5],1574000000200]", "[17,[1001,0,1],1574000000300]", '[17,"hb",1574000000400]', '[18,"tu",[555,1574000000200,-0.5,100.5],1574000000210]', '[18,"te",[555,1574000000200,-0.5,100.5],1574000000205]', '[18,[[1,1574000000100,2,99]],1574000000205]']
    rows = lines(spark, values)
    b = messages.bitfinex_book(rows, 17, "BTCUSD").collect()
    assert [(r.order_id, float(r.price), float(r.amount), r.snapshot) for r in b] == [(1001, 100.5, 2, True), (1002, 101, -1, True), (1001, 100.5, 1.5, False), (1001, 0, 1, False)]
    t = messages.bitfinex_trades(rows, 18, "BTCUSD").collect()
    assert sorted((r.exchange_trade_id, r.side, float(r.amount), float(r.price)) for r in t) == [(1, "b", 2, 99), (555, "s", 0.5, 100.5)]


def test_bitfinex_chains(spark):
    rows = messages.bitfinex_book(lines(spark, ["[17,[[1,100,2],[2,101,-1]],1]", "[17,[1,100,1],2]", "[17,[1,0,1],3]", "[17,[1,100,4],4]"]), 17, "AB")
    rows = rows.withColumn("era", F.lit(at(0))).withColumn("ts", F.col("local_ts")).withColumn("seq", F.unix_micros("local_ts") * 10 + F.col("order_id"))
    got = chains.build(messages.bitfinex_level3(rows)).orderBy("order_id", "ts").collect()
    assert [(r.order_id, r.side, r.event_no, r.status) for r in got] == [(1, "b", 1, "superseded"), (1, "b", 2, "superseded"), (1, "b", 3, "deleted"), (1, "b", 1, "open"), (2, "s", 1, "open")]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1.5, 100, 2, bid\n2.25, 101, 0, ask\n")
    got = messages.depth_csv(spark, str(tmp_path / "d.csv")).collect()
    assert [(r.ts, float(r.price), float(r.volume), r.side) for r in got] == [(dt.datetime(1970, 1, 1, 0, 0, 1, 500000), 100, 2, "bid"), (dt.datetime(1970, 1, 1, 0, 0, 2, 250000), 101, 0, "ask")]
    (tmp_path / "l.csv").write_text("microtimestamp,order_id,event_no,side,price,amount,fill,next_microtimestamp,next_event_no\n2024-01-01 00:00:00,1,1,b,10,1,,infinity,\n2024-01-01 00:00:01,2,2,s,11,0,,-infinity,\n")
    got = messages.level3_csv(spark, str(tmp_path / "l.csv")).collect()
    assert [(r.order_id, r.status, r.next_ts) for r in got] == [(1, "open", None), (2, "deleted", None)]


def test_partitioned_store_prunes(spark, tmp_path):
    rows = levels(spark, [(0, "bid", 1, 1), (90_000, "bid", 2, 1)])
    path = str(tmp_path / "s")
    store.write_partitioned(rows, path)
    got = store.scan(spark, path, "x", "AB", instant(80_000), instant(100_000))
    assert [float(r.price) for r in got.collect()] == [2.0]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and store.scan(spark, path, "y").count() == 0


def test_upserts(spark):
    have = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted(map(tuple, store.upsert(have, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert sorted(map(tuple, store.upsert(have, new, ["k"], update=False).collect())) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    again = spark.createDataFrame([(1, "a", 9), (2, "z", 9)], "k int, v string, t int")
    assert [tuple(r) for r in store.append_changed(have, again, ["k"], "t").collect()] == [(2, "z", 9)]


def test_interval_cache_computes_gaps_only(spark, tmp_path):
    asked = []

    def compute(a, b):
        asked.append((a, b))
        return spark.range(a // 1_000_000, b // 1_000_000).select(F.timestamp_seconds("id").alias("ts"))

    cache = store.IntervalCache(spark, str(tmp_path), 10)
    s = 1_000_000
    assert cache.load("k", 0, 20 * s, compute, 100 * s).count() == 20
    assert cache.load("k", 10 * s, 30 * s, compute, 100 * s).count() == 20
    assert asked == [(0, 20 * s), (20 * s, 30 * s)] and cache.periods("k") == [(0, 30 * s)]
    assert cache.load("k", 25 * s, 100 * s, compute, 100 * s).count() == 75
    assert asked[-2:] == [(30 * s, 90 * s), (90 * s, 100 * s)]


def test_engine(spark):
    rows = raw(spark, [(0, 1, "b", 99, 5), (0, 2, "s", 101, 4), (60, 1, "b", 99, 3), (120, 3, "b", 100, 1)])
    trades = spark.createDataFrame([("x", "AB", at(60), 99.0, 2.0, "s", 1, 2, 7, 1, 50)], "exchange string, pair string, ts timestamp, price double, amount double, side string, buy_order_id long, buy_event_no int, sell_order_id long, sell_event_no int, exchange_trade_id long")
    e = Engine(chains.build(rows), trades)
    span = ("X", "ab", "2024-01-01 00:00:00", "2024-01-01 00:10:00")
    assert e.depth(*span).count() == 4 and e.depth(*span, 300).count() == 4
    assert [float(r.best_bid_price) for r in e.spread(*span).orderBy("ts").collect()] == [99, 99, 100]
    assert e.trading_period(*span, volume=4).orderBy("ts").first().bid_price == 99
    assert e.queues(*span, tick=1.0).columns[-6:] == ["b1", "b2", "b3", "a1", "a2", "a3"]
    bids, asks = e.order_book("x", "AB", "2024-01-01 00:05:00")
    assert bids.count() == 2 and asks.count() == 1
    trade = e.trades(*span).first()
    assert (trade.direction, trade.maker, trade.taker) == ("sell", 1, 7) and e.events(*span).count() == 4 and e.export(*span).count() == 4
    met = [r for r in e.events(*span).collect() if r.event_id]
    assert [(r.id, r.event_no, r.event_id, r.matching_event) for r in met] == [(1, 2, trade.maker_event_id, trade.taker_event_id)]
    assert e.available_exchanges().first().exchange == "x" and e.available_pairs("x").first().pair == "AB"
    assert e.intervals("x", "AB").first().status == "G" and e.data_overview().count() == 1
    assert e.depth_changes(levels(spark, [(0, "bid", 1, 2), (1, "bid", 1, 1)])).where("delta = -1").first().chain_id == 2
    assert [r.bid_vol0bps for r in e.depth_summary(*span).orderBy("ts").collect()][-2:] == [3, 1]
    for bad in (0, 3601, 5000):
        with pytest.raises(ValueError):
            check_frequency(bad)


def run_stream(spark, tmp_path, parts, query):
    """Feeds frames one file at a time, and collects what the query gives."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        stream = query(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(str(out))


def test_streamed_kernel_equals_batch(spark, tmp_path):
    prices = [100, 110, 105, 120, 90, 130, 95, 96, 140, 100]
    q = quotes(spark, prices)
    batch = replay.trading_strategy(q.where(F.col("ts") <= instant(7)), 0.01)
    order = [3, 1, 0, 2, 6, 4, 5, 7, 9, 8]
    every = {r.ts: r for r in q.collect()}
    parts = [spark.createDataFrame([every[at(i)] for i in order[k : k + 3]], q.schema) for k in range(0, 10, 3)]
    parts.append(spark.createDataFrame([("x", "AB", at(1000), 50.0, 50.0), ("x", "AB", at(1001), 50.0, 50.0)], q.schema))
    parts.append(spark.createDataFrame([("x", "AB", at(2000), 50.0, 50.0)], q.schema))
    feed = ["us", "bid_price", "ask_price"]
    query = lambda s: fold.stream_fold(s.withColumn("us", F.unix_micros("ts")), ["exchange", "pair"], "ts", [], feed, lambda: kernels.Strategy(0.01), replay.POSITION, "10 seconds")
    got = [(r.open_price, r.close_price) for r in run_stream(spark, tmp_path, parts, query).orderBy("opened_us").collect()]
    expected = [(r.open_price, r.close_price) for r in batch.orderBy("opened_at").collect()]
    assert len(got) >= len(expected) - 1 and got[: len(expected) - 1] == expected[:-1]


def test_stream_state_ends_and_late_rows_are_kept(spark, tmp_path):
    """Rows behind those that have gone are dead letters; a key without rows ends, and begins anew."""
    frame = lambda rows: spark.createDataFrame([(k, at(t), v) for k, t, v in rows], "k string, ts timestamp, v int")
    parts = [frame([("a", 0, 1), ("a", 3, 2), ("b", 4, 9)]), frame([("b", 40, 10)]), frame([("a", 2, 7), ("b", 41, 11)]), frame([("b", 500, 12)]), frame([("b", 501, 13)]), frame([("a", 520, 3)]), frame([("b", 900, 14)]), frame([("b", 901, 15)])]
    query = lambda s: fold.stream_fold(s, ["k"], "ts", [], ["v"], Counting, "n long, v int", "5 seconds", grace_seconds=60, idle_seconds=100)
    got = run_stream(spark, tmp_path, parts, query).collect()
    a = [(r.late_us is not None, r.n, r.v) for r in got if r.k == "a"]
    assert (True, None, None) in a and (False, 1, 1) in a and (False, 2, 2) in a
    assert (False, -2, None) in a and (False, 1, 3) in a  # its end, and a new beginning


def test_stream_sink_appends_once(spark, tmp_path):
    rows = levels(spark, [(0, "bid", 1, 1), (90_000, "bid", 2, 1)])
    rows.write.parquet(str(tmp_path / "in"))
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        store.write_stream(stream, path, checkpoint).awaitTermination()
    got = store.scan(spark, path, "x", "AB", instant(80_000), instant(100_000))
    assert [float(r.price) for r in got.collect()] == [2.0] and store.scan(spark, path).count() == 2


class Counting:
    """Numbers the rows; says how many there were at the end, below zero."""

    def __init__(self):
        self.n = 0

    def feed(self, row):
        self.n += 1
        return [(self.n, row[0])]

    def end(self):
        return [(-self.n, None)]


def test_backlogs_are_reported_when_they_change():
    b = Backlog(1.25, 10)
    assert [b.feed(x) for x in (5, 20, 24, 26, 22, 20, 3, 2)] == [False, True, False, True, False, True, True, False]
    said = []
    listener = BacklogListener(1.25, 10, lambda *x: said.append(x))
    progress = lambda n: SimpleNamespace(progress=SimpleNamespace(id="q", name="name", stateOperators=[SimpleNamespace(numRowsTotal=n)], inputRowsPerSecond=2.0, processedRowsPerSecond=1.0))
    listener.onQueryStarted(SimpleNamespace(id="q"))
    for n in (5, 50, 55, 5):
        listener.onQueryProgress(progress(n))
    listener.onQueryTerminated(SimpleNamespace(id="q"))
    assert said == [("name", 50, 2.0, 1.0), ("name", 5, 2.0, 1.0)]


def test_kernels_of_streams():
    a = fold.Assembly()
    rows = [(1, 10, 100, 2), (1, 11, 101, -1), (2, 10, 0, 1), (3, 12, 99, 1), (2, 12, 0, 1), (5, 13, 98, 1)]
    out = [x for r in rows for x in a.feed(r)] + a.end()
    assert [(x[0], x[1], x[2]) for x in out] == [(2, 1, 10), (2, 2, 11), (2, 3, 10), (3, 1, 12), (3, 2, 12), (5, 1, 13)]
    s = fold.Sessions(2)
    assert [s.feed((t * 1_000_000,))[0][0] for t in (0, 1, 3, 6, 7)] == [0, 0, 0, 6_000_000, 6_000_000]
    c = fold.Chain()
    rows = [(1, None, None, True), (2, 10, 5, False), (3, 10, 3, False), (4, None, None, True), (5, 12, 2, False)]
    assert [x[1:] for r in rows for x in c.feed(r)] == [(1, 10, 5, None, "open"), (2, 10, 3, 2, "open"), (3, 10, 3, None, "deleted"), (1, 12, 2, None, "open")]


def test_entry_and_the_rest_without_the_llm_folders():
    code = """
import sys
from types import SimpleNamespace
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidebook.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "spread" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
