"""DuckDB SQL of the registered queries, written from the definitions: books are found from the orders' life spans."""

from __future__ import annotations

START, MIDDLE, END = "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-15 12:00:00'", "TIMESTAMP '2024-01-22'"
ERAS = ("2024-01-01", "2024-01-11", "2024-01-21")


def chain(crossed: bool = False, eras: tuple[str, ...] = ERAS[:1], venues: int = 1) -> str:
    """CTEs raw and l3: l3 has a row per level-3 event."""
    era = "CASE " + " ".join(f"WHEN ts >= TIMESTAMP '{e}' THEN TIMESTAMP '{e}'" for e in reversed(eras)) + " END"
    return f"""
raw AS (
  SELECT 'venue' || (user_id % {venues}) AS exchange, {era} AS era, ts, event_id AS seq, user_id AS order_id, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 's' END AS side,
    (CASE WHEN user_id % 2 = 0 THEN {1004 if crossed else 1000} - value::DECIMAL(12,2) ELSE 1000.01 + value::DECIMAL(12,2) END)::DECIMAL(18,8) AS price,
    (json_extract_string(props, '$.k')::BIGINT + 1)::DECIMAL(18,8) AS amount, event_type = 'error' AS deleted
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), s1 AS (
  SELECT *, coalesce(sum(deleted::INT) OVER (PARTITION BY exchange, era, order_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM raw WHERE era IS NOT NULL
), s2 AS (
  SELECT *, row_number() OVER (PARTITION BY exchange, era, order_id, segment ORDER BY ts, seq) AS event_no FROM s1
), s3 AS (
  SELECT * REPLACE (CASE WHEN deleted THEN lag(price) OVER w ELSE price END AS price), lag(price) OVER w AS was_price, lag(amount) OVER w AS was FROM s2 WHERE NOT (deleted AND event_no = 1)
  WINDOW w AS (PARTITION BY exchange, era, order_id, segment ORDER BY event_no)
), l3 AS (
  SELECT exchange, era, ts, seq, order_id, side, segment, event_no::INT AS event_no, price, CASE WHEN deleted THEN was ELSE amount END AS amount, CASE WHEN NOT deleted THEN was - amount END AS fill, deleted,
    lead(ts) OVER w AS next_ts, lead(event_no) OVER w::INT AS next_event_no,
    CASE WHEN deleted THEN 'deleted' WHEN lead(ts) OVER w IS NOT NULL THEN 'superseded' ELSE 'open' END AS status,
    max(CASE WHEN was_price IS NULL OR price <> was_price THEN event_no END) OVER w::INT AS price_event_no,
    max(CASE WHEN was_price IS NULL OR price <> was_price THEN ts END) OVER w AS price_ts
  FROM s3 WINDOW w AS (PARTITION BY exchange, era, order_id, segment ORDER BY event_no)
)"""


def side(c: str = "side") -> str:
    return f"CASE {c} WHEN 'b' THEN 'bid' ELSE 'ask' END"


def grid(c: str, seconds: int | None) -> str:
    return f"make_timestamp((ceil(epoch_us({c}) / {seconds}000000.0) * {seconds}000000)::BIGINT)" if seconds else c


def levels(frequency: int | None = None) -> str:
    """CTEs after l3. chg: level changes at episodes, from orders' life spans; lv: each volume with the time it holds."""
    return f"""
life AS (
  SELECT exchange, era, side, price, amount, {grid("ts", frequency)} AS a, {grid("next_ts", frequency)} AS b FROM l3 WHERE NOT deleted
), edge AS (
  SELECT exchange, era, side, price, ts, sum(x) AS x FROM (SELECT exchange, era, side, price, a AS ts, amount AS x FROM life UNION ALL SELECT exchange, era, side, price, b, -amount FROM life WHERE b IS NOT NULL)
  GROUP BY ALL HAVING sum(x) <> 0
), chg AS (
  SELECT exchange, era, side, price, ts, sum(x) OVER (PARTITION BY exchange, era, side, price ORDER BY ts) AS volume FROM edge
), lv AS (
  SELECT *, lead(ts) OVER (PARTITION BY exchange, era, side, price ORDER BY ts) AS until FROM chg
)"""


BEST = """
tick AS (
  SELECT DISTINCT ts FROM chg
), best AS (
  SELECT t.ts, max(price) FILTER (side = 'b') AS bp, min(price) FILTER (side = 's') AS ap
  FROM tick t LEFT JOIN lv ON lv.ts <= t.ts AND (lv.until IS NULL OR lv.until > t.ts) AND lv.volume > 0 GROUP BY t.ts
), quote AS (
  SELECT b.ts, b.bp, x.volume AS bv, b.ap, y.volume AS av FROM best b
  LEFT JOIN lv x ON x.side = 'b' AND x.price = b.bp AND x.ts <= b.ts AND (x.until IS NULL OR x.until > b.ts)
  LEFT JOIN lv y ON y.side = 's' AND y.price = b.ap AND y.ts <= b.ts AND (y.until IS NULL OR y.until > b.ts)
), spread AS (
  SELECT * FROM quote QUALIFY row_number() OVER (ORDER BY ts) = 1 OR (bp, bv, ap, av) IS DISTINCT FROM lag((bp, bv, ap, av)) OVER (ORDER BY ts)
)"""

CHANGES = f"SELECT epoch_us(ts) AS ts_us, {side()} AS side, price::DOUBLE AS price, volume::DOUBLE AS volume FROM"
SPREAD = "SELECT epoch_us(ts) AS ts_us, bp::DOUBLE AS best_bid_price, bv::DOUBLE AS best_bid_volume, ap::DOUBLE AS best_ask_price, av::DOUBLE AS best_ask_volume FROM spread"


def standing(at: str, before: bool = False, eras: tuple[str, ...] = ERAS[:1], crossed: bool = False) -> str:
    a, b = ("<", ">=") if before else ("<=", ">")
    return f"WITH {chain(crossed, eras)}, ob AS (SELECT * FROM l3 WHERE NOT deleted AND ts {a} {at} AND (next_ts IS NULL OR next_ts {b} {at}) AND era = (SELECT max(era) FROM l3 WHERE era <= {at}))"


LEVELS = f"SELECT {side()} AS side, price::DOUBLE AS price, sum(amount)::DOUBLE AS volume FROM ob GROUP BY ALL"

FLAGS = """, f AS (
  SELECT *, coalesce(CASE WHEN side = 'b' THEN price <= (SELECT min(o.price) FROM ob o WHERE o.side = 's' AND (o.price_ts, o.ts) <= (ob.price_ts, ob.ts))
      ELSE price >= (SELECT max(o.price) FROM ob o WHERE o.side = 'b' AND (o.price_ts, o.ts) <= (ob.price_ts, ob.ts)) END, true) AS is_maker,
    coalesce(CASE WHEN side = 'b' THEN price > (SELECT min(o.price) FROM ob o WHERE o.side = 's' AND (o.price_ts, o.ts) >= (ob.price_ts, ob.ts))
      ELSE price < (SELECT max(o.price) FROM ob o WHERE o.side = 'b' AND (o.price_ts, o.ts) >= (ob.price_ts, ob.ts)) END, false) AS is_crossed
  FROM ob)"""


def summary(step: int, most: int) -> str:
    return f"""WITH {chain()}, {levels()}, day AS (SELECT TIMESTAMP '2024-01-01' + to_days(d::INT) AS t FROM range(2, 30) r(d)), bk AS (
  SELECT t, side, price, volume FROM day JOIN lv ON ts <= t AND (until IS NULL OR until > t) AND volume > 0
), w AS (
  SELECT *, CASE WHEN side = 'b' THEN max(price) OVER (PARTITION BY t, side) ELSE min(price) OVER (PARTITION BY t, side) END AS best FROM bk
), x AS (
  SELECT *, (ceil(abs(price - best)::DOUBLE / best::DOUBLE * 10000 / {step} - 1e-9) * {step})::INT AS bps FROM w
), bands AS (
  SELECT t, side, bps, any_value(best) AS best, sum(volume) AS volume FROM x WHERE bps <= {most} GROUP BY t, side, bps
)"""


PAIR = """t AS (
  SELECT e.event_id, e.ts, r.price, r.amount, r.side, e.user_id, e.event_type, CASE WHEN e.event_id % 2 = 0 THEN 'b' ELSE 's' END AS taker_side FROM events e JOIN raw r ON r.seq = e.event_id
), m AS (
  SELECT *, CASE WHEN taker_side = 'b' THEN last_value(CASE WHEN side = 's' THEN user_id END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN side = 'b' THEN user_id END IGNORE NULLS) OVER w END AS maker
  FROM t WINDOW w AS (PARTITION BY date_trunc('day', ts) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), trade AS (
  SELECT ts, price, amount, taker_side, user_id AS taker, maker, event_id FROM m WHERE event_type = 'purchase'
)"""

LINE = """u AS (
  SELECT l_shipdate AS ts, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, CASE WHEN l_linestatus = 'F' THEN 100000 - l_partkey ELSE 100000 + l_partkey END AS price,
    sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS volume FROM lineitem GROUP BY ALL
)"""


def effective(volume: str) -> str:
    """Mean price of taking ``volume`` from each side of the book at every changed cell."""
    return f"""WITH {chain()}, {levels(3600)}, tick AS (SELECT DISTINCT ts AS t FROM chg), bk AS (
  SELECT t, side, price::DOUBLE AS price, volume::DOUBLE AS volume FROM tick JOIN lv ON ts <= t AND (until IS NULL OR until > t) AND volume > 0
), c AS (
  SELECT *, coalesce(sum(volume) OVER (PARTITION BY t, side ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bk
), e AS (
  SELECT t, side, sum(least(volume, greatest({volume} - before, 0)) * price) / sum(least(volume, greatest({volume} - before, 0))) AS p, sum(volume) AS total FROM c GROUP BY t, side
), q AS (
  SELECT t, max(p) FILTER (side = 'b' AND (total >= {volume} OR {volume} >= 1e15)) AS b, max(p) FILTER (side = 's' AND (total >= {volume} OR {volume} >= 1e15)) AS a FROM tick LEFT JOIN e USING (t) GROUP BY t
), z AS (
  SELECT *, lag(b) OVER (ORDER BY t) AS lb, lag(a) OVER (ORDER BY t) AS la, row_number() OVER (ORDER BY t) AS n FROM q
)
SELECT epoch_us(t) AS ts_us, round(b, 4) AS bid_price, round(a, 4) AS ask_price FROM z
WHERE n = 1 OR (b IS NULL) <> (lb IS NULL) OR (a IS NULL) <> (la IS NULL) OR abs(b - lb) >= 1e-5 OR abs(a - la) >= 1e-5"""


QUEUE = f"""WITH {chain()}, {levels(86400)}, tick AS (SELECT DISTINCT ts AS t FROM chg), bk AS (
  SELECT t, side, price::DOUBLE AS price, volume::DOUBLE AS volume FROM tick LEFT JOIN lv ON ts <= t AND (until IS NULL OR until > t) AND volume > 0
), w AS (
  SELECT *, max(price) FILTER (side = 'b') OVER (PARTITION BY t) AS bid, min(price) FILTER (side = 's') OVER (PARTITION BY t) AS ask FROM bk
), x AS (
  SELECT t, side, volume, CASE WHEN side = 'b' THEN ceil((ask - price) / 25 - 1e-9) ELSE ceil((price - bid) / 25 - 1e-9) END AS i FROM w
)
SELECT epoch_us(t) AS ts_us, """ + ", ".join(f"coalesce(sum(volume) FILTER (side = '{s}' AND i = {i}), 0)::DOUBLE AS {c}{i}" for s, c in (("b", "b"), ("s", "a")) for i in range(1, 5)) + " FROM x GROUP BY t"

def uuid(order: str, event: str) -> str:
    """The event's id: an MD5 of its key, with the hyphens of a UUID."""
    return f"regexp_replace(md5(epoch_us(ts)::VARCHAR || '#' || {order}::VARCHAR || '#' || {event}::VARCHAR || '#venue0#AB'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def met() -> str:
    """CTEs after PAIR. mt: trades by buyer and seller."""
    return """mt AS (
  SELECT tr.ts, price, amount, taker_side AS side, tr.event_id AS trade_id, CASE WHEN taker_side = 'b' THEN taker ELSE maker END AS buy_order_id, CASE WHEN taker_side = 'b' THEN maker ELSE taker END AS sell_order_id,
    CASE WHEN taker_side = 'b' THEN n.event_no WHEN maker IS NOT NULL THEN 1 END AS buy_event_no, CASE WHEN taker_side = 's' THEN n.event_no WHEN maker IS NOT NULL THEN 1 END AS sell_event_no
  FROM trade tr LEFT JOIN (SELECT seq, event_no FROM l3) n ON n.seq = tr.event_id
)"""


CLASSIFY = f"""WITH {chain(crossed=True)}, {levels()}, {BEST}, {PAIR}, {met()}, rg AS (
  SELECT * FROM spread WHERE ts >= {START} AND ts <= {END}
), sb AS (
  SELECT lead(ts) OVER (ORDER BY ts) AS ts, bp, ap FROM rg
), ev AS (
  SELECT *, deleted AS gone FROM l3 WHERE ts > {START} AND ts <= {END} AND NOT (amount = 0 AND event_no = 1 AND NOT deleted)
  UNION ALL SELECT *, false FROM l3 WHERE NOT deleted AND ts <= {START} AND (next_ts IS NULL OR next_ts > {START})
), ba AS (
  SELECT ev.*, q.bp, q.ap, coalesce(CASE WHEN side = 's' THEN price <= q.bp ELSE price >= q.ap END, false) AS is_aggressor FROM ev ASOF LEFT JOIN (SELECT * FROM sb WHERE ts IS NOT NULL) q ON ev.ts >= q.ts
), fl AS (
  SELECT *, max(price) OVER o <> min(price) OVER o AS is_price_ever_changed, bool_or(NOT is_aggressor) OVER o AS is_ever_resting, bool_or(is_aggressor) OVER o AS is_ever_aggressor,
    bool_or(coalesce(fill, 0) > 0) OVER o AS is_ever_filled, bool_or(gone) OVER o AS is_deleted, bool_or(event_no = 1 AND NOT gone) OVER o AS is_created FROM ba WINDOW o AS (PARTITION BY order_id)
), cn AS (
  SELECT ts, buy_event_no AS event_no, buy_order_id AS order_id, {uuid("sell_order_id", "sell_event_no")} AS met FROM mt WHERE ts >= {START} AND ts <= {END}
  UNION ALL SELECT ts, sell_event_no, sell_order_id, {uuid("buy_order_id", "buy_event_no")} FROM mt WHERE ts >= {START} AND ts <= {END}
)
SELECT CASE WHEN cn.ts IS NOT NULL THEN {uuid("fl.order_id", "fl.event_no").replace("epoch_us(ts)", "epoch_us(fl.ts)")} END AS event_id, fl.order_id AS id, epoch_us(fl.ts) AS timestamp_us, epoch_us(price_ts) AS exchange_timestamp_us, price::DOUBLE AS price,
  amount::DOUBLE AS volume, CASE WHEN gone THEN 'deleted' WHEN fl.event_no = 1 THEN 'created' ELSE 'changed' END AS action, {side()} AS direction, CASE WHEN fill > 0 THEN fill ELSE 0 END::DOUBLE AS fill, cn.met AS matching_event,
  CASE WHEN is_price_ever_changed THEN 'pacman' WHEN is_ever_resting AND NOT is_ever_aggressor AND NOT is_ever_filled AND is_deleted THEN 'flashed-limit'
    WHEN is_ever_resting AND NOT is_ever_aggressor AND NOT is_ever_filled AND NOT is_deleted THEN 'resting-limit' WHEN is_ever_resting AND NOT is_ever_aggressor AND is_ever_filled THEN 'resting-limit'
    WHEN NOT is_ever_resting AND is_ever_aggressor AND is_deleted AND is_ever_filled THEN 'market' WHEN NOT is_ever_resting AND is_ever_aggressor AND is_deleted AND NOT is_ever_filled THEN 'flashed-limit'
    WHEN (is_ever_resting OR NOT is_deleted) AND is_ever_aggressor THEN 'market-limit' ELSE 'unknown' END AS type,
  round(10000 * (CASE WHEN side = 's' THEN ap - price ELSE price - bp END)::DOUBLE / ap::DOUBLE) + 0.0::DOUBLE AS aggressiveness_bps, fl.event_no, is_aggressor, is_created, is_ever_resting, is_ever_aggressor, is_ever_filled, is_deleted,
  is_price_ever_changed, bp::DOUBLE AS best_bid_price, ap::DOUBLE AS best_ask_price
FROM fl LEFT JOIN cn ON cn.ts = fl.ts AND cn.event_no = fl.event_no AND cn.order_id = fl.order_id"""

FILLS = "fills AS (SELECT *, seq AS event FROM l3 WHERE fill > 0)"


def mids(seconds: int, venues: int = 1, where: str = "TRUE") -> str:
    """mid: the last mid price of each grid cell, by exchange."""
    return f"""{chain(venues=venues)}, {levels()}, tk AS (
  SELECT DISTINCT exchange, ts FROM chg WHERE {where}
), bs AS (
  SELECT t.exchange, t.ts, max(price) FILTER (side = 'b') AS bp, min(price) FILTER (side = 's') AS ap
  FROM tk t JOIN lv ON lv.exchange = t.exchange AND lv.ts <= t.ts AND (lv.until IS NULL OR lv.until > t.ts) AND lv.volume > 0 GROUP BY ALL
), bq AS (
  SELECT b.exchange, b.ts, b.bp, x.volume AS bv, b.ap, y.volume AS av FROM bs b
  LEFT JOIN lv x ON x.exchange = b.exchange AND x.side = 'b' AND x.price = b.bp AND x.ts <= b.ts AND (x.until IS NULL OR x.until > b.ts)
  LEFT JOIN lv y ON y.exchange = b.exchange AND y.side = 's' AND y.price = b.ap AND y.ts <= b.ts AND (y.until IS NULL OR y.until > b.ts)
), sx AS (
  SELECT * FROM bq QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY ts) = 1 OR (bp, bv, ap, av) IS DISTINCT FROM lag((bp, bv, ap, av)) OVER (PARTITION BY exchange ORDER BY ts)
), mid AS (
  SELECT exchange, {grid("ts", seconds)} AS cell, arg_max((bp + ap)::DOUBLE / 2, ts) AS mid FROM sx WHERE bp IS NOT NULL AND ap IS NOT NULL GROUP BY ALL
)"""


PLACED = f"""WITH {chain()}, {levels()}, {BEST}, dl AS (
  SELECT ts, side, price, volume - coalesce(lag(volume) OVER (PARTITION BY side, price ORDER BY ts), 0) AS delta FROM chg
), pl AS (
  SELECT dl.ts, {side("dl.side")} AS side, dl.price, delta, CASE WHEN dl.side = 'b' THEN q.ap - dl.price ELSE dl.price - q.bp END AS distance FROM dl ASOF LEFT JOIN spread q ON dl.ts > q.ts
), placed AS (
  SELECT *, CASE WHEN delta < 0 THEN 'cancellation' WHEN distance <= 0 THEN 'marketable' ELSE 'placement' END AS kind FROM pl WHERE delta <> 0
)"""


def tail(values: str, column: str) -> str:
    return f"""st AS (SELECT stddev_samp({column}) AS sigma, count(*) AS n FROM {values}), tl AS (
  SELECT {column} / sigma AS x, n, sigma, row_number() OVER (ORDER BY {column} DESC) AS rk FROM {values}, st WHERE {column} / sigma >= 1
)"""


ORACLES = {
    "level3_chain": f"WITH {chain()} SELECT epoch_us(ts) AS ts_us, order_id, event_no, side, price::DOUBLE AS price, amount::DOUBLE AS amount, fill::DOUBLE AS fill, epoch_us(next_ts) AS next_ts_us, next_event_no, status, epoch_us(price_ts) AS price_ts_us, price_event_no FROM l3",
    "depth_changes": f"WITH {chain()}, {levels()} {CHANGES} chg",
    "depth_sampled_1h": f"WITH {chain()}, {levels(3600)} {CHANGES} chg",
    "depth_multi_era": f"""WITH {chain(eras=ERAS)}, {levels()}, nx AS (SELECT era, lead(era) OVER (ORDER BY era) AS n FROM (SELECT DISTINCT era FROM l3))
{CHANGES} (SELECT ts, side, price, volume FROM chg UNION ALL SELECT n - INTERVAL 1 MICROSECOND, side, price, 0 FROM lv JOIN nx USING (era) WHERE until IS NULL AND volume > 0 AND n IS NOT NULL)""",
    "starting_depth": f"{standing(MIDDLE, True)} {LEVELS}",
    "depth_at_ts": f"{standing("TIMESTAMP '2024-01-21 06:00:00'", eras=ERAS)} {LEVELS}",
    "depth_range": f"""WITH {chain()}, {levels(1800)} {CHANGES} (
  SELECT {START} AS ts, side, price, sum(amount) AS volume FROM l3 WHERE NOT deleted AND ts < {START} AND (next_ts IS NULL OR next_ts >= {START}) GROUP BY side, price
  UNION ALL SELECT ts, side, price, volume FROM chg WHERE ts >= {START} AND ts <= {END})""",
    "periods_within_eras": f"""WITH {chain(eras=ERAS)}, e AS (SELECT era, max(ts) AS l FROM l3 GROUP BY era), p AS (
  SELECT era, greatest(era, {START}) AS s, least(date_trunc('hour', l), {END}) AS x FROM e), k AS (SELECT * FROM p WHERE x > s)
SELECT epoch_us(era) AS era_us, epoch_us(s) AS period_start_us, epoch_us(x) AS period_end_us, epoch_us(lag(x) OVER (ORDER BY era)) AS previous_period_end_us FROM k""",
    "events_intervals": f"""WITH {chain(eras=ERAS)}, e AS (SELECT era, max(ts) AS l, lead(era) OVER (ORDER BY era) AS n FROM l3 GROUP BY era), i AS (
  SELECT era AS a, l AS b, 'G' AS status FROM e UNION ALL SELECT l, n, 'R' FROM e WHERE n IS NOT NULL)
SELECT epoch_us(a) AS interval_start_us, epoch_us(b) AS interval_end_us, status FROM i WHERE epoch_us(b) - epoch_us(a) >= 60000000""",
    "data_overview": f"""WITH {chain(eras=ERAS)}, e AS (SELECT era, max(ts) AS l FROM l3 GROUP BY era)
SELECT epoch_us(era) AS era_us, epoch_us(l) AS last_ts_us, epoch_us(lead(era) OVER (ORDER BY era)) AS next_era_us, row_number() OVER (ORDER BY era DESC)::INT AS r FROM e QUALIFY r <= 2""",
    "available_period": f"WITH {chain(venues=3)} SELECT exchange, 'AB' AS pair, epoch_us(min(ts)) AS s_us, epoch_us(max(ts)) AS e_us FROM l3 GROUP BY exchange",
    "era_summary": f"""WITH {chain(eras=ERAS)}, {PAIR}, n AS (SELECT max(raw.era) AS era, seq FROM raw GROUP BY seq), c AS (SELECT n.era, count(*) AS trades FROM trade JOIN n ON n.seq = trade.event_id GROUP BY n.era)
SELECT epoch_us(era) AS era_us, count(*) AS events, count(*) FILTER (event_no = 1 AND NOT deleted) AS created, count(*) FILTER (event_no > 1 AND NOT deleted) AS changed, count(*) FILTER (deleted) AS deletions,
  coalesce(any_value(trades), 0) AS trades, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9)::DOUBLE AS events_per_second, round(coalesce(any_value(trades), 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9)::DOUBLE AS trades_per_second, epoch_us(min(ts)) AS first_event_us, epoch_us(max(ts)) AS last_event_us FROM l3 LEFT JOIN c USING (era) GROUP BY era""",
    "book_snapshot": f"{standing(MIDDLE)} SELECT epoch_us(ts) AS ts_us, order_id, event_no, side, price::DOUBLE AS price, amount::DOUBLE AS amount FROM ob",
    "book_flags": f"{standing(MIDDLE, crossed=True)}{FLAGS} SELECT order_id, event_no, side, price::DOUBLE AS price, is_maker, is_crossed FROM f",
    "book_liquidity": f"""{standing(MIDDLE, crossed=True)}{FLAGS}, mk AS (
  SELECT *, CASE WHEN side = 'b' THEN -price ELSE price END AS k FROM f WHERE is_maker AND amount > 0
), r AS (
  SELECT *, abs(price - CASE WHEN side = 'b' THEN max(price) OVER (PARTITION BY side) ELSE min(price) OVER (PARTITION BY side) END)::DOUBLE / (CASE WHEN side = 'b' THEN max(price) OVER (PARTITION BY side) ELSE min(price) OVER (PARTITION BY side) END)::DOUBLE * 10000 AS x,
    sum(amount) OVER (PARTITION BY side ORDER BY k, price_ts, ts, order_id ROWS UNBOUNDED PRECEDING) AS liquidity, dense_rank() OVER (PARTITION BY side ORDER BY k)::INT AS level FROM mk
)
SELECT order_id, side, price::DOUBLE AS price, amount::DOUBLE AS amount, liquidity::DOUBLE AS liquidity, round(x, 2) AS bps, level FROM r WHERE level <= 20 AND round(x, 2) <= 500""",
    "spread": f"WITH {chain()}, {levels()}, {BEST} {SPREAD}",
    "spread_sampled_1h": f"WITH {chain()}, {levels(3600)}, {BEST} {SPREAD}",
    "spread_uncrossed": f"WITH {chain(crossed=True)}, {levels()}, {BEST} SELECT epoch_us(ts) AS ts_us, bp::DOUBLE AS best_bid_price, ap::DOUBLE AS best_ask_price FROM spread WHERE bp <= ap",
    "mid_price": f"WITH {chain()}, {levels()}, {BEST} SELECT epoch_us(ts) AS ts_us, round((bp + ap)::DOUBLE / 2, 4) AS mid FROM spread WHERE bp IS NOT NULL AND ap IS NOT NULL",
    "depth_summary_bps": f"{summary(100, 1000)} SELECT epoch_us(t) AS ts_us, {side()} AS side, bps AS bps_level, round(best::DOUBLE * (1 + CASE WHEN side = 'b' THEN -1 ELSE 1 END * bps / 10000.0::DOUBLE), 2) AS price, volume::DOUBLE AS volume FROM bands",
    "depth_summary_pivot": f"{summary(250, 1000)} SELECT epoch_us(t) AS ts_us, max(best) FILTER (side = 'b' AND bps = 0)::DOUBLE AS best_bid_price, max(best) FILTER (side = 's' AND bps = 0)::DOUBLE AS best_ask_price, "
    + ", ".join(f"coalesce(sum(volume) FILTER (side = '{s}' AND bps = {k}), 0)::DOUBLE AS {n}_vol{k}bps" for s, n in (("b", "bid"), ("s", "ask")) for k in range(0, 1001, 250))
    + " FROM bands GROUP BY t",
    "depth_resample_tick": f"""WITH {LINE}, c AS (
  SELECT {grid("ts", 30 * 86400)} AS cell, side, price, (CASE WHEN side = 'bid' THEN floor(price / 500.0) ELSE ceil(price / 500.0) END * 500)::BIGINT AS bucket, ts, volume FROM u
), lim AS (SELECT make_timestamp((floor(epoch_us(max(ts)) / 2592000000000.0) * 2592000000000)::BIGINT) AS e FROM u), k AS (
  SELECT DISTINCT cell, side, bucket FROM c, lim WHERE cell <= e
), v AS (
  SELECT k.cell, k.side, k.bucket, c.price, arg_max(c.volume, c.ts) AS volume FROM k JOIN c ON c.side = k.side AND c.bucket = k.bucket AND c.cell <= k.cell GROUP BY ALL
)
SELECT epoch_us(cell) AS ts_us, side, bucket::DOUBLE AS price, sum(volume)::DOUBLE AS volume FROM v GROUP BY ALL HAVING true""",
    "depth_signed_changes": f"WITH {LINE} SELECT epoch_us(ts) AS ts_us, side, price::DOUBLE AS price, volume::DOUBLE AS volume, (volume - coalesce(lag(volume) OVER (PARTITION BY side, price ORDER BY ts), 0))::DOUBLE AS delta FROM u",
    "chain_id": f"""WITH {LINE}, d AS (SELECT *, volume - coalesce(lag(volume) OVER (PARTITION BY side, price ORDER BY ts), 0) AS delta FROM u), o AS (
  SELECT *, row_number() OVER (ORDER BY ts, side, CASE WHEN side = 'ask' THEN price ELSE -price END) AS n FROM d WHERE delta <> 0
), f AS (SELECT side, abs(delta) AS z, min(n) AS n FROM o GROUP BY ALL), i AS (SELECT side, z, row_number() OVER (ORDER BY n)::INT AS chain_id FROM f)
SELECT epoch_us(ts) AS ts_us, o.side, price::DOUBLE AS price, delta::DOUBLE AS delta, chain_id FROM o JOIN i ON o.side = i.side AND abs(o.delta) = i.z""",
    "queues_absolute": QUEUE,
    "trading_period_best": f"""WITH {chain()}, {levels()}, {BEST}, z AS (SELECT ts, bp::DOUBLE AS b, ap::DOUBLE AS a, lag(bp) OVER (ORDER BY ts) AS lb, lag(ap) OVER (ORDER BY ts) AS la, row_number() OVER (ORDER BY ts) AS n FROM best)
SELECT epoch_us(ts) AS ts_us, b AS bid_price, a AS ask_price FROM z WHERE n = 1 OR b IS DISTINCT FROM lb OR a IS DISTINCT FROM la""",
    "trading_period_volume": effective("500.0"),
    "trading_period_infinite": effective("1e15"),
    "events_classified": CLASSIFY,
    "export_events": f"""WITH {chain()} SELECT order_id AS id, epoch_us(ts) // 1000 AS timestamp, epoch_us(ts) // 1000 AS exchange_timestamp, price::DOUBLE AS price, amount::DOUBLE AS volume,
  CASE WHEN deleted THEN 'deleted' WHEN event_no = 1 THEN 'created' ELSE 'changed' END AS action, {side()} AS direction, event_no FROM l3 WHERE ts >= {START} AND ts < {END} AND NOT (amount = 0 AND event_no = 1 AND NOT deleted)""",
    "trades": f"""WITH {chain()}, {PAIR}, {met()} SELECT epoch_us(ts) AS timestamp_us, price::DOUBLE AS price, amount::DOUBLE AS volume, CASE side WHEN 'b' THEN 'buy' ELSE 'sell' END AS direction,
  CASE WHEN side = 'b' THEN {uuid("sell_order_id", "sell_event_no")} ELSE {uuid("buy_order_id", "buy_event_no")} END AS maker_event_id, CASE WHEN side = 'b' THEN {uuid("buy_order_id", "buy_event_no")} ELSE {uuid("sell_order_id", "sell_event_no")} END AS taker_event_id,
  CASE WHEN side = 'b' THEN sell_order_id ELSE buy_order_id END AS maker, CASE WHEN side = 'b' THEN buy_order_id ELSE sell_order_id END AS taker, trade_id AS exchange_trade_id FROM mt WHERE ts BETWEEN {START} AND {END}""",
    "market_orders": f"""WITH {chain()}, {PAIR} SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS timestamp_us, taker, CASE taker_side WHEN 'b' THEN 'buy' ELSE 'sell' END AS direction, sum(amount)::DOUBLE AS volume, count(DISTINCT price) AS levels,
  round(sum(amount::DOUBLE * price::DOUBLE) / sum(amount)::DOUBLE, 4) AS mean_price FROM trade GROUP BY ALL""",
    "crossed_books": f"""WITH {chain(crossed=True)}, {levels()}, {BEST}, c AS (SELECT ts, coalesce(bp > ap, false) AS x FROM spread), i AS (
  SELECT ts FROM c QUALIFY x AND NOT coalesce(lag(x) OVER (ORDER BY ts), false)
)
SELECT (SELECT epoch_us(max(ts)) FROM spread s WHERE s.ts < i.ts) AS previous_uncrossed_us, epoch_us(ts) AS first_crossed_us, (SELECT epoch_us(min(ts)) FROM c WHERE c.ts > i.ts AND NOT x) AS next_uncrossed_us FROM i""",
    "match_exact_fill": f"""WITH {chain()}, {FILLS}, t AS (SELECT seq AS trade, epoch_us(ts) - (seq % 4) * 400000 AS u, price, fill, side FROM fills), j AS (
  SELECT trade, event, row_number() OVER (PARTITION BY trade ORDER BY ts, event) AS r, row_number() OVER (PARTITION BY event ORDER BY u, trade) AS q
  FROM t JOIN fills e ON e.price = t.price AND e.fill = t.fill AND e.side = t.side AND epoch_us(e.ts) BETWEEN u AND u + 1000000
)
SELECT trade, event FROM j WHERE r = 1 AND q = 1""",
    "match_sum_of_fill": f"""WITH {chain()}, {FILLS}, t AS (
  SELECT seq * 2 + k AS trade, epoch_us(ts) - 500000 + k * 300000 AS u, price, side, CASE WHEN k = 0 THEN (fill / 2)::DECIMAL(18,8) ELSE fill - (fill / 2)::DECIMAL(18,8) END AS amount FROM fills, range(2) r(k)
), g AS (
  SELECT a.trade AS x, b.trade AS y, b.u, a.price, a.side, a.amount + b.amount AS amount FROM t a JOIN t b ON a.price = b.price AND a.side = b.side AND a.trade < b.trade AND b.u - a.u BETWEEN 0 AND 1000000
), j AS (
  SELECT event, x, y, ts, row_number() OVER (PARTITION BY x ORDER BY ts, x, y, event) AS r, row_number() OVER (PARTITION BY y ORDER BY ts, x, y, event) AS q
  FROM g JOIN fills e ON e.price = g.price AND e.side = g.side AND e.fill = g.amount AND epoch_us(ts) BETWEEN u AND u + 1000000
)
SELECT event, x AS first_trade, 2 AS members FROM j WHERE r = 1 AND q = 1""",
    "dup_order_events": f"WITH {chain()} SELECT order_id, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS ts_us, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1",
    "invalid_chains": f"""WITH {chain()}, k AS (SELECT * FROM l3 WHERE seq % 17 <> 0)
SELECT order_id, epoch_us(ts) AS ts_us, event_no, 'no next event' AS problem FROM k WHERE next_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k n WHERE n.order_id = k.order_id AND n.ts = k.next_ts AND n.event_no = k.next_event_no)
UNION ALL SELECT order_id, epoch_us(ts), event_no, 'no previous event' FROM k WHERE event_no > 1 AND NOT EXISTS (SELECT 1 FROM k n WHERE n.order_id = k.order_id AND n.next_ts = k.ts AND n.next_event_no = k.event_no)""",
    "eternal_orders": f"WITH {chain()} SELECT order_id, epoch_us(ts) AS ts_us, event_no FROM l3 WHERE status = 'open' AND (SELECT epoch_us(max(ts)) FROM l3) - epoch_us(ts) > 86400000000",
    "merge_episodes": f"""WITH {chain()}, h AS (
  SELECT seq, order_id, deleted, ts, date_trunc('day', ts) AS dy, epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP) AS o FROM raw
), x AS (
  SELECT *, o >= 3600000000 AND o < 32400000000 AND dy >= TIMESTAMP '2024-01-02' AND dy < TIMESTAMP '2024-01-30' AS hit FROM h
), a AS (
  SELECT *, lead(seq) OVER w IS NOT NULL AS again FROM x WHERE hit WINDOW w AS (PARTITION BY order_id, dy ORDER BY ts, seq)
), m AS (
  SELECT a.seq, coalesce((SELECT min(b.ts) FROM a b WHERE b.order_id = a.order_id AND b.dy = a.dy AND b.deleted AND b.again AND (b.ts, b.seq) >= (a.ts, a.seq)), dy + INTERVAL 9 HOUR) AS t FROM a
)
SELECT raw.seq, raw.order_id, epoch_us(coalesce(m.t, raw.ts)::TIMESTAMP) AS ts_us FROM raw LEFT JOIN m USING (seq)""",
    "missing_fill_backprop": f"""WITH {chain()}, z AS (
  SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN fill END AS fill) FROM l3
), mt AS (
  SELECT DISTINCT order_id, event_no FROM z WHERE fill IS NULL AND event_no > 1 AND NOT deleted AND seq % 2 = 1
), q AS (
  SELECT z.*, mt.order_id IS NOT NULL AS has, CASE WHEN fill IS NULL AND z.event_no > 1 AND mt.order_id IS NOT NULL THEN 2 ELSE 0 END AS lost FROM z LEFT JOIN mt ON mt.order_id = z.order_id AND mt.event_no = z.event_no
)
SELECT seq, (amount + coalesce((SELECT sum(lost) FROM q l WHERE l.order_id = q.order_id AND l.segment = q.segment AND l.event_no > q.event_no), 0))::DOUBLE AS amount, CASE WHEN fill IS NULL AND has THEN 2 ELSE fill END::DOUBLE AS fill FROM q""",
    "session_eras": f"""WITH {chain()}, g AS (SELECT ts, seq, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, seq)) <= 900000000 THEN 0 ELSE 1 END AS n FROM raw), i AS (SELECT *, sum(n) OVER (ORDER BY ts, seq) AS k FROM g)
SELECT epoch_us(min(ts)) AS era_us, count(*) AS events, epoch_us(max(ts)) AS last_ts_us FROM i GROUP BY k""",
    "late_reassign": f"WITH {chain(eras=ERAS)} SELECT epoch_us(era) AS era_us, count(*) AS events, count(DISTINCT order_id) AS orders FROM raw GROUP BY era",
    "reincarnation_numbering": f"WITH {chain()} SELECT order_id, segment::BIGINT AS segment, max(event_no) AS events FROM l3 GROUP BY ALL",
    "order_book_diff": f"""WITH {chain()}, a AS (SELECT order_id, price, CASE WHEN side = 'b' THEN amount ELSE -amount END AS v FROM l3 WHERE NOT deleted AND ts <= {START} AND (next_ts IS NULL OR next_ts > {START})),
b AS (SELECT order_id, price, CASE WHEN side = 'b' THEN amount ELSE -amount END AS v FROM l3 WHERE NOT deleted AND ts <= {MIDDLE} AND (next_ts IS NULL OR next_ts > {MIDDLE}))
SELECT order_id, coalesce(b.price, 0)::DOUBLE AS price, coalesce(b.v, sign(a.v))::DOUBLE AS amount FROM a FULL JOIN b USING (order_id) WHERE (a.price, a.v) IS DISTINCT FROM (b.price, b.v)""",
    "asof_last_spread": f"WITH {chain()}, {levels()}, {BEST}, {PAIR} SELECT event_id AS exchange_trade_id, bp::DOUBLE AS best_bid_price, ap::DOUBLE AS best_ask_price FROM trade ASOF LEFT JOIN spread ON trade.ts > spread.ts",
    "power_law_volume": f"""WITH {chain()}, {PAIR}, b AS (SELECT sum(amount)::DOUBLE AS v FROM trade GROUP BY {grid("ts", 900)}), {tail("b", "v")}
SELECT max(n) AS n, count(*) AS tail, round(max(sigma), 6) AS sigma, round(-regr_slope(ln(rk / n), ln(x)), 6) AS exponent FROM tl""",
    "power_law_returns": f"""WITH {mids(900)}, r0 AS (SELECT cell, ln(mid) - lag(ln(mid)) OVER (ORDER BY cell) AS r FROM mid), p AS (SELECT cell, r, abs(r) * abs(lag(r) OVER (ORDER BY cell)) AS p FROM r0), v AS (
  SELECT r, count(p) OVER w AS c, sum(p) OVER w AS s FROM p WINDOW w AS (ORDER BY cell ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
), b AS (SELECT abs(r) AS v FROM v WHERE c = 2 AND s > 0 AND abs(r) > 0), {tail("b", "v")}
SELECT max(n) AS n, count(*) AS tail, round(-regr_slope(ln(rk / n), ln(x)), 5) AS exponent FROM tl""",
    "lead_lag_corr": f"""WITH {mids(3600, 3)}, ends AS (SELECT min(cell) AS a, max(cell) AS b FROM mid), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM ends), f AS (
  SELECT t, (SELECT arg_max(mid, cell) FROM mid WHERE exchange = 'venue0' AND cell <= t) AS x, (SELECT arg_max(mid, cell) FROM mid WHERE exchange = 'venue1' AND cell <= t) AS y FROM g
), c AS (
  SELECT row_number() OVER (ORDER BY t) AS n, log10(x) - lag(log10(x)) OVER (ORDER BY t) AS x, log10(y) - lag(log10(y)) OVER (ORDER BY t) AS y FROM f
)
SELECT k::INT AS lag, round(corr(a.x, b.y), 6) AS correlation FROM range(-5, 6) r(k) LEFT JOIN c a ON true JOIN c b ON b.n = a.n - k GROUP BY k""",
    "jump_test": f"""WITH {mids(600)}, r0 AS (SELECT cell, ln(mid) - lag(ln(mid)) OVER (ORDER BY cell) AS r FROM mid), p AS (SELECT cell, r, abs(r) * abs(lag(r) OVER (ORDER BY cell)) AS p FROM r0), v AS (
  SELECT cell, r, count(p) OVER w AS c, sum(p) OVER w / 28 AS s FROM p WINDOW w AS (ORDER BY cell ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)
)
SELECT epoch_us(cell) AS ts_us, round(r, 9) AS log_return, round(abs(r) / sqrt(s), 5) AS statistic FROM v WHERE c = 28 AND s > 0""",
    "range_by_interval": f"WITH {mids(600)} SELECT epoch_us(date_trunc('day', cell)::TIMESTAMP) AS cell_us, round(ln(max(mid)) - ln(min(mid)), 9) AS log_range FROM mid GROUP BY ALL",
    "takers_levels": f"""WITH {chain()}, {PAIR}, o AS (SELECT date_trunc('day', ts) AS t, taker, taker_side, sum(amount) AS volume, count(DISTINCT price) AS levels FROM trade GROUP BY ALL)
SELECT levels, count(*) AS orders, sum(volume)::DOUBLE AS volume FROM o GROUP BY levels""",
    "limit_placements": f"{PLACED} SELECT epoch_us(ts) AS ts_us, side, price::DOUBLE AS price, delta::DOUBLE AS delta, kind, distance::DOUBLE AS distance FROM placed",
    "arrival_rate_by_distance": f"{PLACED} SELECT kind, ceil(distance::DOUBLE / 25 - 1e-9)::INT AS ticks, count(*) AS events, round(count(*) / (29 * 86400.0), 9)::DOUBLE AS rate FROM placed GROUP BY ALL",
    "placements_histogram": f"""{PLACED}, c AS (SELECT epoch_us(ts) // 600000000 AS cell, count(*) AS events FROM placed WHERE kind = 'placement' AND ts >= {START} AND ts < {END} GROUP BY ALL)
SELECT events, count(*) AS cells FROM c GROUP BY events UNION ALL SELECT 0, 14 * 144 - count(*) FROM c""",
    "queue_profile": f"WITH q AS ({QUEUE}) " + " UNION ALL ".join(f"SELECT '{s}' AS side, {i} AS tick, round(avg({c}{i}), 6) AS volume FROM q" for s, c in (("bid", "b"), ("ask", "a")) for i in range(1, 5)),
    "quote_events": f"""WITH {chain()} SELECT order_id, segment::BIGINT AS segment, event_no AS k, CASE WHEN deleted THEN 'D' WHEN event_no = 1 THEN 'A' ELSE 'C' END AS type,
  CASE WHEN deleted THEN amount ELSE fill END::DOUBLE AS decrease FROM l3""",
}


QUOTES = f"""{chain()}, {levels(600)}, {BEST}, qt AS (
  SELECT ts, bp::DOUBLE AS b, ap::DOUBLE AS a FROM best QUALIFY row_number() OVER (ORDER BY ts) = 1 OR bp IS DISTINCT FROM lag(bp) OVER (ORDER BY ts) OR ap IS DISTINCT FROM lag(ap) OVER (ORDER BY ts)
), pp AS (
  SELECT row_number() OVER (ORDER BY ts) AS n, epoch_us(ts) AS t, (b + a) / 2 AS p FROM qt WHERE b IS NOT NULL AND a IS NOT NULL
)"""
RETURNS = """SELECT 'venue0' AS exchange, 'AB' AS pair, p0 AS open_price, p1 AS close_price, t0 AS opened_at_us, t1 AS closed_at_us, round((p1 - p0) / p0 * 10000, 2) AS bps_return,
  round(CASE WHEN t1 > t0 THEN exp(abs(ln(p1) - ln(p0)) / ((t1 - t0) / 1e6)) - 1 END, 12) AS rate, round(abs(ln(p1) - ln(p0)), 12) AS log_return FROM"""


def draws(epsilon: float) -> str:
    """CTEs after pp. draw: rises and falls, one row of the recursion per price."""
    on = "tt = st AND tp = sp OR (p > tp) = (tp > sp)"
    turned = f"p <> tp AND NOT ({on}) AND abs(ln(p) - ln(tp)) > {epsilon}"
    return f"""dr AS (
  SELECT n, t AS st, p AS sp, t AS tt, p AS tp, t AS lt, p AS lp, NULL::BIGINT AS t0, NULL::DOUBLE AS p0, NULL::BIGINT AS t1, NULL::DOUBLE AS p1 FROM pp WHERE n = 1
  UNION ALL
  SELECT pp.n, CASE WHEN {turned} THEN tt ELSE st END, CASE WHEN {turned} THEN tp ELSE sp END, CASE WHEN p <> tp AND ({on}) THEN t ELSE tt END, CASE WHEN p <> tp AND ({on}) THEN p ELSE tp END, t, p,
    CASE WHEN {turned} THEN st END, CASE WHEN {turned} THEN sp END, CASE WHEN {turned} THEN tt END, CASE WHEN {turned} THEN tp END
  FROM dr JOIN pp ON pp.n = dr.n + 1
), draw AS (
  SELECT t0, p0, t1, p1 FROM dr WHERE t0 IS NOT NULL UNION ALL SELECT st, sp, lt, lp FROM dr WHERE n = (SELECT max(n) FROM pp) AND (st, sp) <> (lt, lp)
)"""


def strategy(phi: float, rho: float) -> str:
    """CTEs after pp. closed: positions, by the same transitions, one row of the recursion per price."""
    cost = lambda a: f"{rho} * abs(t - {a}t) / 1e6"
    up = lambda a: f"ln(p) - ln({a}p)"
    down = lambda a: f"ln({a}p) - ln(p)"
    both = 2 * phi
    fields = ("l", "s", "x", "y")  # where a long or short one starts, and ends
    raised, lowered = f"{down('s')} < {cost('s')}", f"{up('l')} < {cost('l')}"
    return f"""sa AS (
  SELECT n, t AS lt, p AS lp, t AS st, p AS sp, NULL::BIGINT AS xt, NULL::DOUBLE AS xp, NULL::BIGINT AS yt, NULL::DOUBLE AS yp, '' AS pos, NULL::BIGINT AS t0, NULL::DOUBLE AS p0, NULL::BIGINT AS t1, NULL::DOUBLE AS p1 FROM pp WHERE n = 1
  UNION ALL
  SELECT n, {", ".join(f"CASE WHEN {c} THEN t ELSE {f}t END, CASE WHEN {c} THEN p ELSE {f}p END" for f, c in zip(fields, ("step IN ('2', '4l', 'd2', 'd3', 'e1', 'll')  OR lows", "step IN ('1', 'd1', 'e2', 'e3') OR highs", "step IN ('1', 'd1', 'e2')", "step IN ('2', 'd2', 'e1')"), strict=True))},
    CASE WHEN step IN ('1', 'e2') THEN 'long' WHEN step IN ('2', 'd2') THEN 'short' WHEN step IN ('d3', 'e3') THEN '' ELSE pos END,
    CASE WHEN step IN ('d2', 'd3') THEN lt WHEN step IN ('e2', 'e3') THEN st END, CASE WHEN step IN ('d2', 'd3') THEN lp WHEN step IN ('e2', 'e3') THEN sp END,
    CASE WHEN step IN ('d2', 'd3') THEN xt WHEN step IN ('e2', 'e3') THEN yt END, CASE WHEN step IN ('d2', 'd3') THEN xp WHEN step IN ('e2', 'e3') THEN yp END
  FROM (
    SELECT *, pos = '' AND step = '0' AND {lowered} OR pos = 'short' AND {lowered} AND step <> 'e1' AS lows, pos = '' AND step = '0' AND {raised} OR pos = 'long' AND {raised} AND step <> 'd1' AS highs FROM (
      SELECT pp.n, pp.t, pp.p, sa.* EXCLUDE (n, t0, p0, t1, p1), CASE
        WHEN pos = '' AND {up("l")} > {cost("l")} + {both} THEN '1' WHEN pos = '' AND {down("s")} > {cost("s")} + {both} THEN '2' WHEN pos = '' THEN '0'
        WHEN pos = 'long' AND {up("x")} > {cost("x")} THEN 'd1' WHEN pos = 'long' AND NOT ({raised}) AND {down("s")} > {cost("s")} + {both} THEN 'd2' WHEN pos = 'long' AND {cost("x")} > {both} - ({down("x")}) THEN 'd3' WHEN pos = 'long' THEN 'd'
        WHEN {down("y")} > {cost("y")} THEN 'e1' WHEN NOT ({lowered}) AND {up("l")} > {cost("l")} + {both} THEN 'e2' WHEN {cost("y")} > {both} - ({up("y")}) THEN 'e3' ELSE 'e' END AS step
      FROM sa JOIN pp ON pp.n = sa.n + 1))
), closed AS (
  SELECT t0, p0, t1, p1 FROM sa WHERE t0 IS NOT NULL
  UNION ALL SELECT CASE pos WHEN 'long' THEN lt ELSE st END, CASE pos WHEN 'long' THEN lp ELSE sp END, CASE pos WHEN 'long' THEN xt ELSE yt END, CASE pos WHEN 'long' THEN xp ELSE yp END FROM sa WHERE n = (SELECT max(n) FROM pp) AND pos <> ''
)"""


#: A row of the recursion per fill: the pending fills of both sides are lists.
INFER = f"""WITH RECURSIVE {chain(crossed=True)}, fe AS (
  SELECT row_number() OVER (ORDER BY ts, order_id, event_no) AS n, epoch_us(ts) AS us, order_id, event_no, side, price::DOUBLE AS price, fill::DOUBLE AS fill, epoch_us(price_ts) AS pu
  FROM l3 WHERE fill > 0 OR (fill IS NULL AND NOT (event_no = 1 AND NOT deleted))
), it AS (
  SELECT 0::BIGINT AS n, []::STRUCT(price DOUBLE, us BIGINT, order_id BIGINT, event_no INT, fill DOUBLE, pu BIGINT)[] AS pb, []::STRUCT(price DOUBLE, us BIGINT, order_id BIGINT, event_no INT, fill DOUBLE, pu BIGINT)[] AS ps,
    NULL::STRUCT(price DOUBLE, us BIGINT, order_id BIGINT, event_no INT, fill DOUBLE, pu BIGINT) AS hit
  UNION ALL
  SELECT n, CASE WHEN side = 'b' THEN CASE WHEN hit IS NULL THEN list_append(pb, me) ELSE pb END WHEN hit IS NULL THEN oth ELSE list_filter(oth, lambda x: x <> hit) END,
    CASE WHEN side = 's' THEN CASE WHEN hit IS NULL THEN list_append(ps, me) ELSE ps END WHEN hit IS NULL THEN oth ELSE list_filter(oth, lambda x: x <> hit) END, hit
  FROM (
    SELECT *, CASE WHEN len(fits) = 0 THEN NULL WHEN side = 'b' THEN list_sort(fits)[1] ELSE list_sort(list_filter(fits, lambda x: x.price = list_max([y.price FOR y IN fits])))[1] END AS hit FROM (
      SELECT *, list_filter(oth, lambda x: (CASE WHEN side = 'b' THEN price >= x.price ELSE price <= x.price END)
        AND (fill IS NULL OR x.fill IS NULL OR abs(fill - x.fill) * (CASE WHEN (x.pu, x.order_id) <= (pu, order_id) THEN x.price ELSE price END) <= 1)) AS fits FROM (
        SELECT fe.*, it.pb, it.ps, {{'price': fe.price, 'us': fe.us, 'order_id': fe.order_id, 'event_no': fe.event_no, 'fill': fe.fill, 'pu': fe.pu}} AS me,
          list_filter(CASE WHEN fe.side = 'b' THEN it.ps ELSE it.pb END, lambda x: fe.us - x.us < 3600000000) AS oth FROM it JOIN fe ON fe.n = it.n + 1)))
)
SELECT 'venue0' AS exchange, 'AB' AS pair, CASE WHEN own THEN fe.price ELSE hit.price END AS price, coalesce(fe.fill, hit.fill) AS amount, CASE WHEN own THEN CASE fe.side WHEN 'b' THEN 's' ELSE 'b' END ELSE fe.side END AS side,
  CASE WHEN fe.side = 'b' THEN fe.order_id ELSE hit.order_id END AS buy_order_id, CASE WHEN fe.side = 'b' THEN fe.event_no ELSE hit.event_no END AS buy_event_no,
  CASE WHEN fe.side = 's' THEN fe.order_id ELSE hit.order_id END AS sell_order_id, CASE WHEN fe.side = 's' THEN fe.event_no ELSE hit.event_no END AS sell_event_no, fe.us AS ts_us
FROM (SELECT it.n, it.hit, NOT ((it.hit.pu, it.hit.order_id) <= (fe.pu, fe.order_id)) AS own FROM it JOIN fe USING (n) WHERE it.hit IS NOT NULL) h JOIN fe USING (n)"""


def days(crossed: bool = True) -> str:
    """CTEs: od: orders that stand at the end of each day, dv: the volume of their levels."""
    return f"""{chain(crossed=crossed)}, day AS (SELECT TIMESTAMP '2024-01-01' + to_days(d::INT) AS t FROM range(2, 30) r(d)), od AS (
  SELECT t, l3.* FROM day JOIN l3 ON NOT deleted AND ts <= t AND (next_ts IS NULL OR next_ts > t)
), dv AS (
  SELECT t, side, price, sum(amount) AS volume FROM od GROUP BY ALL
)"""


def day_flags(strict: bool) -> str:
    less, more = ("<", ">") if strict else ("<=", ">=")
    rest = "FROM od o WHERE o.t = od.t AND o.amount > 0 AND"
    return f"""df AS (
  SELECT *, coalesce(CASE WHEN side = 'b' THEN price {less} (SELECT min(o.price) {rest} o.side = 's' AND (o.price_ts, o.ts) <= (od.price_ts, od.ts)) ELSE price {more} (SELECT max(o.price) {rest} o.side = 'b' AND (o.price_ts, o.ts) <= (od.price_ts, od.ts)) END, true) AS is_maker,
    coalesce(CASE WHEN side = 'b' THEN price > (SELECT min(o.price) {rest} o.side = 's' AND (o.price_ts, o.ts) >= (od.price_ts, od.ts)) ELSE price < (SELECT max(o.price) {rest} o.side = 'b' AND (o.price_ts, o.ts) >= (od.price_ts, od.ts)) END, false) AS is_crossed FROM od
)"""


DAY_SPREAD = """ds AS (
  SELECT t, max(price) FILTER (side = 'b') AS bp, arg_max(volume, price) FILTER (side = 'b') AS bv, min(price) FILTER (side = 's') AS ap, arg_min(volume, price) FILTER (side = 's') AS av FROM day LEFT JOIN dv USING (t) GROUP BY t
)"""
SHAKEN = "sh AS (SELECT order_id, event_no, ts + to_microseconds(CASE WHEN seq % 3 = 0 THEN (seq % 7) * 20000000000 ELSE 0 END::BIGINT) AS ts, fill, price_ts, seq FROM l3 WHERE segment = 0)"
TWO_BOOKS = f"""a AS (SELECT side, price, sum(amount) AS v FROM l3 WHERE NOT deleted AND ts <= {START} AND (next_ts IS NULL OR next_ts > {START}) GROUP BY ALL),
b AS (SELECT side, price, sum(amount) AS v FROM l3 WHERE NOT deleted AND ts <= {MIDDLE} AND (next_ts IS NULL OR next_ts > {MIDDLE}) GROUP BY ALL)"""

ORACLES |= {
    "trading_strategy": f"WITH RECURSIVE {QUOTES}, {strategy(0.0005, 1e-10)} {RETURNS} closed",
    "epsilon_drawupdowns": f"WITH RECURSIVE {QUOTES}, {draws(0.002)} {RETURNS} draw",
    "infer_trades": INFER,
    "top_spikes": f"WITH RECURSIVE {QUOTES}, {draws(0.001)}, ret AS ({RETURNS} draw) SELECT * FROM ret ORDER BY abs(bps_return) DESC, opened_at_us LIMIT 10",
    "position_trellis": f"""WITH RECURSIVE {QUOTES}, {draws(0.002)} SELECT 'venue0' AS exchange, 'AB' AS pair, t0 AS opened_at_us, t1 AS closed_at_us, epoch_us(ts) AS ts_us, round(ln(b / p0), 12) AS log_bid, round(ln(a / p0), 12) AS log_ask
FROM draw JOIN qt ON epoch_us(ts) BETWEEN t0 - 600000000 AND t1 + 600000000""",
    "depth_difference": f"WITH {chain()}, {TWO_BOOKS} SELECT {side()} AS side, price::DOUBLE AS price, coalesce(b.v, 0)::DOUBLE AS volume FROM a FULL JOIN b USING (side, price) WHERE a.v IS DISTINCT FROM b.v",
    "depth_applied": f"WITH {chain()}, {TWO_BOOKS} SELECT {side()} AS side, price::DOUBLE AS price, v::DOUBLE AS volume FROM b",
    "takers_checked": f"{standing(MIDDLE)}{FLAGS} SELECT order_id, is_maker, is_crossed FROM f",
    "starting_spread": f"""{standing(MIDDLE, True, ERAS)}, v AS (SELECT side, price, sum(amount) AS volume FROM ob GROUP BY ALL) SELECT epoch_us({MIDDLE}) AS ts_us, max(price) FILTER (side = 'b')::DOUBLE AS best_bid_price,
  arg_max(volume, price) FILTER (side = 'b')::DOUBLE AS best_bid_volume, min(price) FILTER (side = 's')::DOUBLE AS best_ask_price, arg_min(volume, price) FILTER (side = 's')::DOUBLE AS best_ask_volume FROM v""",
    "spread_by_episode": f"""WITH {days()}, {DAY_SPREAD} SELECT epoch_us(t) AS ts_us, bp::DOUBLE AS best_bid_price, bv::DOUBLE AS best_bid_volume, ap::DOUBLE AS best_ask_price, av::DOUBLE AS best_ask_volume
FROM ds QUALIFY row_number() OVER (ORDER BY t) = 1 OR (bp, bv, ap, av) IS DISTINCT FROM lag((bp, bv, ap, av)) OVER (ORDER BY t)""",
    "books_by_episode": f"""WITH {days()}, {day_flags(False)} SELECT epoch_us(t) AS episode_us, (row_number() OVER (PARTITION BY t ORDER BY price, ts, order_id, event_no) - 1)::INT AS place, order_id, event_no, side, price::DOUBLE AS price,
  amount::DOUBLE AS amount, is_maker, is_crossed FROM df""",
    "maker_depth": f"WITH {days()}, {day_flags(True)} SELECT epoch_us(t) AS ts_us, {side()} AS side, price::DOUBLE AS price, sum(amount)::DOUBLE AS volume FROM df WHERE is_maker GROUP BY ALL",
    "depth_summary_range": f"""WITH {chain()}, {levels(3600)}, tk AS (SELECT DISTINCT ts AS t FROM chg WHERE ts >= {START} AND ts <= {MIDDLE}), bk AS (
  SELECT t, side, price, volume FROM tk JOIN lv ON ts <= t AND (until IS NULL OR until > t) AND volume > 0
), w AS (SELECT *, CASE WHEN side = 'b' THEN max(price) OVER (PARTITION BY t, side) ELSE min(price) OVER (PARTITION BY t, side) END AS best FROM bk
), x AS (SELECT *, (ceil(abs(price - best)::DOUBLE / best::DOUBLE * 10000 / 100 - 1e-9) * 100)::INT AS bps FROM w)
SELECT epoch_us(t) AS ts_us, {side()} AS side, bps AS bps_level, round(any_value(best)::DOUBLE * (1 + CASE WHEN side = 'b' THEN -1 ELSE 1 END * bps / 10000.0::DOUBLE), 2) AS price, sum(volume)::DOUBLE AS volume FROM x WHERE bps <= 1000 GROUP BY t, side, bps""",
    "spread_range": f"""WITH {chain(eras=ERAS)}, {levels()}, nx AS (SELECT era, lead(era) OVER (ORDER BY era) AS n FROM (SELECT DISTINCT era FROM l3)), al AS (
  SELECT lv.side, lv.price, lv.volume, lv.ts, least(lv.until, n - INTERVAL 1 MICROSECOND) AS until FROM lv JOIN nx USING (era) WHERE volume > 0
), tk AS (SELECT DISTINCT ts FROM (SELECT ts FROM lv UNION ALL SELECT until FROM al WHERE until IS NOT NULL)), sp AS (
  SELECT tk.ts, max(price) FILTER (side = 'b') AS bp, arg_max(volume, price) FILTER (side = 'b') AS bv, min(price) FILTER (side = 's') AS ap, arg_min(volume, price) FILTER (side = 's') AS av
  FROM tk LEFT JOIN al ON al.ts <= tk.ts AND (al.until IS NULL OR al.until > tk.ts) GROUP BY tk.ts
), ch AS (SELECT * FROM sp QUALIFY row_number() OVER (ORDER BY ts) = 1 OR (bp, bv, ap, av) IS DISTINCT FROM lag((bp, bv, ap, av)) OVER (ORDER BY ts))
SELECT epoch_us(ts) AS ts_us, bp::DOUBLE AS best_bid_price, bv::DOUBLE AS best_bid_volume, ap::DOUBLE AS best_ask_price, av::DOUBLE AS best_ask_volume FROM ch WHERE ts >= {START} AND ts < {END}""",
    "depth_range_multi_era": f"""WITH {chain(eras=ERAS)}, {levels()}, nx AS (SELECT era, lead(era) OVER (ORDER BY era) AS n FROM (SELECT DISTINCT era FROM l3))
{CHANGES} (SELECT {START} AS ts, side, price, sum(amount) AS volume FROM l3 WHERE NOT deleted AND ts < {START} AND (next_ts IS NULL OR next_ts >= {START}) AND era = (SELECT max(era) FROM l3 WHERE era <= {START}) GROUP BY side, price
  UNION ALL SELECT ts, side, price, volume FROM chg WHERE ts >= {START} AND ts < {END}
  UNION ALL SELECT n - INTERVAL 1 MICROSECOND, side, price, 0 FROM lv JOIN nx USING (era) WHERE until IS NULL AND volume > 0 AND n > {START} AND n <= {END})""",
    "depth_at_emptied_era": "SELECT 'bid' AS side, 0.0::DOUBLE AS price, 0.0::DOUBLE AS volume FROM events WHERE false",
    "depth_window": f"WITH {chain()}, {levels()} {CHANGES} chg WHERE price BETWEEN 900 AND 1100 AND (volume BETWEEN 2 AND 20 OR volume = 0)",
    "match_sequential": f"""WITH {chain()}, {FILLS}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event) AS n FROM fills), pr AS (
  SELECT a.n, a.price, a.fill AS amount, a.event AS e1, a.order_id AS o1, a.fill AS f1, b.event AS e2, b.order_id AS o2, b.fill AS f2 FROM o a JOIN o b ON b.n = a.n + 1
), t AS (
  SELECT e1 AS trade, price, amount, CASE WHEN e1 % 2 = 0 THEN o1 ELSE o2 END AS bo, CASE WHEN e1 % 2 = 0 THEN o2 ELSE o1 END AS so FROM pr WHERE n % 2 = 0
), w AS (
  SELECT e1 AS be, o1 AS bo, f1 AS bf, e2 AS se, o2 AS so, f2 AS sf FROM pr UNION ALL SELECT e2, o2, f2, e1, o1, f1 FROM pr
), m AS (
  SELECT trade, be, se, CASE WHEN bf = amount THEN 0 WHEN abs(bf * price - amount * price) < 1e-4 THEN 1 END AS br, CASE WHEN sf = amount THEN 0 WHEN abs(sf * price - amount * price) < 1e-4 THEN 1 END AS sr FROM t JOIN w USING (bo, so)
), r AS (SELECT * FROM m WHERE br IS NOT NULL AND sr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade ORDER BY be, se) = 1)
SELECT trade, be AS buy_event, se AS sell_event, br AS buy_rule, sr AS sell_rule FROM r QUALIFY row_number() OVER (PARTITION BY be ORDER BY trade) = 1 AND row_number() OVER (PARTITION BY se ORDER BY trade) = 1""",
    "match_rules": f"""WITH {chain()}, x AS (
  SELECT seq, price, amount, coalesce(fill, amount) + CASE seq % 3 WHEN 0 THEN 0.00000001 WHEN 1 THEN 0 ELSE 1 END AS ta, CASE WHEN seq % 5 <> 0 THEN fill END AS f, CASE WHEN deleted THEN 'deleted' WHEN event_no = 1 THEN 'created' ELSE 'changed' END AS e FROM l3
)
SELECT seq, CASE WHEN f = ta THEN 0 WHEN abs(f * price - ta * price) < 1e-4 THEN 1 WHEN f IS NULL AND e = 'deleted' AND abs(amount - ta) < 1e-4 THEN 2 WHEN f IS NULL AND e = 'changed' THEN 3 END AS rule FROM x""",
    "remaining_fill": f"WITH {chain()}, {FILLS} SELECT event, fill::DOUBLE AS fill, (fill - CASE WHEN event % 2 = 0 THEN (fill / 4)::DECIMAL(18,8) + (fill / 2)::DECIMAL(18,8) ELSE 0 END)::DOUBLE AS \"left\" FROM fills",
    "coupling_candidates": f"""WITH {chain()}, {levels()}, dl AS (SELECT ts, side, price, volume - coalesce(lag(volume) OVER (PARTITION BY side, price ORDER BY ts), 0) AS delta FROM chg), t AS (
  SELECT seq AS trade, epoch_us(ts) - (seq % 4) * 400000 AS u, price, fill, side FROM l3 WHERE fill > 0
)
SELECT trade, count(*) FILTER (abs(epoch_us(dl.ts) - u) <= 1000000 AND -delta >= fill) AS candidates FROM t LEFT JOIN dl ON dl.side = t.side AND dl.price = t.price AND delta < 0 GROUP BY trade""",
    "monotone_times": f"WITH {chain()}, {SHAKEN} SELECT order_id, event_no, epoch_us(max(ts) OVER (PARTITION BY order_id ORDER BY event_no)) AS ts_us FROM sh",
    "aggressor_first": f"WITH {chain()}, {SHAKEN} SELECT order_id, event_no, epoch_us(min(ts) OVER (PARTITION BY order_id ORDER BY event_no DESC)) AS ts_us FROM sh",
    "times_in_order": f"""WITH RECURSIVE {chain()}, {SHAKEN}, nb AS (
  SELECT order_id, event_no, ts, coalesce(fill > 0, true) OR event_no = 1 AS can, row_number() OVER (PARTITION BY order_id ORDER BY event_no DESC) AS k FROM sh
), bk AS (
  SELECT order_id, event_no, k, ts FROM nb WHERE k = 1 UNION ALL SELECT nb.order_id, nb.event_no, nb.k, CASE WHEN can THEN least(nb.ts, bk.ts) ELSE nb.ts END FROM bk JOIN nb ON nb.order_id = bk.order_id AND nb.k = bk.k + 1
)
SELECT order_id, event_no, epoch_us(max(ts) OVER (PARTITION BY order_id ORDER BY event_no)) AS ts_us FROM bk""",
    "revealed_episodes": f"""WITH {chain()}, {SHAKEN}, m AS (SELECT a.seq AS x, b.seq AS y, greatest(a.price_ts, b.price_ts) AS t FROM sh a JOIN sh b ON b.seq = a.seq + 1 WHERE a.seq % 5 = 0)
SELECT seq AS event, epoch_us(coalesce((SELECT min(t) FROM m WHERE x = seq OR y = seq), ts)) AS ts_us FROM sh""",
    "synthetic_creations": f"""WITH {chain()}, ra AS (
  SELECT ts, seq::DECIMAL(21,1) AS seq, order_id, price, deleted, CASE WHEN deleted THEN 'deleted' WHEN seq % 4 = 0 THEN 'created' ELSE 'changed' END AS event, coalesce(lag(deleted) OVER (PARTITION BY order_id ORDER BY ts, seq), true) AS starts FROM raw
), un AS (
  SELECT ts, seq, order_id, price, deleted FROM ra UNION ALL SELECT ts, seq - 0.5, order_id, price, false FROM ra WHERE starts AND event <> 'created'
), sg AS (
  SELECT *, coalesce(sum(deleted::INT) OVER (PARTITION BY order_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM un
)
SELECT order_id, segment::BIGINT AS segment, (row_number() OVER w)::INT AS event_no, CASE WHEN deleted THEN 'deleted' WHEN lead(seq) OVER w IS NOT NULL THEN 'superseded' ELSE 'open' END AS status,
  (CASE WHEN deleted THEN lag(price) OVER w ELSE price END)::DOUBLE AS price, seq::DOUBLE AS seq FROM sg WINDOW w AS (PARTITION BY order_id, segment ORDER BY ts, seq)""",
    "transferred_chains": f"WITH {chain()} SELECT order_id, segment::BIGINT AS segment, event_no, epoch_us(ts) AS ts_us FROM l3 WHERE EXISTS (SELECT 1 FROM l3 d WHERE d.order_id = l3.order_id AND d.segment = l3.segment AND d.deleted AND d.ts <= {MIDDLE})",
    "deleted_events": f"""WITH {chain()}, g AS (SELECT order_id, segment, min(event_no) AS c FROM l3 WHERE seq % 97 = 0 GROUP BY ALL)
SELECT seq, order_id, event_no, CASE WHEN event_no = c - 1 THEN 'open' ELSE status END AS status, CASE WHEN event_no = c - 1 THEN NULL ELSE epoch_us(next_ts) END AS next_ts_us, CASE WHEN event_no = c - 1 THEN NULL ELSE next_event_no END AS next_event_no
FROM l3 LEFT JOIN g USING (order_id, segment) WHERE c IS NULL OR event_no < c""",
    "reconnected_chains": f"WITH {chain()} SELECT seq, status, epoch_us(next_ts) AS next_ts_us, next_event_no FROM l3 WHERE segment = 0",
    "duplicates_fixed": f"WITH {chain()} SELECT seq, order_id, event_no, status FROM l3 WHERE segment = 0 AND NOT (order_id % 3 = 0 AND event_no = 1 AND status = 'open')",
    "queues_log": QUEUE.replace("(ask - price) / 25", "(ln(ask) - ln(price)) / 0.01").replace("(price - bid) / 25", "(ln(price) - ln(bid)) / 0.01"),
    "rate_fit": f"""{PLACED}, rt AS (SELECT kind, ceil(distance::DOUBLE / 25 - 1e-9)::INT AS ticks, count(*) / (29 * 86400.0) AS rate FROM placed GROUP BY ALL)
SELECT kind, round(regr_slope(ln(rate), ln(ticks)), 6) AS slope, round(regr_intercept(ln(rate), ln(ticks)), 6) AS intercept FROM rt WHERE ticks > 0 GROUP BY kind""",
    "raw_book_eras": f"""WITH {chain()}, rw AS (
  SELECT ts, seq, order_id, CASE WHEN deleted THEN 0 ELSE price END AS price, CASE WHEN side = 'b' THEN amount ELSE -amount END AS amount, seq % 100 = 0 AS snap FROM raw WHERE ts >= {START} AND ts < {END}
), ep AS (
  SELECT ts, bool_or(snap) AS snap, lag(ts) OVER (ORDER BY ts) AS before FROM rw GROUP BY ts
), er AS (
  SELECT *, snap AND (before IS NULL OR epoch_us(ts) - epoch_us(before) > 180000000) AS opens FROM ep
), ee AS (
  SELECT ts, snap AND NOT opens AS goes_on, (SELECT max(x.ts) FROM er x WHERE x.opens AND x.ts <= er.ts) AS era FROM er
), rr AS (
  SELECT rw.*, ee.era, ee.goes_on FROM rw JOIN ee USING (ts) WHERE ee.era IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rw.ts, order_id ORDER BY seq DESC) = 1
), st AS (
  SELECT *, lag(price) OVER w AS lp, lag(amount) OVER w AS la, lead(ts) OVER w AS nt FROM rr WINDOW w AS (PARTITION BY era, order_id ORDER BY ts)
)
SELECT epoch_us(era) AS era_us, epoch_us(ts) AS ts_us, order_id, price::DOUBLE AS price, amount::DOUBLE AS amount FROM st WHERE NOT (goes_on AND snap AND coalesce(lp = price AND la = amount, false))
UNION ALL SELECT epoch_us(st.era), epoch_us(g.ts), order_id, 0, sign(amount)::DOUBLE FROM st JOIN (SELECT ts, era FROM ee WHERE goes_on) g ON g.era = st.era AND g.ts > st.ts AND (st.nt IS NULL OR g.ts < st.nt)
  WHERE price > 0 AND g.ts = (SELECT min(x.ts) FROM ee x WHERE x.goes_on AND x.era = st.era AND x.ts > st.ts)""",
    "book_arrays": f"""{standing(MIDDLE, crossed=True)} SELECT epoch_us((SELECT max(ts) FROM ob)) AS ts_us, (SELECT count(*) FROM ob)::INT AS n, (row_number() OVER (ORDER BY price, ts, order_id, event_no) - 1)::INT AS place,
  order_id, price::DOUBLE AS price, amount::DOUBLE AS amount FROM ob""",
    "tick_levels": f"""{standing(MIDDLE)} SELECT {side()} AS side, (CASE WHEN side = 'b' THEN floor(price / 25) ELSE ceil(price / 25) END * 25)::DOUBLE AS price, sum(amount)::DOUBLE AS volume FROM ob GROUP BY ALL""",
    "price_segments": "WITH e AS (" + effective("500.0") + """), g AS (SELECT *, (count(*) FILTER (bid_price IS NULL) OVER (ORDER BY ts_us))::BIGINT AS run FROM e)
SELECT ts_us, run, bid_price FROM g WHERE bid_price IS NOT NULL""",
    "order_flow_without_trades": f"""WITH {chain()}, {levels()}, dl AS (SELECT ts, side, price, volume - coalesce(lag(volume) OVER (PARTITION BY side, price ORDER BY ts), 0) AS delta FROM chg), tk AS (
  SELECT ts, side, price, sum(fill) AS took FROM l3 WHERE fill > 0 AND seq % 2 = 0 GROUP BY ALL
)
SELECT epoch_us(ts) AS ts_us, {side()} AS side, price::DOUBLE AS price, (delta + coalesce(took, 0))::DOUBLE AS delta FROM dl LEFT JOIN tk USING (ts, side, price) WHERE delta + coalesce(took, 0) <> 0""",
    "renumbered_chains": f"WITH {chain(eras=ERAS)} SELECT epoch_us(era) AS era_us, epoch_us(ts) AS ts_us, order_id, event_no, price::DOUBLE AS price, amount::DOUBLE AS amount, status, next_event_no FROM l3",
    "time_jumps": f"WITH {chain()}, {SHAKEN} SELECT seq, epoch_us(ts) AS ts_us FROM sh WHERE (seq % 5) * 10000000 - 10000000 NOT BETWEEN 0 AND 25000000",
    "event_times": f"WITH {chain()} SELECT seq, epoch_us(ts) - 946684800000000 AS since_2000, printf('%d.%02d', epoch_us(ts) // 1000, (epoch_us(ts) % 1000) // 10) AS milliseconds FROM l3",
}
