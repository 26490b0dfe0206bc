"""Time and price grids, labels and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
AMOUNT = "decimal(28,8)"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_to(ts: Column, seconds: float | None) -> Column:
    """The last instant of the grid that isn't after ts; None leaves ts alone."""
    if not seconds:
        return ts
    step = round(seconds * 1_000_000)
    x = F.unix_micros(ts)
    return F.timestamp_micros(x - F.pmod(x, F.lit(step)))


def ceil_to(ts: Column, seconds: float | None) -> Column:
    """The first instant of the grid that isn't before ts; None leaves ts alone."""
    if not seconds:
        return ts
    step = round(seconds * 1_000_000)
    x = F.unix_micros(ts)
    return F.timestamp_micros(x + F.pmod(-x, F.lit(step)))


def tick_floor(price: Column, tick) -> Column:
    return F.floor(price / F.lit(tick)).cast(PRICE) * F.lit(tick) if tick else price


def tick_ceil(price: Column, tick) -> Column:
    return F.ceil(price / F.lit(tick)).cast(PRICE) * F.lit(tick) if tick else price


def truncate(x: Column, digits: int) -> Column:
    """Drops the digits after ``digits`` decimals, towards zero."""
    scale = F.lit(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def shown_price(price: Column) -> Column:
    """A price as the kernels show it: five decimals."""
    return F.round(price, 5)


def shown_volume(volume: Column) -> Column:
    """A volume as the kernels show it: eight decimals."""
    return F.round(volume, 8)


def since_2000(ts: Column) -> Column:
    """Microseconds since 2000-01-01 UTC."""
    return F.unix_micros(ts) - F.lit(946_684_800_000_000)


def in_milliseconds(ts: Column) -> Column:
    """Milliseconds since 1970 as text, with two decimals (10 microseconds)."""
    return F.format_string("%d.%02d", F.expr("0L") + F.floor(F.unix_micros(ts) / 1000), F.floor(F.pmod(F.unix_micros(ts), F.lit(1000)) / 10))


def side_label(side: Column) -> Column:
    return F.when(side == "b", "bid").when(side == "s", "ask")


def direction_label(side: Column) -> Column:
    return F.when(side == "b", "buy").when(side == "s", "sell")


def event_id(ts: Column, order_id: Column, event_no: Column, exchange: Column, pair: Column) -> Column:
    """A UUID-shaped MD5 of the event's key, null if part of it is; the time is written as microseconds, so no time zone matters."""
    digest = F.md5(F.concat(F.unix_micros(ts).cast("string"), F.lit("#"), order_id.cast("string"), F.lit("#"), event_no.cast("string"), F.lit("#"), exchange, F.lit("#"), pair))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def match_rule(trade_amount: Column, trade_price: Column, event_amount: Column, event_fill: Column, event: Column, tolerance: float) -> Column:
    """How an order event can stand for a trade: 0 its fill, 1 a nearly equal fill, 2 a deletion of that amount, 3 an unknown fill's change."""
    near = lambda a, b: F.abs(a - b) < F.lit(tolerance)
    return (
        F.when(event_fill == trade_amount, F.lit(0))
        .when(event_fill.isNotNull() & near(event_fill * trade_price, trade_amount * trade_price), F.lit(1))
        .when(event_fill.isNull() & (event == "deleted") & near(event_amount, trade_amount), F.lit(2))
        .when(event_fill.isNull() & (event == "changed"), F.lit(3))
    )
