"""Time arithmetic on epoch milliseconds (UTC) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickbars.functions.periods import (
    CONTINUITY_MS,
    DAY_MS,
    FRESHNESS_DEFAULT_MINUTES,
    FRESHNESS_MINUTES,
    HISTORY_DEFAULT_DEPTH_MS,
    HISTORY_DEPTH_MS,
    HISTORY_GENESIS_MS,
    HOUR_MS,
    MINUTE_MS,
    MONDAY_SHIFT_MS,
    PERIOD_MS,
    PERIODS,
    WEEK_MS,
    period_ms,
)


def _lookup(key: Column, table: dict, default) -> Column:
    """CASE over a small constant table."""
    expr = None
    for k, v in table.items():
        cond, value = key == k, F.lit(v)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(default))


def floor_ms(ts: Column, step: int, shift: int = 0) -> Column:
    """Start of the step holding ``ts``; steps begin at ``-shift`` from the epoch."""
    return ts - F.pmod(ts + F.lit(shift), F.lit(step).cast("bigint"))


def bar_open(ts: Column, period: str) -> Column:
    """Start of the bar of ``period`` that holds ``ts``; weeks begin on Monday."""
    return floor_ms(ts, period_ms(period), MONDAY_SHIFT_MS if period == "1w" else 0)


def bar_open_by(ts: Column, period: Column) -> Column:
    """As :func:`bar_open` for a period held in a column; null if unsupported."""
    shift = F.when(period == "1w", F.lit(MONDAY_SHIFT_MS)).otherwise(F.lit(0)).cast("bigint")
    return ts - F.pmod(ts + shift, ms_of(period))


def ms_of(period: Column) -> Column:
    """Length of a supported period held in a column; null if unsupported."""
    return _lookup(period, PERIOD_MS, None).cast("bigint")


def ordinal_of(period: Column, periods: tuple[str, ...] = PERIODS) -> Column:
    """Position of a period in the configured list; null if absent."""
    return _lookup(period, {p: i for i, p in enumerate(periods)}, None)


def period_at(ordinal: Column, periods: tuple[str, ...] = PERIODS) -> Column:
    """Period at a position of the configured list; null when out of range."""
    return F.try_element_at(F.array(*(F.lit(p) for p in periods)), ordinal.cast("int") + 1)


def interval_to_ms(interval: Column) -> Column:
    """Lenient interval length: unknown units count as minutes, a bad number as one."""
    unit = F.right(interval, F.lit(1))
    number = F.coalesce(F.left(interval, F.length(interval) - 1).try_cast("bigint"), F.lit(1))
    return number * _lookup(unit, {"m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS, "w": WEEK_MS}, MINUTE_MS)


def align(ts: Column, interval: Column) -> Column:
    """Align to an interval: minutes and hours by multiple, ``1d`` to midnight, ``1w`` to
    Monday; every other interval leaves the value as it is."""
    unit = F.right(interval, F.lit(1))
    return (
        F.when(unit.isin("m", "h"), ts - F.pmod(ts, interval_to_ms(interval)))
        .when(interval == "1d", floor_ms(ts, DAY_MS))
        .when(interval == "1w", floor_ms(ts, WEEK_MS, MONDAY_SHIFT_MS))
        .otherwise(ts)
    )


def close_time(open_time: Column, period: Column) -> Column:
    """Last millisecond that belongs to a bar."""
    return open_time + ms_of(period) - 1


def safe_end(now_ms: Column) -> Column:
    """Start of the minute before the running one; audits look no further."""
    return floor_ms(now_ms, MINUTE_MS) - MINUTE_MS


def next_minute(now_ms: Column) -> Column:
    return floor_ms(now_ms, MINUTE_MS) + MINUTE_MS


def clock_grace_ms(avg_delay_ms: Column) -> Column:
    """Wait after a minute boundary before the clock ticks."""
    return F.greatest(avg_delay_ms * 2 + 100, F.lit(100))


def next_tick_ms(now_ms: Column, avg_delay_ms: Column) -> Column:
    return next_minute(now_ms) + clock_grace_ms(avg_delay_ms)


def best_request_ms(now_ms: Column, skew_ms: Column, delay_ms: Column, margin_ms: int = 30) -> Column:
    """When to send a request so that it reaches the server at the next minute."""
    return next_minute(now_ms) - skew_ms - delay_ms - F.lit(margin_ms)


def ms_to_text(ts: Column, millis: bool = False) -> Column:
    """UTC text of an epoch-ms value (session time zone must be UTC)."""
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss")


def date_to_ms(day: Column) -> Column:
    """Midnight UTC of a ``YYYY-MM-DD`` text; null if it is no date."""
    return F.unix_millis(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def ntz_to_ms(ts: Column) -> Column:
    """Epoch ms of a timestamp without zone read as UTC (session time zone must be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def continuity_ms(period: Column) -> Column:
    """Expected spacing for the continuity check; unknown periods count as a minute."""
    return _lookup(period, CONTINUITY_MS, MINUTE_MS).cast("bigint")


def freshness_minutes(period: Column) -> Column:
    return _lookup(period, FRESHNESS_MINUTES, FRESHNESS_DEFAULT_MINUTES)


def history_start(now_ms: Column, period: Column, genesis: bool = True) -> Column:
    """Where a first download starts: a fixed day for 1d and 1w, a depth before now for the
    rest. ``genesis=False`` uses the depth for every period."""
    by_depth = now_ms - _lookup(period, HISTORY_DEPTH_MS, HISTORY_DEFAULT_DEPTH_MS).cast("bigint")
    if not genesis:
        return by_depth
    return F.when(period.isin("1d", "1w"), F.lit(HISTORY_GENESIS_MS)).otherwise(by_depth)
