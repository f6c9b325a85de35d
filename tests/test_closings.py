"""What closes a bar, against a walk through arrivals and ticks."""

import pytest

from test_bars import random_rows, tape
from tickbars.functions.periods import MONDAY_SHIFT_MS, period_ms
from tickbars.operators import bars as B
from tickbars.operators import quality as Q

PERIODS = ("1m", "5m", "1h", "1w")


def start_of(ms, period):
    shift = MONDAY_SHIFT_MS if period == "1w" else 0
    return ms - (ms + shift) % period_ms(period)


def walked(rows, grace):
    """(symbol, period, open_time): (trigger, old state, new state) of each closing."""
    out, opened, since = {}, {}, {}

    def roll(symbol, period, start, trigger):
        at, real = opened[symbol, period]
        while at < start:
            end = at + period_ms(period)
            new = "real" if trigger == "Trade" and end == start else "flat"
            out[symbol, period, at] = (trigger, "real" if real else "flat", new)
            at, real = end, False
        opened[symbol, period] = (start, trigger == "Trade")

    def tick(ms):
        for symbol, period in list(opened):
            if ms > since[symbol] and start_of(ms, period) > opened[symbol, period][0]:
                roll(symbol, period, start_of(ms, period), "Clock")

    rows = sorted(rows, key=lambda r: r[5])
    ticks = range(rows[0][6] // 60_000 * 60_000 + grace, rows[-1][6] + 1, 60_000)
    events = sorted([(t, 0, None) for t in ticks] + [(r[6], 1, r) for r in rows], key=lambda e: (e[0], e[1], e[2][5] if e[2] else 0))
    for ms, _, row in events:
        if row is None:
            tick(ms)
            continue
        symbol = row[0]
        since.setdefault(symbol, ms)
        for period in PERIODS:
            start = start_of(row[3], period)
            if (symbol, period) not in opened:
                opened[symbol, period] = (start, True)
            elif start > opened[symbol, period][0]:
                roll(symbol, period, start, "Trade")
            elif start == opened[symbol, period][0]:
                opened[symbol, period] = (start, True)
    return out


@pytest.mark.parametrize("delay, grace", [(120_000, 150), (400_000, 150), (10, 30_000)])
def test_causes(spark, delay, grace):
    rows = random_rows(300, delay, span_ms=4 * 3_600_000)
    trades = tape(spark, rows)
    bars = B.build_bars(trades, PERIODS, clock_grace_ms=grace, gaps=True, horizon_ms=B.clock_horizon(trades, grace))
    found = {(r.symbol, r.period, r.open_time): (r.trigger, r.old_state, r.new_state) for r in Q.closings(trades, bars, grace, PERIODS).collect()}
    want = walked(rows, grace)
    assert found == want
    if grace > 1_000:  # a longer wait lets trades close bars too
        assert {t for t, _, _ in want.values()} == {"Trade", "Clock"}
