import random

import pytest
from pyspark.sql import functions as F

from fold import Fold, bars_of
from tickbars.functions.periods import PERIODS
from tickbars.operators import bars as B

BASE = 1_704_067_200_000  # a Monday, 00:00 UTC
TRADE = "symbol string, price double, quantity double, ts_ms bigint, is_buyer_maker boolean, seq bigint, arrival_ms bigint"
SEED = (
    "symbol string, period string, open_time bigint, open double, high double, low double, close double, volume double, "
    "turnover double, trade_count bigint, taker_buy_volume double, taker_buy_turnover double"
)


def tape(spark, rows):
    return spark.createDataFrame(rows, TRADE)


def random_rows(n, spread_ms, symbols=("A", "B", "HOT"), span_ms=3 * 86_400_000, seed=7):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(span_ms) for _ in range(n))
    rows = []
    for t in times:
        symbol = "HOT" if rnd.random() < 0.6 else rnd.choice(symbols)
        ts = BASE + t - (rnd.randrange(spread_ms) if spread_ms else 0)
        rows.append((symbol, round(rnd.uniform(1, 100), 2), float(rnd.randrange(1, 9)), ts, rnd.random() < 0.5, BASE + t))
    return [(s, p, q, ts, m, i, a) for i, (s, p, q, ts, m, a) in enumerate(rows)]


def folded(rows, periods, grace=None, seeds=()):
    f = Fold(periods)
    for s in seeds:
        f.seed(s[0], s[1], s[2], list(s[3:]))
    tick = None
    for s, p, q, ts, m, _, arrival in rows:
        if grace is not None:
            last = arrival - grace - (arrival - grace) % 60_000 + grace
            if tick is None:
                tick = last
            while tick < last:
                tick += 60_000
                f.heartbeat(tick)
        f.trade(s, p, q, ts, m)
    return f


SECONDS = {
    "in order": ([(1, 10, 1), (2, 12, 1), (3, 9, 1)], {0: (10, 12, 9, 9, 3, 3)}),
    "open by arrival": ([(30, 10, 1), (5, 8, 1)], {0: (10, 10, 8, 8, 2, 2)}),
    "roll by trade": ([(1, 10, 1), (61, 11, 1)], {0: (10, 10, 10, 10, 1, 1), 60: (11, 11, 11, 11, 1, 1)}),
    "gap": (
        [(1, 10, 1), (181, 11, 1)],
        {0: (10, 10, 10, 10, 1, 1), 60: (10, 10, 10, 10, 0, 0), 120: (10, 10, 10, 10, 0, 0), 180: (11, 11, 11, 11, 1, 1)},
    ),
}


@pytest.mark.parametrize("name", SECONDS)
def test_small_cases(spark, name):
    rows, expected = SECONDS[name]
    df = tape(spark, [("A", float(p), float(q), BASE + t * 1000, True, i, 0) for i, (t, p, q) in enumerate(rows)])
    got = B.build_bars(df, ("1m",), arrival_order=True, gaps=True).collect()
    assert {
        (r.open_time - BASE) // 1000: (r.open, r.high, r.low, r.close, r.volume, r.trade_count) for r in got
    } == expected
    assert sorted(r.open_time for r in got if not r.is_final) == [BASE + max(expected) * 1000]


def test_late_for_one_minute_counts_for_five(spark):
    rows = [("A", 10.0, 1.0, BASE + 1000, True, 0, 0), ("A", 11.0, 1.0, BASE + 61_000, True, 1, 0), ("A", 99.0, 1.0, BASE + 59_000, True, 2, 0)]
    got = {(r.period, r.open_time): r for r in B.build_bars(tape(spark, rows), ("1m", "5m"), arrival_order=True).collect()}
    assert got["1m", BASE].trade_count == 1
    five = got["5m", BASE]
    assert (five.open, five.high, five.low, five.close, five.trade_count) == (10, 99, 10, 99, 3)
    late = B.late_trades(tape(spark, rows), ("1m", "5m")).collect()
    assert [(r.seq, r.period) for r in late] == [(2, "1m")]


@pytest.mark.parametrize("spread", [0, 3_600_000])
@pytest.mark.parametrize("steps", [None, 0, 500_000])
def test_all_periods_equal_the_fold(spark, spread, steps):
    rows = random_rows(400, spread)
    periods = ("5m", "1h", "4h", "1d", "1w")
    f = folded(rows, periods)
    got = bars_of(B.build_bars(tape(spark, rows), periods, arrival_order=True, gaps=True, broadcast_steps=steps))
    assert got == f.result()
    late = B.late_trades(tape(spark, rows), periods, broadcast_steps=steps)
    assert late.count() == len(f.late)


def test_periods_that_do_not_divide_each_other(spark, monkeypatch):
    from tickbars.functions import periods as P
    import fold

    for p, ms in (("3m", 180_000),):
        monkeypatch.setitem(P.PERIOD_MS, p, ms)
        monkeypatch.setitem(fold.MS, p, ms)
    rows = random_rows(200, 600_000, span_ms=7_200_000)
    periods = ("3m", "5m")
    got = bars_of(B.build_bars(tape(spark, rows), periods, arrival_order=True, gaps=True))
    assert got == folded(rows, periods).result()


@pytest.mark.parametrize("steps", [None, 500_000])
def test_clock_equals_the_fold(spark, steps):
    rows = random_rows(300, 120_000, span_ms=6 * 3_600_000)
    periods = ("1m", "5m", "1h")
    df = tape(spark, rows)
    got = bars_of(
        B.build_bars(df, periods, clock_grace_ms=150, gaps=True, horizon_ms=B.clock_horizon(df, 150), broadcast_steps=steps)
    )
    assert got == folded(rows, periods, grace=150).result()


def test_seeds_equal_the_fold(spark):
    rows = random_rows(200, 0, span_ms=86_400_000)
    seeds = [
        ("A", "1h", BASE, 5.0, 6.0, 4.0, 5.0, 3.0, 15.0, 2, 1.0, 5.0),
        ("B", "1h", BASE, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0, 0.0, 0.0),
        ("HOT", "1h", BASE + 36_000_000, 7.0, 7.0, 7.0, 7.0, 1.0, 7.0, 1, 0.0, 0.0),
        ("IDLE", "1h", BASE, 9.0, 9.0, 9.0, 9.0, 1.0, 9.0, 1, 0.0, 0.0),
    ]
    got = bars_of(
        B.build_bars(tape(spark, rows), ("1h",), arrival_order=True, seeds=spark.createDataFrame(seeds, SEED), gaps=True)
    )
    assert got == folded(rows, ("1h",), seeds=seeds).result()


def test_event_time_bars_of_one_period_match_the_roll_up(spark):
    df = tape(spark, random_rows(300, 3_600_000))
    every = B.build_bars(df)
    for p in PERIODS:
        one = B.build_bars(df, (p,))
        drop = ("volume", "turnover", "taker_buy_volume", "taker_buy_turnover")
        a, b = (x.select(*(F.round(c, 6).alias(c) if c in drop else F.col(c) for c in x.columns)) for x in (one, every.filter(F.col("period") == p)))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_unknown_period_is_refused(spark):
    with pytest.raises(ValueError):
        B.build_bars(tape(spark, random_rows(1, 0)), ("1M",))


def test_no_join_or_window_multiplies_raw_rows(spark):
    """One shuffle of slices, one of bars; raw trades are aggregated before any shuffle."""
    plan = B.build_bars(tape(spark, random_rows(10, 0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_late_trades_are_found_without_shuffling_the_tape(spark):
    """The tape meets the limits in a broadcast join; what is shuffled is aggregated first."""
    rows = random_rows(300, 3_600_000)
    plan = B.build_bars(tape(spark, rows), arrival_order=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_stored_bars_as_seeds(spark):
    stored = spark.createDataFrame(
        [("A", "1h", BASE, "1.5", "2", "x", "1.7", "3", 5, "4", "1", "2")],
        "symbol string, period string, open_time bigint, open string, high string, low string, close string, volume string, "
        "number_of_trades bigint, quote_asset_volume string, taker_buy_base_asset_volume string, taker_buy_quote_asset_volume string",
    )
    r = B.seeds_from_stored(stored).first()
    assert (r.open, r.low, r.turnover, r.trade_count) == (1.5, 0.0, 4.0, 5)
