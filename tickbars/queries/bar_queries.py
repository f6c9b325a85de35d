"""Registered bar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickbars.functions.periods import PERIODS
from tickbars.operators import bars as B
from tickbars.queries import inputs as I
from tickbars.sinks import store as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

_KEEP = "symbol, period, open_time, open, high, low, close, volume, turnover, trade_count, taker_buy_volume, taker_buy_turnover"


def _one_period(p: str):
    def run(spark, sf_dir):
        return I.rounded(B.build_bars(I.trades(spark, sf_dir), (p,)))

    return run


for _p in PERIODS:
    QUERIES[f"bars_{_p}"] = _one_period(_p)
    SQL[f"bars_{_p}"] = I.sql_rounded(f"SELECT * FROM ({I.sql_bars()}) WHERE period = '{_p}'")


def bars_all_periods(spark, sf_dir):
    return I.rounded(B.build_bars(I.trades(spark, sf_dir)))


SQL["bars_all_periods"] = I.sql_rounded(I.sql_bars())

# Gap filling in SQL: flat bars between consecutive bars, up to `last` of each row.
_FILL = """
WITH bars AS ({bars}),
spread AS (
  SELECT *, lead(open_time) OVER (PARTITION BY symbol, period ORDER BY open_time) AS nxt
  FROM bars JOIN (SELECT period, ms, shift FROM {periods}) USING (period)),
ends AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN nxt - ms ELSE greatest(open_time, {horizon}) END AS last FROM spread),
starts AS (SELECT *, unnest(range(open_time, last + 1, ms)) AS start FROM ends)
SELECT symbol, period, start AS open_time,
  CASE WHEN start = open_time THEN open ELSE close END AS open,
  CASE WHEN start = open_time THEN high ELSE close END AS high,
  CASE WHEN start = open_time THEN low ELSE close END AS low, close,
  CASE WHEN start = open_time THEN volume ELSE 0 END AS volume,
  CASE WHEN start = open_time THEN turnover ELSE 0 END AS turnover,
  CASE WHEN start = open_time THEN trade_count ELSE 0 END AS trade_count,
  CASE WHEN start = open_time THEN taker_buy_volume ELSE 0 END AS taker_buy_volume,
  CASE WHEN start = open_time THEN taker_buy_turnover ELSE 0 END AS taker_buy_turnover,
  (nxt IS NOT NULL OR start < last) AS is_final
FROM starts"""


def sql_fill(bars: str, horizon: str = "open_time") -> str:
    return _FILL.format(bars=bars, periods=I.PERIOD_ROWS, horizon=horizon)


def bars_gapfilled(spark, sf_dir):
    return I.rounded(B.build_bars(I.trades(spark, sf_dir), gaps=True))


SQL["bars_gapfilled"] = I.sql_rounded(sql_fill(I.sql_bars()))


def bars_final_flag(spark, sf_dir):
    return I.rounded(B.mark_final(B.build_bars(I.trades(spark, sf_dir))))


SQL["bars_final_flag"] = I.sql_rounded(
    f"SELECT *, open_time < max(open_time) OVER (PARTITION BY symbol, period) AS is_final FROM ({I.sql_bars()})"
)


def taker_flow(spark, sf_dir):
    """Share of bought volume per hour."""
    bars = B.build_bars(I.trades(spark, sf_dir), ("1h",))
    return bars.select(
        "symbol",
        "open_time",
        F.round("taker_buy_volume", 4).alias("taker_buy_volume"),
        F.round("taker_buy_turnover", 4).alias("taker_buy_turnover"),
        F.round(F.col("volume") - F.col("taker_buy_volume"), 4).alias("taker_sell_volume"),
        B.direction().alias("direction"),
    )


SQL["taker_flow"] = f"""SELECT symbol, open_time, round(taker_buy_volume, 4) AS taker_buy_volume,
  round(taker_buy_turnover, 4) AS taker_buy_turnover,
  round(volume - taker_buy_volume, 4) AS taker_sell_volume,
  CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction
FROM ({I.sql_bars()}) WHERE period = '1h'"""

# Arrival order: the running maximum per symbol and period decides lateness.
_EXACT = """SELECT symbol, period, b AS open_time, late, price, quantity, is_buyer_maker, seq FROM (
  SELECT *, coalesce(b < max(b) OVER (PARTITION BY symbol, period ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late
  FROM (SELECT *, {floor} AS b FROM ({trades}) CROSS JOIN {periods}))"""
_EXACT_SCATTERED = _EXACT.format(floor=I.sql_floor("ts_ms"), trades=I.SCATTERED, periods=I.PERIOD_ROWS)
_BARS_EXACT = f"""SELECT symbol, period, open_time, {I.SQL_OHLCV} FROM ({_EXACT_SCATTERED})
  WHERE NOT late GROUP BY ALL"""


def bars_late_dropped(spark, sf_dir):
    return I.rounded(B.build_bars(I.scattered_trades(spark, sf_dir), arrival_order=True))


SQL["bars_late_dropped"] = I.sql_rounded(_BARS_EXACT)


def bars_exact_gapfilled(spark, sf_dir):
    return I.rounded(B.build_bars(I.scattered_trades(spark, sf_dir), arrival_order=True, gaps=True))


SQL["bars_exact_gapfilled"] = I.sql_rounded(sql_fill(_BARS_EXACT))


def late_trade_counts(spark, sf_dir):
    late = B.late_trades(I.scattered_trades(spark, sf_dir))
    return late.groupBy("symbol", "period").agg(
        F.count("*").alias("late_trades"), F.round(F.sum("quantity"), 4).alias("late_volume")
    )


SQL["late_trade_counts"] = f"""SELECT symbol, period, count(*) AS late_trades, round(sum(quantity), 4) AS late_volume
FROM ({_EXACT_SCATTERED}) WHERE late GROUP BY ALL"""

# The minute clock: the last tick before an arrival closes ended bars too.
_G = I.CLOCK_GRACE_MS
_TICK = f"(arrival_ms - {_G}) - (arrival_ms - {_G}) % 60000 + {_G}"
_CLOCKED = f"""SELECT symbol, period, b AS open_time, b < greatest(
    coalesce(max(b) OVER before, b),
    CASE WHEN tick > min(arrival_ms) OVER before THEN {I.sql_floor('tick')} ELSE b END) AS late,
  price, quantity, is_buyer_maker, seq
FROM (SELECT *, {I.sql_floor('ts_ms')} AS b, {_TICK} AS tick FROM ({I.DELAYED}) CROSS JOIN {I.PERIOD_ROWS})
WINDOW before AS (PARTITION BY symbol, period ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_HORIZON = f"(SELECT {_TICK} FROM (SELECT max(arrival_ms) AS arrival_ms FROM ({I.DELAYED})))"


def bars_with_clock(spark, sf_dir):
    """All rules together: late trades, clock ticks, flat bars up to the last tick."""
    tape = I.delayed_trades(spark, sf_dir)
    return I.rounded(
        B.build_bars(
            tape,
            clock_grace_ms=I.CLOCK_GRACE_MS,
            gaps=True,
            horizon_ms=B.clock_horizon(tape, I.CLOCK_GRACE_MS),
        )
    )


SQL["bars_with_clock"] = I.sql_rounded(
    sql_fill(
        f"SELECT symbol, period, open_time, {I.SQL_OHLCV} FROM ({_CLOCKED}) WHERE NOT late GROUP BY ALL",
        I.sql_floor(_HORIZON),
    )
)

# Seeds: bars are cut in two at the middle of the history and joined up again.
_CUT = "(SELECT (min(epoch_us(ts) // 1000) + max(epoch_us(ts) // 1000)) // 2 FROM events)"


def _halves(spark, sf_dir):
    tape = I.trades(spark, sf_dir)
    cut = tape.select(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("c")).scalar()
    return tape.filter(F.col("ts_ms") < cut), tape.filter(F.col("ts_ms") >= cut)


def _latest(bars):
    return S.latest_per_series(bars)


def bars_seeded(spark, sf_dir):
    """Second half of the tape on top of the bars open at the cut; seeds with trades extend,
    provisional seeds (here those of ``click``) are replaced by the first trade."""
    first, second = _halves(spark, sf_dir)
    seeds = _latest(B.build_bars(first))
    blank = F.col("symbol") == "click"
    seeds = seeds.select(
        *B.BAR_KEY,
        *(F.when(blank, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")),
        "close",
        *(F.when(blank, F.lit(0)).otherwise(F.col(c)).cast("bigint" if c == "trade_count" else "double").alias(c) for c in B.SUMS),
    )
    return I.rounded(B.build_bars(second, arrival_order=True, seeds=seeds, gaps=True))


_SEEDED = f"""
WITH tape AS ({I.TRADES}),
first AS ({I.sql_bars(f'SELECT * FROM tape WHERE ts_ms < {_CUT}')}),
second AS ({I.sql_bars(f'SELECT * FROM tape WHERE ts_ms >= {_CUT}')}),
latest AS (SELECT * FROM first QUALIFY open_time = max(open_time) OVER (PARTITION BY symbol, period)),
seeds AS (SELECT * REPLACE (
   CASE WHEN symbol = 'click' THEN close ELSE open END AS open,
   CASE WHEN symbol = 'click' THEN close ELSE high END AS high,
   CASE WHEN symbol = 'click' THEN close ELSE low END AS low,
   CASE WHEN symbol = 'click' THEN 0 ELSE volume END AS volume,
   CASE WHEN symbol = 'click' THEN 0 ELSE turnover END AS turnover,
   CASE WHEN symbol = 'click' THEN 0 ELSE trade_count END AS trade_count,
   CASE WHEN symbol = 'click' THEN 0 ELSE taker_buy_volume END AS taker_buy_volume,
   CASE WHEN symbol = 'click' THEN 0 ELSE taker_buy_turnover END AS taker_buy_turnover) FROM latest)
SELECT symbol, period, open_time,
  CASE WHEN b.open IS NULL THEN s.open WHEN s.trade_count > 0 THEN s.open ELSE b.open END AS open,
  CASE WHEN b.open IS NULL THEN s.high WHEN s.trade_count > 0 THEN greatest(s.high, b.high) ELSE b.high END AS high,
  CASE WHEN b.open IS NULL THEN s.low WHEN s.trade_count > 0 THEN least(s.low, b.low) ELSE b.low END AS low,
  coalesce(b.close, s.close) AS close,
  coalesce(b.volume, 0) + coalesce(s.volume, 0) AS volume,
  coalesce(b.turnover, 0) + coalesce(s.turnover, 0) AS turnover,
  coalesce(b.trade_count, 0) + coalesce(s.trade_count, 0) AS trade_count,
  coalesce(b.taker_buy_volume, 0) + coalesce(s.taker_buy_volume, 0) AS taker_buy_volume,
  coalesce(b.taker_buy_turnover, 0) + coalesce(s.taker_buy_turnover, 0) AS taker_buy_turnover
FROM second b FULL OUTER JOIN seeds s USING (symbol, period, open_time)"""
SQL["bars_seeded"] = I.sql_rounded(sql_fill(_SEEDED))


def missing_seeds(spark, sf_dir):
    """Symbols x periods without a stored bar to start from (seeds exist where events do)."""
    seeds = _latest(B.build_bars(I.trades(spark, sf_dir), ("1h", "1d")))
    wanted = seeds.select("symbol").distinct().select(
        "symbol", F.explode(F.array(*(F.lit(p) for p in PERIODS))).alias("period")
    )
    return B.missing_seeds(wanted, seeds)


SQL["missing_seeds"] = f"""SELECT symbol, period FROM (SELECT DISTINCT event_type AS symbol FROM events)
CROSS JOIN {I.PERIOD_ROWS} WHERE period NOT IN ('1h', '1d')"""

for _f in (
    bars_all_periods,
    bars_gapfilled,
    bars_final_flag,
    taker_flow,
    bars_late_dropped,
    bars_exact_gapfilled,
    late_trade_counts,
    bars_with_clock,
    bars_seeded,
    missing_seeds,
):
    QUERIES[_f.__name__] = _f
