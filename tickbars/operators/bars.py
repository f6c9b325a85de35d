"""OHLCV bars from trades, for all periods at once.

Rules: a trade belongs to the bar that holds its time; within a bar, open and close follow
arrival order (``seq``), not trade time. A trade whose bar starts before the bar that is
open on its arrival is dropped for that period only. Bars without trades are flat at the
last close. A bar is final once a later bar of its key exists.

Every raw trade is hashed once, into a *slice*: one row per (symbol, base step, accept
mask), where the mask has a bit for each period that accepts the trade. Slices carry the
arrival positions of their first and last trade, so bars of every period are an exact
roll-up of the slices whose bit is set. Raw rows are never multiplied by the number of
periods, and a hot symbol is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.functions.periods import MINUTE_MS, PERIODS, base_ms, period_ms
from tickbars.functions.timefns import bar_open, floor_ms
from tickbars.operators.sizing import SMALL_ROWS, counted_side

SUMS = ("volume", "turnover", "trade_count", "taker_buy_volume", "taker_buy_turnover")
BAR_VALUES = ("open", "high", "low", "close", *SUMS)
BAR_KEY = ("symbol", "period", "open_time")


def ohlcv() -> list[Column]:
    price, quantity = F.col("price"), F.col("quantity")
    taken = ~F.col("is_buyer_maker")
    return [
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(price * quantity).alias("turnover"),
        F.count("*").alias("trade_count"),
        F.sum(F.when(taken, quantity).otherwise(F.lit(0.0))).alias("taker_buy_volume"),
        F.sum(F.when(taken, price * quantity).otherwise(F.lit(0.0))).alias("taker_buy_turnover"),
    ]


def single_period_bars(trades: DataFrame, period: str) -> DataFrame:
    """Bars of one period when no trade is late: one aggregate, one shuffle."""
    return (
        trades.groupBy("symbol", bar_open(F.col("ts_ms"), period).alias("open_time"))
        .agg(*ohlcv())
        .select("symbol", F.lit(period).alias("period"), "open_time", *BAR_VALUES)
    )


# --- lateness -----------------------------------------------------------------------------
#
# A trade is late for a period if, before it, a trade of a later bar arrived. With
# ``first_seq`` the first arrival of each later bar, that is ``seq > min(first_seq)``: one
# limit per (symbol, step, period) decides, and the trades need not be put in order. The
# limits come from a narrow aggregate; only steps that do hold late trades are kept, so in a
# feed that is nearly in order the table of limits is small and raw trades are not shuffled.

_NEVER = (1 << 63) - 1


def last_tick(arrival_ms: Column, grace_ms: int) -> Column:
    """Time of the last clock tick not after ``arrival_ms``."""
    return floor_ms(arrival_ms - grace_ms, MINUTE_MS) + grace_ms


def late_limits(
    trades: DataFrame,
    periods: tuple[str, ...] = PERIODS,
    *,
    clock_grace_ms: int | None = None,
    seeded: DataFrame | None = None,
) -> DataFrame:
    """Steps that hold late trades: ``symbol, step_ms`` and, per period *i*, ``limit_i``, the
    arrival position after which trades of the step are late.

    With ``clock_grace_ms`` a clock ticks at every full minute plus the grace, on the scale
    of the ``arrival_ms`` column (which must not fall as ``seq`` grows). A tick closes ended
    bars once the symbol has traded (``ticks_after``), or at once for symbols in ``seeded``.
    The last tick before a trade follows from its arrival, so no heartbeat rows are needed.

    The windows see one row per symbol and step, so their size depends on the length of
    history and not on how busy a symbol is.
    """
    clock = clock_grace_ms is not None
    extent = [F.min("seq").alias("_first"), F.max("seq").alias("_last")]
    if clock:
        extent += [F.min("arrival_ms").alias("_first_arrival"), F.max("arrival_ms").alias("_last_arrival")]
    steps = trades.groupBy("symbol", floor_ms(F.col("ts_ms"), base_ms(periods)).alias("step_ms")).agg(*extent)

    # all windows go back in time over the same order, so one sort serves them
    back = Window.partitionBy("symbol").orderBy(F.col("step_ms").desc())
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.select(
        "*",
        F.coalesce(F.min("_first").over(later), F.lit(_NEVER)).alias("_limit"),
        F.lag("step_ms").over(back).alias("_later_step"),
    )
    step, next_step = F.col("step_ms"), F.col("_later_step")

    def limit(p: str) -> Column:
        """What was known at the end of the bar: the limit of its last step."""
        ends = next_step.isNull() | (bar_open(next_step, p) != bar_open(step, p))
        return F.last(F.when(ends, F.col("_limit")), ignorenulls=True).over(upto)

    limits = [limit(p).alias(f"limit_{i}") for i, p in enumerate(periods)]
    late = F.lit(False)
    for i in range(len(periods)):
        late = late | (F.col("_last") > F.col(f"limit_{i}"))
    if clock:
        since = F.min("_first_arrival").over(Window.partitionBy("symbol"))
        limits.append(since.alias("ticks_after"))
    steps = steps.select("*", *limits)
    kept = ["symbol", "step_ms", *(f"limit_{i}" for i in range(len(periods)))]
    if clock:
        kept.append("ticks_after")
        if seeded is not None:
            marks = seeded.select("symbol", F.lit(True).alias("_seeded")).distinct()
            steps = steps.join(marks, "symbol", "left").withColumn(
                "ticks_after", F.when(F.col("_seeded"), F.lit(-_NEVER)).otherwise(F.col("ticks_after"))
            )
        tick = last_tick(F.col("_last_arrival"), clock_grace_ms)
        for p in periods:
            late = late | ((tick > F.col("ticks_after")) & (bar_open(tick, p) > bar_open(step, p)))
    return steps.filter(late).select(*kept)


def _late_for(i: int, period: str, clock_grace_ms: int | None) -> Column:
    """Whether a trade joined with the limits of its step is late for a period."""
    late = F.col("seq") > F.col(f"limit_{i}")
    if clock_grace_ms is not None:
        tick = last_tick(F.col("arrival_ms"), clock_grace_ms)
        late = late | (
            (tick > F.col("ticks_after")) & (bar_open(tick, period) > bar_open(F.col("ts_ms"), period))
        )
    return late


def with_accept_mask(
    trades: DataFrame,
    periods: tuple[str, ...] = PERIODS,
    *,
    clock_grace_ms: int | None = None,
    seeded: DataFrame | None = None,
    broadcast_steps: int | None = SMALL_ROWS,
) -> DataFrame:
    """Add ``accept_mask``: bit *i* is set when period *i* accepts the trade."""
    everyone = F.lit((1 << len(periods)) - 1)
    limits = counted_side(late_limits(trades, periods, clock_grace_ms=clock_grace_ms, seeded=seeded), broadcast_steps)
    if limits is None:
        return trades.withColumn("accept_mask", everyone)
    mask = F.lit(0)
    for i, p in enumerate(periods):
        mask = mask + F.when(_late_for(i, p, clock_grace_ms), F.lit(0)).otherwise(F.lit(1 << i))
    return (
        trades.withColumn("step_ms", floor_ms(F.col("ts_ms"), base_ms(periods)))
        .join(limits, ["symbol", "step_ms"], "left")
        .select(
            *(F.col(c) for c in trades.columns),
            F.when(F.col("limit_0").isNull(), everyone).otherwise(mask).alias("accept_mask"),
        )
    )


def late_trades(
    trades: DataFrame,
    periods: tuple[str, ...] = PERIODS,
    *,
    clock_grace_ms: int | None = None,
    seeded: DataFrame | None = None,
    broadcast_steps: int | None = SMALL_ROWS,
) -> DataFrame:
    """Side output: one row per trade and period that dropped it."""
    limits = late_limits(trades, periods, clock_grace_ms=clock_grace_ms, seeded=seeded)
    sized = counted_side(limits, broadcast_steps)
    dropped = F.array_compact(
        F.array(
            *(
                F.when(
                    _late_for(i, p, clock_grace_ms),
                    F.struct(F.lit(p).alias("period"), bar_open(F.col("ts_ms"), p).alias("open_time")),
                )
                for i, p in enumerate(periods)
            )
        )
    )
    return (
        trades.withColumn("step_ms", floor_ms(F.col("ts_ms"), base_ms(periods)))
        .join(limits.limit(0) if sized is None else sized, ["symbol", "step_ms"])
        .select(*(F.col(c) for c in trades.columns), F.inline(dropped))
    )


# --- slices and roll-up -------------------------------------------------------------------


def slices(masked: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """One row per (symbol, base step, accept mask) with its first and last arrival.

    Without an ``accept_mask`` column every period accepts every trade.
    """
    if "accept_mask" not in masked.columns:
        masked = masked.withColumn("accept_mask", F.lit((1 << len(periods)) - 1))
    return masked.groupBy(
        "symbol", floor_ms(F.col("ts_ms"), base_ms(periods)).alias("step_ms"), "accept_mask"
    ).agg(*ohlcv(), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _targets(periods: tuple[str, ...]) -> Column:
    """Bars a slice goes into, as an array of (period, open_time)."""
    return F.filter(
        F.array(
            *(
                F.struct(
                    F.lit(p).alias("period"),
                    bar_open(F.col("step_ms"), p).alias("open_time"),
                    (F.col("accept_mask").bitwiseAND(1 << i) != 0).alias("_in"),
                )
                for i, p in enumerate(periods)
            )
        ),
        lambda t: t["_in"],
    )


def roll_up(sliced: DataFrame, periods: tuple[str, ...] = PERIODS, seeds: DataFrame | None = None) -> DataFrame:
    """Bars of every period from slices, on top of ``seeds`` if given.

    A seed is the bar that was open before the first trade. Bars older than the seed of
    their key are dropped. Trades of the seed's own bar extend it if it holds trades, and
    replace it if it is provisional (``trade_count = 0``).
    """
    parts = sliced.select(
        "symbol", F.inline(_targets(periods)), "first_seq", "last_seq", *BAR_VALUES
    ).drop("_in")
    if seeds is not None:
        start = seeds.select("symbol", "period", F.col("open_time").alias("_seed_open"))
        parts = (
            parts.join(start, ["symbol", "period"], "left")
            .filter(F.col("_seed_open").isNull() | (F.col("open_time") >= F.col("_seed_open")))
            .drop("_seed_open")
            .unionByName(
                seeds.select(
                    *BAR_KEY,
                    F.lit(-1).cast("bigint").alias("first_seq"),
                    F.lit(-1).cast("bigint").alias("last_seq"),
                    *BAR_VALUES,
                )
            )
        )
        real = F.col("trade_count") > 0
    else:
        real = F.lit(True)

    def kept(c: str) -> Column:
        return F.col(c) if seeds is None else F.when(real, F.col(c))

    def flat(agg: Column, c: str) -> Column:
        # only a provisional seed without any trade leaves the aggregate null
        return agg if seeds is None else F.coalesce(agg, F.max(c))

    return (
        parts.groupBy(*BAR_KEY)
        .agg(
            flat(F.min_by("open", kept("first_seq")), "open").alias("open"),
            flat(F.max(kept("high")), "high").alias("high"),
            flat(F.min(kept("low")), "low").alias("low"),
            flat(F.max_by("close", kept("last_seq")), "close").alias("close"),
            *(flat(F.sum(kept(c)), c).alias(c) for c in SUMS),
        )
        .select(*BAR_KEY, *BAR_VALUES)
    )


# --- gaps and finality --------------------------------------------------------------------


def _by_period(periods: tuple[str, ...], value) -> Column:
    expr = None
    for p in periods:
        cond = F.col("period") == p
        expr = F.when(cond, value(p)) if expr is None else expr.when(cond, value(p))
    return expr


def fill_gaps(bars: DataFrame, periods: tuple[str, ...] = PERIODS, horizon_ms: Column | None = None) -> DataFrame:
    """Add flat bars between the bars of a key and mark ``is_final``.

    ``horizon_ms`` is the time of the last clock tick: keys are then filled up to the bar
    that holds it. The window runs over finished bars, whose number per key depends on the
    length of history and not on how busy the symbol is.
    """
    step = _by_period(periods, lambda p: F.lit(period_ms(p)).cast("bigint"))
    key = Window.partitionBy("symbol", "period").orderBy("open_time")
    last = F.col("open_time")
    if horizon_ms is not None:
        last = F.greatest(last, _by_period(periods, lambda p: bar_open(horizon_ms, p)))
    spread = bars.select("*", step.alias("_ms"), F.lead("open_time").over(key).alias("_next")).select(
        "*",
        # last start this row accounts for: just before the next bar, or the horizon
        F.coalesce(F.col("_next") - F.col("_ms"), last).alias("_last"),
    )
    starts = F.when(
        F.col("_last") > F.col("open_time"), F.sequence("open_time", "_last", "_ms")
    ).otherwise(F.array("open_time"))
    flat = F.col("_pos") > 0
    rows = spread.select(
        "symbol", "period", "_next", "_last", F.posexplode(starts).alias("_pos", "_start"), *BAR_VALUES
    )
    return rows.select(
        "symbol",
        "period",
        F.col("_start").alias("open_time"),
        *(F.when(flat, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")),
        "close",
        *(
            F.when(flat, F.lit(0).cast("bigint" if c == "trade_count" else "double")).otherwise(F.col(c)).alias(c)
            for c in SUMS
        ),
        (F.col("_next").isNotNull() | (F.col("_start") < F.col("_last"))).alias("is_final"),
    )


def direction() -> Column:
    """Whether a bar closed at or above its open."""
    return F.when(F.col("close") >= F.col("open"), "up").otherwise("down")


def mark_final(bars: DataFrame) -> DataFrame:
    """``is_final`` without filling gaps: a later bar of the key exists."""
    later = F.lead("open_time").over(Window.partitionBy("symbol", "period").orderBy("open_time"))
    return bars.withColumn("is_final", later.isNotNull())


# --- the whole builder --------------------------------------------------------------------


def build_bars(
    trades: DataFrame,
    periods: tuple[str, ...] = PERIODS,
    *,
    arrival_order: bool = False,
    clock_grace_ms: int | None = None,
    seeds: DataFrame | None = None,
    gaps: bool = False,
    horizon_ms: Column | None = None,
    broadcast_steps: int | None = SMALL_ROWS,
) -> DataFrame:
    """Bars from ``trades(symbol, price, quantity, ts_ms, is_buyer_maker, seq[, arrival_ms])``.

    ``arrival_order`` drops late trades; without it all trades count (event-time mode).
    ``clock_grace_ms`` lets the minute clock close bars too and implies ``arrival_order``.
    ``gaps`` fills empty bars and adds ``is_final``. ``broadcast_steps`` bounds what is
    broadcast to find late trades; to check the bound, their number is counted at once (None
    skips that and leaves the join to the optimizer).
    """
    if arrival_order or clock_grace_ms is not None:
        trades = with_accept_mask(
            trades, periods, clock_grace_ms=clock_grace_ms, seeded=seeds, broadcast_steps=broadcast_steps
        )
    elif len(periods) == 1 and seeds is None:
        bars = single_period_bars(trades, periods[0])
        return fill_gaps(bars, periods, horizon_ms) if gaps else bars
    bars = roll_up(slices(trades, periods), periods, seeds)
    return fill_gaps(bars, periods, horizon_ms) if gaps else bars


def clock_horizon(trades: DataFrame, grace_ms: int) -> Column:
    """Last tick up to the newest arrival, as a scalar subquery."""
    return trades.select(last_tick(F.max("arrival_ms"), grace_ms).alias("t")).scalar()


def missing_seeds(wanted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Wanted (symbol, period) pairs without a seed: fatal on a strict start, else reported."""
    return wanted.select("symbol", "period").join(seeds.select("symbol", "period"), ["symbol", "period"], "left_anti")


def seeds_from_stored(latest: DataFrame) -> DataFrame:
    """Open bars from the latest stored bar of each key; bad numbers count as 0."""

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))

    return latest.select(
        *BAR_KEY,
        *(number(c).alias(c) for c in ("open", "high", "low", "close", "volume")),
        number("quote_asset_volume").alias("turnover"),
        F.col("number_of_trades").alias("trade_count"),
        number("taker_buy_base_asset_volume").alias("taker_buy_volume"),
        number("taker_buy_quote_asset_volume").alias("taker_buy_turnover"),
    )
