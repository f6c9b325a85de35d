"""Checks on bars: single-row rules, continuity, freshness, comparison of two bar sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.functions.periods import MINUTE_MS, PERIODS, base_ms
from tickbars.functions.timefns import bar_open, close_time, continuity_ms, floor_ms, freshness_minutes, ms_of
from tickbars.operators.running import CHUNK_ROWS, previous
from tickbars.sinks.store import last_wins

EPSILON = 1e-8
KEY = ("symbol", "period", "open_time")

# --- rules on one bar ---------------------------------------------------------------------


def rules() -> dict[str, Column]:
    """Name -> condition that a sound bar meets."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "invalid_price": (o > 0) & (h > 0) & (lo > 0) & (c > 0),
        "ohlc_logic_error": (h >= lo) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c),
        "invalid_volume": F.col("volume") >= 0,
    }


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the rule they break, one output row per broken rule; work goes on."""
    broken = F.array_compact(F.array(*(F.when(~cond, F.lit(name)) for name, cond in checks.items())))
    return rows.select("*", F.explode(broken).alias("rule"))


def future_rows(rows: DataFrame, ts: str, now_ms: Column, slack_ms: int = 60_000) -> DataFrame:
    """Rows dated more than ``slack_ms`` ahead of now."""
    return rows.filter(F.col(ts) > now_ms + slack_ms)


# --- continuity ---------------------------------------------------------------------------


def continuity(bars: DataFrame, arrival: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Step from the bar that arrived before, per series: ``gap`` when it is more than two
    intervals, ``duplicate`` when it is none, else ``ok``. A step back is not flagged."""
    stepped = previous(bars, ["symbol", "period"], arrival, "open_time", "prev_open_time", chunk_rows=chunk_rows)
    step = F.col("open_time") - F.col("prev_open_time")
    return stepped.withColumn(
        "status",
        F.when(step > 2 * continuity_ms(F.col("period")), "gap").when(step == 0, "duplicate").otherwise("ok"),
    )


def completeness(checked: DataFrame) -> DataFrame:
    """Totals over a continuity check."""
    return checked.agg(
        F.count("*").alias("processed"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("period").alias("periods"),
        F.count_if(F.col("status") == "gap").alias("gaps"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
    )


# --- comparing two bar sets ---------------------------------------------------------------


def closed_before(bars: DataFrame, safe_end_ms: Column, by_open: bool = False) -> DataFrame:
    """Bars that had ended by the safe end. ``by_open`` only asks that they had begun."""
    if by_open:
        return bars.filter(F.col("open_time") <= safe_end_ms)
    return bars.filter(close_time(F.col("open_time"), F.col("period")) < safe_end_ms)


def compare(
    local: DataFrame, remote: DataFrame, arrival: str | None = None, keys: tuple[str, ...] = KEY
) -> DataFrame:
    """Every key of either side with ``outcome``: match, MissingInLocal, ExtraInLocal or
    FieldMismatch.

    Prices and volume may differ by 1e-8, trade counts not at all; turnover is not compared.
    With ``arrival``, the last row of a key counts on each side. ``keys`` may name more columns than those of a bar.
    """
    values = ("open", "high", "low", "close", "volume", "trade_count")

    def side(df: DataFrame, tag: str) -> DataFrame:
        if arrival is not None:
            df = last_wins(df, keys, arrival)
        return df.select(*keys, F.struct(*values).alias(tag))

    both = side(local, "local").join(side(remote, "remote"), list(keys), "full_outer")
    same = F.col("local.trade_count") == F.col("remote.trade_count")
    for v in values[:-1]:
        same = same & (F.abs(F.col(f"local.{v}") - F.col(f"remote.{v}")) <= EPSILON)
    return both.withColumn(
        "outcome",
        F.when(F.col("local").isNull(), "MissingInLocal")
        .when(F.col("remote").isNull(), "ExtraInLocal")
        .when(~same, "FieldMismatch")
        .otherwise("match"),
    )


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("outcome") != "match")


def audit_summary(compared: DataFrame) -> DataFrame:
    """Totals and success rate; 100 when nothing was checked."""
    bad = F.count_if(F.col("outcome") != "match")
    checked = F.count("*")
    return compared.agg(
        checked.alias("total_checked"),
        F.count_if(F.col("outcome") == "MissingInLocal").alias("missing_in_local"),
        F.count_if(F.col("outcome") == "ExtraInLocal").alias("extra_in_local"),
        F.count_if(F.col("outcome") == "FieldMismatch").alias("field_mismatches"),
        F.when(checked == 0, F.lit(100.0)).otherwise((checked - bad) / F.nullif(checked, F.lit(0)) * 100).alias("success_rate"),
    )


# --- last bars against a benchmark --------------------------------------------------------


def last_bar_vs_benchmark(bars: DataFrame, benchmark: str) -> DataFrame:
    """Per period, whether each symbol's newest bar is at the benchmark's. Periods without
    the benchmark are left out. At most one benchmark row per period takes part."""
    last = bars.groupBy("symbol", "period").agg(F.max("open_time").alias("last_open_time"))
    mark = last.filter(F.col("symbol") == benchmark).select(
        "period", F.col("last_open_time").alias("benchmark_open_time")
    )
    return (
        last.filter(F.col("symbol") != benchmark)
        .join(mark, "period")
        .withColumn("consistent", F.col("last_open_time") == F.col("benchmark_open_time"))
    )


def benchmark_totals(compared: DataFrame) -> DataFrame:
    return compared.groupBy("period").agg(
        F.count("*").alias("symbols"),
        F.count_if("consistent").alias("consistent"),
        F.count_if(~F.col("consistent")).alias("inconsistent"),
    )


def inconsistent_groups(compared: DataFrame, shown: int = 10) -> DataFrame:
    """Inconsistent symbols grouped by their last bar: the first few names and how many more.
    Only the shown names are gathered."""
    odd = compared.filter(~F.col("consistent"))
    group = ["period", "last_open_time"]
    names = (
        odd.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("symbol")))
        .filter(F.col("_r") <= shown)
        .groupBy(*group)
        .agg(F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"))
    )
    sizes = odd.groupBy(*group).agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return names.join(sizes, group)


# --- freshness ----------------------------------------------------------------------------


def freshness(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Newest local bar against the newest remote bar per series; a series that is missing
    locally fails."""
    newest = lambda df, name: df.groupBy("symbol", "period").agg(F.max("open_time").alias(name))
    lag = F.abs(F.col("remote_open_time") - F.col("local_open_time")) / 60_000
    return (
        newest(remote, "remote_open_time")
        .join(newest(local, "local_open_time"), ["symbol", "period"], "left")
        .withColumn("lag_minutes", lag)
        .withColumn("passed", F.coalesce(lag <= freshness_minutes(F.col("period")), F.lit(False)))
    )


def pass_rate(checked: DataFrame, warn_below: float = 95.0) -> DataFrame:
    rate = F.round(F.count_if("passed") / F.count("*") * 100, 2)
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        rate.alias("pass_rate"),
        (rate < warn_below).alias("warn"),
    )


def stale_inputs(trades: DataFrame, now_ms: Column, limit_ms: int = 60_000) -> DataFrame:
    """Newest trade per symbol and whether it is older than the limit."""
    return (
        trades.groupBy("symbol")
        .agg(F.max("ts_ms").alias("last_ts_ms"))
        .withColumn("silent_ms", now_ms - F.col("last_ts_ms"))
        .withColumn("stale", F.col("silent_ms") > limit_ms)
    )


def input_health(
    trades: DataFrame, connects: DataFrame, now_ms: Column, limit_ms: int = 60_000, most_reconnects: int = 10
) -> DataFrame:
    """Per symbol what the computing side (``computing``: Error when silent for too long) and the reading side (``reading``: Warning
    when silent for too long or reconnected too often) report. Symbols with connections but no trade yet have a warning in the former.

    ``connects(symbol)`` has a row per connection, of which the first is no reconnect.
    """
    counts = connects.groupBy("symbol").agg((F.count("*") - 1).alias("reconnects"))
    both = stale_inputs(trades, now_ms, limit_ms).join(counts, "symbol", "full")
    often = F.coalesce(F.col("reconnects"), F.lit(0)) > most_reconnects
    silent = F.coalesce(F.col("stale"), F.lit(False))
    return both.select(
        "symbol",
        "last_ts_ms",
        F.coalesce("reconnects", F.lit(0)).cast("bigint").alias("reconnects"),
        F.when(F.col("last_ts_ms").isNull(), "Warning").when(silent, "Error").otherwise("Ok").alias("computing"),
        F.when(often | silent, "Warning").otherwise("Ok").alias("reading"),
    )


# --- activity counters --------------------------------------------------------------------


def throughput(rows: DataFrame, ts: str, window: str, **totals: Column) -> DataFrame:
    """Rows (and further totals) per window of time."""
    return (
        rows.groupBy(F.window(F.timestamp_millis(ts), window).alias("w"))
        .agg(F.count("*").alias("events"), *(agg.alias(name) for name, agg in totals.items()))
        .select(F.unix_millis("w.start").alias("window_start"), "events", *totals)
    )


def transitions(bars: DataFrame) -> DataFrame:
    """States of each finished bar and the one before it; needs bars with gaps filled. State is ``real`` or ``flat``.

    What caused a change cannot be seen from finished bars, see :func:`closings`.
    """
    key = Window.partitionBy("symbol", "period").orderBy("open_time")
    state = F.when(F.col("trade_count") > 0, "real").otherwise("flat")
    return (
        bars.select("symbol", "period", "open_time", state.alias("new_state"))
        .withColumn("old_state", F.lag("new_state").over(key))
        .filter(F.col("old_state").isNotNull())
    )


def closings(trades: DataFrame, bars: DataFrame, grace_ms: int, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """What closed each final bar: the first trade of a later bar, or the first tick of the clock past its end, whichever
    came first (at the same time, the tick). A bar that the clock opened and that traded later was still opened by the clock.

    ``bars`` are those of ``trades`` with the clock and gaps filled. Old state is that of the closed bar (``real``
    or ``flat``); new state is what stands right after: real only if the closing trade belongs to the very next bar.

    Arrivals are combined per symbol and step first; the window runs over bars, from the newest back, so that one sort serves it.
    """
    first = F.min(F.struct("seq", "arrival_ms")).alias("_first")
    steps = trades.groupBy("symbol", floor_ms(F.col("ts_ms"), base_ms(periods)).alias("_step")).agg(first)
    places = F.array(*(F.struct(F.lit(p).alias("period"), bar_open(F.col("_step"), p).alias("open_time")) for p in periods))
    arrivals = steps.select("symbol", F.inline(places), "_first").groupBy("symbol", "period", "open_time").agg(
        F.min(F.struct("_first.seq", "_first.arrival_ms", "open_time")).alias("_came")
    )
    since = steps.groupBy("symbol").agg(F.min("_first.arrival_ms").alias("_since"))
    later = Window.partitionBy("symbol", "period").orderBy(F.col("open_time").desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = bars.join(arrivals, ["symbol", "period", "open_time"], "left").withColumn("_next", F.min("_came").over(later))
    end = F.col("open_time") + ms_of(F.col("period"))
    next_tick = floor_ms(F.col("_since") - grace_ms, MINUTE_MS) + (MINUTE_MS + grace_ms)
    tick = F.greatest(end + grace_ms, next_tick)
    by_trade = F.coalesce(F.col("_next.arrival_ms") < tick, F.lit(False))
    return (
        met.filter("is_final")
        .join(since, "symbol")
        .select(
            "symbol",
            "period",
            "open_time",
            F.when(by_trade, "Trade").otherwise("Clock").alias("trigger"),
            F.when(F.col("trade_count") > 0, "real").otherwise("flat").alias("old_state"),
            F.when(by_trade & (F.col("_next.open_time") == end), "real").otherwise("flat").alias("new_state"),
        )
    )


def transition_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("trigger", "old_state", "new_state").agg(F.count("*").alias("changes"))
