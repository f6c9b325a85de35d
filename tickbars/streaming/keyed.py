"""Bars kept in a state store, one open bar per symbol and period.

Trades, commands and ticks come as one stream with a ``kind``. Before anything is dealt by symbol, each stretch of
arrival is folded into *runs*: trades of a symbol that follow each other in the same base step and the same minute of the clock,
with their first and last arrival. A busy symbol sends a few runs a minute to its state, however many trades it
has. A stretch is a fixed number of arrival positions, so a run never straddles another task's trades, and runs put in
order by their first arrival give the bars of the trades one by one.

Ticks of the minute clock are not dealt to every symbol. Runs know the last tick before them; where no trade comes, a timer
on the watermark of arrivals closes the bar. A row of ``kind`` ``tick`` has no symbol and only moves that watermark.

A state store needs the RocksDB provider, see :func:`use_state_store`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickbars.functions.periods import MINUTE_MS, MONDAY_SHIFT_MS, PERIODS, base_ms, period_ms
from tickbars.functions.timefns import floor_ms, ms_of
from tickbars.operators import bars as B
from tickbars.sinks import store as S
from tickbars.streaming.metrics import observed_bars, observed_trades

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Arrival positions that are folded in one task.
STRETCH = 1 << 16

#: Runs that are handled as Python objects at once; closed bars are handed out after each such number.
AT_ONCE = 20_000

#: One row of the input. ``kind`` is trade, add, remove or tick. ``price`` of an add is the ticker's close and ``ts_ms`` its
#: time; without a price, the symbol's bars begin with its first trade.
EVENT_SCHEMA = (
    "kind string, symbol string, seq bigint, arrival_ms bigint, price double, quantity double, ts_ms bigint, is_buyer_maker boolean"
)
_VALUES = list(B.BAR_VALUES)
_NUMBERS = (
    "open double, high double, low double, close double, volume double, turnover double, trade_count bigint, "
    "taker_buy_volume double, taker_buy_turnover double"
)
RUN_SCHEMA = f"kind string, symbol string, first_seq bigint, step_ms bigint, first_ms bigint, last_ms bigint, {_NUMBERS}"
_OUT = f"symbol string, epoch bigint, period string, open_time bigint, {_NUMBERS}, until_ms bigint, is_final boolean, late bigint"
_FLAT = {c: 0.0 for c in B.SUMS} | {"trade_count": 0}
_NEVER = -(1 << 62)


def use_state_store(spark: SparkSession) -> SparkSession:
    """Keep state in RocksDB: in the checkpoint folder, with only a working copy on the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def as_events(trades: DataFrame) -> DataFrame:
    """Trades as rows of ``kind`` trade; without an arrival clock, ``arrival_ms`` is null."""
    arrival = F.col("arrival_ms") if "arrival_ms" in trades.columns else F.lit(None).cast("bigint")
    cols = [F.lit("trade").alias("kind"), "symbol", "seq", arrival.alias("arrival_ms")]
    return trades.select(*cols, "price", "quantity", "ts_ms", "is_buyer_maker")


def _starts(groups: np.ndarray) -> np.ndarray:
    """Positions where a row differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]).any(axis=1)])) if len(groups) else np.zeros(0, int)


def fold_runs(rows: pd.DataFrame, step_ms: int, grace_ms: int | None) -> pd.DataFrame:
    """Runs of one stretch of arrival, in the columns of RUN_SCHEMA. Commands pass as they are and part runs."""
    rows = rows[rows["symbol"].notna()]
    codes, _ = pd.factorize(rows["symbol"])
    order = np.lexsort([rows["seq"].to_numpy(), codes])
    rows, codes = rows.iloc[order], codes[order]
    is_trade = (rows["kind"] == "trade").to_numpy()
    ts = rows["ts_ms"].fillna(0).to_numpy(np.int64)
    arrival = rows["arrival_ms"].fillna(0).to_numpy(np.int64)
    tick = np.zeros(len(rows), np.int64) if grace_ms is None else (arrival - grace_ms) // MINUTE_MS
    alone = np.where(is_trade, -1, np.arange(len(rows)))
    at = _starts(np.column_stack([codes, ts // step_ms, tick, alone])) if len(rows) else np.zeros(0, int)
    last = np.append(at[1:], len(rows)) - 1 if len(at) else at
    price, quantity = rows["price"].to_numpy(float), rows["quantity"].fillna(0.0).to_numpy(float)
    taken = rows["is_buyer_maker"].eq(False).to_numpy(float)

    def sums(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, at) if len(at) else x[:0]

    return pd.DataFrame(
        {
            "kind": rows["kind"].to_numpy()[at],
            "symbol": rows["symbol"].to_numpy()[at],
            "first_seq": rows["seq"].to_numpy(np.int64)[at],
            "step_ms": ts[at] - ts[at] % step_ms,
            "first_ms": arrival[at],
            "last_ms": arrival[last],
            "open": price[at],
            "high": np.maximum.reduceat(price, at) if len(at) else price[:0],
            "low": np.minimum.reduceat(price, at) if len(at) else price[:0],
            "close": price[last],
            "volume": sums(quantity),
            "turnover": sums(price * quantity),
            "trade_count": sums(is_trade.astype(np.int64)),
            "taker_buy_volume": sums(quantity * taken),
            "taker_buy_turnover": sums(price * quantity * taken),
        }
    )


def runs(events: DataFrame, periods: tuple[str, ...] = PERIODS, grace_ms: int | None = None) -> DataFrame:
    """Runs of a stream (or table) of events."""
    step = base_ms(periods)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return fold_runs(rows, step, grace_ms)

    return events.groupBy(F.floor(F.col("seq") / STRETCH).alias("_stretch")).applyInPandas(fold, RUN_SCHEMA)


def _bar_start(ts: int, period: str) -> int:
    shift = MONDAY_SHIFT_MS if period == "1w" else 0
    return ts - (ts + shift) % period_ms(period)


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one symbol by their first arrival, some at a time: until then they are columns without texts."""
    kinds = pd.CategoricalDtype(["trade", "add", "remove"])
    together = pd.concat([r.drop(columns="symbol").astype({"kind": kinds}) for r in rows], ignore_index=True)
    order = np.argsort(together["first_seq"].to_numpy(), kind="stable")
    for at in range(0, len(order), AT_ONCE):
        yield together.iloc[order[at : at + AT_ONCE]]


class Bars(StatefulProcessor):
    """The open bars of a symbol (``bars``, by period) and where it stands (``standing``).

    With ``managed``, only symbols that were added count. A removed one loses its state, and so does one that is added
    again: it starts anew, in another ``epoch``. Emits closed bars with the start of the bar that follows (what lies between is
    flat), bars that were open when their epoch ended (not final), and, with a null start, the late trades of a batch.
    """

    def __init__(self, periods: tuple[str, ...], grace_ms: int | None, managed: bool):
        self._periods, self._grace, self._managed = periods, grace_ms, managed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._bars = handle.getMapState("bars", "period string", f"open_time bigint, {_NUMBERS}")
        # ticks count after since_ms; epoch is the arrival of the command that added the symbol
        self._standing = handle.getValueState("standing", "epoch bigint, since_ms bigint, timer_ms bigint")

    # state of one symbol while its rows are handled

    def _load(self) -> None:
        self._open = {k[0]: dict(zip(["open_time", *_VALUES], v)) for k, v in self._bars.iterator()}
        found = self._standing.get()
        self._known = found is not None
        self._epoch, self._since, self._timer = tuple(found) if found is not None else (0, None, None)
        self._closed, self._late = [], dict.fromkeys(self._periods, 0)

    def _save(self) -> None:
        stale = {k[0] for k in self._bars.keys()} - set(self._open)
        for period in stale:
            self._bars.removeKey((period,))
        for period, bar in self._open.items():
            self._bars.updateValue((period,), tuple(bar[c] for c in ["open_time", *_VALUES]))
        due = None
        if self._grace is not None and self._open:
            # a watermark that reaches this time has passed the first tick that closes a bar
            due = min(bar["open_time"] + period_ms(p) for p, bar in self._open.items()) + self._grace - 1
        if due != self._timer:
            if self._timer is not None:
                self._handle.deleteTimer(self._timer)
            if due is not None:
                self._handle.registerTimer(due)
            self._timer = due
        if self._known:
            self._standing.update((self._epoch, self._since, self._timer))
        elif self._standing.exists():
            self._standing.clear()

    def _results(self, symbol: str, with_late: bool = True) -> Iterator[pd.DataFrame]:
        rows, self._closed = [(symbol, *row) for row in self._closed], []
        if with_late:
            rows += [(symbol, self._epoch, p, None, *[None] * len(_VALUES), None, None, n) for p, n in self._late.items() if n]
        if rows:
            columns = ["symbol", "epoch", "period", "open_time", *_VALUES, "until_ms", "is_final", "late"]
            frame = pd.DataFrame(rows, columns=columns)
            whole = {c: "Int64" for c in ("epoch", "open_time", "trade_count", "until_ms", "late")}
            yield frame.astype(whole | {c: "float64" for c in _VALUES if c != "trade_count"} | {"is_final": "boolean"})

    # rules

    def _close(self, period: str, until: int, is_final: bool = True) -> dict:
        bar = self._open[period]
        self._closed.append((self._epoch, period, bar["open_time"], *(bar[c] for c in _VALUES), until, is_final, None))
        return bar

    def _end(self) -> None:
        """What was open stays as it is, and is forgotten."""
        for period, bar in self._open.items():
            self._close(period, bar["open_time"] + period_ms(period), is_final=False)
        self._open, self._known, self._since = {}, False, None

    def _add(self, run: dict) -> None:
        self._known, self._epoch = True, run["first_seq"]
        if run["close"] == run["close"]:  # a ticker: ticks count at once
            self._since = _NEVER
            for period in self._periods:
                flat = dict.fromkeys(("open", "high", "low", "close"), run["close"]) | _FLAT
                self._open[period] = {"open_time": _bar_start(run["step_ms"], period)} | flat

    def _tick(self, tick_ms: int) -> None:
        for period, bar in list(self._open.items()):
            start = _bar_start(tick_ms, period)
            if start > bar["open_time"]:
                close = self._close(period, start)["close"]
                self._open[period] = {"open_time": start} | dict.fromkeys(("open", "high", "low", "close"), close) | _FLAT

    def _trades(self, run: dict) -> None:
        values = {c: run[c] for c in _VALUES}
        for period in self._periods:
            start, bar = _bar_start(run["step_ms"], period), self._open.get(period)
            if bar is not None and start < bar["open_time"]:
                self._late[period] += run["trade_count"]
            elif bar is not None and start == bar["open_time"] and bar["trade_count"] > 0:
                bar["high"], bar["low"], bar["close"] = max(bar["high"], run["high"]), min(bar["low"], run["low"]), run["close"]
                for c in B.SUMS:
                    bar[c] += run[c]
            else:
                if bar is not None and start > bar["open_time"]:
                    self._close(period, start)
                self._open[period] = {"open_time": start} | values

    def _last_tick(self, ms: int) -> int:
        return (ms - self._grace) // MINUTE_MS * MINUTE_MS + self._grace

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for together in _in_order(rows):
            for run in together.to_dict("records"):
                self._run(run)
            yield from self._results(key[0], with_late=False)
        self._save()
        yield from self._results(key[0])

    def _run(self, run: dict) -> None:
        if run["kind"] in ("add", "remove"):
            self._end()
            if run["kind"] == "add":
                self._add(run)
            return
        if run["kind"] != "trade" or self._managed and not self._known:
            return
        self._known = True
        if self._since is None:
            self._since = run["first_ms"]
        elif self._grace is not None and self._last_tick(run["first_ms"]) > self._since:
            self._tick(self._last_tick(run["first_ms"]))
        self._trades(run)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        tick = self._last_tick(timerValues.getCurrentWatermarkInMs())
        if self._known and self._since is not None and tick > self._since:
            self._tick(tick)
        if self._timer == expiredTimerInfo.getExpiryTimeInMs():
            self._timer = None  # Spark takes away a timer that has fired
        self._save()
        yield from self._results(key[0])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._load()
        for seed in initialState.to_dict("records"):
            self._open[seed["period"]] = {c: seed[c] for c in ["open_time", *_VALUES]}
        self._known, self._since = True, _NEVER
        self._save()


def _with_watermark(events: DataFrame) -> DataFrame:
    return events.withColumn("_at", F.timestamp_millis("arrival_ms")).withWatermark("_at", "0 seconds")


def closed_bars(
    events: DataFrame,
    periods: tuple[str, ...] = PERIODS,
    *,
    grace_ms: int | None = None,
    initial: DataFrame | None = None,
    managed: bool = False,
) -> DataFrame:
    """Closed bars of a stream of events (EVENT_SCHEMA), each once, with those that had no trade: ``symbol, epoch, period,
    open_time``, values, ``is_final``; and rows with a null ``open_time`` that count ``late`` trades by period.

    ``initial`` holds open bars to start from. ``seq`` must grow from batch to batch, and ``arrival_ms`` with it where
    ``grace_ms`` is given. Within a batch any order will do.
    """
    timed = events if grace_ms is None else _with_watermark(events)
    seeds = None if initial is None else initial.select("symbol", "period", "open_time", *_VALUES).groupBy("symbol")
    out = (
        runs(timed, periods, grace_ms)
        .groupBy("symbol")
        .transformWithStateInPandas(
            Bars(periods, grace_ms, managed),
            outputStructType=_OUT,
            outputMode="Append",
            timeMode="None" if grace_ms is None else "EventTime",
            initialState=seeds,
        )
    )
    step = ms_of(F.col("period"))
    starts = F.when(F.col("open_time").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.sequence("open_time", F.col("until_ms") - step, step)
    )
    spread = out.select("*", F.posexplode(starts).alias("_pos", "_start"))
    flat = F.col("_pos") > 0
    return spread.select(
        "symbol",
        "epoch",
        "period",
        F.col("_start").alias("open_time"),
        *(F.when(flat, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")),
        "close",
        *(F.when(flat, F.lit(0).cast("bigint" if c == "trade_count" else "double")).otherwise(F.col(c)).alias(c) for c in B.SUMS),
        "is_final",
        "late",
    )


class Silence(StatefulProcessor):
    """When each symbol was last heard of (``heard``). Emits a row when it has been silent for too long, and one when it
    returns. A timer finds the silence; where a batch shows it first, the rows of the batch do."""

    def __init__(self, limit_ms: int):
        self._limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._heard = handle.getValueState("heard", "last_ms bigint, is_silent boolean, timer_ms bigint")

    def _emit(self, symbol: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(symbol, *r) for r in rows], columns=["symbol", "what", "since_ms", "at_ms"])

    def _save(self, last: int, is_silent: bool, timer: int | None) -> None:
        # fires once the watermark has passed the limit
        due = None if is_silent else last + self._limit
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if due is not None:
                self._handle.registerTimer(due)
        self._heard.update((last, is_silent, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self._heard.get()
        last, is_silent, timer = tuple(found) if found is not None else (None, False, None)
        out = []
        for run in pd.concat(list(rows), ignore_index=True).sort_values("first_ms").itertuples():
            if last is not None and run.first_ms - last > self._limit:
                if not is_silent:
                    out.append(("silent", last, last + self._limit))
                out.append(("back", last, run.first_ms))
            # what arrives within the limit of a silent symbol came before its timer
            last, is_silent = run.last_ms if last is None else max(last, run.last_ms), False
        self._save(int(last), is_silent, timer)
        yield from self._emit(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, is_silent, timer = tuple(self._heard.get())
        if is_silent or timerValues.getCurrentWatermarkInMs() - last <= self._limit:
            return
        self._save(last, True, None)
        yield from self._emit(key[0], [("silent", last, last + self._limit)])


def _heard(rows: pd.DataFrame, limit_ms: int) -> pd.DataFrame:
    """Spans of arrival of each symbol without a gap over the limit."""
    rows = rows.sort_values(["symbol", "arrival_ms"])
    codes, _ = pd.factorize(rows["symbol"])
    arrival = rows["arrival_ms"].to_numpy(np.int64)
    gap = np.concatenate([[0], np.diff(arrival) > limit_ms]).astype(int)
    at = _starts(np.column_stack([codes, np.cumsum(gap)]))
    last = np.append(at[1:], len(rows)) - 1 if len(at) else at
    return pd.DataFrame({"symbol": rows["symbol"].to_numpy()[at], "first_ms": arrival[at], "last_ms": arrival[last]})


def silences(events: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """``symbol, what, since_ms, at_ms`` of a stream of arrivals (``symbol, seq, arrival_ms``): ``silent`` when nothing came for
    more than the limit after ``since_ms``, and ``back`` at the next arrival. The time is that of all arrivals together (their
    watermark), so one symbol's silence shows while others are heard."""

    def heard(rows: pd.DataFrame) -> pd.DataFrame:
        return _heard(rows[rows["symbol"].notna()], limit_ms)

    spans = (
        _with_watermark(events.select("symbol", "seq", "arrival_ms"))
        .groupBy(F.floor(F.col("seq") / STRETCH).alias("_stretch"))
        .applyInPandas(heard, "symbol string, first_ms bigint, last_ms bigint")
    )
    return spans.groupBy("symbol").transformWithStateInPandas(
        Silence(limit_ms),
        outputStructType="symbol string, what string, since_ms bigint, at_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def start(events: DataFrame, root: str, periods: tuple[str, ...] = PERIODS, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Write closed bars and late counts of a stream below ``root``. Started again on the same folder, it goes on
    where it was: state and the files written so far come from the checkpoint. Its numbers of events, late trades and closed
    bars are observed, see :mod:`tickbars.streaming.metrics`."""
    bars = observed_bars(closed_bars(observed_trades(events), periods, **options))
    return (
        bars.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/closed")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def open_bars(spark: SparkSession, root: str) -> DataFrame:
    """The open bar of every symbol and period, read from the state store."""
    held = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "bars").load()
    return held.select(
        F.col("key.symbol").alias("symbol"), F.col("user_map_key.period").alias("period"), "user_map_value.*"
    )


def standing(spark: SparkSession, root: str) -> DataFrame:
    """When each symbol was added, and from which time on ticks count for it."""
    held = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "standing").load()
    return held.select(F.col("key.symbol").alias("symbol"), "value.epoch", "value.since_ms")


def all_bars(spark: SparkSession, root: str) -> DataFrame:
    """Closed bars from the files and open ones from the state, with ``epoch`` and ``is_final``."""
    closed = spark.read.parquet(f"{root}/closed").filter(F.col("open_time").isNotNull()).drop("late")
    epochs = standing(spark, root).select("symbol", "epoch")
    opened = open_bars(spark, root).join(epochs, "symbol")
    columns = ["symbol", "epoch", "period", "open_time", *_VALUES]
    return (
        closed.select(*columns, "is_final").unionByName(opened.select(*columns, F.lit(False).alias("is_final")))
    )


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """Late trades by symbol and period."""
    rows = spark.read.parquet(f"{root}/closed").filter(F.col("open_time").isNull())
    return rows.groupBy("symbol", "period").agg(F.sum("late").alias("late"))
