"""Bars from a stream of trades.

``start_exact`` follows all bar rules. Each micro-batch is a batch job: the open bars left
by the batch before are its seeds, and what is still open afterwards is written for the next
one. Within a batch the lateness and roll-up steps are those of :mod:`tickbars.operators.bars`,
so a hot symbol is split like anywhere else, nothing runs row by row in Python, and a batch
that is repeated after a failure reads the same seeds and replaces its own output.

``relaxed`` uses event-time windows and a watermark instead: simpler, but bars appear late,
there are no flat bars, and late trades are dropped by watermark and not by arrival.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickbars.functions.periods import PERIODS, period_ms
from tickbars.operators import bars as B
from tickbars.operators.sizing import small_side
from tickbars.operators.universe import add_seeds
from tickbars.session import stored
from tickbars.sinks import store as S
from tickbars.sinks.generations import Generations
from tickbars.sources.wire import known_symbols_only

BAR_SCHEMA = (
    "symbol string, period string, open_time bigint, open double, high double, low double, close double, "
    "volume double, turnover double, trade_count bigint, taker_buy_volume double, taker_buy_turnover double, is_final boolean"
)


def relaxed(trades: DataFrame, period: str, delay: str) -> DataFrame:
    """Event-time bars of one period, each emitted once when the watermark passes its end."""
    length = f"{period_ms(period)} milliseconds"
    start = "4 days" if period == "1w" else "0 seconds"  # weeks begin on Monday
    timed = trades.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    bars = timed.groupBy("symbol", F.window("ts", length, length, start).alias("w")).agg(*B.ohlcv())
    return bars.select(
        "symbol", F.lit(period).alias("period"), F.unix_millis("w.start").alias("open_time"), *B.BAR_VALUES
    )


def _slot(root: str, batch_id: int) -> str:
    """Open bars alternate between two folders: a batch reads one and replaces the other."""
    return f"{root}/open/{batch_id % 2}"


def fold_batch(
    trades: DataFrame,
    seeds: DataFrame | None,
    periods: tuple[str, ...] = PERIODS,
    clock_grace_ms: int | None = None,
    tick_ms: Column | None = None,
) -> DataFrame:
    """All bars a batch touches, with ``is_final``: the closed ones and one open bar per key.
    With a clock, bars close up to its last tick, that of the trades or a given one."""
    horizon = None if clock_grace_ms is None else B.clock_horizon(trades, clock_grace_ms)
    if tick_ms is not None:
        horizon = F.greatest(horizon, tick_ms)
    return B.build_bars(
        trades,
        periods,
        arrival_order=True,
        clock_grace_ms=clock_grace_ms,
        seeds=None if seeds is None else seeds.drop("is_final"),
        gaps=True,
        horizon_ms=horizon,
        broadcast_steps=None,
    )


def changes(bars: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Change feed of a batch: the newest state of every key that differs from its seed."""
    newest = bars.filter(~F.col("is_final"))
    if seeds is None:
        return newest
    return newest.join(seeds.select(*B.BAR_KEY, "trade_count"), [*B.BAR_KEY, "trade_count"], "left_anti")


def with_added(seeds: DataFrame | None, tickers: DataFrame, periods: tuple[str, ...]) -> DataFrame:
    """Open bars, with provisional ones for the symbols of ``tickers`` that have none yet."""
    fresh = add_seeds(tickers, periods).withColumn("is_final", F.lit(False))
    if seeds is None:
        return fresh
    seeds = seeds.drop("is_final").withColumn("is_final", F.lit(False))
    return seeds.unionByName(fresh.join(seeds.select("symbol"), "symbol", "left_anti"))


def hand_over(spark: SparkSession, root: str, trades: DataFrame, periods: tuple[str, ...] = PERIODS) -> None:
    """One round of catching up before a stream: bars of ``trades`` on top of what earlier rounds left below ``root``.

    Trades that an earlier round has counted are left out, so rounds may overlap by any length. Beside its bars a round
    leaves the open ones and, per symbol, the last arrival it counted (``marks``). A round is complete once its marks are written; one
    that failed before is repeated.
    """
    done = _rounds(spark, root)
    n = len(done)
    seeds = None if n == 0 else spark.read.schema(BAR_SCHEMA).parquet(f"{root}/rounds/{n - 1}/open")
    news = trades if n == 0 else after_marks(trades, marks(spark, root))
    bars = stored(fold_batch(news, seeds, periods))
    bars.filter("is_final").unionByName(changes(bars, seeds)).write.mode("overwrite").parquet(f"{root}/rounds/{n}/bars")
    bars.filter(~F.col("is_final")).write.mode("overwrite").parquet(f"{root}/rounds/{n}/open")
    counted = news.groupBy("symbol").agg(F.max("seq").alias("upto"))
    if n:
        counted = marks(spark, root).unionByName(counted).groupBy("symbol").agg(F.max("upto").alias("upto"))
    counted.coalesce(1).write.mode("overwrite").parquet(f"{root}/rounds/{n}/marks")


def _rounds(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/rounds/*/marks/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(int(f.getPath().getParent().getParent().getName()) for f in found or [])


def marks(spark: SparkSession, root: str) -> DataFrame:
    """Per symbol the last arrival that the rounds so far have counted."""
    return spark.read.schema("symbol string, upto bigint").parquet(f"{root}/rounds/{_rounds(spark, root)[-1]}/marks")


def after_marks(trades: DataFrame, counted: DataFrame) -> DataFrame:
    """Trades that are not counted yet; a symbol without a mark is new."""
    met = trades.join(small_side(counted.withColumnRenamed("upto", "_upto")), "symbol", "left")
    return met.filter(F.col("_upto").isNull() | (F.col("seq") > F.col("_upto"))).drop("_upto")


def start_after_rounds(trades: DataFrame, root: str, **options) -> StreamingQuery:
    """:func:`start_exact` on top of all rounds of :func:`hand_over`. The stream may replay trades from any earlier
    offset: what the rounds have counted is left out. Late rules see the open bars of the last round."""
    spark = trades.sparkSession
    last = _rounds(spark, root)[-1]
    opened = spark.read.schema(BAR_SCHEMA).parquet(f"{root}/rounds/{last}/open")
    fresh = after_marks(trades, marks(spark, root))
    return start_exact(fresh, root, initial=opened, **options)


def bars_after_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Bars of all rounds and of the stream after them."""
    rounds = [
        spark.read.schema(BAR_SCHEMA).parquet(f"{root}/rounds/{n}/bars").withColumn("_n", F.lit(n).cast("bigint"))
        for n in _rounds(spark, root)
    ]
    streamed = S.read_current(spark, f"{root}/bars").drop("month").withColumn("_n", F.lit(len(rounds)).cast("bigint"))
    return S.merge_bars(reduce(DataFrame.unionByName, [*rounds, streamed]), "_n").drop("_n")


def start_exact(
    trades: DataFrame,
    root: str,
    *,
    periods: tuple[str, ...] = PERIODS,
    clock_grace_ms: int | None = None,
    initial: DataFrame | None = None,
    registry: Callable[[SparkSession], DataFrame] | None = None,
    tickers: Callable[[SparkSession], DataFrame] | None = None,
    ticks: DataFrame | None = None,
    push: bool = False,
    compact_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Write the bars of a trade stream below ``root``, a folder all executors share.

    ``initial`` holds the open bars to start from, so that a stream can follow a backfill.
    ``registry`` is asked in every batch which symbols count, so subscriptions may change
    while the stream runs; the open bars of a symbol that was removed are dropped, and if it
    returns it starts anew. ``tickers`` gives tickers of symbols as they are added (as from
    :func:`tickbars.sources.wire.ticker_numbers`); those without an open bar start with flat
    provisional bars. ``ticks`` is a stream of ``tick_ms`` (as from
    :func:`tickbars.streaming.clock.live_ticks`); with it and ``clock_grace_ms`` bars close while
    no trade comes. ``push`` writes the change feed as JSON, one message per symbol.
    ``seq`` must grow from batch to batch. Bars are read with ``S.read_current``. With ``compact_every``, they are kept as
    generations: after so many batches the job folds them into the partitions they touch and removes what two
    generations no longer list; they are then read with ``Generations(spark, f"{root}/bars").read()``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seeds = initial if batch_id == 0 else spark.read.schema(BAR_SCHEMA).parquet(_slot(root, batch_id - 1))
        tick = None
        if ticks is not None:
            tick = batch.select(F.max("tick_ms").alias("t")).scalar()
            batch = batch.filter(F.col("tick_ms").isNull()).drop("tick_ms")
        known = batch
        if tickers is not None:
            seeds = with_added(seeds, tickers(spark), periods)
        if registry is not None:
            current = registry(spark)
            known = known_symbols_only(batch, current)
            seeds = None if seeds is None else known_symbols_only(seeds, current)
        bars = fold_batch(known, seeds, periods, clock_grace_ms, tick).persist()
        try:
            # final bars and changed open ones: a later final version beats the open one
            news = bars.filter("is_final").unionByName(changes(bars, seeds))
            if compact_every is None:
                S.write_batch(news, f"{root}/bars", batch_id)
            else:
                bars_store = Generations(spark, f"{root}/bars")
                bars_store.append(news, batch_id)
                if (batch_id + 1) % compact_every == 0:
                    bars_store.compact()
                    bars_store.retire()
            if push:
                feed = S.push_messages(changes(bars, seeds))
                feed.write.mode("overwrite").json(f"{root}/push/batch_id={batch_id}")
            bars.filter(~F.col("is_final")).hint("rebalance").write.mode("overwrite").parquet(_slot(root, batch_id))
        finally:
            bars.unpersist()

    if ticks is not None and clock_grace_ms is None:
        raise ValueError("ticks need clock_grace_ms")
    rows = trades if ticks is None else trades.unionByName(ticks.select("tick_ms"), allowMissingColumns=True)
    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def final_bars(spark: SparkSession, root: str) -> DataFrame:
    """Closed bars written so far."""
    return S.read_current(spark, f"{root}/bars").filter("is_final").drop("month")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The open bar of every key, from what the last finished batch left open."""
    done = spark.read.text(f"{root}/checkpoint/commits", pathGlobFilter="[0-9]*")
    last = int(done.select(F.max(F.element_at(F.split("_metadata.file_name", "[.]"), 1).cast("bigint"))).first()[0])
    return S.valid(spark.read.schema(BAR_SCHEMA).parquet(_slot(root, last)))


class StaleInput(StreamingQueryListener):
    """Calls ``warn(query name, seconds)`` when a stream had no input for too long."""

    def __init__(self, warn: Callable[[str, float], None], limit_s: float = 60.0):
        self._warn, self._limit, self._last = warn, limit_s, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self._seen(event.progress.id, event.progress.name, event.progress.timestamp, event.progress.numInputRows)

    def onQueryIdle(self, event):
        self._seen(event.id, None, event.timestamp, 0)

    def onQueryTerminated(self, event):
        self._last.pop(event.id, None)

    def _seen(self, ident, name, stamp, rows):
        from datetime import datetime

        now = datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp()
        if rows or ident not in self._last:
            self._last[ident] = now
        elif now - self._last[ident] > self._limit:
            self._warn(name or str(ident), now - self._last[ident])
