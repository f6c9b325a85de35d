"""Which ranges of history to download, as DataFrames of tasks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickbars.functions.errors import classify_error, error_kind
from tickbars.functions.periods import PERIODS
from tickbars.functions.timefns import bar_open_by, history_start, ms_of
from tickbars.operators.bars import BAR_KEY
from tickbars.sinks.store import best_per_key, last_wins
from tickbars.sources.wire import numeric_bars, parse_rest_bars

# Bars per request, retries per task, longest back-off.
BARS_PER_REQUEST = 1000
MAX_RETRIES = 5
MAX_BACKOFF_S = 30


def wanted_grid(symbols: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """Every symbol with every period."""
    return symbols.select("symbol", F.explode(F.array(*(F.lit(p) for p in periods))).alias("period"))


def grid_status(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Wanted series with their last bar; null where the series is new."""
    last = bars.groupBy("symbol", "period").agg(F.max("open_time").alias("last_open_time"))
    return grid.join(last, ["symbol", "period"], "left")


def grid_counts(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """How many wanted series exist already and how many are to be created, per period."""
    return (
        grid_status(grid, bars)
        .groupBy("period")
        .agg(
            F.count_if(F.col("last_open_time").isNull()).alias("created"),
            F.count_if(F.col("last_open_time").isNotNull()).alias("existing"),
        )
    )


def plan(status: DataFrame, now_ms: int) -> DataFrame:
    """One open range per series that lags: from its last bar (fetched again, since it may
    have been unfinished) or from the start of history, up to now."""
    now = F.lit(now_ms).cast("bigint")
    start = F.coalesce(F.col("last_open_time"), history_start(now, F.col("period")))
    return (
        status.select("symbol", "period", bar_open_by(start, F.col("period")).alias("start_time"), now.alias("end_time"))
        .filter(F.col("start_time") < F.col("end_time"))
        .withColumn("limit", F.lit(BARS_PER_REQUEST))
    )


def legacy_plan(status: DataFrame, now_ms: int) -> DataFrame:
    """The older plan: starts after the last bar, ends at a bar boundary, never split."""
    now, period = F.lit(now_ms).cast("bigint"), F.col("period")
    known = F.col("last_open_time").isNotNull()
    start = F.when(known, F.col("last_open_time") + ms_of(period)).otherwise(history_start(now, period, genesis=False))
    return (
        status.select(
            "symbol",
            "period",
            bar_open_by(start, period).alias("start_time"),
            bar_open_by(now, period).alias("end_time"),
            known.alias("_known"),
        )
        .filter(~F.col("_known") | (F.col("start_time") < F.col("end_time")))
        .drop("_known")
        .withColumn("limit", F.lit(BARS_PER_REQUEST))
    )


def split_ranges(tasks: DataFrame) -> DataFrame:
    """Cut ranges of more than one request into closed ranges that do not overlap. The last
    range of a cut series has no end, so that it reaches the newest bar."""
    step = ms_of(F.col("period")) * BARS_PER_REQUEST
    long_range = F.expr("(end_time - start_time) div _ms") > BARS_PER_REQUEST
    starts = F.when(long_range, F.sequence("start_time", F.col("end_time") - 1, F.col("_step"))).otherwise(
        F.array("start_time")
    )
    cut = tasks.withColumn("_ms", ms_of(F.col("period"))).withColumn("_step", step).select(
        "*", long_range.alias("_long"), F.explode(starts).alias("_start")
    )
    last = F.col("_start") + F.col("_step") >= F.col("end_time")
    return cut.select(
        "symbol",
        "period",
        F.col("_start").alias("start_time"),
        F.when(~F.col("_long"), F.col("end_time"))
        .when(~last, F.col("_start") + F.col("_step") - 1)
        .alias("end_time"),
        "limit",
    )


def retry_selection(failures: DataFrame, round_number: int) -> DataFrame:
    """Failed tasks (``symbol, period, start_time, retries, message``) worth another try.

    Nothing is retried in the first round. A task is keyed with its start, so the ranges of
    one series are retried on their own.
    """
    kind = classify_error(F.col("message"))
    return (
        failures.withColumn("_e", kind)
        .filter(F.lit(round_number >= 2) & (F.col("retries") <= MAX_RETRIES) & F.col("_e.retryable"))
        .select(*failures.columns, F.col("_e.category").alias("category"), F.col("_e.impact").alias("impact"))
    )


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempt - 1), F.lit(MAX_BACKOFF_S)).cast("bigint")


ROUNDS = 3
_LEDGER = "symbol string, period string, start_time bigint, retries bigint, message string, state string, waited_s bigint"


def retry_rounds(
    failures: DataFrame,
    attempt: Callable[[DataFrame, int], DataFrame],
    root: str,
    *,
    rounds: int = ROUNDS,
    wait: Callable[[int], None] = time.sleep,
) -> DataFrame:
    """Carry failed tasks through rounds of retries; returns where each of them ended.

    ``failures`` holds ``symbol, period, start_time, message`` of the first attempts. In each round, tasks that
    :func:`retry_selection` finds worth it are tried again, after a wait that doubles from the second round on; the others are
    given up. ``attempt(tasks, round)`` returns the tasks that failed again with their new ``message``. What a round left is a
    table below ``root``, so a job that starts again goes on after the last whole round. Rounds end early when nothing is
    left to try.

    Result: ``state`` (done, given up, or failed after the last round), ``retries`` (failed attempts), ``message`` (of
    the last failure) and ``waited_s`` (seconds waited for a task).
    """
    spark, keys = failures.sparkSession, ["symbol", "period", "start_time"]
    done = _whole_rounds(spark, root)

    def ledger(n: int) -> DataFrame:
        return spark.read.schema(_LEDGER).parquet(f"{root}/round={n}")

    if not done:
        first = failures.select(*keys, F.lit(1).cast("bigint").alias("retries"), "message", F.lit("failed").alias("state"), F.lit(0).cast("bigint").alias("waited_s"))
        first.write.mode("overwrite").parquet(f"{root}/round=0")
    for n in range(len(done) or 1, rounds + 1):
        before = ledger(n - 1)
        open_ = before.filter(F.col("state") == "failed")
        chosen = retry_selection(open_, 2).select(before.columns)
        if chosen.isEmpty():
            break
        pause = min(2 ** (n - 1), MAX_BACKOFF_S) if n > 1 else 0
        if pause:
            wait(pause)
        again = attempt(chosen.select(*keys, "retries"), n).select(*keys, F.col("message").alias("_new"))
        tried = chosen.join(again.withColumn("_again", F.lit(True)), keys, "left")
        failed = F.coalesce("_again", F.lit(False))
        after = tried.select(
            *keys,
            (F.col("retries") + failed.cast("bigint")).alias("retries"),
            F.when(failed, F.col("_new")).otherwise(F.col("message")).alias("message"),
            F.when(failed, "failed").otherwise("done").alias("state"),
            (F.col("waited_s") + pause).alias("waited_s"),
        )
        kept = before.filter(F.col("state") != "failed")
        given_up = open_.join(chosen.select(*keys), keys, "left_anti").withColumn("state", F.lit("given up"))
        kept.unionByName(given_up).unionByName(after).write.mode("overwrite").parquet(f"{root}/round={n}")
    last = ledger(len(_whole_rounds(spark, root)) - 1)
    worth = F.when(~classify_error(F.col("message"))["retryable"] | (F.col("retries") > MAX_RETRIES), "given up").otherwise("failed")
    return last.withColumn("state", F.when(F.col("state") == "failed", worth).otherwise(F.col("state")))


def _whole_rounds(spark: SparkSession, root: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/round=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy(error_kind(F.col("message")).alias("error")).agg(F.count("*").alias("failures"))


def download_totals(downloads: DataFrame, window: str = "30 seconds") -> DataFrame:
    """Bars fetched per series in each report window (``ts_ms, symbol, period, bars``)."""
    return (
        downloads.groupBy(F.window(F.timestamp_millis("ts_ms"), window).alias("w"), "symbol", "period")
        .agg(F.sum("bars").alias("bars"))
        .select(F.unix_millis("w.start").alias("window_start"), "symbol", "period", "bars")
    )


def most_active(totals: DataFrame, n: int) -> DataFrame:
    """The ``n`` series with the most bars in each window."""
    order = Window.partitionBy("window_start").orderBy(F.col("bars").desc(), "symbol", "period")
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def latest_bar_refresh(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """The newest bar of every wanted series, ready to be stored again each minute."""
    newest = best_per_key(bars, ("symbol", "period"), [F.col("open_time").desc()])
    return newest.join(grid, ["symbol", "period"], "left_semi")


def from_rest_files(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded responses (JSON lines with ``symbol, period, fetched_ms, value``) as bars,
    the last fetch of a bar winning."""
    raw = spark.read.schema("symbol string, period string, fetched_ms bigint, value string").json(path)
    rows = numeric_bars(parse_rest_bars(raw, keep=("symbol", "period", "fetched_ms")))
    return last_wins(rows, BAR_KEY, "fetched_ms").drop("fetched_ms")
