"""Stored bars: shape, upsert, range reads, latest bars, pushes and exports.

Bars live in one parquet table partitioned by ``period`` and ``month``. A batch is written to
its own ``batch_id`` partition, so a repeated batch replaces itself; readers take the best
row per key; ``compact`` folds the batches into a fresh table elsewhere. No path is read
and overwritten in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickbars.functions.timefns import close_time

KEY = ("symbol", "period", "open_time")


# --- shape --------------------------------------------------------------------------------


def valid(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("open_time") > 0)


def provisional(bars: DataFrame) -> DataFrame:
    return bars.filter(~F.col("is_final"))


def of_period(bars: DataFrame, period: str) -> DataFrame:
    return bars.filter(F.col("period") == period)


def to_stored(bars: DataFrame) -> DataFrame:
    """Bars in the columns of the stored table."""
    return valid(bars).select(
        "symbol",
        "period",
        "open_time",
        "open",
        "high",
        "low",
        "close",
        "volume",
        close_time(F.col("open_time"), F.col("period")).alias("close_time"),
        F.col("turnover").alias("quote_asset_volume"),
        F.col("trade_count").alias("number_of_trades"),
        F.col("taker_buy_volume").alias("taker_buy_base_asset_volume"),
        F.col("taker_buy_turnover").alias("taker_buy_quote_asset_volume"),
        F.lit("0").alias("ignore"),
    )


def series_name(symbol: Column, period: Column) -> Column:
    """Name of a series in the old one-table-per-series layout."""
    return F.concat(F.lit("k_"), F.replace(F.lower(symbol), F.lit("usdt"), F.lit("")), F.lit("_"), period)


def series_parts(name: Column) -> tuple[Column, Column]:
    """Symbol and period of such a name."""
    parts = F.split(name, "_")
    return F.concat(F.upper(F.try_element_at(parts, F.lit(2))), F.lit("USDT")), F.try_element_at(parts, F.lit(3))


# --- upsert -------------------------------------------------------------------------------


def best_per_key(rows: DataFrame, keys: tuple[str, ...], better: list[Column]) -> DataFrame:
    """The row of each key that comes first in ``better``.

    Ranking by row number lets Spark cut each partition to one row per key before the
    shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*better))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def last_wins(rows: DataFrame, keys: tuple[str, ...], arrival: str) -> DataFrame:
    return best_per_key(rows, keys, [F.col(arrival).desc()])


def upsert_symbols(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry rows by symbol, incoming ones replacing those already there."""
    both = registry.withColumn("_n", F.lit(0)).unionByName(incoming.withColumn("_n", F.lit(1)))
    return last_wins(both, ("symbol",), "_n").drop("_n")


def merge_bars(versions: DataFrame, arrival: str) -> DataFrame:
    """One bar per key out of many versions: final beats provisional, then more trades,
    then later arrival.

    The month follows from the key; ranking within it lets filters on the month reach the
    stored partitions.
    """
    keys = (*KEY, "month") if "month" in versions.columns else KEY
    return best_per_key(
        versions, keys, [F.col("is_final").desc(), F.col("trade_count").desc(), F.col(arrival).desc()]
    )


def _month(ms: Column) -> Column:
    return F.trunc(F.timestamp_millis(ms), "month")


def with_month(bars: DataFrame) -> DataFrame:
    """A month keeps files large for every period: a day would leave 1d with one row per
    symbol in a file. Within a file, rows are found by symbol and time statistics."""
    return bars.withColumn("month", _month(F.col("open_time")))


def write_batch(bars: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch; writing the same batch again replaces it."""
    (
        with_month(bars)
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .hint("rebalance", F.col("period"), F.col("month"))
        .sortWithinPartitions("period", "month", "symbol", "open_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "period", "month")
        .parquet(path)
    )


def read_current(spark: SparkSession, *paths: str) -> DataFrame:
    """Best version of every bar over compacted tables and batches."""
    parts = [spark.read.parquet(p) for p in paths]
    parts = [p if "batch_id" in p.columns else p.withColumn("batch_id", F.lit(-1).cast("bigint")) for p in parts]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return merge_bars(union, "batch_id").drop("batch_id")


def compact(spark: SparkSession, sources: list[str], target: str) -> None:
    """Fold batches (and an older compacted table) into a new table, sorted for range reads."""
    (
        read_current(spark, *sources)
        .hint("rebalance", F.col("period"), F.col("month"))
        .sortWithinPartitions("period", "month", "symbol", "open_time")
        .write.mode("errorifexists")
        .partitionBy("period", "month")
        .parquet(target)
    )


# --- reads --------------------------------------------------------------------------------


def range_scan(bars: DataFrame, symbol: str, period: str, start_ms: int, end_ms: int) -> DataFrame:
    """Bars of one series between two times, both included, in order."""
    scan = bars.filter(
        (F.col("symbol") == symbol) & (F.col("period") == period) & F.col("open_time").between(start_ms, end_ms)
    )
    if "month" in bars.columns:  # prunes partitions of a stored table
        scan = scan.filter(F.col("month").between(_month(F.lit(start_ms)), _month(F.lit(end_ms))))
    return scan.orderBy("open_time")


def point_lookup(bars: DataFrame, symbol: str, period: str, open_time: int) -> DataFrame:
    return bars.filter(
        (F.col("symbol") == symbol) & (F.col("period") == period) & (F.col("open_time") == open_time)
    )


def latest_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of every series."""
    rank = F.row_number().over(Window.partitionBy("symbol", "period").orderBy(F.col("open_time").desc()))
    return bars.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_series(bars: DataFrame) -> DataFrame:
    return latest_n(bars, 1)


def latest_for(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """The newest bar of each wanted series; values are null where there is none."""
    return wanted.select("symbol", "period").join(latest_per_series(bars), ["symbol", "period"], "left")


def series_extent(bars: DataFrame) -> DataFrame:
    """First and last bar start and number of bars per series."""
    return bars.groupBy("symbol", "period").agg(
        F.min("open_time").alias("first_open_time"),
        F.max("open_time").alias("last_open_time"),
        F.count("*").alias("bars"),
    )


def ready(bars: DataFrame, symbol: str, period: str, at_least: int = 100) -> DataFrame:
    """One row: whether a probe series holds enough bars to serve."""
    n = F.count_if((F.col("symbol") == symbol) & (F.col("period") == period))
    return bars.agg(n.alias("bars"), (n >= at_least).alias("ready"))


# --- pushes and exports -------------------------------------------------------------------


def push_messages(changed: DataFrame) -> DataFrame:
    """One JSON array per symbol with its changed bars; ``changed`` holds the latest state of
    each (symbol, period), so a message has at most one entry per period."""
    bar = F.struct("period", "open_time", "open", "high", "low", "close", "volume", "is_final")
    return (
        valid(changed)
        .groupBy("symbol")
        .agg(F.to_json(F.sort_array(F.collect_list(bar))).alias("message"), F.count("*").alias("bars"))
    )


def csv_record(stored: DataFrame) -> DataFrame:
    """The twelve exported columns in their order."""
    return stored.select(
        "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume",
        "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "ignore",
    )


def write_csv(stored: DataFrame, path: str) -> None:
    csv_record(stored).write.mode("overwrite").csv(path)


def write_report(mismatches: DataFrame, summary: DataFrame, path: str) -> None:
    """Audit report: differences and the summary as JSON lines."""
    mismatches.write.mode("overwrite").json(path + "/differences")
    summary.write.mode("overwrite").json(path + "/summary")
