"""Ticks of the minute clock as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.functions.periods import DAY_MS, MINUTE_MS
from tickbars.functions.timefns import floor_ms


def ticks(bounds: DataFrame, grace_ms: int) -> DataFrame:
    """Every tick (full minute plus grace) in ``(start_ms, end_ms]`` of the one-row input.

    Days are laid out first, so that the minutes of a long history spread over tasks.
    """
    days = bounds.select(
        "*", F.explode(F.sequence(floor_ms(F.col("start_ms") - grace_ms, DAY_MS), F.col("end_ms"), F.lit(DAY_MS))).alias("_day")
    ).repartition("_day")
    minutes = days.select(
        "start_ms",
        "end_ms",
        F.explode(
            F.sequence(F.col("_day") + grace_ms, F.col("_day") + (DAY_MS - MINUTE_MS + grace_ms), F.lit(MINUTE_MS))
        ).alias("tick_ms"),
    )
    return minutes.filter((F.col("tick_ms") > F.col("start_ms")) & (F.col("tick_ms") <= F.col("end_ms"))).select("tick_ms")


def live_ticks(spark: SparkSession, grace_ms: int) -> DataFrame:
    """A stream with one row per elapsed tick (``tick`` and ``tick_ms``), from the built-in rate source."""
    seconds = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    now: Column = F.unix_millis("timestamp")
    tick = floor_ms(now - grace_ms, MINUTE_MS) + grace_ms
    return (
        seconds.select(F.timestamp_millis(tick).alias("tick"))
        .withWatermark("tick", "1 minute")
        .dropDuplicatesWithinWatermark(["tick"])
        .withColumn("tick_ms", F.unix_millis("tick"))
    )
