"""Clock skew, network delay and its smoothed average.

Samples: ``key, seq, sent_ms, received_ms, server_ms`` (local clock for sent and received).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.operators.running import CHUNK_ROWS, chunk_of

# Smoothing factor, how long a sample is trusted.
ALPHA = 0.2
VALID_MS = 300_000

# Possible averages that a chunk is summed up over; before that, its steps are kept.
_SPREAD = 1024


def measured(samples: DataFrame) -> DataFrame:
    """Add one-way delay (half the round trip), skew, and the calibrated time on receipt."""
    skew = F.col("server_ms") - F.col("received_ms")
    return samples.select(
        "*",
        F.expr("(received_ms - sent_ms) div 2").alias("delay_ms"),
        skew.alias("skew_ms"),
        (F.col("received_ms") + skew).alias("calibrated_ms"),
    )


def latest_sync(measurements: DataFrame, now_ms: Column) -> DataFrame:
    """Newest skew per key and whether it is fresh enough to use."""
    return (
        measurements.groupBy("key")
        .agg(
            F.max_by("skew_ms", "seq").alias("skew_ms"),
            F.max_by("delay_ms", "seq").alias("delay_ms"),
            F.max_by("received_ms", "seq").alias("synced_ms"),
        )
        .withColumn("valid", (F.col("synced_ms") != 0) & (now_ms - F.col("synced_ms") < VALID_MS))
    )


def _step(average: int, x: int) -> int:
    return x if average == 0 else math.floor(ALPHA * x + (1 - ALPHA) * average + 0.5)


def _summed_up(delays: list[int], low: int, high: int) -> tuple[list[int], int, list[int]]:
    """A chunk as a function from the average before it to the one after it.

    All averages lie between ``low`` and ``high``. Steps shrink differences, so after some of
    them few averages are possible: those steps are kept as they are, and what follows is a table
    from each possible average to the last one. A short chunk may be kept whole.
    """
    first = 0
    while high - low >= _SPREAD and first < len(delays):
        x, zero = delays[first], low <= 0 <= high
        low, high = _step(low, x) if low else x, _step(high, x) if high else x
        low, high = min(low, high), max(low, high)
        if zero:  # an average of 0 takes the value, those beside it move towards it
            near = [x, _step(-1, x), _step(1, x)]
            low, high = min(low, *near), max(high, *near)
        first += 1
    if first == len(delays):
        return delays, 0, []
    after = list(range(low, high + 1))
    for x in delays[first:]:
        known = {v: _step(v, x) for v in set(after)}
        after = [known[v] for v in after]
    return delays[:first], low, after


def smoothed_delay(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``avg_delay_ms``: an exponential average, rounded to a whole number at every step;
    the first value, and any value after an average of 0, is taken as it is.

    Each step depends on the one before, yet a chunk of steps is a function from the average
    before it to the average after it. Chunks are summed up as functions in parallel, the
    functions of a key are applied one after another (one row per chunk), and then every chunk
    runs from its own start value. Any whole numbers will do, also below 0, and the result does
    not depend on the chunks.
    """
    columns = samples.columns
    chunked = samples.withColumn("_chunk", chunk_of(samples, "seq", chunk_rows))
    bounds = samples.groupBy("key").agg(
        F.least(F.lit(0), F.min("delay_ms")).alias("_low"), F.greatest(F.lit(0), F.max("delay_ms")).alias("_high")
    )

    def as_function(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        steps, low, after = _summed_up(pdf["delay_ms"].tolist(), int(pdf["_low"].iloc[0]), int(pdf["_high"].iloc[0]))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "_chunk": [pdf["_chunk"].iloc[0]], "steps": [steps], "low": [low], "after": [after]})

    def apply_in_turn(pdf):
        pdf = pdf.sort_values("_chunk")
        average, before = 0, []
        for steps, low, after in zip(pdf["steps"], pdf["low"], pdf["after"]):
            before.append(average)
            for x in steps:
                average = _step(average, int(x))
            if len(after):
                average = int(after[average - low])
        return pdf[["key", "_chunk"]].assign(_before=before)

    def run(pdf):
        pdf = pdf.sort_values("seq")
        average, out = int(pdf["_before"].iloc[0]), []
        for x in pdf["delay_ms"].tolist():
            average = _step(average, x)
            out.append(average)
        return pdf[columns].assign(avg_delay_ms=out)

    steps = chunked.select("key", "_chunk", "seq", "delay_ms").join(bounds, "key")
    functions = steps.groupBy("key", "_chunk").applyInPandas(
        as_function, "key string, _chunk bigint, steps array<bigint>, low bigint, after array<bigint>"
    )
    carry = functions.groupBy("key").applyInPandas(apply_in_turn, "key string, _chunk bigint, _before bigint")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", avg_delay_ms bigint"
    return chunked.join(carry, ["key", "_chunk"]).groupBy("key", "_chunk").applyInPandas(run, schema)
