"""Scheduled comparison of two bar sets over a trailing range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickbars.functions.periods import MINUTE_MS
from tickbars.functions.timefns import floor_ms, ms_of, safe_end
from tickbars.operators import quality as Q
from tickbars.operators.sizing import small_side

TRAILING_MS = 1_800_000
#: Fixed value: the second of the minute at which a cycle begins.
AT_MS = 40_000


def audit_cycle(
    local: DataFrame,
    remote: DataFrame,
    now_ms: int,
    *,
    trailing_ms: int = TRAILING_MS,
    symbols: DataFrame | None = None,
    periods: tuple[str, ...] | None = None,
    by_open: bool = False,
    arrival: str | None = None,
) -> DataFrame:
    """Compare the bars of the last ``trailing_ms`` that had ended by the safe end.

    The grid of series needs no tasks of its own: it is part of the join key. Range and
    period filters are plain predicates, so stored tables are pruned.
    """
    now = F.lit(now_ms).cast("bigint")

    def side(df: DataFrame) -> DataFrame:
        df = Q.closed_before(df.filter(F.col("open_time") >= now - trailing_ms), safe_end(now), by_open)
        if periods is not None:
            df = df.filter(F.col("period").isin(*periods))
        return df if symbols is None else df.join(symbols.select("symbol"), "symbol", "left_semi")

    return Q.compare(side(local), side(remote), arrival)


# --- a cycle each minute ------------------------------------------------------------------


def audit_cycles(local: DataFrame, remote: DataFrame, cycles: DataFrame, trailing_ms: int = TRAILING_MS) -> DataFrame:
    """:func:`audit_cycle` for many cycles (``cycle_ms``, at second 40 of a minute) in one comparison, by cycle and bar.

    A bar is laid out to the cycles that look at it, which are no more than the minutes of the trailing range, and met with
    those that are asked for.
    """

    def side(df: DataFrame) -> DataFrame:
        # closed by the safe end: the cycle's minute is two past the bar's last one, or later
        first = floor_ms(F.col("open_time") + ms_of(F.col("period")) - 1, MINUTE_MS) + (2 * MINUTE_MS + AT_MS)
        last = floor_ms(F.col("open_time") + (trailing_ms - AT_MS), MINUTE_MS) + AT_MS
        seen = F.when(first <= last, F.sequence(first, last, F.lit(MINUTE_MS))).otherwise(F.array().cast("array<bigint>"))
        return df.select("*", F.explode(seen).alias("cycle_ms")).join(small_side(cycles), "cycle_ms")

    return Q.compare(side(local), side(remote), keys=("cycle_ms", *Q.KEY))


def start_audits(
    ticks: DataFrame,
    root: str,
    local: Callable[[SparkSession], DataFrame],
    remote: Callable[[SparkSession], DataFrame],
    *,
    trailing_ms: int = TRAILING_MS,
    **trigger,
) -> StreamingQuery:
    """Audit a cycle for each minute of a stream of ``tick_ms``, over the bars stored by then.

    Differences and totals of a cycle go to a partition of their own below ``root``, and then its name to a ledger. Cycles
    of the ledger are not done again. A batch that failed in between is repeated and replaces what it wrote, so a cycle is
    never reported twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = batch.select((floor_ms(F.col("tick_ms") - AT_MS, MINUTE_MS) + AT_MS).alias("cycle_ms")).distinct()
        # what later batches did is unknown to a repeated one
        done = spark.read.schema("cycle_ms bigint, batch_id bigint").parquet(f"{root}/ledger").filter(F.col("batch_id") < batch_id)
        fresh = asked.join(done.select("cycle_ms"), "cycle_ms", "left_anti").persist()
        try:
            compared = audit_cycles(local(spark), remote(spark), fresh, trailing_ms).persist()
            try:
                _report(Q.mismatches(compared), f"{root}/differences")
                counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("match", "MissingInLocal", "ExtraInLocal", "FieldMismatch")]
                totals = fresh.join(compared.groupBy("cycle_ms").agg(*counts), "cycle_ms", "left").fillna(0)
                _report(totals, f"{root}/totals")
            finally:
                compared.unpersist()
            fresh.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch_id={batch_id}")
        finally:
            fresh.unpersist()

    # an empty ledger is a ledger too
    ticks.sparkSession.createDataFrame([], "cycle_ms bigint").write.mode("overwrite").parquet(f"{root}/ledger/batch_id=-1")
    return (
        ticks.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _report(rows: DataFrame, path: str) -> None:
    (
        rows.hint("rebalance", F.col("cycle_ms"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cycle_ms")
        .parquet(path)
    )


def reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Differences and totals of all cycles so far."""
    return tuple(spark.read.parquet(f"{root}/{kind}").withColumn("cycle_ms", F.col("cycle_ms").cast("bigint")) for kind in ("differences", "totals"))
