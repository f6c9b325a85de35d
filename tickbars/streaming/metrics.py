"""Counters of a running stream, from metrics that Spark observes while it computes the batches."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

TRADES, BARS = "trades", "bars"


def observed_trades(trades: DataFrame) -> DataFrame:
    """Trades, with their number observed in each batch."""
    return trades.observe(TRADES, F.count(F.lit(1)).alias("trades"))


def observed_bars(closed: DataFrame) -> DataFrame:
    """Closed bars with late counts (as from :func:`tickbars.streaming.keyed.closed_bars`), with numbers observed."""
    return closed.observe(
        BARS,
        F.coalesce(F.sum("late"), F.lit(0)).cast("bigint").alias("late_trades"),
        F.count_if(F.col("is_final")).alias("closed_bars"),
    )


class Counters(StreamingQueryListener):
    """Sums of all observed metrics by query id, and those of the newest batch.

    A batch that is repeated after a restart counts once: the newest report of a batch replaces an older one.
    """

    def __init__(self):
        self._batches: dict[str, dict[int, dict[str, int]]] = defaultdict(dict)
        self._ended = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        found = {k: v for row in progress.observedMetrics.values() for k, v in row.asDict().items()}
        if found:
            self._batches[str(progress.id)][progress.batchId] = found

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._ended.set()

    def wait(self, seconds: float) -> bool:
        """Whether the end of a query was reported; reports come a little after the batches."""
        return self._ended.wait(seconds)

    def totals(self, query_id: str) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for metrics in self._batches[str(query_id)].values():
            for name, value in metrics.items():
                out[name] += value or 0
        return dict(out)

    def last(self, query_id: str) -> dict[str, int]:
        batches = self._batches[str(query_id)]
        return batches[max(batches)] if batches else {}
