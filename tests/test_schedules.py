"""Retries in rounds and audits each minute: what a crash leaves is taken up, and nothing is done twice."""

from pyspark.sql import functions as F

from test_store import bar, bars
from tickbars.plans import audit as A
from tickbars.plans import backfill as P

TASK = "symbol string, period string, start_time bigint, message string"


def test_rounds_and_a_restart(spark, tmp_path):
    tasks = [("A", "1m", 1, "HTTP error: x"), ("A", "1m", 2, "Data error: x"), ("B", "1h", 3, "IO error: x"), ("C", "1d", 4, "API error: x")]
    failures, root, calls, waits = spark.createDataFrame(tasks, TASK), str(tmp_path / "r"), [], []

    def attempt(pending, n, broken=None):
        calls.append((n, {r.start_time for r in pending.collect()}))
        if n == broken:
            raise RuntimeError("lost")
        # A recovers at once, B in the second round, C ends by a failure that is not worth a retry
        again = pending.filter((F.col("symbol") == "C") | ((F.col("symbol") == "B") & F.lit(n < 2)))
        worse = F.when((F.col("symbol") == "C") & F.lit(n == 2), "CSV error: y").otherwise("IO error: y")
        return again.withColumn("message", worse)

    try:
        P.retry_rounds(failures, lambda t, n: attempt(t, n, broken=2), root, wait=waits.append)
    except RuntimeError:
        pass
    ended = P.retry_rounds(failures, attempt, root, wait=waits.append)
    found = {r.start_time: (r.state, r.retries, r.message, r.waited_s) for r in ended.collect()}
    assert found == {
        1: ("done", 1, "HTTP error: x", 0),
        2: ("given up", 1, "Data error: x", 0),
        3: ("done", 2, "IO error: y", 2),
        4: ("given up", 3, "CSV error: y", 2),
    }
    assert calls == [(1, {1, 3, 4}), (2, {3, 4}), (2, {3, 4})] and waits == [2, 2]
    assert P.retry_rounds(spark.createDataFrame([], TASK), attempt, str(tmp_path / "none"), wait=waits.append).count() == 0


def test_a_cycle_is_reported_once(spark, tmp_path):
    local = bars(spark, bar("A", "1m", 1), bar("A", "1m", 2, 5.0), bar("A", "1m", 40), bar("A", "1h", 0))
    remote = bars(spark, bar("A", "1m", 1), bar("A", "1m", 2), bar("A", "1m", 3), bar("A", "1h", 0))
    base, minute = 1_704_067_200_000, 60_000
    asked = [base + k * minute + 40_000 for k in (4, 5, 5, 33, 70)]
    for part in (asked[:3], asked[2:], asked[4:]):
        rows = [(t,) for t in part]
        spark.createDataFrame(rows, "tick_ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("tick_ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    root, calls = str(tmp_path / "out"), []

    def held(spark):
        calls.append(1)
        return local

    A.start_audits(stream, root, held, lambda _: remote, availableNow=True).awaitTermination()
    differences, totals = A.reports(spark, root)
    found = sorted((r.cycle_ms, r.open_time, r.outcome) for r in differences.collect())
    want = []
    for cycle in sorted(set(asked)):
        one = A.audit_cycle(local, remote, cycle)
        want += [(cycle, r.open_time, r.outcome) for r in one.filter("outcome != 'match'").collect()]
    assert found == sorted(want) and len(want) == 3
    assert {r.cycle_ms: r.match + r.MissingInLocal + r.ExtraInLocal + r.FieldMismatch for r in totals.collect()} == {
        c: A.audit_cycle(local, remote, c).count() for c in set(asked)
    }
    ledger = spark.read.parquet(f"{root}/ledger")
    assert ledger.count() == ledger.select("cycle_ms").distinct().count() == 4 and len(calls) == 3
