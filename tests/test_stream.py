import os

import pytest
from pyspark.sql import functions as F

from fold import bars_of
from test_bars import SEED, TRADE, folded, random_rows, tape
from tickbars.operators import bars as B
from tickbars.operators import clocksync as C
from tickbars.sinks import store as S
from tickbars.streaming import clock, jobs

PERIODS = ("1m", "1h", "1d")


def write_in_parts(spark, rows, folder, size=60):
    """Files with rising names and times, so that the stream reads them in order."""
    os.makedirs(folder, exist_ok=True)
    for n, at in enumerate(range(0, len(rows), size)):
        part = f"{folder}/{n:04d}.parquet"
        tape(spark, rows[at : at + size]).toPandas().to_parquet(part)
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))


def stream_of(spark, folder):
    return spark.readStream.schema(TRADE).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("grace", [None, 150])
def test_stream_equals_batch_and_fold(spark, tmp_path, grace):
    rows = random_rows(240, 1_800_000 if grace is None else 120_000, span_ms=6 * 3_600_000)
    write_in_parts(spark, rows, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    q = jobs.start_exact(
        stream_of(spark, str(tmp_path / "in")), root, periods=PERIODS, clock_grace_ms=grace, push=True, availableNow=True
    )
    q.awaitTermination()
    got = bars_of(S.read_current(spark, f"{root}/bars"))
    want = folded(rows, PERIODS, grace).result()
    assert got == want
    df = tape(spark, rows)
    batch = B.build_bars(
        df, PERIODS, arrival_order=True, clock_grace_ms=grace, gaps=True,
        horizon_ms=None if grace is None else B.clock_horizon(df, grace),
    )
    assert got == bars_of(batch)
    snap = {(r.symbol, r.period, r.open_time) for r in jobs.snapshot(spark, root).collect()}
    assert snap == {k for k, (_, final) in want.items() if not final}
    assert jobs.final_bars(spark, root).count() == sum(f for _, f in want.values())
    pushed = spark.read.json(f"{root}/push")
    assert pushed.select("batch_id").distinct().count() == 4


def test_ticks_alone_close_bars(spark, tmp_path):
    hour = 3_600_000
    start = 400_000 * hour
    rows = [("A", 1.0, 2.0, start + 10, True, 1, start + 10), ("B", 3.0, 1.0, start + 20, False, 2, start + 20)]
    write_in_parts(spark, rows, str(tmp_path / "in"))
    for n, tick in enumerate([start + 150, start + 2 * hour + 150]):
        part = f"{tmp_path}/ticks/{n}.parquet"
        os.makedirs(f"{tmp_path}/ticks", exist_ok=True)
        spark.createDataFrame([(tick,)], "tick_ms bigint").toPandas().to_parquet(part)
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    ticks = spark.readStream.schema("tick_ms bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    root = str(tmp_path / "out")
    trades = stream_of(spark, str(tmp_path / "in"))
    jobs.start_exact(trades, root, periods=("1h",), clock_grace_ms=150, ticks=ticks, availableNow=True).awaitTermination()
    assert {(r.symbol, r.open_time, r.close) for r in jobs.snapshot(spark, root).collect()} == {("A", start + 2 * hour, 1.0), ("B", start + 2 * hour, 3.0)}
    assert {(r.symbol, r.open_time, r.trade_count) for r in jobs.final_bars(spark, root).collect()} == {
        (s, start + k * hour, int(k == 0)) for s in "AB" for k in (0, 1)
    }


def test_stream_resumes_and_follows_the_registry(spark, tmp_path):
    rows = random_rows(120, 600_000, span_ms=3 * 3_600_000)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    registry = spark.createDataFrame([("A",), ("HOT",)], "symbol string")
    write_in_parts(spark, rows[:60], source)
    start = lambda: jobs.start_exact(
        stream_of(spark, source), root, periods=("1m", "1h"), registry=lambda s: registry, availableNow=True
    ).awaitTermination()
    start()
    late = f"{source}/0009.parquet"
    tape(spark, rows[60:]).toPandas().to_parquet(late)
    start()
    known = [r for r in rows if r[0] != "B"]
    assert bars_of(S.read_current(spark, f"{root}/bars")) == folded(known, ("1m", "1h")).result()


def test_stream_starts_from_stored_bars(spark, tmp_path):
    rows = random_rows(60, 0, span_ms=3_600_000)
    seeds = [("A", "1h", rows[0][3] - 7_200_000 - rows[0][3] % 3_600_000, 5.0, 6.0, 4.0, 5.0, 3.0, 15.0, 2, 1.0, 5.0)]
    write_in_parts(spark, rows, str(tmp_path / "in"), size=30)
    root = str(tmp_path / "out")
    initial = spark.createDataFrame(seeds, SEED)
    jobs.start_exact(stream_of(spark, str(tmp_path / "in")), root, periods=("1h",), initial=initial, availableNow=True).awaitTermination()
    assert bars_of(S.read_current(spark, f"{root}/bars")) == folded(rows, ("1h",), seeds=seeds).result()


def test_symbols_come_and_go_in_a_stream(spark, tmp_path):
    """HOT is removed after the first batch and returns for the third; N is added by a ticker."""
    t0 = 1_704_067_200_000
    row = lambda s, sec, price, i: (s, float(price), 1.0, t0 + sec * 1000, True, i, t0 + sec * 1000)
    parts = [
        [row("HOT", 1, 10, 0), row("A", 1, 5, 1)],
        [row("HOT", 61, 11, 2), row("A", 61, 6, 3)],
        [row("HOT", 181, 12, 4), row("A", 121, 7, 5), row("N", 130, 3, 6)],
    ]
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    for n, p in enumerate(parts):
        tape(spark, p).toPandas().to_parquet(f"{folder}/{n}.parquet")
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    seen = []

    def registry(session):
        seen.append(1)
        names = ["A", "N"] + (["HOT"] if len(seen) != 2 else [])
        return session.createDataFrame([(x,) for x in names], "symbol string")

    def tickers(session):
        one = [("N", t0 + 1000, 1.0, 4.0, 1.0, 2.0, 9.0, 9.0)] if seen else []
        return session.createDataFrame(one, "symbol string, event_time_ms bigint, open double, high double, low double, close double, volume double, turnover double")

    jobs.start_exact(stream_of(spark, folder), root, periods=("1m",), registry=registry, tickers=tickers, availableNow=True).awaitTermination()
    got = {(r.symbol, (r.open_time - t0) // 60_000): (r.open, r.close, r.trade_count) for r in S.read_current(spark, f"{root}/bars").collect()}
    assert got == {
        ("A", 0): (5, 5, 1), ("A", 1): (6, 6, 1), ("A", 2): (7, 7, 1),
        ("HOT", 0): (10, 10, 1), ("HOT", 3): (12, 12, 1),
        ("N", 0): (2, 2, 0), ("N", 1): (2, 2, 0), ("N", 2): (3, 3, 1),
    }


def test_repeated_batch_changes_nothing(spark):
    """A batch depends on its trades and seeds alone."""
    rows = random_rows(100, 600_000, span_ms=3_600_000)
    first = jobs.fold_batch(tape(spark, rows[:50]), None, ("1m",))
    seeds = first.filter(~F.col("is_final"))
    again = [bars_of(jobs.fold_batch(tape(spark, rows[50:]), seeds, ("1m",))) for _ in range(2)]
    assert again[0] == again[1]
    quiet = jobs.changes(jobs.fold_batch(tape(spark, rows[50:50]), seeds, ("1m",)), seeds)
    assert quiet.count() == 0


def test_relaxed_weeks_start_on_monday(spark, tmp_path):
    rows = random_rows(100, 0, span_ms=21 * 86_400_000)
    write_in_parts(spark, rows, str(tmp_path / "in"))
    bars = jobs.relaxed(stream_of(spark, str(tmp_path / "in")), "1w", "1 hour")
    q = (
        bars.writeStream.format("parquet").option("path", str(tmp_path / "bars"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {(r.symbol, r.open_time, r.open, r.close, r.trade_count) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    batch = B.build_bars(tape(spark, rows), ("1w",))
    want = {(r.symbol, r.open_time, r.open, r.close, r.trade_count) for r in batch.collect()}
    last = max(w[1] for w in want)
    assert got == {w for w in want if w[1] < last}


def test_ticks(spark):
    bounds = spark.createDataFrame([(86_399_000, 86_400_000 + 180_000)], "start_ms bigint, end_ms bigint")
    assert sorted(r[0] for r in clock.ticks(bounds, 150).collect()) == [86_400_150, 86_460_150, 86_520_150]
    assert clock.live_ticks(spark, 150).isStreaming


@pytest.mark.parametrize("chunk", [2, 7, 100, 10**6])
def test_smoothed_delay(spark, chunk):
    import math
    import random

    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.8 else "cold", i * 5_000_000, rnd.choice([0, 0, 1, 3, 40, 900])) for i in range(200)]
    data += [("below", i, x) for i, x in enumerate([-4, 10, -3, 7, 0, -1, 1, 0, -7])]
    data += [("far", i, x) for i, x in enumerate([3, 1 << 40, 5, *[2] * 150, -(1 << 35), *[1] * 150])]
    got = {(r.key, r.seq): r.avg_delay_ms for r in C.smoothed_delay(spark.createDataFrame(data, "key string, seq bigint, delay_ms bigint"), chunk).collect()}
    state = {}
    for k, i, x in data:
        a = state.get(k, 0)
        state[k] = x if a == 0 else math.floor(0.2 * x + 0.8 * a + 0.5)
        assert got[k, i] == state[k]


def test_clock_sync(spark):
    s = spark.createDataFrame([("x", 1, 1000, 1041, 1500), ("x", 2, 2000, 2010, 1990)], "key string, seq bigint, sent_ms bigint, received_ms bigint, server_ms bigint")
    m = C.measured(s).orderBy("seq").collect()
    assert [(r.delay_ms, r.skew_ms, r.calibrated_ms) for r in m] == [(20, 459, 1500), (5, -20, 1990)]
    for now, valid in ((2010 + 299_999, True), (2010 + 300_000, False)):
        assert C.latest_sync(C.measured(s), F.lit(now)).first().valid is valid
