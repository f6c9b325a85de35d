"""Bars, commands and silence from keyed state, against row-by-row versions."""

import random
import uuid
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fold import bars_of
from test_bars import folded, random_rows, tape
from test_stream import PERIODS, stream_of, write_in_parts
from tickbars.operators import bars as B
from tickbars.operators import universe as U
from tickbars.queries import stream_queries as SQ
from tickbars.streaming import jobs, keyed

DRAIN = {"availableNow": True}


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("grace", [None, 150])
def test_equals_fold_over_batches_and_a_restart(spark, tmp_path, grace):
    rows = random_rows(240, 1_800_000 if grace is None else 120_000, span_ms=6 * 3_600_000)
    root = str(tmp_path / "out")
    for upto in (130, 240):
        write_in_parts(spark, rows[:upto], str(tmp_path / "in"), 65)
        events = keyed.as_events(stream_of(spark, str(tmp_path / "in")))
        keyed.start(events, root, PERIODS, grace_ms=grace, trigger=DRAIN).awaitTermination()
    want = folded(rows, PERIODS, grace).result()
    assert bars_of(keyed.all_bars(spark, root)) == want
    opened = {(r.symbol, r.period, r.open_time) for r in keyed.open_bars(spark, root).collect()}
    assert opened == {k for k, (_, final) in want.items() if not final}
    dropped = B.late_trades(tape(spark, rows), PERIODS, clock_grace_ms=grace).groupBy("symbol", "period").count()
    late = {(r.symbol, r.period): r.late for r in keyed.late_counts(spark, root).collect()}
    assert late == {(r.symbol, r.period): r["count"] for r in dropped.collect()}


def test_a_busy_symbol_is_a_few_runs(spark):
    minute = 60_000
    rows = [("hot", 1.0 + i % 7, 1.0, 600 * minute + i * 20, True, i, 600 * minute + i * 20) for i in range(30_000)]
    rows += [("cold", 2.0, 1.0, 600 * minute + i * minute, True, i * 3_000 + 7, 600 * minute + i * minute) for i in range(10)]
    events = keyed.as_events(tape(spark, rows).filter(F.col("seq").isNotNull()))
    found = keyed.runs(events, ("1m",), 150)
    assert {r.symbol: r["count"] for r in found.groupBy("symbol").count().collect()} == {"hot": 20, "cold": 10}
    assert found.agg(F.sum("trade_count")).first()[0] == len(rows)


def test_runs_of_a_symbol_are_handled_some_at_a_time():
    n = 3 * keyed.AT_ONCE + 5
    whole = pd.DataFrame({"kind": "trade", "symbol": "a", "first_seq": [(i * 7919) % n for i in range(n)], "close": 1.0})
    parts = list(keyed._in_order(iter([whole[:n // 2], whole[n // 2 :]])))
    assert [len(p) for p in parts] == [keyed.AT_ONCE] * 3 + [5] and "symbol" not in parts[0]
    assert [x for p in parts for x in p["first_seq"]] == list(range(n))
    assert parts[0].to_dict("records")[0] == {"kind": "trade", "first_seq": 0, "close": 1.0}


@pytest.mark.parametrize("name", ["keyed_bars_clock", "stream_bars_clock"])
def test_long_tapes_have_more_batches_of_several_files(spark, monkeypatch, tmp_path, name):
    from oracle import compare, connect

    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(SQ, "_BATCH_ROWS", 200)
    monkeypatch.setattr(SQ, "_FILE_ROWS", 60)
    monkeypatch.setattr(SQ, "_root", lambda _: str(tmp_path))
    assert compare(spark, connect(sf_dir), name, SQ.QUERIES[name], SQ.SQL[name], sf_dir) is None
    folder = tmp_path / ("events" if name.startswith("keyed") else "tape")
    assert len(list(folder.glob("*.parquet"))) == 5 * 4


def commands_and_trades(seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for i in range(300):
        seq += 1
        at = 500_000 * 3_600_000 + i * 240_000 + rng.randrange(120_000)
        symbol, kind = rng.choice("AB"), rng.choices(["trade", "add", "remove"], [12, 1, 1])[0]
        trade = kind == "trade"
        rows.append((kind, symbol, seq, None, rng.uniform(1, 9) if trade else None, 1.0 if trade else None, at if trade else 0, True if trade else None))
    return rows


@pytest.mark.parametrize("size", [300, 47, 11])
def test_adds_and_removes_at_any_cut(spark, tmp_path, size):
    rows = commands_and_trades(4)
    for n, at in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[at : at + size], keyed.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keyed.EVENT_SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    keyed.start(stream, root, ("1h", "1d"), managed=True, trigger=DRAIN).awaitTermination()
    every = spark.createDataFrame(rows, keyed.EVENT_SCHEMA)
    spans = U.lifetimes(every.filter("kind != 'trade'").select("symbol", "seq", "kind"))
    want = U.managed_bars(every.filter("kind = 'trade'").select("symbol", "price", "quantity", "ts_ms", "is_buyer_maker", "seq"), spans, periods=("1h", "1d"), gaps=True)
    key = ["symbol", "epoch", "period", "open_time", "open", "close", "trade_count", "is_final"]
    got = {tuple(r[c] for c in key) for r in keyed.all_bars(spark, root).select(key).collect()}
    assert got == {tuple(r[c] for c in key) for r in want.select(key).collect()} and got


def test_ticker_of_an_add_and_a_tick(spark, tmp_path):
    hour = 3_600_000
    start = 400_000 * hour
    rows = [
        ("add", "A", 1, start, 5.0, None, start + 10, None),
        ("trade", "B", 2, start + 20, 7.0, 1.0, start + 20, True),
        ("trade", "A", 3, start + 30, 6.0, 1.0, start + 30, True),
        ("remove", "A", 4, start + 40, None, None, 0, None),
        ("add", "A", 5, start + 50, 8.0, None, start + 50, None),
        ("tick", None, 6, start + 2 * hour + 150, None, None, None, None),
    ]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], keyed.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keyed.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed.start(stream, str(tmp_path / "out"), ("1h",), grace_ms=150, managed=True, trigger=DRAIN).awaitTermination()
    found = {(r.symbol, r.epoch, (r.open_time - start) // hour, r.open, r.close, r.trade_count, r.is_final) for r in keyed.all_bars(spark, str(tmp_path / "out")).collect()}
    assert found == {
        ("A", 1, 0, 6.0, 6.0, 1, False),  # removed while open
        ("A", 5, 0, 8.0, 8.0, 0, True),  # closed by the clock, without a trade
        ("A", 5, 1, 8.0, 8.0, 0, True),
        ("A", 5, 2, 8.0, 8.0, 0, False),
    }


def test_starts_from_stored_bars(spark, tmp_path):
    rows = random_rows(120, 60_000, span_ms=4 * 3_600_000)
    first, second = rows[:60], rows[60:]
    done = B.build_bars(tape(spark, first), PERIODS, arrival_order=True, gaps=True)
    seeds = done.filter(~F.col("is_final"))
    write_in_parts(spark, second, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    events = keyed.as_events(stream_of(spark, str(tmp_path / "in")))
    keyed.start(events, root, PERIODS, initial=seeds, trigger=DRAIN).awaitTermination()
    want = bars_of(B.build_bars(tape(spark, second), PERIODS, arrival_order=True, gaps=True, seeds=seeds.drop("is_final")))
    assert bars_of(keyed.all_bars(spark, root)) == want


@pytest.mark.parametrize("files", [1, 5])
def test_silence(spark, tmp_path, files):
    rng = random.Random(files)
    rows, at = [], 1_700_000_000_000
    for seq in range(400):
        at += rng.choice([0, 10, 5_000, 20_000])
        rows.append((rng.choice("AAAAABC"), seq, at))
    for part in range(files):
        some = rows[part * 400 // files : (part + 1) * 400 // files]
        spark.createDataFrame(some, "symbol string, seq bigint, arrival_ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, seq bigint, arrival_ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"silence_{uuid.uuid4().hex}"
    keyed.silences(stream, 60_000).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = set()
    for symbol in "ABC":
        times = [t for s, _, t in rows if s == symbol]
        for a, b in zip(times, [*times[1:], None]):
            if (at if b is None else b) - a > 60_000:
                want.add((symbol, "silent", a, a + 60_000))
                if b is not None:
                    want.add((symbol, "back", a, b))
    found = [tuple(r) for r in spark.table(name).collect()]
    assert set(found) == want and len(found) == len(want) > 2


def test_stale_input_listener():
    warned = []
    listener = jobs.StaleInput(lambda name, s: warned.append((name, s)), limit_s=60)

    def progress(second, rows):
        stamp = f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000Z"
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", name="bars", timestamp=stamp, numInputRows=rows)))

    for second, rows in [(0, 0), (30, 5), (80, 0), (90, 0), (91, 0), (95, 3), (150, 0)]:
        progress(second, rows)
    listener.onQueryIdle(SimpleNamespace(id="q", timestamp="2024-01-01T00:03:00.000Z"))
    assert warned == [("bars", 61.0), ("q", 85.0)]
    listener.onQueryTerminated(SimpleNamespace(id="q"))
    listener.onQueryIdle(SimpleNamespace(id="q", timestamp="2024-01-01T01:00:00.000Z"))
    assert len(warned) == 2
