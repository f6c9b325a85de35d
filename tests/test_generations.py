"""Stored bars that are compacted, retired and deleted from while they are read."""

import os

import pytest

from fold import bars_of
from test_bars import folded, random_rows
from test_store import BASE, bar, bars
from test_stream import PERIODS, stream_of, write_in_parts
from tickbars.sinks.generations import Generations
from tickbars.streaming import jobs


def files_below(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def content(df):
    return {(r.symbol, r.period, r.open_time - BASE): (r.close, r.trade_count, r.is_final) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Generations(spark, str(tmp_path / "bars"))


def test_batches_compaction_and_repeats(spark, store, tmp_path):
    assert store.read().count() == 0 and store.compact() == []
    store.append(bars(spark, bar("A", "1m", 1, 1.0, 5, True), bar("A", "1m", 2, 1.0, 5, False), bar("B", "1d", 40, 9.0, 1, True)), 0)
    store.append(bars(spark, bar("A", "1m", 1, 2.0, 9, False), bar("A", "1m", 2, 3.0, 6, True)), 1)
    want = {("A", "1m", 60_000): (1.0, 5, True), ("A", "1m", 120_000): (3.0, 6, True), ("B", "1d", 40 * 86_400_000): (9.0, 1, True)}
    assert content(store.read()) == want
    store.append(bars(spark, bar("A", "1m", 1, 7.0, 99, True)), 1)  # the same batch again
    assert content(store.read()) == want
    assert len(store.compact()) == 2 and content(store.read()) == want
    before = files_below(str(tmp_path / "bars/data"))
    store.append(bars(spark, bar("A", "1m", 3, 4.0, 1, False)), 2)
    daily = {f for f in before if "period=1d" in f and "base" in f}
    assert [p for p, _ in store.compact()] == ["1m"]
    store.retire(keep=1)
    after = files_below(str(tmp_path / "bars/data"))
    assert daily <= after and all("base" in f for f in after)  # the untouched partition kept its file
    store.append(bars(spark, bar("A", "1m", 1, 7.0, 99, True)), 1)  # an older batch, after compaction
    assert content(store.read()) == want | {("A", "1m", 180_000): (4.0, 1, False)}


def test_a_reader_stays_with_its_generation(spark, store):
    store.append(bars(spark, bar("A", "1m", 1, 1.0, 5, False)), 0)
    reader = store.read()
    store.append(bars(spark, bar("A", "1m", 1, 2.0, 6, True)), 1)
    store.compact()
    store.retire(keep=3)
    assert content(reader) == {("A", "1m", 60_000): (1.0, 5, False)}
    assert content(store.read()) == {("A", "1m", 60_000): (2.0, 6, True)}
    assert len(store.versions()) == 3 and content(store.read(0)) == content(reader)


def test_deleted_symbols(spark, store, tmp_path):
    store.append(bars(spark, *(bar(s, p, k) for s in "ABC" for p in ("1m", "1d") for k in (1, 2)), bar("C", "1h", 5)), 0)
    store.compact()
    store.retire(keep=1)
    before = files_below(str(tmp_path / "bars/data"))
    store.delete(spark.createDataFrame([("A",), ("C",), ("C",), ("Z",)], "symbol string"))
    assert files_below(str(tmp_path / "bars/data")) == before
    assert {k[0] for k in content(store.read())} == {"B"}
    store.append(bars(spark, bar("A", "1m", 9)), 1)  # listed again
    want = {("B", p, k * ms) for p, ms in (("1m", 60_000), ("1d", 86_400_000)) for k in (1, 2)} | {("A", "1m", 540_000)}
    assert set(content(store.read())) == want
    assert [p for p, _ in store.compact()] == ["1m"] and set(content(store.read())) == want
    store.retire(keep=1)
    kept = files_below(str(tmp_path / "bars/data"))
    assert {f for f in before if "period=1m" not in f} <= kept
    assert sorted(p for p, _ in store.compact(purge=True)) == ["1d", "1h"] and set(content(store.read())) == want
    store.retire(keep=1)
    left = spark.read.parquet(str(tmp_path / "bars/data"))
    assert {(r.symbol, r.period) for r in left.collect()} == {("A", "1m"), ("B", "1m"), ("B", "1d")}
    assert all(r.kind == "base" for r in store.manifest()) and not os.listdir(str(tmp_path / "bars/deleted"))


def test_compacted_bars_are_not_ranked_again(spark, store):
    """A folder that compaction wrote holds each key once: only partitions with batches are ranked on reading."""
    ranks = lambda df: "Window" in df._jdf.queryExecution().optimizedPlan().toString()
    store.append(bars(spark, bar("A", "1m", 1, 1.0, 5, False), bar("A", "1m", 1, 2.0, 9, True), bar("B", "1d", 40), bar("C", "1d", 40)), 0)
    assert ranks(store.read())
    store.compact()
    store.delete(spark.createDataFrame([("C",)], "symbol string"))
    want = {("A", "1m", 60_000): (2.0, 9, True)}
    daily = {k: v for k, v in content(store.read()).items() if k[1] == "1d"}
    assert not ranks(store.read()) and {k[0] for k in daily} == {"B"} and content(store.read()) == want | daily
    store.append(bars(spark, bar("A", "1m", 1, 7.0, 99, True)), 1)
    want = {("A", "1m", 60_000): (7.0, 99, True)}
    assert ranks(store.read()) and content(store.read()) == want | daily
    store.compact(purge=True)
    assert not ranks(store.read()) and content(store.read()) == want | daily


def test_files_stay_few_over_many_batches(spark, store, tmp_path):
    files = []
    for batch in range(50):
        store.append(bars(spark, bar("A", "1m", batch), bar("A", "1h", batch // 10, float(batch), batch + 1, False)).coalesce(1), batch)
        if batch % 10 == 9:
            store.compact()
            store.retire()
        files.append(len(files_below(str(tmp_path / "bars/data"))))
    # batches since the last compaction, and those of the generation before it
    assert max(files) <= 2 * 2 * 10 + 4 and len(store.versions()) == 2
    assert len(content(store.read())) == 55
    store.retire(keep=1)
    assert len(files_below(str(tmp_path / "bars/data"))) == 2


def test_a_stream_compacts_its_own_bars(spark, tmp_path):
    rows = random_rows(120, 60_000, span_ms=5 * 3_600_000)
    write_in_parts(spark, rows, str(tmp_path / "in"), 20)
    root = str(tmp_path / "out")
    jobs.start_exact(stream_of(spark, str(tmp_path / "in")), root, periods=PERIODS, compact_every=2, availableNow=True).awaitTermination()
    store = Generations(spark, f"{root}/bars")
    assert bars_of(store.read()) == folded(rows, PERIODS).result()
    assert {r.kind for r in store.manifest()} == {"base"} and len(store.versions()) == 2
