"""Rounds of catching up before a stream, throttled writes, counters."""

import pytest
from pyspark.sql import Row
from types import SimpleNamespace

from fold import bars_of
from test_bars import folded, random_rows, tape
from test_stream import PERIODS, stream_of, write_in_parts
from tickbars.streaming import jobs, metrics, throttle


@pytest.mark.parametrize("ends, begins", [((60, 120), (0, 60, 120)), ((60, 60), (0, 0, 0)), ((30, 150), (0, 29, 1)), ((100, 101), (0, 99, 50))])
def test_overlaps_count_once(spark, tmp_path, ends, begins):
    rows = random_rows(180, 600_000, span_ms=5 * 3_600_000)
    root = str(tmp_path / "out")
    for begin, end in zip(begins, ends):
        jobs.hand_over(spark, root, tape(spark, rows[begin:end]), PERIODS)
    write_in_parts(spark, rows[begins[2] :], str(tmp_path / "in"), 90)
    jobs.start_after_rounds(stream_of(spark, str(tmp_path / "in")), root, periods=PERIODS, availableNow=True).awaitTermination()
    assert bars_of(jobs.bars_after_rounds(spark, root)) == folded(rows, PERIODS).result()


def test_a_round_without_its_marks_is_repeated(spark, tmp_path):
    rows, root = random_rows(60, 60_000, span_ms=3_600_000), str(tmp_path / "out")
    jobs.hand_over(spark, root, tape(spark, rows[:30]), PERIODS)
    tape(spark, rows[:5]).write.parquet(f"{root}/rounds/1/bars")  # what a failed round may leave
    jobs.hand_over(spark, root, tape(spark, rows[10:60]), PERIODS)
    assert jobs._rounds(spark, root) == [0, 1]
    assert jobs.marks(spark, root).agg({"upto": "max"}).first()[0] == 59


MINUTE = 60_000


@pytest.mark.parametrize("files", [1, 4])
def test_changes_wait_for_second_30(spark, tmp_path, files):
    base = 28_000_000 * MINUTE
    came = [0, 29_999, 30_000, 30_001, 89_999, 90_000, 95_000, 250_000, 251_000]
    rows = [("A" if n % 3 else "B", n, base + at) for n, at in enumerate(came)]
    for n in range(files):
        part = rows[n * len(rows) // files : (n + 1) * len(rows) // files]
        spark.createDataFrame(part, "k string, seq bigint, at_ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, seq bigint, at_ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    throttle.start(stream, root, ("k",), availableNow=True).awaitTermination()
    before = {(r.k, r.seq) for r in throttle.written(spark, root).collect()}
    newest = {}
    for k, seq, at in rows:
        due = (at + 30_000) // MINUTE * MINUTE + 30_000
        newest[k, due] = (k, seq)
    assert before == {v for (_, due), v in newest.items() if due <= rows[-1][2]}
    for _ in range(2):
        throttle.drain(spark, root)
        assert sorted((r.k, r.due_ms, r.seq) for r in throttle.written(spark, root).collect()) == sorted((k, due, s) for (k, due), (_, s) in newest.items())


def test_a_repeated_batch_is_counted_once():
    counters = metrics.Counters()

    def progress(batch, **found):
        observed = {"bars": Row(**found)}
        counters.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=batch, observedMetrics=observed)))

    progress(0, late_trades=2, closed_bars=5)
    progress(1, late_trades=1, closed_bars=4)
    progress(1, late_trades=3, closed_bars=4)
    progress(2, late_trades=None, closed_bars=0)
    assert counters.totals("q") == {"late_trades": 5, "closed_bars": 9} and counters.last("q")["closed_bars"] == 0
    assert counters.totals("other") == {} and not counters.wait(0)
