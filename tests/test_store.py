import glob
import json

from pyspark.sql import functions as F

from tickbars.operators import quality as Q
from tickbars.plans import audit as A
from tickbars.plans import backfill as P
from tickbars.sinks import store as S

BASE = 1_704_067_200_000
BAR = (
    "symbol string, period string, open_time bigint, open double, high double, low double, close double, volume double, turnover double, "
    "trade_count bigint, taker_buy_volume double, taker_buy_turnover double, is_final boolean"
)


def bar(symbol, period, k, close=1.0, count=1, final=True):
    ms = {"1m": 60_000, "1h": 3_600_000, "1d": 86_400_000}[period]
    return (symbol, period, BASE + k * ms, 1.0, 2.0, 0.5, close, 3.0, 4.0, count, 1.0, 1.0, final)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def test_upsert_rules_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "b")
    S.write_batch(bars(spark, bar("A", "1m", 0, 1.0, 5, True), bar("A", "1m", 1, 1.0, 5, False), bar("A", "1m", 2, 1.0, 5, False)), path, 0)
    second = bars(spark, bar("A", "1m", 0, 9.0, 9, False), bar("A", "1m", 1, 9.0, 1, True), bar("A", "1m", 2, 9.0, 5, False))
    for _ in range(2):
        S.write_batch(second, path, 1)
    got = {r.open_time: (r.close, r.is_final) for r in S.read_current(spark, path).collect()}
    assert got == {BASE: (1.0, True), BASE + 60_000: (9.0, True), BASE + 120_000: (9.0, False)}
    S.compact(spark, [path], str(tmp_path / "c"))
    S.write_batch(bars(spark, bar("A", "1m", 2, 7.0, 6, True)), str(tmp_path / "b2"), 2)
    both = S.read_current(spark, str(tmp_path / "c"), str(tmp_path / "b2"))
    assert {r.open_time: r.close for r in both.collect()}[BASE + 120_000] == 7.0
    assert both.count() == 3


def test_range_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "b")
    S.write_batch(bars(spark, *(bar(s, p, k) for s in "AB" for p in ("1h", "1d") for k in range(0, 60, 3))), path, 0)
    S.compact(spark, [path], str(tmp_path / "c"))
    # straight from a compacted table, and through the merge of unfolded batches
    for table in (spark.read.parquet(str(tmp_path / "c")), S.read_current(spark, path)):
        got = S.range_scan(table, "A", "1d", BASE + 86_400_000 * 3, BASE + 86_400_000 * 9)
        assert [(r.open_time - BASE) // 86_400_000 for r in got.collect()] == [3, 6, 9]
        plan = got._jdf.queryExecution().executedPlan().toString()
        pruned = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert "period" in pruned and "month" in pruned
        assert "EqualTo(symbol,A)" in plan


def test_reads(spark):
    t = bars(spark, *(bar("A", "1m", k) for k in range(5)), bar("B", "1m", 9), bar("A", "1h", 0))
    newest = {(r.symbol, r.period): r.open_time for r in S.latest_per_series(t).collect()}
    assert newest == {("A", "1m"): BASE + 240_000, ("B", "1m"): BASE + 540_000, ("A", "1h"): BASE}
    assert S.latest_n(t, 2).count() == 4
    r = S.ready(t, "A", "1m", 5).first()
    assert (r.bars, r.ready) == (5, True)
    wanted = spark.createDataFrame([("A", "1m"), ("Z", "1m")], "symbol string, period string")
    assert {r.symbol: r.close for r in S.latest_for(wanted, t).collect()} == {"A": 1.0, "Z": None}


def test_names_csv_push_and_report(spark, tmp_path):
    t = bars(spark, bar("BTCUSDT", "1m", 0), bar("BTCUSDT", "1h", 0, final=False))
    name = S.series_name(F.col("symbol"), F.col("period"))
    assert {r[0] for r in t.select(name).collect()} == {"k_btc_1m", "k_btc_1h"}
    parts = S.series_parts(F.lit("k_btc_1m"))
    assert tuple(spark.range(1).select(*parts).first()) == ("BTCUSDT", "1m")
    stored = S.to_stored(t)
    S.write_csv(S.of_period(stored, "1m"), str(tmp_path / "csv"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "csv/*.csv")))
    assert text.strip() == f"{BASE},1.0,2.0,0.5,1.0,3.0,{BASE + 59_999},4.0,1,1.0,1.0,0"
    m = S.push_messages(t).first()
    assert [b["period"] for b in json.loads(m.message)] == ["1h", "1m"]
    compared = Q.compare(t, t.filter("period = '1h'"))
    S.write_report(Q.mismatches(compared), Q.audit_summary(compared), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/differences")).first().outcome == "ExtraInLocal"
    assert spark.read.json(str(tmp_path / "report/summary")).first().success_rate == 50.0


def test_compare_tolerance_and_last_wins(spark):
    a = bars(spark, bar("A", "1m", 0, 1.0), bar("A", "1m", 1, 1.0), bar("A", "1m", 2, 1.0, count=2))
    b = bars(spark, bar("A", "1m", 0, 1.0 + 5e-9), bar("A", "1m", 1, 1.0 + 5e-8), bar("A", "1m", 2, 1.0, count=3))
    out = {r.open_time: r.outcome for r in Q.compare(a, b).collect()}
    assert out == {BASE: "match", BASE + 60_000: "FieldMismatch", BASE + 120_000: "FieldMismatch"}
    twice = bars(spark, bar("A", "1m", 0, 5.0), bar("A", "1m", 0, 1.0)).withColumn("n", F.when(F.col("close") == 1.0, 2).otherwise(1))
    one = bars(spark, bar("A", "1m", 0, 1.0)).withColumn("n", F.lit(1))
    assert [r.outcome for r in Q.compare(twice, one, arrival="n").collect()] == ["match"]
    empty = Q.audit_summary(Q.compare(a.limit(0), b.limit(0))).first()
    assert (empty.total_checked, empty.success_rate) == (0, 100.0)


def test_audit_leaves_out_open_bars(spark):
    now = BASE + 3_600_000 + 30_000  # half a minute into the second hour
    t = bars(spark, *(bar("A", "1m", k) for k in range(62)), bar("A", "1h", 0), bar("A", "1h", 1))
    got = A.audit_cycle(t, t, now, trailing_ms=7_200_000)
    # the safe end is 00:59, so neither hour bar has ended by then
    assert {(r.period, r.open_time) for r in got.collect()} == {("1m", BASE + k * 60_000) for k in range(59)}
    by_open = A.audit_cycle(t, t, now, trailing_ms=7_200_000, by_open=True)
    assert ("1h", BASE) in {(r.period, r.open_time) for r in by_open.collect()}


def test_plan_edges(spark):
    now = BASE + 123
    status = spark.createDataFrame(
        [("A", "1m", BASE - 60_000 * 1000), ("B", "1m", BASE - 60_000 * 1001), ("C", "1m", BASE + 60_000), ("D", "1m", None), ("E", "1w", None)],
        "symbol string, period string, last_open_time bigint",
    )
    tasks = {(r.symbol, r.start_time): r.end_time for r in P.split_ranges(P.plan(status, now)).collect()}
    start = BASE - 60_000 * 1001
    assert tasks["A", BASE - 60_000_000] == now
    assert tasks["B", start] == start + 59_999_999 and tasks["B", start + 60_000_000] is None
    assert not any(s == "C" for s, _ in tasks)
    assert ("D", now - 60_000_000 - 123) in tasks
    assert ("E", 1567900800000 - 6 * 86_400_000) in tasks


def test_retry_rounds(spark):
    f = spark.createDataFrame([("A", "1m", 0, 5, "API error: x"), ("B", "1m", 0, 6, "API error: x")], "symbol string, period string, start_time bigint, retries int, message string")
    assert P.retry_selection(f, 1).count() == 0
    assert [r.symbol for r in P.retry_selection(f, 2).collect()] == ["A"]


def test_downloaded_files_become_bars(spark, tmp_path):
    row = lambda t, c: [t, "1", "2", "0.5", c, "3", t + 59_999, "4", 7, "1", "2", "0"]
    with open(tmp_path / "r.json", "w") as f:
        for at, rows in ((1, [row(0, "1.0"), row(60_000, "1.1")]), (2, [row(60_000, "1.2"), row(120_000, "bad")])):
            f.write(json.dumps({"symbol": "A", "period": "1m", "fetched_ms": at, "value": json.dumps(rows)}) + "\n")
    got = {r.open_time: r.close for r in P.from_rest_files(spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 60_000: 1.2, 120_000: 0.0}


def test_inconsistent_groups_show_ten_names(spark):
    rows = [bar("BTC", "1m", 9)] + [bar(f"S{i:02d}", "1m", 3) for i in range(14)] + [bar("OK", "1m", 9)] + [bar("S00", "1h", 0)]
    c = Q.last_bar_vs_benchmark(bars(spark, *rows), "BTC")
    r = Q.inconsistent_groups(c).first()
    assert r.symbols == ",".join(f"S{i:02d}" for i in range(10)) and r.more == 4
    assert [(x.period, x.symbols, x.inconsistent) for x in Q.benchmark_totals(c).collect()] == [("1m", 15, 14)]
