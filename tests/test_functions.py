import pytest
from pyspark.sql import functions as F

from tickbars.functions import timefns as T
from tickbars.functions.errors import ERRORS, classify_error
from tickbars.functions.periods import base_ms, period_ms

# ts, Monday floor
WEEKS = [
    (0, -259200000),
    (1704067200000, 1704067200000),
    (1704240000000, 1704067200000),
    (1704412800000, 1704067200000),
    (1735689600000, 1735516800000),
    (1704283200000, 1704067200000),
]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame(WEEKS, "ts bigint, want bigint")
    for r in df.select("want", T.bar_open(F.col("ts"), "1w").alias("a"), T.align(F.col("ts"), F.lit("1w")).alias("b")).collect():
        assert r.a == r.b == r.want
    weekday = df.select(F.weekday(F.timestamp_millis(T.bar_open(F.col("ts"), "1w")))).distinct().collect()
    assert [tuple(r) for r in weekday] == [(0,)]


@pytest.mark.parametrize(
    "text, ms", [("1m", 60_000), ("4h", 14_400_000), ("1d", 86_400_000), ("2w", 1_209_600_000), ("1M", 60_000), ("xh", 3_600_000)]
)
def test_lenient_intervals(spark, text, ms):
    assert spark.range(1).select(T.interval_to_ms(F.lit(text))).first()[0] == ms


def test_strict_periods(spark):
    with pytest.raises(ValueError):
        period_ms("3d")
    assert spark.range(1).select(T.ms_of(F.lit("3d"))).first()[0] is None
    assert base_ms(("1h", "1w")) == 3_600_000 and base_ms(("1m", "1d")) == 60_000


def test_clock_arithmetic(spark):
    now = F.lit(1_704_067_230_500)
    r = spark.range(1).select(
        T.safe_end(now).alias("safe"),
        T.next_tick_ms(now, F.lit(40)).alias("tick"),
        T.next_tick_ms(now, F.lit(-90)).alias("least"),
        T.best_request_ms(now, F.lit(7), F.lit(20)).alias("best"),
        T.date_to_ms(F.lit("2024-01-01")).alias("day"),
        T.date_to_ms(F.lit("soon")).alias("none"),
        T.ms_to_text(now, millis=True).alias("text"),
    ).first()
    assert r.safe == 1_704_067_140_000
    assert r.tick == 1_704_067_260_180 and r.least == 1_704_067_260_100
    assert r.best == 1_704_067_260_000 - 7 - 20 - 30
    assert r.day == 1_704_067_200_000 and r.none is None
    assert r.text == "2024-01-01 00:00:30.500"


def test_every_error_kind(spark):
    rows = [(f"{k}: detail", *v) for k, v in ERRORS.items()] + [
        ("Database error: table is busy", *ERRORS["Database error"][:2], True),
        ("nonsense", *ERRORS["Unknown error"]),
    ]
    df = spark.createDataFrame(rows, "m string, c string, i string, r boolean")
    for r in df.select("*", classify_error(F.col("m")).alias("e")).collect():
        assert (r.e.category, r.e.impact, r.e.retryable) == (r.c, r.i, r.r), r.m
