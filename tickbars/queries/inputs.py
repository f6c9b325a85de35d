"""The given tables read as trades, instruments and log lines, with the same in SQL.

``events`` is the trade tape: one symbol per event type, price = value, quantity = the
number in ``props``, arrival order = event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.functions.periods import DAY_MS
from tickbars.functions.timefns import ntz_to_ms
from tickbars.operators.running import numbered
from tickbars.session import prepare

# Scatter of the arrival order, in positions of the tape.
SCATTER = 256
# Delay of arrivals against trade time, in ms.
DELAY_MS = 120_000
CLOCK_GRACE_MS = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        ntz_to_ms(F.col("ts")).alias("ts_ms"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        F.col("event_id").alias("seq"),
    )


TRADES = """SELECT event_type AS symbol, value AS price,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS quantity, epoch_us(ts) // 1000 AS ts_ms,
  user_id % 2 = 0 AS is_buyer_maker, event_id AS seq FROM events"""


def scattered_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape in a different arrival order: each trade slips by up to SCATTER positions.

    Two trades share a slipped position only if their ids are closer than SCATTER, so the
    remainder of the id makes ``seq`` unique at any size.
    """
    return trades(spark, sf_dir).withColumn("seq", scatter(F.col("seq")))


def scatter(seq: Column) -> Column:
    return (seq + (seq * 7919) % SCATTER) * SCATTER + seq % SCATTER


SCATTERED = f"""SELECT * REPLACE ((seq + (seq * 7919) % {SCATTER}) * {SCATTER} + seq % {SCATTER} AS seq)
  FROM ({TRADES})"""


def delayed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with an arrival clock: each trade arrives up to DELAY_MS after its time.

    ``seq`` numbers the trades by arrival and then by id. They are counted per day of arrival, so only a day is
    sorted at a time.
    """
    arrival = F.col("ts_ms") + (F.col("seq") * 7919) % DELAY_MS
    tape = trades(spark, sf_dir).withColumn("arrival_ms", arrival).withColumnRenamed("seq", "_id")
    return numbered(tape, ["arrival_ms", "_id"], F.floor(F.col("arrival_ms") / DAY_MS), "seq").drop("_id")


DELAYED = f"""SELECT * REPLACE (row_number() OVER (ORDER BY arrival_ms, seq) AS seq) FROM (
  SELECT *, ts_ms + (seq * 7919) % {DELAY_MS} AS arrival_ms FROM ({TRADES}))"""

# Period dimension in SQL.
PERIOD_ROWS = """(VALUES ('1m', 0, 60000::BIGINT, 0), ('5m', 1, 300000, 0), ('30m', 2, 1800000, 0),
  ('1h', 3, 3600000, 0), ('4h', 4, 14400000, 0), ('1d', 5, 86400000, 0),
  ('1w', 6, 604800000, 259200000)) AS p(period, ordinal, ms, shift)"""


def sql_floor(ts: str, ms: str = "ms", shift: str = "shift") -> str:
    return f"({ts} - ({ts} + {shift}) % {ms})"


SQL_OHLCV = """arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(quantity) AS volume, sum(price * quantity) AS turnover,
  count(*) AS trade_count,
  sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE quantity END) AS taker_buy_volume,
  sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE price * quantity END) AS taker_buy_turnover"""

MONEY = ("volume", "turnover", "taker_buy_volume", "taker_buy_turnover")


def rounded(df: DataFrame) -> DataFrame:
    """Sums rounded so that the order of addition does not show."""
    return df.select(*(F.round(c, 4).alias(c) if c in MONEY else F.col(c) for c in df.columns))


def sql_rounded(inner: str, columns: str = "*") -> str:
    parts = ", ".join(f"round({c}, 4) AS {c}" for c in MONEY)
    return f"SELECT {columns} REPLACE ({parts}) FROM ({inner})"


def sql_bars(trades_sql: str = TRADES, periods: str = PERIOD_ROWS) -> str:
    return f"""SELECT symbol, period, {sql_floor('ts_ms')} AS open_time, {SQL_OHLCV}
  FROM ({trades_sql}) CROSS JOIN {periods} GROUP BY ALL"""
