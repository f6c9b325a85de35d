"""Registered queries over stored bars, plans, audits and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickbars.functions import timefns as T
from tickbars.functions.errors import classify_error
from tickbars.functions.periods import PERIODS
from tickbars.operators import bars as B
from tickbars.operators import quality as Q
from tickbars.operators import universe as U
from tickbars.plans import audit as A
from tickbars.plans import backfill as P
from tickbars.queries import inputs as I
from tickbars.queries.bar_queries import SQL as BAR_SQL
from tickbars.queries.bar_queries import sql_fill
from tickbars.queries.wire_queries import _ORDER_BARS, _STORED_SQL, _order_bars, instruments
from tickbars.queries.wire_queries import SQL as WIRE_SQL
from tickbars.session import shared_dir, stored
from tickbars.sinks import store as S
from tickbars.sinks.generations import Generations
from tickbars.sources import wire

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, sf_dir, periods=PERIODS):
    return I.rounded(B.build_bars(I.trades(spark, sf_dir), periods))


_BARS = I.sql_rounded(I.sql_bars())

# --- time and error functions ---------------------------------------------------------------

_INTERVALS = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "12h", "1d", "3d", "1w", "1M", "xm", "9")
_SQL_INTERVAL = "[" + ", ".join(f"'{i}'" for i in _INTERVALS) + f"][event_id % {len(_INTERVALS)} + 1]"
_SQL_MS = """coalesce(try_cast(left(i, length(i) - 1) AS BIGINT), 1) * CASE right(i, 1) WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000
  WHEN 'd' THEN 86400000 WHEN 'w' THEN 604800000 ELSE 60000 END"""


@_register(f"""SELECT event_id, i AS "interval", {_SQL_MS} AS ms,
  CASE WHEN right(i, 1) IN ('m', 'h') THEN t - t % ({_SQL_MS}) WHEN i = '1d' THEN t - t % 86400000
    WHEN i = '1w' THEN epoch_us(date_trunc('week', ts)) // 1000 ELSE t END AS aligned,
  epoch_us(date_trunc('week', ts)) // 1000 AS week_open, (t // 60000 - 1) * 60000 AS safe_end,
  strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S.') || lpad((t % 1000)::VARCHAR, 3, '0') AS text,
  strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S') AS text_seconds,
  (t // 60000 + 1) * 60000 + greatest(100, 2 * k + 100) AS next_tick,
  (t // 60000 + 1) * 60000 - (k - 50) - k - 30 AS best_request,
  epoch_us(date_trunc('day', ts)) // 1000 AS day_ms,
  CASE WHEN i IN ('1m', '5m', '30m', '1h', '4h', '1d', '1w') THEN t + ({_SQL_MS}) - 1 END AS close_time,
  list_position(['1m', '5m', '30m', '1h', '4h', '1d', '1w'], i) - 1 AS ordinal,
  ['1m', '5m', '30m', '1h', '4h', '1d', '1w'][event_id % 9 + 1] AS period_at
FROM (SELECT event_id, ts, epoch_us(ts) // 1000 AS t, {_SQL_INTERVAL} AS i, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""")
def time_functions(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select(
        "event_id",
        T.ntz_to_ms(F.col("ts")).alias("t"),
        F.element_at(F.array(*(F.lit(i) for i in _INTERVALS)), (F.col("event_id") % len(_INTERVALS) + 1).cast("int")).alias("interval"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    t, i, k = F.col("t"), F.col("interval"), F.col("k")
    return ev.select(
        "event_id",
        "interval",
        T.interval_to_ms(i).alias("ms"),
        T.align(t, i).alias("aligned"),
        T.bar_open(t, "1w").alias("week_open"),
        T.safe_end(t).alias("safe_end"),
        T.ms_to_text(t, millis=True).alias("text"),
        T.ms_to_text(t).alias("text_seconds"),
        T.next_tick_ms(t, k).alias("next_tick"),
        T.best_request_ms(t, k - 50, k).alias("best_request"),
        T.date_to_ms(F.date_format(F.timestamp_millis(t), "yyyy-MM-dd")).alias("day_ms"),
        T.close_time(t, i).alias("close_time"),
        T.ordinal_of(i).alias("ordinal"),
        T.period_at(F.col("event_id") % 9).alias("period_at"),
    )


_MESSAGES = (
    "API error: 429", "HTTP error: reset: by peer", "IO error: disk", "Database error: database is locked",
    "Database error: no such table", "SQLite error: busy", "JSON parsing error: eof", "Operation timeout: 5s",
    "Initialization error: x", "something odd", "Invalid input: y", "Channel closed: z",
)
_SQL_FAILURES = f"""SELECT 'C' || o_custkey AS symbol, ['1m', '1h', '1d'][o_orderkey % 3 + 1] AS period,
  epoch_us(o_orderdate) // 1000 AS start_time, o_orderkey % 8 AS retries,
  [{', '.join(f"'{m}'" for m in _MESSAGES)}][o_orderkey % {len(_MESSAGES)} + 1] AS message FROM orders"""


def _failures(spark, sf_dir, *more):
    """One failed download per order."""
    o = I.table(spark, sf_dir, "orders")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    return o.select(
        F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        pick(("1m", "1h", "1d")).alias("period"),
        T.ntz_to_ms(F.col("o_orderdate")).alias("start_time"),
        (F.col("o_orderkey") % 8).alias("retries"),
        pick(_MESSAGES).alias("message"),
        *more,
    )


_SQL_KIND = "trim(split_part(message, ':', 1))"
_SQL_CATEGORY = f"""CASE {_SQL_KIND} WHEN 'API error' THEN 'kline_data_acquisition_failed'
  WHEN 'HTTP error' THEN 'market_data_connection_failed' WHEN 'IO error' THEN 'kline_file_operation_failed'
  WHEN 'Database error' THEN 'kline_data_persistence_failed' WHEN 'SQLite error' THEN 'kline_storage_operation_failed'
  WHEN 'JSON parsing error' THEN 'kline_data_parsing_failed' WHEN 'Operation timeout' THEN 'kline_operation_timeout'
  WHEN 'Initialization error' THEN 'kline_service_initialization_failed' WHEN 'Invalid input' THEN 'kline_input_validation_failed'
  WHEN 'Channel closed' THEN 'kline_processing_channel_closed' ELSE 'kline_service_unknown_error' END"""
_SQL_IMPACT = f"""CASE WHEN {_SQL_KIND} IN ('API error', 'HTTP error', 'Database error', 'SQLite error', 'Initialization error') THEN 'high'
  WHEN {_SQL_KIND} = 'Invalid input' THEN 'low' ELSE 'medium' END"""
_SQL_RETRY = f"""({_SQL_KIND} IN ('API error', 'HTTP error', 'IO error', 'SQLite error', 'Operation timeout')
  OR message = 'Database error: database is locked')"""


@_register(f"""SELECT {_SQL_CATEGORY} AS category, {_SQL_IMPACT} AS impact, {_SQL_RETRY} AS retryable, count(*) AS failures
FROM ({_SQL_FAILURES}) GROUP BY ALL""")
def error_classes(spark, sf_dir):
    f = _failures(spark, sf_dir).select(F.inline(F.array(classify_error(F.col("message")))))
    return f.groupBy("category", "impact", "retryable").agg(F.count("*").alias("failures"))


@_register(f"SELECT {_SQL_KIND} AS error, count(*) AS failures FROM ({_SQL_FAILURES}) GROUP BY 1")
def failure_summary(spark, sf_dir):
    return P.failure_summary(_failures(spark, sf_dir))


@_register(f"""SELECT symbol, period, start_time, retries, message, {_SQL_CATEGORY} AS category, {_SQL_IMPACT} AS impact,
  least(2 ** retries, 30)::BIGINT AS wait_s FROM ({_SQL_FAILURES}) WHERE retries <= 5 AND {_SQL_RETRY}""")
def retry_selection(spark, sf_dir):
    chosen = P.retry_selection(_failures(spark, sf_dir), round_number=2)
    return chosen.withColumn("wait_s", P.backoff_seconds(F.col("retries") + 1))


# An attempt fails again for two tasks of five, by a message of its own.
_AGAIN = "(o_orderkey * 31 + {round} * 17) % 5 < 2"
_MESSAGE_AGAIN = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + f"][(o_orderkey + {{round}}) % {len(_MESSAGES)} + 1]"


@_register(f"""WITH RECURSIVE tasks AS (SELECT o_orderkey, symbol, period, start_time, message FROM ({_SQL_FAILURES.replace('SELECT', 'SELECT o_orderkey,', 1)})),
r AS (
  SELECT 0 AS n, *, 1::BIGINT AS retries, 'failed' AS state, 0::BIGINT AS waited_s FROM tasks
  UNION ALL
  SELECT n + 1, o_orderkey, symbol, period, start_time,
    CASE WHEN state = 'failed' AND {_SQL_RETRY} AND {_AGAIN.format(round='(n + 1)')} THEN {_MESSAGE_AGAIN.format(round='(n + 1)')} ELSE message END,
    retries + CASE WHEN state = 'failed' AND {_SQL_RETRY} AND {_AGAIN.format(round='(n + 1)')} THEN 1 ELSE 0 END,
    CASE WHEN state <> 'failed' THEN state WHEN NOT {_SQL_RETRY} THEN 'given up' WHEN {_AGAIN.format(round='(n + 1)')} THEN 'failed' ELSE 'done' END,
    waited_s + CASE WHEN state = 'failed' AND {_SQL_RETRY} AND n > 0 THEN 2 ** n ELSE 0 END::BIGINT
  FROM r WHERE n < 3
)
SELECT symbol, period, start_time, retries, message, CASE WHEN state = 'failed' AND NOT {_SQL_RETRY} THEN 'given up' ELSE state END AS state, waited_s
FROM r WHERE n = 3""")
def retry_rounds(spark, sf_dir):
    """Failed downloads carried through three rounds. The order's key stands for the series' start, so that tasks differ."""
    root, waits = f"{shared_dir(spark)}/retries-{uuid.uuid4().hex}", []
    failures = _failures(spark, sf_dir, "o_orderkey")
    keyed = failures.withColumn("start_time", F.col("o_orderkey"))

    def attempt(tasks, n):
        failed = (F.col("start_time") * 31 + n * 17) % 5 < 2
        messages = F.array(*(F.lit(m) for m in _MESSAGES))
        return tasks.filter(failed).withColumn("message", F.element_at(messages, ((F.col("start_time") + n) % len(_MESSAGES) + 1).cast("int")))

    ended = P.retry_rounds(keyed, attempt, root, wait=waits.append)
    starts = failures.select(F.col("o_orderkey").alias("_key"), F.col("start_time").alias("_start"))
    return ended.join(starts, ended["start_time"] == starts["_key"]).select(
        "symbol", "period", F.col("_start").alias("start_time"), "retries", "message", "state", "waited_s"
    )


# --- plans ----------------------------------------------------------------------------------

_NOW = 1_900_000_000_123
_GRID_SQL = f"""SELECT symbol, p.period, ms, shift, last_open_time FROM
  (SELECT DISTINCT 'C' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol FROM customer)
  CROSS JOIN {I.PERIOD_ROWS} LEFT JOIN (SELECT symbol, period, max(open_time) AS last_open_time FROM ({_ORDER_BARS}) GROUP BY ALL) USING (symbol, period)"""
_SQL_DEPTH = """CASE period WHEN '1m' THEN 60000000 WHEN '5m' THEN 300000000 WHEN '30m' THEN 1800000000
  WHEN '1h' THEN 3600000000 WHEN '4h' THEN 14400000000 WHEN '1d' THEN 86400000000 WHEN '1w' THEN 120960000000 END"""
_SQL_PLAN = f"""SELECT symbol, period, ms, {I.sql_floor('s')} AS start_time, {_NOW}::BIGINT AS end_time, 1000 AS "limit" FROM (
  SELECT *, coalesce(last_open_time, CASE WHEN period IN ('1d', '1w') THEN 1567900800000 ELSE {_NOW} - {_SQL_DEPTH} END) AS s FROM ({_GRID_SQL}))"""


def _status(spark, sf_dir):
    """Customers as wanted symbols; their orders are the bars already there (1d and 1w)."""
    c = I.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    symbols = c.select(F.concat(F.lit("C"), key, F.when(key % 5 == 0, F.lit("USDC")).otherwise(F.lit("USDT"))).alias("symbol")).distinct()
    return P.wanted_grid(symbols), _order_bars(spark, sf_dir)


@_register(f'SELECT symbol, period, start_time, end_time, "limit" FROM ({_SQL_PLAN})')
def backfill_plan(spark, sf_dir):
    return P.plan(P.grid_status(*_status(spark, sf_dir)), _NOW)


@_register(f"""SELECT symbol, period, start AS start_time,
  CASE WHEN NOT cut THEN end_time WHEN start + ms * 1000 < end_time THEN start + ms * 1000 - 1 END AS end_time, "limit"
FROM (SELECT *, (end_time - start_time) // ms > 1000 AS cut,
    unnest(CASE WHEN (end_time - start_time) // ms > 1000 THEN range(start_time, end_time, ms * 1000) ELSE [start_time] END) AS start
  FROM ({_SQL_PLAN}))""")
def backfill_batches(spark, sf_dir):
    return P.split_ranges(P.plan(P.grid_status(*_status(spark, sf_dir)), _NOW))


@_register(f"""SELECT symbol, period, {I.sql_floor('s')} AS start_time, {I.sql_floor(f'{_NOW}::BIGINT')} AS end_time, 1000 AS "limit" FROM (
  SELECT *, coalesce(last_open_time + ms, {_NOW} - {_SQL_DEPTH}) AS s FROM ({_GRID_SQL}))
WHERE last_open_time IS NULL OR {I.sql_floor('s')} < {I.sql_floor(f'{_NOW}::BIGINT')}""")
def legacy_backfill_plan(spark, sf_dir):
    return P.legacy_plan(P.grid_status(*_status(spark, sf_dir)), _NOW)


@_register(f"""SELECT period, count(*) FILTER (last_open_time IS NULL) AS created,
  count(*) FILTER (last_open_time IS NOT NULL) AS existing FROM ({_GRID_SQL}) GROUP BY 1""")
def wanted_grid_counts(spark, sf_dir):
    return P.grid_counts(*_status(spark, sf_dir))


_SQL_DOWNLOADS = """SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 30000 AS window_start, event_type AS symbol,
  ['1m', '1h', '1d'][user_id % 3 + 1] AS period, sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT))::BIGINT AS bars FROM events GROUP BY ALL"""


def _downloads(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events")
    period = F.element_at(F.array(F.lit("1m"), F.lit("1h"), F.lit("1d")), (F.col("user_id") % 3 + 1).cast("int"))
    d = ev.select(
        T.ntz_to_ms(F.col("ts")).alias("ts_ms"),
        F.col("event_type").alias("symbol"),
        period.alias("period"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bars"),
    )
    return P.download_totals(d)


@_register(_SQL_DOWNLOADS)
def download_totals(spark, sf_dir):
    return _downloads(spark, sf_dir)


@_register(f"""SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY bars DESC, symbol, period)::INTEGER AS rank
FROM ({_SQL_DOWNLOADS}) QUALIFY rank <= 2""")
def most_active_series(spark, sf_dir):
    return P.most_active(_downloads(spark, sf_dir), 2)


# --- stored bars ----------------------------------------------------------------------------


@_register(_STORED_SQL)
def stored_bars(spark, sf_dir):
    return S.to_stored(_bars(spark, sf_dir))


@_register(f"""SELECT DISTINCT 'k_' || replace(lower(symbol), 'usdt', '') || '_' || period AS series,
  replace(symbol, 'USDT', '') || 'USDT' AS symbol, period FROM ({_ORDER_BARS}) WHERE symbol LIKE '%USDT'""")
def series_names(spark, sf_dir):
    """Names of the old layout and back again, for symbols of the quote asset."""
    b = _order_bars(spark, sf_dir).filter(F.col("symbol").endswith("USDT")).select("symbol", "period").distinct()
    named = b.select(S.series_name(F.col("symbol"), F.col("period")).alias("series"))
    symbol, period = S.series_parts(F.col("series"))
    return named.select("series", symbol.alias("symbol"), period.alias("period"))


_K = "open_time // ms"
_BARS_K = f"SELECT b.*, {_K} AS k, ms FROM ({_BARS}) b JOIN (SELECT period, ms FROM {I.PERIOD_ROWS}) USING (period)"


def _with_k(bars):
    return bars.withColumn("ms", T.ms_of(F.col("period"))).withColumn("k", F.expr("open_time div ms"))


def _versions(spark, sf_dir):
    """Each bar twice: as built, and a later version with another close, count and state."""
    b = _with_k(_bars(spark, sf_dir))
    first = b.withColumn("is_final", F.col("k") % 3 == 0).withColumn("version", F.lit(1).cast("bigint"))
    second = (
        b.withColumn("close", F.col("close") + 1)
        .withColumn("trade_count", F.col("trade_count") + F.col("k") % 3 - 1)
        .withColumn("is_final", F.col("k") % 2 == 0)
        .withColumn("version", F.lit(2).cast("bigint"))
    )
    return first.unionByName(second).drop("k", "ms")


_SQL_VERSIONS = f"""SELECT * EXCLUDE (k, ms), k % 3 = 0 AS is_final, 1::BIGINT AS version FROM ({_BARS_K}) UNION ALL BY NAME
  SELECT * EXCLUDE (k, ms) REPLACE (close + 1 AS close, trade_count + k % 3 - 1 AS trade_count),
    k % 2 = 0 AS is_final, 2::BIGINT AS version FROM ({_BARS_K})"""
_SQL_MERGED = f"""SELECT * FROM ({_SQL_VERSIONS}) QUALIFY row_number() OVER
  (PARTITION BY symbol, period, open_time ORDER BY is_final DESC, trade_count DESC, version DESC) = 1"""


@_register(_SQL_MERGED)
def upsert_bars(spark, sf_dir):
    return S.merge_bars(_versions(spark, sf_dir), "version")


@_register(f"SELECT * EXCLUDE (version) FROM ({_SQL_MERGED})")
def upsert_through_storage(spark, sf_dir):
    """The same upsert through written batches, one of them written twice, and a compaction."""
    root = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    v = _versions(spark, sf_dir)
    for n in (1, 2, 2):
        S.write_batch(v.filter(F.col("version") == n).drop("version"), f"{root}/batches", n)
    S.compact(spark, [f"{root}/batches"], f"{root}/compacted")
    return S.read_current(spark, f"{root}/compacted").drop("month")


@_register(f"SELECT * EXCLUDE (version) FROM ({_SQL_MERGED})")
def upsert_through_generations(spark, sf_dir):
    """The same upsert into generations: a batch, a compaction, the other batch (twice), a compaction, what is old removed."""
    kept = Generations(spark, f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}")
    v = _versions(spark, sf_dir)
    for n in (1, 2, 2):
        kept.append(v.filter(F.col("version") == n).drop("version"), n)
        kept.compact()
    kept.retire(keep=1)
    return kept.read().drop("month")


@_register(WIRE_SQL["bars_without_delisted"])
def stored_without_delisted(spark, sf_dir):
    """Stored bars of which delisted symbols are deleted, rewritten, and read again."""
    kept = Generations(spark, f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}")
    kept.append(_order_bars(spark, sf_dir).withColumn("is_final", F.lit(True)), 0)
    kept.compact()
    kept.delete(U.delisted(instruments(spark, sf_dir)))
    kept.compact(purge=True)
    kept.retire(keep=1)
    return kept.read().select("symbol", "period", "open_time", "close")


@_register(f"SELECT * FROM ({_SQL_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY symbol, period, open_time ORDER BY version DESC) = 1")
def last_version_wins(spark, sf_dir):
    return S.last_wins(_versions(spark, sf_dir), S.KEY, "version")


@_register("""SELECT symbol, status FROM (
  SELECT 'C' || c_custkey AS symbol, c_mktsegment AS status, 0 AS n FROM customer
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'ORDERED', 1 FROM orders WHERE o_orderstatus = 'O')
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1""")
def upsert_symbols(spark, sf_dir):
    """Customers as registered symbols; those with an open order get another state."""
    c, o = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "orders")
    registry = c.select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_mktsegment").alias("status"))
    incoming = o.filter(F.col("o_orderstatus") == "O").select(F.concat(F.lit("C"), "o_custkey").alias("symbol")).distinct()
    return S.upsert_symbols(registry, incoming.withColumn("status", F.lit("ORDERED")))


_RANGE = (1_704_672_000_000, 1_705_276_800_000)


@_register(f"SELECT * FROM ({_BARS}) WHERE symbol = 'click' AND period = '1h' AND open_time BETWEEN {_RANGE[0]} AND {_RANGE[1]} ORDER BY open_time")
def range_scan(spark, sf_dir):
    return S.range_scan(_bars(spark, sf_dir), "click", "1h", *_RANGE)


@_register(f"SELECT * FROM ({_BARS}) WHERE symbol = 'click' AND period = '1d' AND open_time = {_RANGE[0]}")
def point_lookup(spark, sf_dir):
    return S.point_lookup(_bars(spark, sf_dir), "click", "1d", _RANGE[0])


_LATEST = f"SELECT * FROM ({_BARS}) QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY open_time DESC) = 1"


@_register(_LATEST)
def latest_bar_per_key(spark, sf_dir):
    return S.latest_per_series(_bars(spark, sf_dir))


@_register(f"SELECT * FROM ({_BARS}) QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY open_time DESC) <= 20")
def latest_n_bars(spark, sf_dir):
    return S.latest_n(_bars(spark, sf_dir), 20)


@_register(f"""SELECT symbol, period, open_time, close FROM (SELECT DISTINCT event_type AS symbol FROM events) CROSS JOIN {I.PERIOD_ROWS}
LEFT JOIN (SELECT * FROM ({_LATEST}) WHERE period IN ('1h', '1d')) USING (symbol, period)""")
def latest_for_wanted(spark, sf_dir):
    """Newest bar of every wanted series; only 1h and 1d bars are there."""
    symbols = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    found = S.latest_for(P.wanted_grid(symbols), _bars(spark, sf_dir, ("1h", "1d")))
    return found.select("symbol", "period", "open_time", "close")


@_register(f"SELECT * FROM ({_LATEST}) WHERE period IN ('1m', '1w')")
def latest_bar_refresh(spark, sf_dir):
    symbols = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    return P.latest_bar_refresh(P.wanted_grid(symbols, ("1m", "1w")), _bars(spark, sf_dir))


@_register(f"SELECT symbol, period, min(open_time) AS first_open_time, max(open_time) AS last_open_time, count(*) AS bars FROM ({_BARS}) GROUP BY ALL")
def series_extent(spark, sf_dir):
    return S.series_extent(_bars(spark, sf_dir))


@_register(f"SELECT count(*) AS bars, count(*) >= 100 AS ready FROM ({_BARS}) WHERE symbol = 'click' AND period = '1m'")
def readiness_gate(spark, sf_dir):
    return S.ready(_bars(spark, sf_dir), "click", "1m")


@_register(f"SELECT symbol, period, open_time FROM ({_BARS}) QUALIFY open_time = max(open_time) OVER (PARTITION BY symbol, period)")
def provisional_bars(spark, sf_dir):
    return S.provisional(S.valid(B.mark_final(_bars(spark, sf_dir)))).select("symbol", "period", "open_time")


@_register(f"""SELECT symbol, count(*) AS bars, max(period) AS longest, sum(open_time)::BIGINT AS open_times, round(sum(close), 4) AS closes
FROM ({_LATEST}) GROUP BY 1""")
def push_messages(spark, sf_dir):
    """One JSON message per symbol with its open bars, read back to compare."""
    b = B.mark_final(_bars(spark, sf_dir))
    messages = S.push_messages(S.latest_per_series(b))
    bar = "array<struct<period string, open_time bigint, open double, high double, low double, close double, volume double, is_final boolean>>"
    back = messages.select("symbol", "bars", F.explode(F.from_json("message", bar)).alias("b"))
    return back.groupBy("symbol", "bars").agg(
        F.max("b.period").alias("longest"), F.sum("b.open_time").alias("open_times"), F.round(F.sum("b.close"), 4).alias("closes")
    )


@_register(f"SELECT * EXCLUDE (symbol, period) FROM ({_STORED_SQL})")
def csv_records(spark, sf_dir):
    """Bars of all periods, written as CSV and read back."""
    bars, path = S.to_stored(_bars(spark, sf_dir)), f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    S.write_csv(bars, path)
    return spark.read.schema(S.csv_record(bars).schema).csv(path)


# --- audits ---------------------------------------------------------------------------------


def _local_remote(spark, sf_dir):
    """Remote bars as built; local bars with some missing, some changed and some extra."""
    remote = _with_k(_bars(spark, sf_dir))
    kept = remote.filter(F.col("k") % 7 != 0).withColumn(
        "close", F.when(F.col("k") % 11 == 1, F.col("close") + 1).otherwise(F.col("close"))
    )
    extra = remote.filter(F.col("k") % 13 == 0).withColumn("open_time", F.col("open_time") + F.col("ms") * 100_000)
    return kept.unionByName(extra).drop("k", "ms"), remote.drop("k", "ms")


_SQL_LOCAL = f"""SELECT * EXCLUDE (k, ms) REPLACE (CASE WHEN k % 11 = 1 THEN close + 1 ELSE close END AS close) FROM ({_BARS_K}) WHERE k % 7 <> 0
  UNION ALL BY NAME SELECT * EXCLUDE (k, ms) REPLACE (open_time + ms * 100000 AS open_time) FROM ({_BARS_K}) WHERE k % 13 = 0"""


def _sql_compare(local: str, remote: str) -> str:
    return f"""SELECT symbol, period, open_time, l.close AS local_close, r.close AS remote_close,
  CASE WHEN l.open IS NULL THEN 'MissingInLocal' WHEN r.open IS NULL THEN 'ExtraInLocal'
    WHEN abs(l.open - r.open) > 1e-8 OR abs(l.high - r.high) > 1e-8 OR abs(l.low - r.low) > 1e-8 OR abs(l.close - r.close) > 1e-8
      OR abs(l.volume - r.volume) > 1e-8 OR l.trade_count <> r.trade_count THEN 'FieldMismatch' ELSE 'match' END AS outcome
FROM ({local}) l FULL OUTER JOIN ({remote}) r USING (symbol, period, open_time)"""


_SQL_AUDIT = _sql_compare(_SQL_LOCAL, _BARS)


def _flat(compared, *more):
    return compared.select(
        *more, *S.KEY, F.col("local.close").alias("local_close"), F.col("remote.close").alias("remote_close"), "outcome"
    )


@_register(f"SELECT * FROM ({_SQL_AUDIT}) WHERE outcome <> 'match'")
def audit_full_outer(spark, sf_dir):
    return _flat(Q.mismatches(Q.compare(*_local_remote(spark, sf_dir))))


_SQL_SUMMARY = """SELECT count(*) AS total_checked, count(*) FILTER (outcome = 'MissingInLocal') AS missing_in_local,
  count(*) FILTER (outcome = 'ExtraInLocal') AS extra_in_local, count(*) FILTER (outcome = 'FieldMismatch') AS field_mismatches,
  round(count(*) FILTER (outcome = 'match') / count(*) * 100, 6) AS success_rate"""


@_register(f"{_SQL_SUMMARY} FROM ({_SQL_AUDIT})")
def audit_summary(spark, sf_dir):
    s = Q.audit_summary(Q.compare(*_local_remote(spark, sf_dir)))
    return s.withColumn("success_rate", F.round("success_rate", 6))


@_register(f"""SELECT outcome, count(*) AS bars, NULL::BIGINT AS total_checked FROM ({_SQL_AUDIT}) WHERE outcome <> 'match' GROUP BY 1
  UNION ALL SELECT 'summary', NULL, count(*) FROM ({_SQL_AUDIT})""")
def audit_report(spark, sf_dir):
    """The report of an audit, written and read back: differences by outcome, and the summary."""
    compared, path = Q.compare(*_local_remote(spark, sf_dir)), f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    S.write_report(Q.mismatches(compared), Q.audit_summary(compared), path)
    differences = spark.read.json(path + "/differences").groupBy("outcome").agg(F.count("*").alias("bars"))
    summary = spark.read.json(path + "/summary").select(F.lit("summary").alias("outcome"), "total_checked")
    return differences.unionByName(summary, allowMissingColumns=True)


_AUDIT_NOW = 1_705_500_030_000
_AUDIT_SIDE = f"""SELECT b.* FROM ({{side}}) b JOIN (SELECT period, ms FROM {I.PERIOD_ROWS}) USING (period)
  WHERE open_time >= {_AUDIT_NOW - 86_400_000} AND open_time + ms - 1 < {(_AUDIT_NOW // 60_000 - 1) * 60_000}"""


@_register(_sql_compare(_AUDIT_SIDE.format(side=_SQL_LOCAL), _AUDIT_SIDE.format(side=_BARS)))
def audit_cycle(spark, sf_dir):
    """One scheduled cycle over a trailing day, bars still open left out."""
    local, remote = _local_remote(spark, sf_dir)
    return _flat(A.audit_cycle(local, remote, _AUDIT_NOW, trailing_ms=86_400_000))


_CYCLES = "(SELECT unnest(range(1705500040000, 1705500040000 + 300 * 60000, 60000)) AS cycle_ms)"
_CYCLE_SIDE = f"""SELECT c.cycle_ms, b.* FROM ({{side}}) b JOIN (SELECT period, ms FROM {I.PERIOD_ROWS}) USING (period) JOIN {_CYCLES} c
  ON open_time >= c.cycle_ms - 1800000 AND open_time + ms - 1 < (c.cycle_ms // 60000 - 1) * 60000"""


@_register("SELECT cycle_ms, " + _sql_compare(_CYCLE_SIDE.format(side=_SQL_LOCAL), _CYCLE_SIDE.format(side=_BARS))[7:].replace(
    "USING (symbol, period, open_time)", "USING (cycle_ms, symbol, period, open_time)") + " WHERE outcome <> 'match'")
def audit_schedule(spark, sf_dir):
    """A cycle each minute over five hours, each over the last half hour, in several batches of which one repeats ticks."""
    root = f"{shared_dir(spark)}/audits-{uuid.uuid4().hex}"
    for begin, end in ((0, 120), (100, 220), (220, 300)):
        ticks = spark.range(begin, end, numPartitions=1).select((F.col("id") * 60_000 + 1_705_500_040_000).alias("tick_ms"))
        ticks.write.mode("append").parquet(f"{root}/ticks")
    stream = spark.readStream.schema("tick_ms bigint").option("maxFilesPerTrigger", 1).parquet(f"{root}/ticks")
    local, remote = (stored(x) for x in _local_remote(spark, sf_dir))
    A.start_audits(stream, root, lambda _: local, lambda _: remote, availableNow=True).awaitTermination()
    differences, _ = A.reports(spark, root)
    return _flat(differences, "cycle_ms")


_SQL_LAST = f"SELECT symbol, period, max(open_time) AS last_open_time FROM ({{bars}}) GROUP BY ALL"


def _sql_benchmark(bars: str, mark: str) -> str:
    last = _SQL_LAST.format(bars=bars)
    return f"""SELECT l.*, m.last_open_time AS benchmark_open_time, l.last_open_time = m.last_open_time AS consistent
FROM ({last}) l JOIN ({last}) m ON l.period = m.period AND m.symbol = '{mark}' WHERE l.symbol <> '{mark}'"""


@_register(_sql_benchmark(_BARS, "click"))
def last_bar_vs_benchmark(spark, sf_dir):
    return Q.last_bar_vs_benchmark(_bars(spark, sf_dir), "click")


_ORDER_MARK = _sql_benchmark(_ORDER_BARS, "C1USDT")


@_register(f"""SELECT period, count(*) AS symbols, count(*) FILTER (consistent) AS consistent,
  count(*) FILTER (NOT consistent) AS inconsistent FROM ({_ORDER_MARK}) GROUP BY 1""")
def benchmark_totals(spark, sf_dir):
    return Q.benchmark_totals(Q.last_bar_vs_benchmark(_order_bars(spark, sf_dir), "C1USDT"))


@_register(f"""SELECT period, last_open_time, array_to_string(list(symbol ORDER BY symbol)[1:10], ',') AS symbols,
  greatest(count(*) - 10, 0) AS more FROM ({_ORDER_MARK}) WHERE NOT consistent GROUP BY ALL""")
def inconsistent_groups(spark, sf_dir):
    return Q.inconsistent_groups(Q.last_bar_vs_benchmark(_order_bars(spark, sf_dir), "C1USDT"))


# --- freshness, continuity, rules -----------------------------------------------------------

_SQL_CUT = "(SELECT max(epoch_us(ts) // 1000) FROM events)"
_SQL_OLDER = I.sql_bars(f"SELECT * FROM ({I.TRADES}) WHERE ts_ms < {_SQL_CUT} - length(symbol) * 600000")
_SQL_FRESH = f"""SELECT r.symbol, r.period, r.last_open_time AS remote_open_time, l.last_open_time AS local_open_time,
  abs(r.last_open_time - l.last_open_time) / 60000.0 AS lag_minutes,
  coalesce(abs(r.last_open_time - l.last_open_time) / 60000.0 <= CASE r.period WHEN '1m' THEN 2 WHEN '5m' THEN 10 WHEN '30m' THEN 60 ELSE 5 END, false) AS passed
FROM ({_SQL_LAST.format(bars=_BARS)}) r LEFT JOIN ({_SQL_LAST.format(bars=_SQL_OLDER)}) l USING (symbol, period)"""


def _freshness(spark, sf_dir):
    """Local bars lag: they miss the newest trades, more of them for longer names."""
    t = I.trades(spark, sf_dir)
    newest = t.select(F.max("ts_ms").alias("m")).scalar()
    older = t.filter(F.col("ts_ms") < newest - F.length("symbol") * 600_000)
    return Q.freshness(B.build_bars(older), B.build_bars(t))


@_register(_SQL_FRESH)
def freshness_lag(spark, sf_dir):
    return _freshness(spark, sf_dir)


@_register(f"""SELECT count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*) * 100, 2) AS pass_rate,
  round(count(*) FILTER (passed) / count(*) * 100, 2) < 95 AS warn FROM ({_SQL_FRESH})""")
def integrity_pass_rate(spark, sf_dir):
    return Q.pass_rate(_freshness(spark, sf_dir))


def _arriving(spark, sf_dir):
    """Bars in a slightly mixed order, every fifth sent twice."""
    b = _with_k(_bars(spark, sf_dir))
    seq = (F.col("k") + (F.col("k") * 7919) % 8) * 16 + (F.col("k") % 8) * 2
    sent = b.withColumn("seq", seq)
    again = sent.filter(F.col("k") % 5 == 0).withColumn("seq", F.col("seq") + 1)
    return sent.unionByName(again).drop("k", "ms")


_SQL_ARRIVING = f"""SELECT symbol, period, open_time, (k + (k * 7919) % 8) * 16 + (k % 8) * 2 + again AS seq
  FROM ({_BARS_K}) CROSS JOIN (VALUES (0), (1)) v(again) WHERE again = 0 OR k % 5 = 0"""
_SQL_CONTINUITY = f"""SELECT *, CASE WHEN open_time - prev_open_time > 2 * ms THEN 'gap' WHEN open_time = prev_open_time THEN 'duplicate' ELSE 'ok' END AS status
FROM (SELECT a.*, lag(open_time) OVER (PARTITION BY symbol, period ORDER BY seq) AS prev_open_time FROM ({_SQL_ARRIVING}) a)
JOIN (SELECT period, ms FROM {I.PERIOD_ROWS}) USING (period)"""


@_register(f"SELECT symbol, period, open_time, seq, prev_open_time, status FROM ({_SQL_CONTINUITY})")
def continuity_audit(spark, sf_dir):
    c = Q.continuity(_arriving(spark, sf_dir))
    return c.select("symbol", "period", "open_time", "seq", "prev_open_time", "status")


@_register(f"""SELECT count(*) AS processed, count(DISTINCT symbol) AS symbols, count(DISTINCT period) AS periods,
  count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'duplicate') AS duplicates FROM ({_SQL_CONTINUITY})""")
def completeness_totals(spark, sf_dir):
    return Q.completeness(Q.continuity(_arriving(spark, sf_dir)))


def _damaged(spark, sf_dir):
    b = _with_k(_bars(spark, sf_dir))
    return (
        b.withColumn("low", F.when(F.col("k") % 17 == 0, F.lit(0.0)).otherwise(F.col("low")))
        .withColumn("high", F.when(F.col("k") % 19 == 0, F.col("low") - 1).otherwise(F.col("high")))
        .withColumn("volume", F.when(F.col("k") % 23 == 0, F.lit(-1.0)).otherwise(F.col("volume")))
        .drop("k", "ms")
    )


_SQL_DAMAGED = f"""SELECT symbol, period, open_time, open, close, low, volume, CASE WHEN k % 19 = 0 THEN low - 1 ELSE high END AS high FROM (
  SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN 0.0 ELSE low END AS low, CASE WHEN k % 23 = 0 THEN -1.0 ELSE volume END AS volume) FROM ({_BARS_K}))"""


@_register(f"""SELECT symbol, period, open_time, rule FROM (
  SELECT *, unnest(['invalid_price', 'ohlc_logic_error', 'invalid_volume']) AS rule FROM ({_SQL_DAMAGED}))
WHERE (rule = 'invalid_price' AND (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0))
  OR (rule = 'ohlc_logic_error' AND (high < low OR high < open OR high < close OR low > open OR low > close))
  OR (rule = 'invalid_volume' AND volume < 0)""")
def ohlc_rule_violations(spark, sf_dir):
    return Q.violations(_damaged(spark, sf_dir), Q.rules()).select("symbol", "period", "open_time", "rule")


@_register(f"SELECT symbol, seq FROM ({I.TRADES}) WHERE ts_ms > (SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM ({I.TRADES})) + 60000")
def future_trades(spark, sf_dir):
    """Trades dated after the middle of the tape, seen from there."""
    t = I.trades(spark, sf_dir)
    now = t.select(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("m")).scalar()
    return Q.future_rows(t, "ts_ms", now).select("symbol", "seq")


@_register(f"""SELECT symbol, max(ts_ms) AS last_ts_ms, (SELECT max(ts_ms) FROM ({I.TRADES})) + 30000 - max(ts_ms) AS silent_ms,
  (SELECT max(ts_ms) FROM ({I.TRADES})) + 30000 - max(ts_ms) > 60000 AS stale FROM ({I.TRADES}) GROUP BY 1""")
def stale_inputs(spark, sf_dir):
    t = I.trades(spark, sf_dir)
    return Q.stale_inputs(t, t.select((F.max("ts_ms") + 30_000).alias("m")).scalar())


@_register(f"""WITH t AS ({I.TRADES}), connects AS (SELECT event_type AS symbol, count(*) - 1 AS reconnects FROM events WHERE user_id % 97 = 0 OR event_type = 'error' GROUP BY 1),
  heard AS (SELECT symbol, max(ts_ms) AS last_ts_ms, (SELECT max(ts_ms) FROM t) + 30000 - max(ts_ms) > 60000 AS stale FROM t WHERE symbol <> 'click' GROUP BY 1)
  SELECT symbol, last_ts_ms, coalesce(reconnects, 0) AS reconnects,
    CASE WHEN last_ts_ms IS NULL THEN 'Warning' WHEN stale THEN 'Error' ELSE 'Ok' END AS computing,
    CASE WHEN coalesce(reconnects, 0) > 10 OR coalesce(stale, false) THEN 'Warning' ELSE 'Ok' END AS reading
  FROM heard FULL JOIN connects USING (symbol)""")
def input_health(spark, sf_dir):
    """Errors and every 97th user stand for connections; clicks have not traded yet."""
    t = I.trades(spark, sf_dir)
    now = t.select((F.max("ts_ms") + 30_000).alias("m")).scalar()
    ev = I.table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    return Q.input_health(t.filter("symbol != 'click'"), ev.filter("user_id % 97 = 0 OR symbol = 'error'"), now)


@_register(f"""SELECT ts_ms - ts_ms % 10000 AS window_start, count(*) AS events, count(*) FILTER (symbol <> 'error') AS good,
  round(count(*) FILTER (symbol <> 'error') / count(*) * 100, 4) AS success_rate FROM ({I.TRADES}) GROUP BY 1""")
def throughput_10s(spark, sf_dir):
    good = F.count_if(F.col("symbol") != "error")
    return Q.throughput(
        I.trades(spark, sf_dir), "ts_ms", "10 seconds", good=good, success_rate=F.round(good / F.count("*") * 100, 4)
    )


# A bar's closing: of all arrivals of later bars the first, against the first tick that counts.
_ARRIVALS = f"""SELECT symbol, period, {I.sql_floor('ts_ms')} AS b, min(seq) AS seq, arg_min(arrival_ms, seq) AS arrival_ms FROM ({I.DELAYED}) CROSS JOIN {I.PERIOD_ROWS} GROUP BY ALL"""
_SQL_CLOSINGS = f"""
WITH bars AS MATERIALIZED ({BAR_SQL['bars_with_clock']}), a AS MATERIALIZED ({_ARRIVALS}),
since AS (SELECT symbol, min(arrival_ms) AS since FROM a GROUP BY 1),
walked AS (SELECT symbol, period, b, min(seq) OVER w AS seq FROM a WINDOW w AS (PARTITION BY symbol, period ORDER BY b DESC)),
came AS (SELECT w.symbol, w.period, w.b, a.b AS next_b, a.arrival_ms FROM walked w JOIN a ON a.symbol = w.symbol AND a.period = w.period AND a.seq = w.seq),
asked AS (
  SELECT x.symbol, x.period, x.open_time, x.trade_count, p.ms, s.since, c.next_b, c.arrival_ms
  FROM bars x JOIN {I.PERIOD_ROWS} ON p.period = x.period JOIN since s ON s.symbol = x.symbol
  ASOF LEFT JOIN came c ON c.symbol = x.symbol AND c.period = x.period AND c.b > x.open_time WHERE x.is_final
)
SELECT symbol, period, open_time, CASE WHEN arrival_ms < tick THEN 'Trade' ELSE 'Clock' END AS "trigger",
  CASE WHEN trade_count > 0 THEN 'real' ELSE 'flat' END AS old_state, CASE WHEN arrival_ms < tick AND next_b = open_time + ms THEN 'real' ELSE 'flat' END AS new_state
FROM (SELECT *, CASE WHEN open_time + ms + {I.CLOCK_GRACE_MS} > since THEN open_time + ms + {I.CLOCK_GRACE_MS}
    ELSE (SELECT min(t) FROM range(since - since % 60000 - 60000 + {I.CLOCK_GRACE_MS}, since + 120001, 60000) r(t) WHERE t > since) END AS tick FROM asked)"""


def _closings(spark, sf_dir):
    tape = stored(I.delayed_trades(spark, sf_dir))
    horizon = B.clock_horizon(tape, I.CLOCK_GRACE_MS)
    bars = B.build_bars(tape, clock_grace_ms=I.CLOCK_GRACE_MS, gaps=True, horizon_ms=horizon)
    return Q.closings(tape, bars, I.CLOCK_GRACE_MS)


@_register(f"""SELECT "trigger", old_state, new_state, count(*) AS changes FROM ({_SQL_CLOSINGS}) GROUP BY ALL""")
def lifecycle_totals(spark, sf_dir):
    """What closed the bars of the delayed tape, by cause and states."""
    return Q.transition_totals(_closings(spark, sf_dir))


@_register(f"SELECT * FROM ({_SQL_CLOSINGS}) WHERE period <> '1m'")
def bar_closings(spark, sf_dir):
    """The cause of each closing, for all periods but the shortest."""
    return _closings(spark, sf_dir).filter("period != '1m'")


@_register(f"""SELECT old_state, new_state, count(*) AS changes FROM (
  SELECT CASE WHEN trade_count > 0 THEN 'real' ELSE 'flat' END AS new_state,
    lag(CASE WHEN trade_count > 0 THEN 'real' ELSE 'flat' END) OVER (PARTITION BY symbol, period ORDER BY open_time) AS old_state
  FROM ({sql_fill(I.sql_bars())})) WHERE old_state IS NOT NULL GROUP BY ALL""")
def bar_successions(spark, sf_dir):
    """Which states follow each other in the finished bars."""
    changes = Q.transitions(B.build_bars(I.trades(spark, sf_dir), gaps=True))
    return changes.groupBy("old_state", "new_state").agg(F.count("*").alias("changes"))
