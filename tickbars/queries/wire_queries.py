"""Registered queries over payload texts, which are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickbars.functions.periods import PERIODS
from tickbars.operators import bars as B
from tickbars.operators import universe as U
from tickbars.queries import inputs as I
from tickbars.queries.bar_queries import sql_fill
from tickbars.sinks import store as S
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


# --- trades -------------------------------------------------------------------------------


def _trade_json(spark, sf_dir):
    """Tape with ``body``: most rows are good trades, the rest have one fault each."""
    t = I.trades(spark, sf_dir)
    k = F.col("seq") % 10
    price = (
        F.when(k == 2, F.lit('"abc"')).when(k == 3, F.col("price").cast("string")).otherwise(F.concat(F.lit('"'), F.col("price"), F.lit('"')))
    )
    body = F.concat(
        F.lit('{"e":"'), F.when(k == 0, F.lit("kline")).otherwise(F.lit("aggTrade")),
        F.lit('","E":'), F.col("ts_ms") + 10, F.lit(',"s":"'), "symbol", F.lit('","a":'), "seq",
        F.lit(',"p":'), price, F.lit(',"q":"'), F.when(k == 4, F.lit("x")).otherwise(F.col("quantity").cast("string")),
        F.lit('","f":'), "seq", F.lit(',"l":'), "seq", F.lit(',"T":'), "ts_ms",
        F.lit(',"m":'), F.col("is_buyer_maker").cast("string"), F.lit("}"),
    )
    return t.select("seq", "symbol", k.alias("k"), body.alias("body"))


def _single_lines(spark, sf_dir):
    t = _trade_json(spark, sf_dir)
    return t.select(
        "seq",
        F.when(F.col("k") == 1, F.concat(F.lit('{"result":null,"id":'), "seq", F.lit("}")))
        .when(F.col("k") == 5, F.lit("invalid json"))
        .otherwise(F.col("body"))
        .alias("value"),
    )


def _combined_lines(spark, sf_dir):
    """Combined messages; every 9th names no event, which makes it a bad payload."""
    t = _trade_json(spark, sf_dir)
    body = F.when(F.col("seq") % 9 == 4, F.regexp_replace("body", r'"e":"[^"]*",', "")).otherwise(F.col("body"))
    return t.select(
        "seq",
        F.concat(F.lit('{"stream":"'), wire.stream_name(F.col("symbol")), F.lit('","data":'), body, F.lit("}")).alias("value"),
    )


_TRADE_COLS = ("seq", "symbol", "price", "quantity", "ts_ms", "is_buyer_maker", "agg_trade_id", "event_time_ms")
_SQL_TRADE_COLS = "seq, symbol, price, quantity, ts_ms, is_buyer_maker, seq AS agg_trade_id, ts_ms + 10 AS event_time_ms"


@_register(f"SELECT {_SQL_TRADE_COLS} FROM ({I.TRADES}) WHERE seq % 10 > 5")
def parse_single_stream(spark, sf_dir):
    return wire.accepted_trades(wire.classify_trades(_single_lines(spark, sf_dir))).select(*_TRADE_COLS)


@_register(f"SELECT {_SQL_TRADE_COLS} FROM ({I.TRADES}) WHERE seq % 10 NOT IN (2, 3, 4) AND seq % 9 <> 4")
def parse_combined_stream(spark, sf_dir):
    return wire.accepted_trades(wire.classify_trades(_combined_lines(spark, sf_dir))).select(*_TRADE_COLS)


@_register(f"""SELECT CASE seq % 10 WHEN 0 THEN 'ignored' WHEN 1 THEN 'ignored' WHEN 5 THEN 'ignored'
  WHEN 2 THEN 'bad_price' WHEN 3 THEN 'bad_payload' WHEN 4 THEN 'bad_quantity' ELSE 'trade' END AS outcome,
  count(*) AS messages FROM ({I.TRADES}) GROUP BY ALL""")
def trade_outcomes(spark, sf_dir):
    return wire.classify_trades(_single_lines(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("messages"))


@_register(f"SELECT seq, CASE seq % 10 WHEN 2 THEN 'bad_price' WHEN 3 THEN 'bad_payload' ELSE 'bad_quantity' END AS outcome FROM ({I.TRADES}) WHERE seq % 10 IN (2, 3, 4)")
def trade_rejects(spark, sf_dir):
    return wire.rejected_trades(wire.classify_trades(_single_lines(spark, sf_dir))).select("seq", "outcome")


_BUSY = "(SELECT event_type FROM events GROUP BY 1 HAVING sum(value) > (SELECT sum(value) / 5 FROM events))"


@_register(f"SELECT symbol, count(*) AS trades FROM ({I.TRADES}) WHERE seq % 10 > 5 AND symbol IN {_BUSY} GROUP BY 1")
def known_symbol_gate(spark, sf_dir):
    """Only symbols with more than an equal share of the total value are registered."""
    ev = I.table(spark, sf_dir, "events")
    share = ev.select((F.sum("value") / 5).alias("s")).scalar()
    registry = (
        ev.groupBy(F.col("event_type").alias("symbol")).agg(F.sum("value").alias("v")).filter(F.col("v") > share)
    )
    good = wire.accepted_trades(wire.classify_trades(_single_lines(spark, sf_dir)), registry)
    return good.groupBy("symbol").agg(F.count("*").alias("trades"))


@_register(f"""SELECT seq, symbol, agg_trade_id, CASE WHEN agg_trade_id % 10 = 2 THEN NULL ELSE price END AS price,
  CASE WHEN agg_trade_id % 10 = 4 THEN NULL ELSE quantity END AS quantity, ts_ms, is_buyer_maker
FROM (SELECT seq AS agg_trade_id, seq // 4 AS seq, * EXCLUDE (seq) FROM ({I.TRADES}))
QUALIFY count(*) FILTER (agg_trade_id % 10 = 3) OVER (PARTITION BY seq, symbol) = 0""")
def parse_rest_trades(spark, sf_dir):
    """Responses of up to four trades of a symbol; one bad element fails its whole response."""
    t = _trade_json(spark, sf_dir).select(F.floor(F.col("seq") / 4).alias("seq"), "symbol", "body")
    lines = t.groupBy("seq", "symbol").agg(F.concat(F.lit("["), F.array_join(F.collect_list("body"), ","), F.lit("]")).alias("value"))
    return wire.parse_rest_trades(lines, keep=("seq", "symbol"))


# --- tickers ------------------------------------------------------------------------------


def _ticker_lines(spark, sf_dir):
    """One array of two tickers per part; every 7th message is broken, every 5th volume is
    no number."""
    p = I.table(spark, sf_dir, "part")
    key = F.col("p_partkey")

    def one(quote: str):
        return F.concat(
            F.lit('{"e":"24hrMiniTicker","E":'), F.lit(1704067200000) + key, F.lit(',"s":"P'), key, F.lit(f'{quote}"'),
            F.lit(',"c":"'), F.col("p_retailprice"), F.lit('","o":"'), F.col("p_retailprice") - 1,
            F.lit('","h":"'), F.col("p_retailprice") + 1, F.lit('","l":"'), F.col("p_retailprice") - 2,
            F.lit('","v":"'), F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")), F.lit('","q":"18"}'),
        )

    return p.select(
        F.when(key % 7 == 0, F.lit("invalid json"))
        .otherwise(F.concat(F.lit("["), one("USDT"), F.lit(","), one("USDC"), F.lit("]")))
        .alias("value")
    )


_TICKERS = """SELECT 1704067200000 + p_partkey AS event_time_ms, 'P' || p_partkey || quote AS symbol,
  p_retailprice AS close, p_retailprice - 1 AS open, p_retailprice + 1 AS high, p_retailprice - 2 AS low,
  CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS volume, 18.0::DOUBLE AS turnover, p_partkey
FROM part CROSS JOIN (VALUES ('USDT'), ('USDC')) q(quote) WHERE p_partkey % 7 <> 0"""


@_register(f"SELECT '24hrMiniTicker' AS event_type, * EXCLUDE (p_partkey) FROM ({_TICKERS})")
def parse_ticker_array(spark, sf_dir):
    return wire.ticker_numbers(wire.parse_tickers(_ticker_lines(spark, sf_dir)))


@_register(f"""SELECT symbol, event_time_ms FROM ({_TICKERS}) WHERE symbol LIKE '%USDT'
  AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def new_symbols(spark, sf_dir):
    """Parts with a ticker of which no full lot of 50 was sold yet."""
    lots = I.table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") == 50)
    registry = lots.select(F.concat(F.lit("P"), "l_partkey", F.lit("USDT")).alias("symbol"))
    found = U.new_symbols(wire.parse_tickers(_ticker_lines(spark, sf_dir)), registry)
    return found.select("symbol", "event_time_ms")


_ADD_SEEDS_SQL = f"""SELECT symbol, period, {I.sql_floor('event_time_ms')} AS open_time,
  CASE WHEN ordinal = 0 THEN open ELSE close END AS open, CASE WHEN ordinal = 0 THEN high ELSE close END AS high,
  CASE WHEN ordinal = 0 THEN low ELSE close END AS low, close,
  CASE WHEN ordinal = 0 THEN volume ELSE 0 END AS volume, CASE WHEN ordinal = 0 THEN turnover ELSE 0 END AS turnover,
  CASE WHEN ordinal = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS trade_count,
  0.0::DOUBLE AS taker_buy_volume, 0.0::DOUBLE AS taker_buy_turnover
FROM ({_TICKERS}) CROSS JOIN {I.PERIOD_ROWS}"""


@_register(_ADD_SEEDS_SQL)
def first_bars_of_new_symbols(spark, sf_dir):
    tickers = wire.ticker_numbers(wire.parse_tickers(_ticker_lines(spark, sf_dir)))
    return U.add_seeds(tickers, PERIODS, ticker_as_first_bar=True)


# --- bars ---------------------------------------------------------------------------------


def _rest_lines(spark, sf_dir):
    """One response per trade: a good row, and a second row that is short, mistyped or good;
    every 9th response is empty."""
    t = I.trades(spark, sf_dir)

    def row(open_time, open_text, tail):
        return F.concat(
            F.lit("["), open_time, F.lit(","), open_text, F.lit(',"'), F.col("price") + 1, F.lit('","'), F.col("price") - 1,
            F.lit('","'), F.col("price"), F.lit('","'), F.col("quantity"), F.lit('",'), open_time + 59999,
            F.lit(',"'), F.col("price"), F.lit('",'), F.col("seq"), F.lit(',"1.5","2.5"'), tail, F.lit("]"),
        )

    quoted = F.concat(F.lit('"'), F.col("price"), F.lit('"'))
    good = row(F.col("ts_ms"), quoted, F.lit(',"0"'))
    second = row(
        F.col("ts_ms") + 60000,
        F.when(F.col("seq") % 3 == 1, F.col("price").cast("string")).otherwise(quoted),
        F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.lit(',"0"')),
    )
    return t.select(
        "seq",
        F.when(F.col("seq") % 9 == 0, F.lit("[]"))
        .otherwise(F.concat(F.lit("["), good, F.lit(","), second, F.lit("]")))
        .alias("value"),
    )


@_register(f"""SELECT seq, ts_ms + 60000 * part AS open_time, price AS open, price + 1 AS high, price - 1 AS low, price AS close,
  quantity AS volume, ts_ms + 60000 * part + 59999 AS close_time, price AS quote_asset_volume, seq AS number_of_trades,
  1.5::DOUBLE AS taker_buy_base_asset_volume, 2.5::DOUBLE AS taker_buy_quote_asset_volume, '0' AS ignore
FROM ({I.TRADES}) CROSS JOIN (VALUES (0), (1)) v(part)
WHERE seq % 9 <> 0 AND (part = 0 OR seq % 3 = 2)""")
def parse_rest_bars(spark, sf_dir):
    return wire.numeric_bars(wire.parse_rest_bars(_rest_lines(spark, sf_dir), keep=("seq",)))


@_register(f"SELECT seq FROM ({I.TRADES}) WHERE seq % 9 = 0")
def empty_rest_responses(spark, sf_dir):
    return wire.empty_responses(_rest_lines(spark, sf_dir)).select("seq")


_STORED_SQL = f"""SELECT symbol, period, open_time, open, high, low, close, round(volume, 4) AS volume, open_time + ms - 1 AS close_time,
  round(turnover, 4) AS quote_asset_volume, trade_count AS number_of_trades,
  round(taker_buy_volume, 4) AS taker_buy_base_asset_volume,
  round(taker_buy_turnover, 4) AS taker_buy_quote_asset_volume, '0' AS ignore
FROM ({I.sql_bars()}) JOIN (SELECT period, ms FROM {I.PERIOD_ROWS}) USING (period)"""


@_register(f"SELECT *, number_of_trades > 3 AS is_closed FROM ({_STORED_SQL})")
def parse_stream_bars(spark, sf_dir):
    """Bars of all periods written as pushed payloads and read back."""
    b = S.to_stored(I.rounded(B.build_bars(I.trades(spark, sf_dir))))
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    value = F.concat(
        F.lit('{"t":'), "open_time", F.lit(',"T":'), "close_time", F.lit(',"i":"'), "period", F.lit('","f":1,"L":2,"o":'), q("open"),
        F.lit(',"c":'), q("close"), F.lit(',"h":'), q("high"), F.lit(',"l":'), q("low"), F.lit(',"v":'), q("volume"),
        F.lit(',"n":'), "number_of_trades", F.lit(',"x":'), (F.col("number_of_trades") > 3).cast("string"),
        F.lit(',"q":'), q("quote_asset_volume"), F.lit(',"V":'), q("taker_buy_base_asset_volume"),
        F.lit(',"Q":'), q("taker_buy_quote_asset_volume"), F.lit(',"B":"0"}'),
    )
    back = wire.numeric_bars(wire.parse_stream_bars(b.select("symbol", value.alias("value")), keep=("symbol",)))
    return back.select("symbol", "period", *wire.STORED_BAR_COLUMNS, "is_closed")


# --- instruments and the universe ---------------------------------------------------------


def instrument_lines(spark, sf_dir):
    """One instrument list per customer; the market segment stands for the state."""
    c = I.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    status = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "SETTLING")
        .when(F.col("c_mktsegment") == "MACHINERY", "CLOSE")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "PENDING_TRADING")
        .otherwise("TRADING")
    )
    value = F.concat(
        F.lit('{"timezone":"UTC","symbols":[{"symbol":"C'), key, F.when(key % 5 == 0, F.lit("USDC")).otherwise(F.lit("USDT")),
        F.lit('","status":"'), status, F.lit('","contractType":"'),
        F.when(key % 4 == 0, F.lit("CURRENT_QUARTER")).otherwise(F.lit("PERPETUAL")),
        F.lit('","baseAsset":"C'), key, F.lit('","pricePrecision":'), F.col("c_nationkey"),
        F.lit(',"onboardDate":'), F.lit(1567900800000) + key * 86400000,
        F.lit(',"timeInForce":["GTC","IOC"],"filters":[{"filterType":"PRICE_FILTER"},{"x":1}],"maintMarginPercent":"2.5"}]}'),
    )
    return c.select(value.alias("value"))


INSTRUMENTS = """SELECT 'C' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SETTLING' WHEN 'MACHINERY' THEN 'CLOSE'
    WHEN 'HOUSEHOLD' THEN 'PENDING_TRADING' ELSE 'TRADING' END AS status,
  CASE WHEN c_custkey % 4 = 0 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type,
  'C' || c_custkey AS base_asset, c_nationkey::BIGINT AS price_precision,
  1567900800000 + c_custkey * 86400000 AS onboard_date FROM customer"""


def instruments(spark, sf_dir):
    return wire.parse_instruments(instrument_lines(spark, sf_dir))


_INST = ("symbol", "status", "contract_type")


@_register(f"""SELECT *, '' AS quote_asset, 0::BIGINT AS settle_plan, 'GTC,IOC' AS time_in_force, 2 AS filters, '"2.5"' AS margin
FROM ({INSTRUMENTS})""")
def parse_instruments(spark, sf_dir):
    return instruments(spark, sf_dir).select(
        *_INST, "base_asset", "price_precision", "onboard_date", "quote_asset", "settle_plan",
        F.array_join("time_in_force", ",").alias("time_in_force"),
        F.size("filters").alias("filters"),
        F.to_json(F.col("extra")["maintMarginPercent"]).alias("margin"),
    )


_SCOPE = "symbol LIKE '%USDT' AND contract_type = 'PERPETUAL'"


@_register(f"SELECT symbol, status, contract_type FROM ({INSTRUMENTS}) WHERE {_SCOPE} AND status = 'TRADING'")
def tradable_universe(spark, sf_dir):
    return U.tradable(instruments(spark, sf_dir), strict=True).select(*_INST)


@_register(f"SELECT symbol, status, contract_type FROM ({INSTRUMENTS}) WHERE {_SCOPE} AND status IN ('CLOSE', 'SETTLING')")
def delisted_symbols(spark, sf_dir):
    return U.delisted(instruments(spark, sf_dir)).select(*_INST)


@_register(f"SELECT symbol, status, contract_type FROM ({INSTRUMENTS}) WHERE status IN ('CLOSE', 'SETTLING')")
def delisted_any_contract(spark, sf_dir):
    return U.delisted(instruments(spark, sf_dir), any_contract=True).select(*_INST)


@_register(f"SELECT symbol, status, contract_type FROM ({INSTRUMENTS}) WHERE {_SCOPE} AND status = 'PENDING_TRADING'")
def unknown_status(spark, sf_dir):
    return U.unknown_status(instruments(spark, sf_dir)).select(*_INST)


def _order_bars(spark, sf_dir):
    """Monthly-ish bars of customers' orders: one weekly series per customer symbol."""
    o = I.table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    t = o.select(
        F.concat(F.lit("C"), key, F.when(key % 5 == 0, F.lit("USDC")).otherwise(F.lit("USDT"))).alias("symbol"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        (F.col("o_orderstatus") == "F").alias("is_buyer_maker"),
        F.col("o_orderkey").alias("seq"),
    )
    return B.build_bars(t, ("1d", "1w"))


_ORDER_TRADES = """SELECT 'C' || o_custkey || CASE WHEN o_custkey % 5 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol,
  o_totalprice AS price, 1.0::DOUBLE AS quantity, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderstatus = 'F' AS is_buyer_maker,
  o_orderkey AS seq FROM orders"""
_ORDER_BARS = f"SELECT * FROM ({I.sql_bars(_ORDER_TRADES)}) WHERE period IN ('1d', '1w')"


@_register(I.sql_rounded(_ORDER_BARS))
def order_bars(spark, sf_dir):
    """Daily and weekly bars over the orders table, one symbol per customer."""
    return I.rounded(_order_bars(spark, sf_dir))


_GONE = f"SELECT symbol FROM ({INSTRUMENTS}) WHERE {_SCOPE} AND status IN ('CLOSE', 'SETTLING')"


@_register(f"SELECT symbol, period, count(*) AS bars FROM ({_ORDER_BARS}) WHERE symbol IN ({_GONE}) GROUP BY ALL")
def data_of_delisted(spark, sf_dir):
    return U.data_of_delisted(_order_bars(spark, sf_dir), U.delisted(instruments(spark, sf_dir)))


@_register(f"SELECT symbol, period, open_time, close FROM ({_ORDER_BARS}) WHERE symbol NOT IN ({_GONE})")
def bars_without_delisted(spark, sf_dir):
    kept = U.without_delisted(_order_bars(spark, sf_dir), U.delisted(instruments(spark, sf_dir)))
    return kept.select("symbol", "period", "open_time", "close")


@_register(f"SELECT DISTINCT symbol, period FROM ({_ORDER_BARS})")
def catalog(spark, sf_dir):
    return U.catalog(_order_bars(spark, sf_dir), PERIODS)


@_register("SELECT DISTINCT event_type AS symbol FROM events")
def all_symbols_empty_registry(spark, sf_dir):
    """The registry holds nothing (no event has a negative id), so the data names the symbols."""
    ev = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id")
    return U.all_symbols(ev.filter(F.col("event_id") < 0), B.build_bars(I.trades(spark, sf_dir), ("1d",)))


_NOW = 1_900_000_000_000


@_register(f"""SELECT symbol, listed_ms, row_number() OVER (ORDER BY listed_ms, symbol) - 1 AS symbol_index FROM (
  SELECT i.symbol, coalesce(min(b.open_time), {_NOW}) AS listed_ms FROM (SELECT DISTINCT symbol FROM ({INSTRUMENTS})) i
  LEFT JOIN (SELECT * FROM ({_ORDER_BARS}) WHERE period = '1d') b ON b.symbol = i.symbol GROUP BY 1)""")
def symbol_index(spark, sf_dir):
    daily = S.of_period(_order_bars(spark, sf_dir), "1d")
    return U.symbol_index(instruments(spark, sf_dir).select("symbol").distinct(), daily, _NOW)


# Symbols that come and go: events of users divisible by 25 add, by 25 + 1 remove.
_COMMANDS = """SELECT event_type AS symbol, event_id AS seq, CASE WHEN user_id % 25 = 0 THEN 'add' ELSE 'remove' END AS kind
FROM events WHERE user_id % 25 < 2"""


def managed_commands(spark, sf_dir):
    return I.table(spark, sf_dir, "events").filter(F.col("user_id") % 25 < 2).select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 25 == 0, "add").otherwise("remove").alias("kind"),
    )


@_register(I.sql_rounded(sql_fill(f"""SELECT * FROM (
  WITH spans AS (SELECT symbol, seq AS from_seq, to_seq FROM (
      SELECT *, lead(seq) OVER (PARTITION BY symbol ORDER BY seq) AS to_seq FROM ({_COMMANDS})) WHERE kind = 'add'),
  tape AS (SELECT t.* REPLACE (t.symbol || '|' || s.from_seq AS symbol) FROM ({I.TRADES}) t JOIN spans s
      ON t.symbol = s.symbol AND t.seq > s.from_seq AND (s.to_seq IS NULL OR t.seq < s.to_seq))
  SELECT symbol, period, {I.sql_floor('ts_ms')} AS open_time, {I.SQL_OHLCV}
  FROM tape CROSS JOIN {I.PERIOD_ROWS} WHERE period IN ('1h', '1d') GROUP BY ALL)"""), "split_part(symbol, '|', 2)::BIGINT AS epoch, *").replace("* REPLACE (round", "* REPLACE (split_part(symbol, '|', 1) AS symbol, round"))
def bars_of_managed_symbols(spark, sf_dir):
    """Only trades between an add and the next command count; each add starts anew."""
    bars = U.managed_bars(I.trades(spark, sf_dir), U.lifetimes(managed_commands(spark, sf_dir)), periods=("1h", "1d"), gaps=True)
    return I.rounded(bars)
