import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickbars.operators import universe as U
from tickbars.sources import wire

TRADE = '{"e":"aggTrade","E":1704067200100,"s":"BTCUSDT","a":1,"p":"42000.50","q":"0.010","f":1,"l":1,"T":1704067200090,"m":false}'


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize(
    "text, outcome",
    [
        (TRADE, "trade"),
        ('{"stream":"btcusdt@aggTrade","data":%s}' % TRADE, "trade"),
        ('{"stream":"btcusdt@aggTrade","data":%s}' % TRADE.replace("aggTrade", "other"), "trade"),
        ('{"stream":"btcusdt@aggTrade","data":5}', "bad_payload"),
        ('{"stream":"btcusdt@aggTrade","data":{"p":"1"}}', "bad_payload"),
        ('{"result":null,"id":1}', "ignored"),
        (TRADE.replace("aggTrade", "kline"), "ignored"),
        ("invalid json", "ignored"),
        ("[1,2]", "ignored"),
        (TRADE.replace('"42000.50"', '"abc"'), "bad_price"),
        (TRADE.replace('"42000.50"', "42000.50"), "bad_payload"),
        (TRADE.replace('"0.010"', '""'), "bad_quantity"),
        (TRADE.replace("false", '"false"'), "bad_payload"),
        (TRADE.replace("1704067200090", '"1704067200090"'), "bad_payload"),
    ],
)
def test_trade_outcomes(spark, text, outcome):
    r = wire.classify_trades(lines(spark, text)).first()
    assert r.outcome == outcome
    if outcome == "trade":
        assert (r.symbol, r.price, r.quantity, r.ts_ms, r.is_buyer_maker) == ("BTCUSDT", 42000.5, 0.01, 1704067200090, False)
        assert (r.agg_trade_id, r.event_time_ms) == (1, 1704067200100)


def test_unknown_symbols_are_dropped_without_a_reject(spark):
    c = wire.classify_trades(lines(spark, TRADE, TRADE.replace("BTCUSDT", "NOPE")))
    registry = spark.createDataFrame([("BTCUSDT",), ("BTCUSDT",)], "symbol string")
    assert [r.symbol for r in wire.accepted_trades(c, registry).collect()] == ["BTCUSDT"]
    assert wire.rejected_trades(c).count() == 0


TICKER = '{"e":"24hrMiniTicker","E":123456789,"s":"BNBUSDT","c":"0.0025","o":"0.0010","h":"0.0025","l":"0.0010","v":"10000","q":"18"}'


def test_tickers(spark):
    two = "[%s,%s]" % (TICKER, TICKER.replace("BNB", "BTC").replace('"18"', '"x"'))
    broken = "[%s,%s]" % (TICKER, TICKER.replace('"s"', '"z"'))
    got = wire.ticker_numbers(wire.parse_tickers(lines(spark, two, broken, "invalid json", TICKER, "[]"))).collect()
    assert [(r.symbol, r.close, r.turnover) for r in got] == [("BNBUSDT", 0.0025, 18.0), ("BTCUSDT", 0.0025, 0.0)]


ROW = '[1704067200000,"42000","42100","41900","42050","12.5",1704067259999,"525000",321,"6.1","256200","0"]'


def test_rest_bars_skip_bad_rows(spark):
    short = ROW.replace(',"0"]', "]")
    mistyped = ROW.replace('"42000"', "42000")
    longer = ROW.replace('"0"]', '"0","more"]')
    got = wire.parse_rest_bars(lines(spark, f"[{ROW},{short},{mistyped},{longer}]", "oops")).collect()
    assert len(got) == 2 and got[0].open == "42000" and got[0].number_of_trades == 321
    assert wire.empty_responses(lines(spark, "[]", f"[{ROW}]", "oops")).count() == 1


def test_stream_bar(spark):
    text = '{"t":1,"T":59999,"i":"1m","f":1,"L":2,"o":"1","c":"2","h":"3","l":"0.5","v":"9","n":4,"x":true,"q":"18","V":"3","Q":"6","B":"0"}'
    r = wire.parse_stream_bars(lines(spark, text, "{}")).first()
    assert (r.open_time, r.close_time, r.period, r.low, r.volume, r.taker_buy_base_asset_volume, r.is_closed) == (1, 59999, "1m", "0.5", "9", "3", True)


def instruments(spark):
    rows = [
        ("BTCUSDT", "PERPETUAL", "TRADING"),
        ("OLDUSDT", "PERPETUAL", "SETTLING"),
        ("GONEUSDT", "PERPETUAL", "CLOSE"),
        ("NEWUSDT", "PERPETUAL", "PENDING_TRADING"),
        ("BTCUSDC", "PERPETUAL", "TRADING"),
        ("BTCUSDT_240628", "CURRENT_QUARTER", "TRADING"),
        ("ENDUSDC", "PERPETUAL", "CLOSE"),
    ]
    one = ",".join('{"symbol":"%s","contractType":"%s","status":"%s","odd":1}' % r for r in rows)
    return wire.parse_instruments(lines(spark, '{"symbols":[%s,{"status":"TRADING"}]}' % one))


def test_universe(spark):
    names = lambda df: sorted(r.symbol for r in df.collect())
    found = instruments(spark)
    assert names(U.tradable(found, strict=True)) == ["BTCUSDT"]
    assert names(U.delisted(found)) == ["GONEUSDT", "OLDUSDT"]
    assert names(U.delisted(found, any_contract=True)) == ["ENDUSDC", "GONEUSDT", "OLDUSDT"]
    assert names(U.unknown_status(found)) == ["NEWUSDT"]
    r = found.filter("symbol = 'BTCUSDT'").select("price_precision", "base_asset", "filters", F.map_keys("extra").alias("x")).first()
    assert (r.price_precision, r.base_asset, r.filters, r.x) == (0, "", [], ["odd"])
    with pytest.raises(PySparkException):
        U.tradable(found.filter("symbol <> 'BTCUSDT'"), strict=True).collect()


def test_add_and_remove_while_trading(spark):
    commands = spark.createDataFrame(
        [("A", 10, "add"), ("A", 20, "remove"), ("A", 30, "add"), ("B", 5, "remove")], "symbol string, seq bigint, kind string"
    )
    trades = spark.createDataFrame(
        [(s, float(i), 1.0, 1_704_067_200_000 + i * 1000, True, i) for i in (5, 11, 19, 21, 31, 40) for s in "AB"],
        "symbol string, price double, quantity double, ts_ms bigint, is_buyer_maker boolean, seq bigint",
    )
    spans = U.lifetimes(commands)
    got = sorted((r.symbol, r.seq, r.epoch) for r in U.managed_trades(trades, spans).collect())
    assert got == [("A", 11, 10), ("A", 19, 10), ("A", 31, 30), ("A", 40, 30)]
    bars = U.managed_bars(trades, spans, periods=("1m",)).collect()
    assert sorted((r.symbol, r.epoch, r.open, r.close) for r in bars) == [("A", 10, 11.0, 19.0), ("A", 30, 31.0, 40.0)]


def test_trades_do_not_meet_all_spans_of_their_symbol(spark):
    ids = spark.range(3000)
    commands = ids.select(F.lit("A").alias("symbol"), (F.col("id") * 3).alias("seq"), F.when(F.col("id") % 3 < 2, "add").otherwise("remove").alias("kind"))
    trades = ids.select(F.lit("A").alias("symbol"), F.explode(F.array(*(F.col("id") * 3 + i for i in range(3)))).alias("seq"))
    found = U.managed_trades(trades, U.lifetimes(commands))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    # the trade that is a command itself does not count
    want = [(i * 3 + k, i * 3) for i in range(3000) if i % 3 < 2 for k in (1, 2)]
    assert sorted((r.seq, r.epoch) for r in found.collect()) == want


def test_stream_names(spark):
    r = spark.range(1).select(wire.stream_name(F.lit("BTCUSDT")).alias("n"), wire.symbol_of_stream(F.lit("btcusdt@aggTrade")).alias("s")).first()
    assert (r.n, r.s) == ("btcusdt@aggTrade", "BTCUSDT")
