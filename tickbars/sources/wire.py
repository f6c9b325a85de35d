"""Exchange payloads (one JSON text per row) as typed rows.

Works on any DataFrame with a text column ``value``: files read with ``spark.read.text``,
or a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.functions import variants as V
from tickbars.operators.sizing import small_side

TRADE_EVENT = "aggTrade"

# Fields of the payloads, key -> (column, type).
TRADE_FIELDS = {
    "s": ("symbol", "text"),
    "p": ("price_text", "text"),
    "q": ("quantity_text", "text"),
    "T": ("ts_ms", "integer"),
    "m": ("is_buyer_maker", "flag"),
}
TRADE_EXTRAS = {
    "a": ("agg_trade_id", "integer"),
    "f": ("first_trade_id", "integer"),
    "l": ("last_trade_id", "integer"),
    "E": ("event_time_ms", "integer"),
}
TICKER_FIELDS = {
    "e": ("event_type", "text"),
    "E": ("event_time_ms", "integer"),
    "s": ("symbol", "text"),
    "c": ("close", "text"),
    "o": ("open", "text"),
    "h": ("high", "text"),
    "l": ("low", "text"),
    "v": ("volume", "text"),
    "q": ("turnover", "text"),
}
STREAM_BAR_FIELDS = {
    "t": ("open_time", "integer"),
    "T": ("close_time", "integer"),
    "i": ("period", "text"),
    "f": ("first_trade_id", "integer"),
    "L": ("last_trade_id", "integer"),
    "o": ("open", "text"),
    "c": ("close", "text"),
    "h": ("high", "text"),
    "l": ("low", "text"),
    "v": ("volume", "text"),
    "n": ("number_of_trades", "integer"),
    "x": ("is_closed", "flag"),
    "q": ("quote_asset_volume", "text"),
    "V": ("taker_buy_base_asset_volume", "text"),
    "Q": ("taker_buy_quote_asset_volume", "text"),
    "B": ("ignore", "text"),
}
REST_TRADE_FIELDS = {
    "a": ("agg_trade_id", "integer"),
    "p": ("price_text", "text"),
    "q": ("quantity_text", "text"),
    "T": ("ts_ms", "integer"),
    "m": ("is_buyer_maker", "flag"),
}
REST_BAR_POSITIONS = (
    ("open_time", "integer"),
    ("open", "text"),
    ("high", "text"),
    ("low", "text"),
    ("close", "text"),
    ("volume", "text"),
    ("close_time", "integer"),
    ("quote_asset_volume", "text"),
    ("number_of_trades", "integer"),
    ("taker_buy_base_asset_volume", "text"),
    ("taker_buy_quote_asset_volume", "text"),
    ("ignore", "text"),
)
STORED_BAR_COLUMNS = tuple(name for name, _ in REST_BAR_POSITIONS)

# Instrument fields that fall back to an empty value when absent.
INSTRUMENT_TEXTS = {
    "status": "status",
    "baseAsset": "base_asset",
    "quoteAsset": "quote_asset",
    "marginAsset": "margin_asset",
    "underlyingType": "underlying_type",
    "triggerProtect": "trigger_protect",
    "contractType": "contract_type",
    "contractStatus": "contract_status",
    "liquidationFee": "liquidation_fee",
    "marketTakeBound": "market_take_bound",
}
INSTRUMENT_NUMBERS = {
    "pricePrecision": "price_precision",
    "quantityPrecision": "quantity_precision",
    "baseAssetPrecision": "base_asset_precision",
    "quotePrecision": "quote_precision",
    "settlePlan": "settle_plan",
    "deliveryDate": "delivery_date",
    "onboardDate": "onboard_date",
}
INSTRUMENT_LISTS = {
    "underlyingSubType": "underlying_sub_type",
    "orderType": "order_type",
    "timeInForce": "time_in_force",
}

def _complete(fields: dict) -> Column:
    ok = F.lit(True)
    for name, _ in fields.values():
        ok = ok & F.col(name).isNotNull()
    return ok


def to_number(text: Column) -> Column:
    """Number or null; the trade path drops rows with a null."""
    return text.try_cast("double")


def number_or_zero(text: Column) -> Column:
    """Number, or 0.0 for text that is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def stream_name(symbol: Column) -> Column:
    return F.concat(F.lower(symbol), F.lit(f"@{TRADE_EVENT}"))


def symbol_of_stream(stream: Column) -> Column:
    return F.upper(F.substring_index(stream, "@", 1))


# --- trades -------------------------------------------------------------------------------


def classify_trades(lines: DataFrame) -> DataFrame:
    """All input columns plus the trade fields and ``outcome``.

    Single-stream messages must be trade events; messages in a combined envelope
    (``stream`` and ``data``) are taken by their data, which must name an event. ``outcome`` is ``trade``,
    ``ignored`` (another message), ``bad_payload``, ``bad_price`` or ``bad_quantity``.
    """
    held = [F.col(c) for c in lines.columns]
    fields = TRADE_FIELDS | TRADE_EXTRAS
    tagged = {"e": ("_event", "text")} | fields
    own, names = V.json_type(tagged)[len("struct<") : -1], V.named_type(tagged)[len("struct<") : -1]
    envelope = F.from_json("value", f"struct<stream:variant,data:{V.json_type(tagged)},{own}>").cast(
        f"struct<_stream:variant,_data:{V.named_type(tagged)},{names}>"
    )
    opened = lines.select(*held, F.inline(F.array(envelope)))
    in_stream = V.kind(F.col("_stream")) == "STRING"
    # data that is no object is still a (bad) combined message
    combined = F.coalesce(
        in_stream & (F.col("_data").isNotNull() | F.get_json_object("value", "$.data").isNotNull()), F.lit(False)
    )
    body = F.when(F.col("_combined"), F.col("_data")).otherwise(F.struct(*(n for n, _ in tagged.values())))
    chosen = opened.withColumn("_combined", combined).select(
        *held, V.as_text(F.col("_event")).alias("_event"), "_combined", body.alias("_body")
    )
    tag = F.col("_body._event").isNotNull().alias("_tagged")
    texts = chosen.select(*held, "_event", "_combined", V.unfold([*V.strict(fields, "_body"), tag]))
    parsed = texts.select(
        "*",
        to_number(F.col("price_text")).alias("price"),
        to_number(F.col("quantity_text")).alias("quantity"),
    )
    outcome = (
        F.when(~F.col("_combined") & ~F.col("_event").eqNullSafe(F.lit(TRADE_EVENT)), "ignored")
        .when(~_complete(TRADE_FIELDS) | ~F.col("_tagged"), "bad_payload")
        .when(F.col("price").isNull(), "bad_price")
        .when(F.col("quantity").isNull(), "bad_quantity")
        .otherwise("trade")
    )
    return parsed.withColumn("outcome", outcome).drop("_combined", "_event", "_tagged")


def known_symbols_only(trades: DataFrame, registry: DataFrame) -> DataFrame:
    """Drop trades of symbols that are not registered, without a report."""
    return trades.join(small_side(registry.select("symbol").distinct()), "symbol", "left_semi")


def accepted_trades(classified: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    good = classified.filter(F.col("outcome") == "trade")
    return good if registry is None else known_symbols_only(good, registry)


def rejected_trades(classified: DataFrame) -> DataFrame:
    """Trade messages that could not be used; other messages are not errors."""
    return classified.filter(F.col("outcome").startswith("bad_"))


def _array_of(fields: dict) -> Column:
    """A text that is a JSON array of payloads; null for anything else."""
    parsed = F.from_json("value", f"array<{V.json_type(fields)}>").cast(f"array<{V.named_type(fields)}>")
    return F.when(F.ltrim("value").startswith("["), parsed)


def parse_rest_trades(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trade history responses: one JSON array of trades per row. A response with an element
    that lacks a field, or holds one of another type, gives no rows. ``keep`` names input
    columns to carry along."""
    def whole(t: Column) -> Column:
        ok = t.isNotNull()
        for name, kind in REST_TRADE_FIELDS.values():
            ok = ok & (V.kind(t[name]) == "STRING" if kind == "text" else t[name].isNotNull())
        return F.coalesce(ok, F.lit(False))

    opened = lines.select(*keep, F.explode(F.array(_array_of(REST_TRADE_FIELDS))).alias("_all"))
    return (
        opened.filter(F.forall("_all", whole))
        .select(*keep, F.inline("_all"))
        .select(*keep, V.unfold(V.strict(REST_TRADE_FIELDS)))
        .select(
            *keep,
            "agg_trade_id",
            to_number(F.col("price_text")).alias("price"),
            to_number(F.col("quantity_text")).alias("quantity"),
            "ts_ms",
            "is_buyer_maker",
        )
    )


# --- tickers and bars ---------------------------------------------------------------------


def parse_tickers(lines: DataFrame) -> DataFrame:
    """Ticker arrays, one row per symbol. A message that is no array, or has an element that
    lacks a field, gives no rows and no error."""
    def whole(t: Column) -> Column:
        ok = F.lit(True)
        for name, kind in TICKER_FIELDS.values():
            ok = ok & (V.kind(t[name]) == "STRING" if kind == "text" else t[name].isNotNull())
        return F.coalesce(ok, F.lit(False))

    opened = lines.select(F.explode(F.array(_array_of(TICKER_FIELDS))).alias("_all"))
    return (
        opened.filter(F.forall("_all", whole))
        .select(F.inline("_all"))
        .select(*V.strict(TICKER_FIELDS))
    )


def ticker_numbers(tickers: DataFrame) -> DataFrame:
    """Numeric OHLCV of tickers; text that is no number counts as 0."""
    values = ("open", "high", "low", "close", "volume", "turnover")
    return tickers.select(
        *(number_or_zero(F.col(c)).alias(c) if c in values else F.col(c) for c in tickers.columns)
    )


def parse_rest_bars(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bar history responses: arrays of 12-element arrays. Rows with fewer elements or a
    wrong type in a position are skipped. ``keep`` names input columns to carry along."""
    rows = lines.select(*keep, F.explode(F.from_json("value", "array<array<variant>>")).alias("_r"))
    read = {"text": V.as_text, "integer": V.as_integer}
    cells = [read[kind](F.get("_r", F.lit(i))).alias(name) for i, (name, kind) in enumerate(REST_BAR_POSITIONS)]
    full = F.lit(True)
    for name in STORED_BAR_COLUMNS:
        full = full & F.col(name).isNotNull()
    return rows.select(*keep, V.unfold(cells)).filter(full)


def empty_responses(lines: DataFrame) -> DataFrame:
    """Bar responses without a single row: an error of the request, to be reported."""
    return lines.filter(F.size(F.from_json("value", "array<variant>")) == 0)


def parse_stream_bars(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bars pushed by the exchange, with the names of stored bars."""
    payload = F.from_json("value", V.json_type(STREAM_BAR_FIELDS)).cast(V.named_type(STREAM_BAR_FIELDS))
    return (
        lines.select(*keep, F.inline(F.array(payload)))
        .select(*keep, V.unfold(V.strict(STREAM_BAR_FIELDS)))
        .filter(_complete(STREAM_BAR_FIELDS))
    )


def numeric_bars(stored: DataFrame) -> DataFrame:
    """Stored bars with number columns instead of number texts."""
    texts = {n for n, kind in REST_BAR_POSITIONS if kind == "text"} - {"ignore"}
    return stored.select(
        *(number_or_zero(F.col(c)).alias(c) if c in texts else F.col(c) for c in stored.columns)
    )


# --- instruments --------------------------------------------------------------------------


def parse_instruments(lines: DataFrame) -> DataFrame:
    """Instrument list responses: one row per symbol. Only ``symbol`` is required; other
    fields have defaults, and unknown ones are kept in ``extra``."""
    listed = F.from_json("value", "struct<symbols:array<map<string,variant>>>")["symbols"]
    opened = lines.select(F.explode(listed).alias("_s"))
    at = lambda key: F.col("_s")[key]
    known = ["symbol", "filters", *INSTRUMENT_TEXTS, *INSTRUMENT_NUMBERS, *INSTRUMENT_LISTS]
    no_text = F.array().cast("array<string>")
    fields = [
        V.as_text(at("symbol")).alias("symbol"),
        *(F.coalesce(V.as_text(at(k)), F.lit("")).alias(n) for k, n in INSTRUMENT_TEXTS.items()),
        *(F.coalesce(V.as_integer(at(k)), F.lit(0)).alias(n) for k, n in INSTRUMENT_NUMBERS.items()),
        *(
            F.coalesce(F.try_variant_get(at(k), "$", "array<string>"), no_text).alias(n)
            for k, n in INSTRUMENT_LISTS.items()
        ),
        F.coalesce(V.as_items(at("filters")), F.array().cast("array<variant>")).alias("filters"),
        F.map_filter("_s", lambda k, _: ~k.isin(known)).alias("extra"),
    ]
    return opened.select(V.unfold(fields)).filter(F.col("symbol").isNotNull())
