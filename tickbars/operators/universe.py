"""Which symbols are traded, gone, new or unknown, and their stable numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.functions.timefns import bar_open
from tickbars.operators.bars import build_bars
from tickbars.operators.running import numbered, running

# The instrument kind in scope and its states.
QUOTE = "USDT"
CONTRACT = "PERPETUAL"
TRADING = "TRADING"
DELISTED = ("CLOSE", "SETTLING")


def _in_scope() -> Column:
    return F.col("symbol").endswith(QUOTE) & (F.col("contract_type") == CONTRACT)


def tradable(instruments: DataFrame, strict: bool = False) -> DataFrame:
    """Perpetual contracts against the quote asset that trade now. With ``strict`` an empty
    result fails when the job runs."""
    found = instruments.filter(_in_scope() & (F.col("status") == TRADING))
    if not strict:
        return found
    some = instruments.select(F.count_if(_in_scope() & (F.col("status") == TRADING)).alias("n")).scalar()
    return found.unionByName(
        instruments.select(F.count("*").alias("_n")).filter(some == 0).select(
            *(F.raise_error(F.lit("no tradable instruments")).cast(f.dataType).alias(f.name) for f in instruments.schema)
        )
    )


def delisted(instruments: DataFrame, any_contract: bool = False) -> DataFrame:
    """Symbols whose trading ended; ``any_contract`` looks at the state alone."""
    gone = F.col("status").isin(*DELISTED)
    return instruments.filter(gone if any_contract else gone & _in_scope())


def unknown_status(instruments: DataFrame) -> DataFrame:
    """In-scope symbols in any other state, for a report."""
    return instruments.filter(_in_scope() & ~F.col("status").isin(TRADING, *DELISTED))


def new_symbols(tickers: DataFrame, registry: DataFrame) -> DataFrame:
    """Tickers of symbols that are not registered yet."""
    return tickers.filter(F.col("symbol").endswith(QUOTE)).join(registry.select("symbol"), "symbol", "left_anti")


def data_of_delisted(bars: DataFrame, gone: DataFrame) -> DataFrame:
    """Report: which (symbol, period) still hold bars of delisted symbols."""
    return (
        bars.join(gone.select("symbol"), "symbol", "left_semi")
        .groupBy("symbol", "period")
        .agg(F.count("*").alias("bars"))
    )


def without_delisted(bars: DataFrame, gone: DataFrame) -> DataFrame:
    return bars.join(gone.select("symbol"), "symbol", "left_anti")


def catalog(bars: DataFrame, periods: tuple[str, ...] | None = None) -> DataFrame:
    """(symbol, period) pairs that hold data, for the configured periods."""
    pairs = bars.select("symbol", "period").distinct()
    return pairs if periods is None else pairs.filter(F.col("period").isin(*periods))


def all_symbols(registry: DataFrame, bars: DataFrame) -> DataFrame:
    """Registered symbols, or those found in the data while the registry is empty."""
    registered = registry.select(F.count("*").alias("n")).scalar()
    return (
        registry.select("symbol")
        .distinct()
        .unionByName(bars.select("symbol").distinct().filter(registered == 0))
    )


def symbol_index(symbols: DataFrame, daily_bars: DataFrame, now_ms: int) -> DataFrame:
    """Number symbols from 0 by listing time (first daily bar, else now) and then by name."""
    first = daily_bars.groupBy("symbol").agg(F.min("open_time").alias("_first"))
    timed = symbols.join(first, "symbol", "left").select(
        "symbol", F.coalesce("_first", F.lit(now_ms)).alias("listed_ms")
    )
    # symbols without bars share one time, so the beginning of the name parts them
    chunk = F.struct("listed_ms", F.substring("symbol", 1, 2))
    ranked = numbered(timed, ["listed_ms", "symbol"], chunk, "_n")
    return ranked.select("symbol", "listed_ms", (F.col("_n") - 1).alias("symbol_index"))


# --- symbols that come and go while trades flow -------------------------------------------


def lifetimes(commands: DataFrame) -> DataFrame:
    """Spans of arrival positions in which a symbol is managed, from add/remove commands.

    ``commands(symbol, seq, kind)``; each add opens a span that the next command of the
    symbol closes. A remove without an add closes nothing.
    """
    per_symbol = Window.partitionBy("symbol").orderBy("seq")
    return (
        commands.select(
            "symbol", "kind", F.col("seq").alias("from_seq"), F.lead("seq").over(per_symbol).alias("to_seq")
        )
        .filter(F.col("kind") == "add")
        .drop("kind")
    )


def managed_trades(trades: DataFrame, spans: DataFrame) -> DataFrame:
    """Trades that arrive inside a span of their symbol, tagged with its start (``epoch``).

    Spans of a symbol do not overlap (:func:`lifetimes`). So the last one that started before a trade is
    the only one that may hold it, and a running maximum in arrival order finds it: trades never meet all spans
    of their symbol. A trade that is a command itself comes before the span that it opens.
    """
    never = F.lit((1 << 63) - 1)
    starts = spans.select("symbol", (F.col("from_seq") * 2 + 1).alias("_at"), "from_seq", F.coalesce("to_seq", never).alias("_to"))
    rows = trades.withColumn("_at", F.col("seq") * 2).unionByName(starts, allowMissingColumns=True).filter(F.col("symbol").isNotNull())
    known = running(rows, ["symbol"], "_at", {"epoch": ("max", "from_seq"), "_until": ("max", "_to")})
    inside = F.col("from_seq").isNull() & F.col("epoch").isNotNull() & (F.col("seq") < F.col("_until"))
    return known.filter(inside).select(*trades.columns, "epoch")


def managed_bars(trades: DataFrame, spans: DataFrame, seeds: DataFrame | None = None, **options) -> DataFrame:
    """Bars of managed symbols. A symbol that returns starts anew, so bars are built per
    (symbol, epoch); ``seeds`` carry an ``epoch`` too. Result has an ``epoch`` column."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("symbol", F.concat_ws("|", "symbol", F.col("epoch").cast("string"))).drop("epoch")

    bars = build_bars(
        keyed(managed_trades(trades, spans)),
        arrival_order=True,
        seeds=None if seeds is None else keyed(seeds),
        **options,
    )
    return bars.select(
        F.regexp_replace("symbol", r"\|-?[0-9]+$", "").alias("symbol"),
        F.substring_index("symbol", "|", -1).cast("bigint").alias("epoch"),
        *(c for c in bars.columns if c != "symbol"),
    )


def add_seeds(adds: DataFrame, periods: tuple[str, ...], ticker_as_first_bar: bool = False) -> DataFrame:
    """Open bars of newly added symbols: flat and provisional at the ticker's close.

    ``adds`` holds ``symbol, event_time_ms, open, high, low, close, volume, turnover``. With
    ``ticker_as_first_bar`` the shortest period takes the ticker's own OHLCV as one trade.
    """

    def seed(i: int, p: str) -> Column:
        real = ticker_as_first_bar and i == 0
        zero = F.lit(0.0)
        return F.struct(
            F.lit(p).alias("period"),
            bar_open(F.col("event_time_ms"), p).alias("open_time"),
            *(F.col(c if real else "close").alias(c) for c in ("open", "high", "low", "close")),
            *((F.col(c) if real else zero).alias(c) for c in ("volume", "turnover")),
            F.lit(1 if real else 0).cast("bigint").alias("trade_count"),
            zero.alias("taker_buy_volume"),
            zero.alias("taker_buy_turnover"),
        )

    return adds.filter(F.col("event_time_ms") > 0).select(
        "symbol", F.inline(F.array(*(seed(i, p) for i, p in enumerate(periods))))
    )
