"""Filters, sessions and statistics over log entries and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.operators.running import CHUNK_ROWS, chunk_of, running
from tickbars.session import stored
from tickbars.sources.logs import SUMMARY_TYPES, session_marker

# History length and default size of an answer.
HISTORY_ROWS = 50_000_000
ANSWER_ROWS = 1000


# --- sessions and history -----------------------------------------------------------------


def sessions(entries: DataFrame, order: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``session``: the number of markers so far. Markers themselves are left out.

    Entries are parsed once and stored. Sorted chunks then carry a running count, which starts
    from the markers of the chunks before.
    """
    held = stored(entries.withColumn("_mark", session_marker().cast("int")))
    counted = running(held, [], order, {"session": ("sum", "_mark")}, inclusive=True, chunk_rows=chunk_rows)
    return counted.filter(F.col("_mark") == 0).drop("_mark").withColumn("session", F.col("session").cast("bigint"))


def current_session(entries: DataFrame, order: str = "seq") -> DataFrame:
    """Entries after the last marker: what is left once earlier history is cleared."""
    last = entries.filter(session_marker()).select(F.max(order).alias("m")).scalar()
    return entries.filter(last.isNull() | (F.col(order) > last))


def last_connection(spans: DataFrame, connection: str = "connection_id") -> DataFrame:
    """Spans of the newest connection: each connection clears the store."""
    return spans.filter(F.col(connection) == spans.select(F.max(connection).alias("m")).scalar())


def newest(entries: DataFrame, n: int = HISTORY_ROWS, order: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The newest ``n`` entries by arrival, without bringing them into one task.

    Counts per chunk of arrival tell in which chunk the oldest kept entry lies. Newer chunks
    are kept whole by a plain filter; only that one chunk is ranked.
    """
    entries = stored(entries)
    chunk = chunk_of(entries, order, chunk_rows)
    counts = entries.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
    newer = Window.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.select("_chunk", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer")).filter(
        F.col("_newer") < n
    )
    oldest = edge.select(F.min("_chunk").alias("c")).scalar()
    room = edge.select((F.lit(n) - F.max("_newer")).alias("r")).scalar()
    rank = F.row_number().over(Window.orderBy(F.col(order).desc()))
    on_edge = entries.filter(chunk == oldest).withColumn("_rank", rank).filter(F.col("_rank") <= room).drop("_rank")
    return entries.filter(chunk > oldest).unionByName(on_edge)


# --- filters ------------------------------------------------------------------------------


def subscription(entries: DataFrame, kind: str) -> DataFrame:
    """``trace`` takes trace entries; ``module`` takes all others, those without a type too."""
    is_trace = F.col("log_type").eqNullSafe(F.lit("trace"))
    return entries.filter(is_trace if kind == "trace" else ~is_trace)


def problems(entries: DataFrame, kind: Column | None = None) -> DataFrame:
    """Warnings, errors and summary entries. ``kind`` defaults to ``log_type``."""
    kind = F.col("log_type") if kind is None else kind
    return entries.filter(F.col("level").isin("WARN", "ERROR") | F.coalesce(kind.isin(*SUMMARY_TYPES), F.lit(False)))


def latest_records(spans: DataFrame, order: str = "seq") -> DataFrame:
    """The last record of each span id: a repeated id replaces the span."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col(order).desc()))
    return spans.withColumn("_newest", newest).filter(F.col("_newest") == 1).drop("_newest")


def spans_by_tx(spans: DataFrame, tx_id: str, limit: int | None = None, order: str = "seq") -> DataFrame:
    """Spans whose attribute ``tx_id`` is this text; a number does not match. With ``limit``,
    the first ones by arrival."""
    value = F.try_element_at("attributes", F.lit("tx_id"))
    is_text = F.schema_of_variant(value) == "STRING"
    found = spans.filter(is_text & (F.try_variant_get(value, "$", "string") == tx_id))
    return found if limit is None else found.orderBy(order).limit(limit)


def trace(spans: DataFrame, trace_id: str, order: str = "seq") -> DataFrame:
    """All spans of a trace in the order they came in."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy(order)


def search(
    entries: DataFrame,
    *,
    target_part: str | None = None,
    level: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    trace_id: str | None = None,
    limit: int | None = None,
    order: str = "seq",
) -> DataFrame:
    """Entries that meet all given conditions; with ``limit``, the first ones by arrival."""
    found = entries
    if target_part is not None:
        found = found.filter(F.col("target").contains(target_part))
    if level is not None:
        found = found.filter(F.col("level") == level)
    if start is not None:
        found = found.filter(F.col("timestamp") >= start)
    if end is not None:
        found = found.filter(F.col("timestamp") <= end)
    if trace_id is not None:
        found = found.filter(F.col("trace_id") == trace_id)
    return found if limit is None else found.orderBy(order).limit(limit)


# --- statistics ---------------------------------------------------------------------------


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.count("*").alias("entries"))


def target_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("target").agg(F.count("*").alias("entries"))


def span_totals(spans: DataFrame) -> DataFrame:
    """Number of spans, each id once, and of traces."""
    return spans.agg(F.count_distinct("id").alias("spans"), F.count_distinct("trace_id").alias("traces"))


def trace_stats(spans: DataFrame) -> DataFrame:
    """Per trace: extent in time, spans and failures (``start_ms``, ``duration_ms``, ``status``)."""
    end = F.col("start_ms") + F.col("duration_ms")
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"),
        (F.max(end) - F.min("start_ms")).alias("trace_ms"),
        F.count_if(F.col("status") == "FAILURE").alias("failures"),
    )


def span_stats(spans: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """Per span name: count and spread of durations."""
    return spans.groupBy("name").agg(
        F.count("*").alias("spans"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.5, accuracy).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95, accuracy).alias("p95_ms"),
    )
