"""Registered streaming queries (the tape is read as a stream and drained), clock samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickbars.functions.timefns import bar_open, ntz_to_ms
from tickbars.operators import bars as B
from tickbars.operators import clocksync as C
from tickbars.queries import inputs as I
from tickbars.queries.bar_queries import SQL as BAR_SQL
from tickbars.queries.wire_queries import SQL as WIRE_SQL
from tickbars.queries.wire_queries import managed_commands
from tickbars.session import prepare, shared_dir, stored
from tickbars.sinks import store as S
from tickbars.streaming import clock, jobs, keyed, metrics, throttle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _tape_stream(spark, sf_dir):
    prepare(spark)
    schema = I.table(spark, sf_dir, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        ntz_to_ms(F.col("ts")).alias("ts_ms"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        F.col("event_id").alias("seq"),
    )


def _root(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@_register(BAR_SQL["bars_exact_gapfilled"])
def stream_bars_exact(spark, sf_dir):
    """All bar rules over a stream with scattered arrivals; equal to the batch result."""
    root = _root(spark)
    tape = _tape_stream(spark, sf_dir).withColumn("seq", I.scatter(F.col("seq")))
    jobs.start_exact(tape, root, availableNow=True).awaitTermination()
    return I.rounded(S.read_current(spark, f"{root}/bars").drop("month"))


#: Rows of a micro-batch and of a file, at most (about, as the tape is cut at approximate quantiles).
_BATCH_ROWS, _FILE_ROWS = 4_000_000, 500_000


def _cut(events, n):
    """``n`` parts of a stored tape in order of arrival, more of a long one, and how many files each shall have."""
    rows = events.count()
    n = max(n, -(-rows // _BATCH_ROWS))
    cuts = events.select(F.percentile_approx("seq", [i / n for i in range(1, n)], 100_000)).first()[0] or []
    bounds = list(zip([None, *cuts], [*cuts, None]))
    above = lambda low: F.lit(True) if low is None else F.col("seq") > low
    upto = lambda high: F.lit(True) if high is None else F.col("seq") <= high
    return [events.filter(above(low) & upto(high)) for low, high in bounds], max(1, -(-rows // n // _FILE_ROWS))


def _append(part, path, files):
    """Each part has the same number of files, so that a trigger of so many files reads a part."""
    part = part.coalesce(1) if files == 1 else part.repartition(files)
    part.write.mode("append").parquet(path)


def _batches(spark, sf_dir, root, n=3, trades=None):
    """The scattered tape as a stream of ``n`` micro-batches in order of arrival, of more if it is long."""
    prepare(spark)
    return _streamed(spark, root, stored(I.scattered_trades(spark, sf_dir) if trades is None else trades), n)[0]


def _streamed(spark, root, tape, n):
    """A stored tape as a stream, and the number of its micro-batches."""
    cut, files = _cut(tape, n)
    for part in cut:
        _append(part, f"{root}/tape", files)
    return spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/tape"), len(cut)


@_register(f"""SELECT symbol, period, open_time, close FROM ({BAR_SQL['bars_exact_gapfilled']}) WHERE NOT is_final""")
def stream_snapshot(spark, sf_dir):
    """The open bars after several micro-batches."""
    root = _root(spark)
    jobs.start_exact(_batches(spark, sf_dir, root), root, availableNow=True).awaitTermination()
    return jobs.snapshot(spark, root).select("symbol", "period", "open_time", "close")


@_register(f"""SELECT symbol, period, open_time, close FROM ({BAR_SQL['bars_exact_gapfilled']}) WHERE NOT is_final""")
def stream_changes(spark, sf_dir):
    """The last pushed state of every series over several micro-batches, which is its open bar."""
    root = _root(spark)
    jobs.start_exact(_batches(spark, sf_dir, root), root, push=True, availableNow=True).awaitTermination()
    bar = "array<struct<period string, open_time bigint, close double>>"
    pushed = spark.read.json(f"{root}/push").select("symbol", "batch_id", F.inline(F.from_json("message", bar)))
    last = F.max_by(F.struct("open_time", "close"), "batch_id").alias("b")
    return pushed.groupBy("symbol", "period").agg(last).select("symbol", "period", "b.open_time", "b.close")


_BUSY = "(SELECT event_type FROM events GROUP BY 1 HAVING sum(value) > (SELECT sum(value) / 5 FROM events))"


@_register(f"SELECT * FROM ({BAR_SQL['bars_exact_gapfilled']}) WHERE symbol IN {_BUSY}")
def stream_registry(spark, sf_dir):
    """Bars of the registered symbols alone: those with more than an equal share of the value."""
    root = _root(spark)

    def registered(session):
        ev = I.table(session, sf_dir, "events")
        share = ev.select((F.sum("value") / 5).alias("s")).scalar()
        return ev.groupBy(F.col("event_type").alias("symbol")).agg(F.sum("value").alias("v")).filter(F.col("v") > share)

    jobs.start_exact(_batches(spark, sf_dir, root), root, registry=registered, availableNow=True).awaitTermination()
    return I.rounded(S.read_current(spark, f"{root}/bars").drop("month"))


@_register(BAR_SQL["bars_with_clock"])
def stream_bars_clock(spark, sf_dir):
    """The delayed tape with its clock, over several micro-batches and one of a tick alone."""
    root, tape = _root(spark), stored(I.delayed_trades(spark, sf_dir))
    stream, n = _streamed(spark, root, tape, 3)
    last = tape.select(B.last_tick(F.max("arrival_ms"), I.CLOCK_GRACE_MS).alias("tick_ms"))
    for tick in (*[F.lit(0)] * n, F.col("tick_ms")):
        last.select(tick.cast("bigint").alias("tick_ms")).coalesce(1).write.mode("append").parquet(f"{root}/ticks")
    ticks = spark.readStream.schema("tick_ms bigint").option("maxFilesPerTrigger", 1).parquet(f"{root}/ticks")
    jobs.start_exact(stream, root, clock_grace_ms=I.CLOCK_GRACE_MS, ticks=ticks, availableNow=True).awaitTermination()
    return I.rounded(S.read_current(spark, f"{root}/bars").drop("month"))


def _keyed_root(spark):
    keyed.use_state_store(spark)
    return _root(spark)


def _drain(spark, root, events, **options):
    """Two thirds of the tape, then, after a stop, the rest: the second start goes on from the checkpoint."""
    events = stored(events)
    cut, files = _cut(events, 3)
    first = len(cut) * 2 // 3
    for some in (cut[:first], cut[first:]):
        for part in some:
            _append(part, f"{root}/events", files)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/events")
        keyed.start(stream, root, trigger={"availableNow": True}, **options).awaitTermination()


@_register(BAR_SQL["bars_with_clock"])
def keyed_bars_clock(spark, sf_dir):
    """The delayed tape with its clock from keyed state, over several batches and a restart: closed bars as
    written, open bars from the state store."""
    root = _keyed_root(spark)
    _drain(spark, root, keyed.as_events(I.delayed_trades(spark, sf_dir)), grace_ms=I.CLOCK_GRACE_MS)
    return I.rounded(keyed.all_bars(spark, root).drop("epoch"))


@_register(f"SELECT symbol, period, open_time, close FROM ({BAR_SQL['bars_with_clock']}) WHERE NOT is_final")
def keyed_open_bars(spark, sf_dir):
    """The open bars alone, read from the state store."""
    root = _keyed_root(spark)
    _drain(spark, root, keyed.as_events(I.delayed_trades(spark, sf_dir)), grace_ms=I.CLOCK_GRACE_MS)
    return keyed.open_bars(spark, root).select("symbol", "period", "open_time", "close")


@_register(f"SELECT symbol, period, late_trades FROM ({BAR_SQL['late_trade_counts']})")
def keyed_late_counts(spark, sf_dir):
    """Trades that came late, counted by the stream itself."""
    root = _keyed_root(spark)
    _drain(spark, root, keyed.as_events(I.scattered_trades(spark, sf_dir)))
    return keyed.late_counts(spark, root).withColumnRenamed("late", "late_trades")


@_register(WIRE_SQL["bars_of_managed_symbols"])
def keyed_managed_bars(spark, sf_dir):
    """Trades, adds and removes in one stream."""
    root = _keyed_root(spark)
    columns = keyed.as_events(I.trades(spark, sf_dir)).columns
    commands = managed_commands(spark, sf_dir).withColumn("ts_ms", F.lit(0).cast("bigint"))
    blank = {c: F.lit(None).cast("bigint" if c == "arrival_ms" else "boolean" if c == "is_buyer_maker" else "double") for c in columns if c not in commands.columns}
    # a trade that is a command itself does not count
    trades = keyed.as_events(I.trades(spark, sf_dir)).join(commands.select("symbol", "seq"), ["symbol", "seq"], "left_anti")
    events = trades.select(columns).unionByName(commands.withColumns(blank).select(columns))
    _drain(spark, root, events, periods=("1h", "1d"), managed=True)
    return I.rounded(keyed.all_bars(spark, root))


_LATE = f"(SELECT coalesce(sum(late_trades), 0)::BIGINT FROM ({BAR_SQL['late_trade_counts']}))"


@_register(f"""SELECT 'trades' AS metric, count(*) AS total FROM events UNION ALL SELECT 'late_trades', {_LATE}
UNION ALL SELECT 'closed_bars', count(*) FROM ({BAR_SQL['bars_exact_gapfilled']}) WHERE is_final""")
def stream_counters(spark, sf_dir):
    """Numbers that a listener gathers from the metrics of each batch."""
    root, counters = _keyed_root(spark), metrics.Counters()
    stream = _batches(spark, sf_dir, root, 3, keyed.as_events(I.scattered_trades(spark, sf_dir)))
    spark.streams.addListener(counters)
    try:
        query = keyed.start(stream, root, trigger={"availableNow": True})
        query.awaitTermination()
        counters.wait(60)
    finally:
        spark.streams.removeListener(counters)
    return spark.createDataFrame(sorted(counters.totals(query.id).items()), "metric string, total bigint")


_DUE = "(arrival_ms + 30000) - (arrival_ms + 30000) % 60000 + 30000"


@_register(f"""SELECT {_DUE} AS due_ms, symbol, period, {I.sql_floor('ts_ms')} AS open_time, arg_max(price, seq) AS close, max(seq) AS seq
FROM ({I.DELAYED}) CROSS JOIN {I.PERIOD_ROWS} WHERE period IN ('1m', '1h') GROUP BY ALL""")
def throttled_writes(spark, sf_dir):
    """What is written at each second 30: the newest state of each series that changed in the minute before."""
    root = _root(spark)
    places = F.array(*(F.struct(F.lit(p).alias("period"), bar_open(F.col("ts_ms"), p).alias("open_time")) for p in ("1m", "1h")))
    changed = I.delayed_trades(spark, sf_dir).select("symbol", F.inline(places), F.col("price").alias("close"), "seq", F.col("arrival_ms").alias("at_ms"))
    stream = _batches(spark, sf_dir, root, 4, changed)
    throttle.start(stream, root, ("symbol", "period", "open_time"), availableNow=True).awaitTermination()
    throttle.drain(spark, root)
    return throttle.written(spark, root).drop("at_ms")


@_register(BAR_SQL["bars_exact_gapfilled"])
def stream_after_two_rounds(spark, sf_dir):
    """Two rounds of catching up, the second from before the end of the first, and a stream that replays from before
    the end of the second."""
    root, tape = _root(spark), stored(I.scattered_trades(spark, sf_dir))
    a, b, c, d = tape.select(F.percentile_approx("seq", [0.3, 0.4, 0.5, 0.7], 100_000)).first()[0]
    jobs.hand_over(spark, root, tape.filter(F.col("seq") <= b))
    jobs.hand_over(spark, root, tape.filter((F.col("seq") > a) & (F.col("seq") <= d)))
    stream = _batches(spark, sf_dir, root, 2, tape.filter(F.col("seq") > c))
    jobs.start_after_rounds(stream, root, availableNow=True).awaitTermination()
    return I.rounded(jobs.bars_after_rounds(spark, root))


_HEARD = f"SELECT symbol, arrival_ms, lead(arrival_ms) OVER (PARTITION BY symbol ORDER BY arrival_ms) AS next_ms, max(arrival_ms) OVER () AS end_ms FROM ({I.DELAYED})"


@_register(f"""SELECT symbol, 'silent' AS what, arrival_ms AS since_ms, arrival_ms + 60000 AS at_ms FROM ({_HEARD}) WHERE coalesce(next_ms, end_ms) - arrival_ms > 60000
UNION ALL SELECT symbol, 'back', arrival_ms, next_ms FROM ({_HEARD}) WHERE next_ms - arrival_ms > 60000""")
def silent_symbols(spark, sf_dir):
    """Symbols that were silent for a minute while others were heard, and their return."""
    root = _keyed_root(spark)
    stream = _batches(spark, sf_dir, root, 4, I.delayed_trades(spark, sf_dir).select("symbol", "seq", "arrival_ms"))
    (
        keyed.silences(stream)
        .writeStream.format("parquet")
        .option("path", f"{root}/silences")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/silences")


_HALF = "(SELECT avg(event_id) FROM events)"


@_register(f"""SELECT b.* FROM ({BAR_SQL['bars_gapfilled']}) b JOIN (
  SELECT symbol, period, max(open_time) AS seed FROM ({I.sql_bars(f'SELECT * FROM ({I.TRADES}) WHERE seq <= {_HALF}')}) GROUP BY 1, 2) s
  USING (symbol, period) WHERE b.open_time >= s.seed""")
def stream_after_backfill(spark, sf_dir):
    """The second half of the tape as a stream that starts from the open bars of the first half."""
    root, tape = _root(spark), I.trades(spark, sf_dir)
    half = I.table(spark, sf_dir, "events").select(F.avg("event_id").alias("h")).scalar()
    first = S.latest_per_series(B.build_bars(tape.filter(F.col("seq") <= half))).withColumn("is_final", F.lit(False))
    stream = _batches(spark, sf_dir, root, 2, tape.filter(F.col("seq") > half))
    jobs.start_exact(stream, root, initial=first, availableNow=True).awaitTermination()
    return I.rounded(S.read_current(spark, f"{root}/bars").drop("month"))


@_register(I.sql_rounded(f"SELECT * FROM ({I.sql_bars()}) WHERE period = '1d' AND open_time < (SELECT max(ts_ms) - 86400000 - (max(ts_ms) - 86400000) % 86400000 FROM ({I.TRADES}))"))
def stream_bars_relaxed(spark, sf_dir):
    """Daily event-time bars with a watermark of a day; the last open days stay in state."""
    root = _root(spark)
    bars = jobs.relaxed(_tape_stream(spark, sf_dir), "1d", "1 day")
    (
        bars.writeStream.format("parquet")
        .option("path", f"{root}/bars")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return I.rounded(spark.read.parquet(f"{root}/bars"))


@_register(f"""SELECT unnest(range(lo - lo % 60000 + 60150, hi + 1, 60000)) AS tick_ms FROM (
  SELECT min(ts_ms) + 60000 AS lo, max(ts_ms) AS hi FROM ({I.TRADES}))""".replace("min(ts_ms) + 60000", "min(ts_ms) - 150"))
def clock_ticks(spark, sf_dir):
    """Every minute tick between the first and the last trade."""
    bounds = I.trades(spark, sf_dir).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return clock.ticks(bounds, 150)


_SAMPLES = """SELECT event_type AS key, event_id AS seq, t - 2 * k - 1 AS sent_ms, t AS received_ms, t + user_id % 100 - 50 AS server_ms, k AS delay_ms FROM (
  SELECT *, epoch_us(ts) // 1000 AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def _samples(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events")
    t, k = ntz_to_ms(F.col("ts")), F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("event_type").alias("key"),
        F.col("event_id").alias("seq"),
        (t - 2 * k - 1).alias("sent_ms"),
        t.alias("received_ms"),
        (t + F.col("user_id") % 100 - 50).alias("server_ms"),
    )


@_register(f"SELECT key, seq, delay_ms, server_ms - received_ms AS skew_ms, server_ms AS calibrated_ms FROM ({_SAMPLES})")
def clock_measurements(spark, sf_dir):
    return C.measured(_samples(spark, sf_dir)).select("key", "seq", "delay_ms", "skew_ms", "calibrated_ms")


@_register(f"""SELECT key, arg_max(server_ms - received_ms, seq) AS skew_ms, arg_max(delay_ms, seq) AS delay_ms, arg_max(received_ms, seq) AS synced_ms,
  (SELECT max(received_ms) FROM ({_SAMPLES})) - arg_max(received_ms, seq) < 300000 AS valid FROM ({_SAMPLES}) GROUP BY 1""")
def latest_sync(spark, sf_dir):
    m = C.measured(_samples(spark, sf_dir))
    return C.latest_sync(m, m.select(F.max("received_ms").alias("n")).scalar())


@_register(f"""SELECT key, list_reduce(list(delay_ms ORDER BY seq), lambda a, x: CASE WHEN a = 0 THEN x ELSE round(0.2 * x + 0.8 * a)::BIGINT END) AS avg_delay_ms
FROM ({_SAMPLES}) GROUP BY 1""")
def smoothed_delay(spark, sf_dir):
    """Smoothed delay at the end of the tape, per key."""
    m = C.measured(_samples(spark, sf_dir)).select("key", "seq", "delay_ms")
    return C.smoothed_delay(m).groupBy("key").agg(F.max_by("avg_delay_ms", "seq").alias("avg_delay_ms"))
