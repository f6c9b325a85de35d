"""Registered queries over log lines and spans, which are written from ``events`` first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickbars.functions.timefns import ntz_to_ms
from tickbars.operators import logquery as L
from tickbars.operators import spans as SP
from tickbars.queries import inputs as I
from tickbars.sinks import logs as out
from tickbars.sources import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "odd")


def log_lines(spark, sf_dir):
    """One log line per event, in twelve shapes by id: plain, module, trace and older span
    forms, broken ones among them; a few open a session."""
    ev = I.table(spark, sf_dir, "events")
    i = F.col("event_id")
    level = F.element_at(F.array(*(F.lit(v) for v in _LEVELS)), (F.col("user_id") % 6 + 1).cast("int"))
    stamp = F.date_format(F.timestamp_millis(ntz_to_ms(F.col("ts"))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    t = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = t('"timestamp":"', stamp, '","level":"', level, '","target":"mod.', F.col("event_type"), '"')
    mark7 = F.when(F.col("user_id") % 50 == 7, "session_start").otherwise(t("new event ", i.cast("string")))
    mark9 = (F.col("user_id") % 50 == 9).cast("string")
    shapes = [
        t("{", head, ',"message":"', mark7, '","fields":{"key":"v', i, '"},"module_path":"m","file":"f.x","line":', i % 1000, "}"),
        t("{", head, ',"message":"close it","elapsed_milliseconds":5,"fields":{"user":', F.col("user_id"), ',"session_start":', mark9, '},"user":"top"}'),
        t('{"log_type":"module",', head, ',"message":"m","span":{"name":"n","hierarchy":["a",7,"b"]},"fields":{"log_type":"low_freq"}}'),
        t('{"log_type":"module",', head, "}"),
        t('{"log_type":"trace",', head, ',"message":"go","fields":{"event_type":"span_start","span_name":"s', F.col("user_id") % 5, '","span_id":"', i, '"}}'),
        t('{"log_type":"trace",', head, ',"message":"","fields":{"event_type":"log"}}'),
        t('{"log_type":"trace",', head, ',"message":"plain after all","fields":{"event_type":"other"},"span":{"id":"', i, '","target":"st"}}'),
        t('{"type":"span_start","timestamp":"', stamp, '","trace_id":"t', F.col("user_id"), '","span_id":"', i, '","name":"op","target":"tg"}'),
        t('{"type":"span_end","timestamp":"', stamp, '","trace_id":"t', F.col("user_id"), '","span_id":"', i, '","duration_ms":', i % 1000, ".251}"),
        t('{"type":"log","timestamp":"', stamp, '","trace_id":"t', F.col("user_id"), '","level":"', level, '","parent_id":"p"}'),
        t("[", stamp, " ", level, " mod] not json"),
        t("{", head, "}"),
    ]
    value = F.when(i % 12 == 0, shapes[0])
    for n, s in enumerate(shapes[1:], 1):
        value = value.when(i % 12 == n, s)
    return ev.select(i.alias("seq"), value.alias("value"))


def entries(spark, sf_dir):
    return logs.parse_logs(log_lines(spark, sf_dir))


_ENTRIES = """SELECT i AS seq, t AS timestamp_ms, k, user_id,
  CASE WHEN k IN (7, 8) THEN 'INFO' ELSE lvl END AS level,
  CASE k WHEN 7 THEN 'tg' WHEN 8 THEN 'span' WHEN 9 THEN 'log' ELSE 'mod.' || event_type END AS target,
  CASE k WHEN 0 THEN CASE WHEN user_id % 50 = 7 THEN 'session_start' ELSE 'new event ' || i END WHEN 1 THEN 'close it' WHEN 2 THEN 'm'
    WHEN 4 THEN 'go' WHEN 5 THEN '' WHEN 6 THEN 'plain after all' WHEN 7 THEN 'Span started: op'
    WHEN 8 THEN 'Span ended: ' || (i % 1000) || '.25ms' WHEN 9 THEN '(empty message)' END AS message,
  CASE WHEN k = 0 THEN 'm' END AS module_path, CASE WHEN k = 0 THEN 'f.x' END AS file, CASE WHEN k = 0 THEN i % 1000 END AS line,
  CASE WHEN k IN (4, 5, 7, 8, 9) THEN 'trace' WHEN k = 2 THEN 'module' END AS log_type,
  CASE WHEN k IN (4, 5) THEN 'trace' WHEN k = 2 THEN 'module' WHEN k IN (7, 8, 9) THEN 'legacy' ELSE 'plain' END AS form,
  CASE k WHEN 2 THEN 'n' WHEN 4 THEN 's' || user_id % 5 WHEN 6 THEN 'unknown' WHEN 7 THEN 'op' WHEN 8 THEN 'unknown' WHEN 9 THEN 'unknown' END AS span_name,
  CASE k WHEN 2 THEN 'mod.' || event_type WHEN 4 THEN 'mod.' || event_type WHEN 6 THEN 'st' WHEN 7 THEN 'tg' WHEN 8 THEN 'span' WHEN 9 THEN 'log' END AS span_target,
  CASE WHEN k IN (4, 6, 7, 8) THEN i::VARCHAR WHEN k = 9 THEN 'unknown_span' END AS span_id,
  CASE WHEN k = 9 THEN 'p' END AS span_parent, CASE WHEN k = 2 THEN 'a>b' END AS hierarchy,
  CASE k WHEN 0 THEN 'fields,key' WHEN 1 THEN 'elapsed_milliseconds,fields,session_start,user' WHEN 2 THEN 'log_type' WHEN 4 THEN 'event_type,span_id,span_name'
    WHEN 5 THEN 'event_type' WHEN 6 THEN 'event_type,fields,log_type' WHEN 7 THEN 'event_type,span_id,span_name,trace_id'
    WHEN 8 THEN 'duration_ms,event_type,span_id,trace_id' WHEN 9 THEN 'event_type,parent_id,span_id,trace_id' END AS field_keys,
  (k = 0 AND user_id % 50 = 7) OR (k = 1 AND user_id % 50 = 9) AS marker
FROM (SELECT event_id AS i, event_id % 12 AS k, epoch_us(ts) // 1000 AS t, event_type, user_id,
  ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'odd'][user_id % 6 + 1] AS lvl FROM events) WHERE k NOT IN (3, 10, 11)"""


@_register(f"SELECT * EXCLUDE (k, user_id, marker) FROM ({_ENTRIES})")
def parse_logs(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "seq", F.unix_millis("timestamp").alias("timestamp_ms"), "level", "target", "message", "module_path", "file", "line",
        "log_type", "form", F.col("span.name").alias("span_name"), F.col("span.target").alias("span_target"),
        F.col("span.id").alias("span_id"), F.col("span.parent_id").alias("span_parent"),
        F.array_join("span.hierarchy", ">").alias("hierarchy"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("field_keys"),
    )


@_register("SELECT event_id AS seq, event_id % 12 NOT IN (7, 8, 9, 10) AS is_log FROM events")
def json_log_test(spark, sf_dir):
    return log_lines(spark, sf_dir).select("seq", logs.is_json_log(F.col("value")).alias("is_log"))


@_register(f"""SELECT seq, CASE WHEN level = 'odd' THEN 'INFO' ELSE level END AS level,
  CASE WHEN message LIKE '%new%' THEN 'Start' WHEN message LIKE '%close%' OR k = 1 THEN 'Close' WHEN span_name IS NOT NULL THEN 'Event' END AS kind
FROM ({_ENTRIES})""")
def span_event_kinds(spark, sf_dir):
    e = logs.valid_entries(entries(spark, sf_dir))
    return e.select("seq", logs.normal_level(F.col("level")).alias("level"), logs.span_kind(e).alias("kind"))


@_register(f"""SELECT seq, session FROM (SELECT *, sum(marker::INTEGER) OVER (ORDER BY seq)::BIGINT AS session FROM ({_ENTRIES})) WHERE NOT marker""")
def log_sessions(spark, sf_dir):
    return L.sessions(entries(spark, sf_dir)).select("seq", "session")


@_register(f"SELECT seq, message FROM ({_ENTRIES}) WHERE seq > (SELECT max(seq) FROM ({_ENTRIES}) WHERE marker)")
def current_session(spark, sf_dir):
    return L.current_session(entries(spark, sf_dir)).select("seq", "message")


@_register(f"SELECT seq, target FROM ({_ENTRIES}) ORDER BY seq DESC LIMIT 5000")
def newest_entries(spark, sf_dir):
    return L.newest(entries(spark, sf_dir), 5000).select("seq", "target")


@_register(f"SELECT seq, log_type FROM ({_ENTRIES}) WHERE log_type = 'trace'")
def trace_subscription(spark, sf_dir):
    return L.subscription(entries(spark, sf_dir), "trace").select("seq", "log_type")


@_register(f"SELECT seq, log_type FROM ({_ENTRIES}) WHERE log_type IS DISTINCT FROM 'trace'")
def module_subscription(spark, sf_dir):
    return L.subscription(entries(spark, sf_dir), "module").select("seq", "log_type")


@_register(f"SELECT seq, level FROM ({_ENTRIES}) WHERE level IN ('WARN', 'ERROR')")
def problem_filter(spark, sf_dir):
    return L.problems(entries(spark, sf_dir)).select("seq", "level")


@_register(f"""SELECT seq, level FROM ({_ENTRIES}) WHERE level IN ('WARN', 'ERROR') OR seq % 5 IN (1, 2, 3)""")
def problem_filter_summaries(spark, sf_dir):
    """As above with a summary type on three of five entries."""
    kinds = F.array(*(F.lit(k) for k in ("other", "checkpoint", "snapshot", "assertion", "")))
    kind = F.element_at(kinds, (F.col("seq") % 5 + 1).cast("int"))
    return L.problems(entries(spark, sf_dir), kind).select("seq", "level")


@_register(f"""SELECT seq, level, target FROM ({_ENTRIES}) WHERE target LIKE '%purch%' AND level = 'ERROR'
  AND timestamp_ms BETWEEN 1704672000000 AND 1705881600000 ORDER BY seq LIMIT 50""")
def log_search(spark, sf_dir):
    return L.search(
        entries(spark, sf_dir),
        target_part="purch",
        level="ERROR",
        start=F.timestamp_millis(F.lit(1_704_672_000_000)),
        end=F.timestamp_millis(F.lit(1_705_881_600_000)),
        limit=50,
    ).select("seq", "level", "target")


@_register(f"SELECT level, count(*) AS entries FROM ({_ENTRIES}) GROUP BY 1")
def log_level_counts(spark, sf_dir):
    return L.level_counts(entries(spark, sf_dir))


@_register(f"SELECT target, count(*) AS entries FROM ({_ENTRIES}) GROUP BY 1")
def log_target_counts(spark, sf_dir):
    return L.target_counts(entries(spark, sf_dir))


@_register(f"""SELECT seq, json_extract_string(value, '$.message') AS message, json_extract_string(value, '$.log_type') AS route FROM (
  SELECT seq, '{{"message":"m","log_type":"low_freq"}}' AS value FROM ({_ENTRIES}) WHERE k = 2)""")
def low_freq_lines(spark, sf_dir):
    """Module entries marked as low-frequency, as flat lines."""
    e = entries(spark, sf_dir).withColumn("route", F.try_variant_get(F.try_element_at("fields", F.lit("log_type")), "$", "string"))
    lines = out.flat_lines(out.routed(e, "low_freq"))
    return lines.select(
        "seq", F.get_json_object("value", "$.message").alias("message"), F.get_json_object("value", "$.log_type").alias("route")
    )


@_register(f"""SELECT seq, level, CASE WHEN k = 2 THEN 'a > b' END AS span_path, CASE WHEN k = 0 THEN 'v' || seq END AS key
FROM ({_ENTRIES}) WHERE NOT (level = 'TRACE' AND target = 'log')""")
def target_lines(spark, sf_dir):
    lines = out.target_lines(entries(spark, sf_dir))
    get = lambda p: F.get_json_object("value", p)
    return lines.select("seq", get("$.level").alias("level"), get("$.span_path").alias("span_path"), get("$.fields.key").alias("key"))


# --- spans ----------------------------------------------------------------------------------


def _span_lines(spark, sf_dir):
    """One span record per event; every 10th lacks a status, every 11th is no JSON, every 13th has
    an event without a level, and every 17th repeats the id before it."""
    ev = I.table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(i % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"status":"'), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS"), F.lit('"'))
    )
    tx = F.when(i % 3 == 0, F.concat(F.lit('"tx'), F.col("user_id") % 7, F.lit('"'))).otherwise((F.col("user_id") % 7).cast("string"))
    level = F.when(i % 13 == 0, F.lit("")).otherwise(F.lit('"level":"INFO",'))
    event = F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00Z","name":"in",'), level, F.lit('"attributes":{"n":1}}'))
    value = F.concat(
        F.lit('{"type":"span","id":"'), F.when(i % 17 == 0, i - 1).otherwise(i), F.lit('","trace_id":"t'), F.col("user_id"), F.lit('","parent_id":null,"name":"'), F.col("event_type"),
        F.lit('","target":"x","level":"INFO","timestamp":"2024-01-01T00:00:00Z","duration_ms":'), F.col("value"),
        F.lit(',"attributes":{"tx_id":'), tx, F.lit('},"events":['), event, F.lit('],"span_type":"span"'), status, F.lit("}"),
    )
    return ev.select(
        i.alias("seq"),
        (F.col("user_id") % 4).alias("connection_id"),
        ntz_to_ms(F.col("ts")).cast("double").alias("start_ms"),
        F.when(i % 11 == 0, F.lit("oops")).otherwise(value).alias("value"),
    )


_ALL_SPANS = """SELECT event_id AS seq, user_id % 4 AS connection_id, (epoch_us(ts) // 1000)::DOUBLE AS start_ms, CASE WHEN event_id % 17 = 0 THEN event_id - 1 ELSE event_id END::VARCHAR AS id, 't' || user_id AS trace_id,
  event_type AS name, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'tx' || user_id % 7 END AS tx_id FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0"""
_SPANS = f"""WITH s AS MATERIALIZED ({_ALL_SPANS}), newest AS MATERIALIZED (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT * FROM newest"""


def _spans(spark, sf_dir):
    """Of a repeated id, the last record."""
    return L.latest_records(logs.parse_spans(_span_lines(spark, sf_dir)))


@_register(f"SELECT seq, id, trace_id, name, duration_ms, status FROM ({_ALL_SPANS})")
def parse_spans(spark, sf_dir):
    return logs.parse_spans(_span_lines(spark, sf_dir)).select("seq", "id", "trace_id", "name", "duration_ms", "status")


@_register(f"SELECT id, name FROM ({_SPANS}) WHERE tx_id = 'tx3'")
def spans_by_tx(spark, sf_dir):
    """Transaction ids that are numbers do not match."""
    return L.spans_by_tx(_spans(spark, sf_dir), "tx3").select("id", "name")


@_register(f"SELECT seq, id FROM ({_SPANS}) WHERE trace_id = 't5' ORDER BY seq")
def trace_by_id(spark, sf_dir):
    return L.trace(_spans(spark, sf_dir), "t5").select("seq", "id")


@_register(f"""WITH s AS MATERIALIZED ({_ALL_SPANS}), newest AS MATERIALIZED (SELECT * FROM s WHERE connection_id = (SELECT max(connection_id) FROM s))
  SELECT seq, connection_id FROM newest QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""")
def spans_of_last_connection(spark, sf_dir):
    """A new connection clears the store, and a repeated id replaces what came since."""
    spans = logs.parse_spans(_span_lines(spark, sf_dir))
    return L.latest_records(L.last_connection(spans)).select("seq", "connection_id")


@_register(f"SELECT count(DISTINCT id) AS spans, count(DISTINCT trace_id) AS traces FROM ({_ALL_SPANS})")
def span_totals(spark, sf_dir):
    return L.span_totals(logs.parse_spans(_span_lines(spark, sf_dir)))


@_register(f"""SELECT trace_id, count(*) AS spans, round(max(start_ms + duration_ms) - min(start_ms), 3) AS trace_ms,
  count(*) FILTER (status = 'FAILURE') AS failures FROM ({_SPANS}) GROUP BY 1""")
def trace_stats(spark, sf_dir):
    return L.trace_stats(_spans(spark, sf_dir)).withColumn("trace_ms", F.round("trace_ms", 3))


@_register(f"""SELECT name, count(*) AS spans, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
  quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM ({_SPANS}) GROUP BY 1""")
def span_stats(spark, sf_dir):
    return L.span_stats(_spans(spark, sf_dir))


# Spans from records. Groups of 50 events: a group is a tree (parent of n is n div 2), every
# 7th group a chain; event n opens span n, and the same row closes it and logs inside it.
_GROUP = 50


def _records(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events")
    i, n, g = F.col("event_id"), F.col("event_id") % _GROUP, F.floor(F.col("event_id") / _GROUP)
    parent = F.when(n == 0, F.lit(None)).when(g % 7 == 0, i - 1).otherwise(g * _GROUP + F.floor(n / 2))
    t = ntz_to_ms(F.col("ts"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = F.lit(None).cast("string")
    held = F.concat(F.lit('{"tx_id":"tx'), F.col("user_id") % 7, F.lit('","k":'), k, F.lit("}"))

    def rec(offset, kind, at, span, lvl, message):
        return F.struct(
            (i * 4 + offset).alias("seq"), at.alias("ts_ms"), F.lit(kind).alias("kind"), span.alias("span_id"),
            parent.cast("string").alias("parent_id"), F.col("event_type").alias("name"), F.lit("core").alias("target"),
            lvl.alias("level"), message.alias("message"), F.from_json(held, "map<string,variant>").alias("attributes"),
        )

    me = i.cast("string")
    rows = F.array(
        rec(0, "new", t, me, F.lit("INFO"), text),
        rec(1, "event", t + 1, me, level, F.lit("inside")),
        rec(2, "close", t + k, F.when(n == 49, F.lit(None).cast("string")).otherwise(me), F.lit("INFO"), text),
        rec(3, "event", t + 2, F.lit(None).cast("string"), level, F.lit("alone")),
    )
    return ev.select(F.inline(rows))


_TREE = f"""SELECT event_id AS i, 'tx' || user_id % 7 AS tx_id, event_type AS name, epoch_us(ts) // 1000 AS t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  event_id % {_GROUP} AS n, CASE WHEN event_id % {_GROUP} = 0 THEN NULL WHEN (event_id // {_GROUP}) % 7 = 0 THEN event_id - 1
    ELSE (event_id // {_GROUP}) * {_GROUP} + (event_id % {_GROUP}) // 2 END AS parent FROM events"""
_PATHS = f"""WITH RECURSIVE tree AS ({_TREE}), walk AS (
  SELECT i, i AS root, name::VARCHAR AS path FROM tree WHERE parent IS NULL
  UNION ALL SELECT tree.i, walk.root, walk.path || ' > ' || tree.name FROM tree JOIN walk ON tree.parent = walk.i)"""


@_register(f"{_PATHS} SELECT i::VARCHAR AS span_id, root::VARCHAR AS root_id, path AS span_path FROM walk")
def span_paths(spark, sf_dir):
    new = _records(spark, sf_dir).filter(F.col("kind") == "new")
    return SP.ancestry(new.select("span_id", "parent_id", "name"))


@_register(f"""{_PATHS} SELECT tree.i::VARCHAR AS id, root::VARCHAR AS trace_id, parent::VARCHAR AS parent_id, name, t AS start_ms, k::DOUBLE AS duration_ms, 1::BIGINT AS events, tx_id, k,
  CASE WHEN name = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, 'span' AS span_type, path AS span_path FROM tree JOIN walk USING (i) WHERE n <> 49
UNION ALL SELECT 'event-' || (i * 4 + 3), 'event-' || (i * 4 + 3), NULL, 'alone', t + 2, 0.0, 0, tx_id, k,
  CASE WHEN name IN ('error', 'view') THEN 'FAILURE' ELSE 'SUCCESS' END, 'event', 'alone' FROM tree""")
def build_spans(spark, sf_dir):
    spans = SP.build_spans(_records(spark, sf_dir)).drop("target", "level", "timestamp_ms")
    return _attributes(spans)


def _attributes(spans):
    at = lambda key, kind: F.try_variant_get(F.try_element_at("attributes", F.lit(key)), "$", kind).alias(key)
    return spans.select(*(c for c in spans.columns if c != "attributes"), at("tx_id", "string"), at("k", "bigint"))


@_register(f"""SELECT i::VARCHAR AS id FROM ({_TREE}) WHERE n <> 49 AND tx_id = 'tx3'
UNION ALL SELECT 'event-' || (i * 4 + 3) FROM ({_TREE}) WHERE tx_id = 'tx3'""")
def built_spans_by_tx(spark, sf_dir):
    """Spans made of records, asked for by an attribute."""
    return L.spans_by_tx(SP.build_spans(_records(spark, sf_dir)), "tx3").select("id")


@_register(f"""SELECT i::VARCHAR AS span_id FROM ({_TREE}) WHERE i // {_GROUP} % 11 = 5 AND i // {_GROUP} % 7 <> 0 AND n > 0""")
def span_parent_loops(spark, sf_dir):
    """Every 11th tree is cut off its root by a loop at its second span, which takes all below it along."""
    new = _records(spark, sf_dir).filter(F.col("kind") == "new")
    i = F.col("span_id").cast("bigint")
    g, n = F.floor(i / _GROUP), i % _GROUP
    parent = F.when((g % 11 == 5) & (g % 7 != 0) & (n == 1), F.col("span_id")).otherwise(F.col("parent_id"))
    return SP.parent_loops(new.select("span_id", parent.alias("parent_id"), "name"))


@_register("""SELECT event_id::VARCHAR AS span_id, event_id * 4 + 1 AS seq, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level FROM events""")
def span_events(spark, sf_dir):
    return SP.span_events(_records(spark, sf_dir)).select("span_id", "seq", "level")
