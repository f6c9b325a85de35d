"""Structured log lines (one JSON text per row, column ``value``) as log entries and spans.

A line is read by the first form that fits: trace events (``log_type: trace``), module logs
(``log_type: module``, which end the search), older span events (a top-level ``type``), and
plain entries. Each line is parsed once; the forms are conditions over the parsed fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.functions import variants as V

# Event types, own keys of a plain entry, known levels, summary kinds. The key
# ``fields`` is not among a plain entry's own keys, so the object shows up as a field too.
SPAN_EVENTS = ("span_start", "span_end", "log")
SYSTEM_KEYS = ("timestamp", "level", "target", "message", "module_path", "file", "line", "span")
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")
SUMMARY_TYPES = ("checkpoint", "snapshot", "assertion")

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_MAP = "map<string,variant>"


def rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text; null for any other form."""
    upper = F.upper(text)
    return F.when(upper.rlike(_RFC3339), upper.try_cast("timestamp"))


def normal_level(level: Column) -> Column:
    upper = F.upper(level)
    return F.when(upper.isin(*LEVELS), upper).otherwise("INFO")


def is_json_log(line: Column) -> Column:
    """Whether a line is a JSON object with a timestamp, a level and a target."""
    keys = F.map_keys(F.from_json(line, _MAP))
    has = lambda key: F.array_contains(keys, key)
    return (
        F.ltrim(line).startswith("{")
        & F.rtrim(line).endswith("}")
        & F.coalesce(has("timestamp") & has("level") & has("target"), F.lit(False))
    )


def _read(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The fields that any of the forms may use."""
    top = lambda key: F.col("_top")[key]
    texts = ("log_type", "type", "timestamp", "level", "target", "message", "module_path", "file",
             "name", "trace_id", "span_id", "parent_id")
    fields = [
        *(V.as_text(top(k)).alias(f"_{k}") for k in texts),
        V.as_integer(top("line")).alias("_line"),
        V.as_number(top("duration_ms")).alias("_duration"),
        F.map_contains_key("_top", "duration_ms").alias("_has_duration"),
        F.map_contains_key("_top", "span").alias("_has_span"),
        top("span").alias("_span"),
        F.coalesce(V.as_entries(top("fields")), F.create_map().cast(_MAP)).alias("_f"),
        F.col("_top"),
    ]
    opened = lines.select(*keep, F.explode(F.array(F.from_json("value", _MAP))).alias("_top"))
    return opened.filter(F.col("_top").isNotNull()).select(*keep, V.unfold(fields))


def parse_logs(lines: DataFrame) -> DataFrame:
    """Log entries: ``timestamp, level, target, message, module_path, file, line, fields, span,
    log_type`` and ``form``, with the other input columns. Lines of no form are left out."""
    keep = [c for c in lines.columns if c != "value"]
    c = F.col
    read = _read(lines, keep).select(
        "*", rfc3339(c("_timestamp")).alias("_ts"), V.as_text(c("_f")["event_type"]).alias("_event_type")
    )

    core = c("_ts").isNotNull() & c("_level").isNotNull() & c("_target").isNotNull() & c("_message").isNotNull()
    legacy = c("_ts").isNotNull() & c("_trace_id").isNotNull() & (
        ((c("_type") == "span_start") & c("_name").isNotNull() & c("_target").isNotNull())
        | ((c("_type") == "span_end") & c("_has_duration"))
        | ((c("_type") == "log") & c("_level").isNotNull())
    )
    form = (
        F.when((c("_log_type") == "trace") & c("_event_type").isin(*SPAN_EVENTS) & core, "trace")
        .when(c("_log_type") == "module", F.when(core, "module"))
        .when(legacy, "legacy")
        .when(core, "plain")
    )
    formed = read.select(*keep, V.unfold([c(x) for x in read.columns if x not in keep] + [form.alias("form")]))
    formed = formed.filter(c("form").isNotNull())

    is_legacy = c("form") == "legacy"
    level = F.when(is_legacy & (c("_type") != "log"), F.lit("INFO")).otherwise(c("_level"))
    target = (
        F.when(is_legacy & (c("_type") == "span_end"), F.lit("span"))
        .when(is_legacy & (c("_type") == "log"), F.lit("log"))
        .otherwise(c("_target"))
    )
    message = (
        F.when(is_legacy & (c("_type") == "span_start"), F.concat(F.lit("Span started: "), "_name"))
        .when(
            is_legacy & (c("_type") == "span_end"),
            F.format_string("Span ended: %.2fms", F.coalesce("_duration", F.lit(0.0))),
        )
        .when(is_legacy, F.coalesce("_message", F.lit("(empty message)")))
        .otherwise(c("_message"))
    )

    def pair(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value")))

    span_id = F.coalesce("_span_id", F.lit("unknown_span"))
    legacy_fields = F.map_from_entries(
        F.array_compact(
            F.array(
                pair("event_type", c("_type")),
                pair("trace_id", c("_trace_id")),
                pair("span_id", span_id),
                pair("parent_id", c("_parent_id")),
                pair("span_name", c("_name")),
                pair("duration_ms", c("_duration")),
            )
        )
    )
    extras = F.map_filter(c("_top"), lambda k, _: ~k.isin(*SYSTEM_KEYS) & ~F.map_contains_key(c("_f"), k))
    fields = F.when(is_legacy, legacy_fields).when(c("form") == "plain", F.map_concat("_f", extras)).otherwise(c("_f"))

    def span(name: Column, tgt: Column, ident: Column, parent: Column, hierarchy: Column) -> Column:
        return F.struct(
            F.coalesce(name, F.lit("unknown")).alias("name"),
            tgt.alias("target"),
            ident.alias("id"),
            parent.alias("parent_id"),
            hierarchy.alias("hierarchy"),
        )

    none = F.lit(None).cast("array<string>")
    in_fields = lambda key: V.as_text(c("_f")[key])
    in_span = lambda key: V.as_text(F.try_variant_get("_span", f"$.{key}", "variant"))
    names = F.transform(
        F.filter(F.try_variant_get("_span", "$.hierarchy", "array<variant>"), lambda v: V.kind(v) == "STRING"),
        lambda v: v.cast("string"),
    )
    spanned = (c("form").isin("module", "plain")) & c("_has_span")
    span_of = (
        F.when(
            (c("form") == "trace") & (c("_event_type") != "log"),
            span(in_fields("span_name"), c("_target"), in_fields("span_id"), in_fields("parent_id"), none),
        )
        .when(is_legacy, span(c("_name"), F.coalesce(c("_target"), target), span_id, c("_parent_id"), none))
        .when(
            spanned,
            span(
                in_span("name"),
                F.coalesce(in_span("target"), c("_target")),
                in_span("id"),
                in_span("parent_id"),
                F.when(c("form") == "module", names),
            ),
        )
    )
    plain_only = lambda col: F.when(c("form") == "plain", c(col))
    return formed.select(
        *keep,
        c("_ts").alias("timestamp"),
        level.alias("level"),
        target.alias("target"),
        message.alias("message"),
        plain_only("_module_path").alias("module_path"),
        plain_only("_file").alias("file"),
        F.when((c("form") == "plain") & (c("_line") >= 0), c("_line")).alias("line"),
        fields.alias("fields"),
        span_of.alias("span"),
        F.when(c("form").isin("trace", "legacy"), "trace").when(c("form") == "module", "module").alias("log_type"),
        "form",
    )


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries with a level and a target; the message may be empty."""
    return entries.filter((F.col("level") != "") & (F.col("target") != ""))


def span_kind(entries: DataFrame) -> Column:
    """Start, Close or Event of a span, by message and fields; the first match counts."""
    has = lambda key: F.map_contains_key("fields", key)
    return (
        F.when(F.col("message").contains("new") | has("span.kind"), "Start")
        .when(F.col("message").contains("close") | has("elapsed_milliseconds"), "Close")
        .when(F.col("span").isNotNull(), "Event")
    )


def session_marker() -> Column:
    """Whether an entry opens a session."""
    mark = F.try_element_at("fields", F.lit("session_start"))
    return (F.col("message") == "session_start") | F.coalesce(V.as_flag(mark), F.lit(False))


# --- span records -------------------------------------------------------------------------

_SPAN_TEXTS = ("id", "trace_id", "name", "target", "level", "timestamp", "status", "span_type")


def parse_spans(lines: DataFrame) -> DataFrame:
    """Span records (``type: span``). A line that lacks a required field is left out;
    ``parent_id`` may be null. ``attributes`` is a map, ``events`` an array of JSON values,
    each of which must have a timestamp, a name, a level and attributes."""
    keep = [c for c in lines.columns if c != "value"]
    schema = ",".join(
        ["type variant", *(f"{k} variant" for k in _SPAN_TEXTS), "parent_id variant", "duration_ms double",
         f"attributes {_MAP}", "events array<variant>"]
    )
    fields = [
        V.as_text(F.col("_s.type")).alias("_type"),
        *(V.as_text(F.col(f"_s.{k}")).alias(k) for k in _SPAN_TEXTS),
        V.as_text(F.col("_s.parent_id")).alias("parent_id"),
        *(F.col(f"_s.{k}").alias(k) for k in ("duration_ms", "attributes", "events")),
    ]
    opened = lines.select(*keep, F.explode(F.array(F.from_json("value", schema))).alias("_s"))
    read = opened.select(*keep, V.unfold(fields))
    whole = F.col("_type") == "span"
    for name in (*_SPAN_TEXTS, "duration_ms", "attributes", "events"):
        whole = whole & F.col(name).isNotNull()
    return read.filter(whole).filter(F.forall("events", _is_event)).drop("_type")


def _is_event(event: Column) -> Column:
    part = F.coalesce(V.as_entries(event), F.create_map().cast("map<string,variant>"))
    texts = [V.as_text(F.try_element_at(part, F.lit(k))).isNotNull() for k in ("timestamp", "name", "level")]
    held = V.as_entries(F.try_element_at(part, F.lit("attributes"))).isNotNull()
    return reduce(lambda a, b: a & b, texts, held)
