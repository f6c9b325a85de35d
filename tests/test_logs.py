import json

import pytest
from pyspark.sql import functions as F

from tickbars.operators import logquery as L
from tickbars.operators import spans as SP
from tickbars.sinks import logs as out
from tickbars.sources import logs

T0 = "2024-01-01T12:00:00.000Z"


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, value string")
    return logs.parse_logs(df)


def one(spark, **top):
    e = parsed(spark, json.dumps(top))
    return e.select("*", F.to_json("fields").alias("f")).drop("fields").first()


CORE = dict(timestamp=T0, level="INFO", target="test", message="test message")


def test_plain(spark):
    r = one(spark, **CORE, fields={"key": "value", "shared": 1}, shared=2, other=[1], line=7, file="f", module_path="m")
    assert (r.form, r.log_type, r.level, r.target, r.message, r.line, r.file, r.module_path) == (
        "plain", None, "INFO", "test", "test message", 7, "f", "m")
    assert json.loads(r.f) == {"key": "value", "shared": 1, "other": [1], "fields": {"key": "value", "shared": 1}}
    assert r.span is None


@pytest.mark.parametrize(
    "text",
    ["[2024-01-01T12:00:00.000Z INFO test] test message", "[]", "5", "{}", json.dumps({**CORE, "timestamp": "yesterday"}),
     json.dumps({**CORE, "timestamp": "2024-01-01"}), json.dumps({**CORE, "level": 3}), json.dumps({**CORE, "log_type": "module", "message": None})],
)
def test_no_entry(spark, text):
    assert parsed(spark, text).count() == 0


def test_module(spark):
    r = one(spark, **CORE, log_type="module", span={"name": "n", "hierarchy": ["a", 1, "b"]}, line=3)
    assert (r.log_type, r.span.name, r.span.target, r.span.hierarchy, r.line) == ("module", "n", "test", ["a", "b"], None)


def test_span_that_is_null_still_counts(spark):
    r = one(spark, **CORE, span=None)
    assert (r.span.name, r.span.target) == ("unknown", "test")


def test_trace(spark):
    r = one(spark, **CORE, log_type="trace", fields={"event_type": "span_start", "span_name": "n", "span_id": "1"})
    assert (r.form, r.log_type, r.span.name, r.span.id, r.span.parent_id) == ("trace", "trace", "n", "1", None)
    assert one(spark, **CORE, log_type="trace", fields={"event_type": "log"}).span is None
    other = one(spark, **CORE, log_type="trace", fields={"event_type": "odd"})
    assert (other.form, other.log_type) == ("plain", None) and json.loads(other.f)["log_type"] == "trace"


def test_legacy(spark):
    head = dict(timestamp="2024-01-01T14:00:00+02:00", trace_id="x", span_id="1")
    end = one(spark, type="span_end", **head, duration_ms=1.234)
    assert (end.message, end.target, end.level, end.log_type) == ("Span ended: 1.23ms", "span", "INFO", "trace")
    assert end.timestamp.isoformat() == "2024-01-01T12:00:00"
    assert json.loads(end.f) == {"event_type": "span_end", "trace_id": "x", "span_id": "1", "duration_ms": 1.234}
    start = one(spark, type="span_start", **head, name="n", target="t", parent_id="0")
    assert (start.message, start.span.name, start.span.parent_id) == ("Span started: n", "n", "0")
    log = one(spark, type="log", timestamp=T0, trace_id="x", level="WARN")
    assert (log.message, log.target, log.span.id, log.span.name) == ("(empty message)", "log", "unknown_span", "unknown")
    assert one(spark, type="span_end", **head, duration_ms="long").message == "Span ended: 0.00ms"
    assert parsed(spark, json.dumps(dict(type="span_end", **head))).count() == 0


@pytest.mark.parametrize(
    "line, want",
    [(json.dumps({k: CORE[k] for k in ("timestamp", "level", "target")}), True), ("[2024-01-01 INFO test] message", False),
     ("regular log message", False), ('{"level":"INFO"}', False), ("  " + json.dumps(CORE) + " ", True)],
)
def test_json_test(spark, line, want):
    assert spark.range(1).select(logs.is_json_log(F.lit(line))).first()[0] is want


def test_validity_kinds_levels(spark):
    e = parsed(
        spark,
        json.dumps({**CORE, "level": ""}),
        json.dumps({**CORE, "message": "new"}),
        json.dumps({**CORE, "span.kind": "x"}),
        json.dumps({**CORE, "message": "", "elapsed_milliseconds": 1}),
        json.dumps({**CORE, "span": {"name": "s"}}),
        json.dumps({**CORE, "level": "warn"}),
    )
    v = logs.valid_entries(e)
    got = {r.seq: (r.k, r.n) for r in v.select("seq", logs.span_kind(v).alias("k"), logs.normal_level(F.col("level")).alias("n")).collect()}
    assert got == {1: ("Start", "INFO"), 2: ("Start", "INFO"), 3: ("Close", "INFO"), 4: ("Event", "INFO"), 5: (None, "WARN")}


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_sessions(spark, chunk):
    mark, plain = {**CORE, "message": "session_start"}, CORE
    by_field = {**CORE, "fields": {"session_start": True}}
    not_one = {**CORE, "fields": {"session_start": "true"}}
    e = parsed(spark, *(json.dumps(x) for x in (plain, mark, plain, not_one, by_field, plain, plain)))
    assert [(r.seq, r.session) for r in L.sessions(e, chunk_rows=chunk).orderBy("seq").collect()] == [(0, 0), (2, 1), (3, 1), (5, 2), (6, 2)]
    assert sorted(r.seq for r in L.current_session(e).collect()) == [5, 6]
    assert sorted(r.seq for r in L.current_session(e.filter("seq = 0")).collect()) == [0]
    assert sorted(r.seq for r in L.newest(e, 3, chunk_rows=chunk).collect()) == [4, 5, 6]


def test_problems(spark):
    e = parsed(spark, *(json.dumps({**CORE, **x}) for x in ({}, {"level": "WARN"}, {"fields": {"log_type": "snapshot"}})))
    kind = F.try_variant_get(F.try_element_at("fields", F.lit("log_type")), "$", "string")
    assert sorted(r.seq for r in L.problems(e, kind).collect()) == [1, 2]


SPAN = dict(type="span", id="1", trace_id="t", parent_id=None, name="n", target="x", level="INFO", timestamp=T0, duration_ms=1,
            attributes={"tx_id": "7"}, events=[], status="SUCCESS", span_type="span")


def test_spans(spark):
    event = {"timestamp": T0, "name": "e", "level": "INFO", "attributes": {}}
    bad_events = [[{k: v for k, v in event.items() if k != "level"}], [event, 3], [{**event, "attributes": 1}]]
    texts = [{**SPAN, "events": [event]}, {**SPAN, "id": "2", "attributes": {"tx_id": 7}}, *({**SPAN, "events": e} for e in bad_events), {k: v for k, v in SPAN.items() if k not in ("status", "span_type")}, {**SPAN, "type": "log"}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(9, "oops")], "seq bigint, value string")
    s = logs.parse_spans(df)
    assert [r.id for r in s.orderBy("seq").collect()] == ["1", "2"]
    assert [r.id for r in L.spans_by_tx(s, "7").collect()] == ["1"]
    assert [r.seq for r in L.trace(s, "t").collect()] == [0, 1]


def test_ancestry_of_chains_stars_and_orphans(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, f"n{i}") for i in range(70)]
    star = [("root", None, "r")] + [(f"s{i}", "root", f"s{i}") for i in range(200)]
    orphan = [("o", "nowhere", "o")]
    df = spark.createDataFrame(chain + star + orphan, "span_id string, parent_id string, name string")
    got = {r.span_id: (r.root_id, r.span_path) for r in SP.ancestry(df).collect()}
    assert len(got) == len(chain) + len(star) + 1
    for i in range(70):
        assert got[f"c{i}"] == ("c0", " > ".join(f"n{j}" for j in range(i + 1)))
    assert got["s7"] == ("root", "r > s7") and got["o"] == ("o", "o")


def test_loops_leave_sound_traces_alone(spark):
    loop = [("a", "b", "a"), ("b", "a", "b"), ("below", "a", "c"), ("self", "self", "d")]
    sound = [(f"c{i}", f"c{i - 1}" if i else None, f"n{i}") for i in range(9)]
    paths, loops = SP.resolve(spark.createDataFrame(loop + sound, "span_id string, parent_id string, name string"))
    assert {r.span_id for r in loops.collect()} == {"a", "b", "below", "self"}
    got = {r.span_id: r.span_path for r in paths.collect()}
    assert len(got) == 9 and got["c8"] == " > ".join(f"n{i}" for i in range(9))


def test_paths_keep_to_counted_partitions(spark, monkeypatch):
    """Rows that take few bytes in a shuffle are still dealt to partitions by their number, and names that are missing add nothing."""
    monkeypatch.setattr(SP, "PART_ROWS", 100)
    rows = [(f"{g}-{i}", f"{g}-{i - 1}" if i else None, None if i == 2 else "n") for g in range(40) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    paths, loops = SP.resolve(spark.createDataFrame(rows, "span_id string, parent_id string, name string"))
    per_file = paths.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]
    assert per_file < 300 and loops.count() == 0 and paths.count() == 800
    got = {r.span_id: r.span_path for r in paths.collect()}
    assert got["3-1"] == "n > n" and got["3-2"] == "n > n" and got["3-19"] == " > ".join(["n"] * 19)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_loops_are_found_without_paths(spark):
    rows = [("a", "b", "a"), ("b", "a", "b"), ("c", "a", "c"), ("d", None, "d"), ("e", "d", "e")]
    paths, loops = SP.resolve(spark.createDataFrame(rows, "span_id string, parent_id string, name string"), with_paths=False)
    assert paths.columns == ["span_id", "root_id"] and {tuple(r) for r in paths.collect()} == {("d", "d"), ("e", "d")}
    assert {r.span_id for r in loops.collect()} == {"a", "b", "c"}


def test_last_record_of_an_id_counts(spark):
    rows = [(i, f"{i // 2}", "t", "tx1") for i in range(5000)]
    s = spark.createDataFrame(rows, "seq bigint, id string, trace_id string, tx string")
    s = s.withColumn("attributes", F.from_json(F.concat(F.lit('{"tx_id":"'), "tx", F.lit('"}')), "map<string,variant>"))
    newest = L.latest_records(s)
    assert sorted(r.seq for r in newest.collect()) == list(range(1, 5000, 2))
    assert L.spans_by_tx(newest, "tx1").count() == 2500
    assert [r.seq for r in L.spans_by_tx(newest, "tx1", limit=3).collect()] == [1, 3, 5]
    assert L.span_totals(s).first().spans == 2500


def test_build_spans(spark):
    schema = "seq bigint, ts_ms bigint, kind string, span_id string, parent_id string, name string, target string, level string, message string, attributes map<string,string>"
    rows = [
        (0, 100, "new", "1", None, "outer", "t", "INFO", None),
        (1, 110, "new", "2", "1", "inner", "t", "INFO", None),
        (2, 115, "event", "2", None, None, "t", "ERROR", "boom"),
        (3, 120, "close", "2", None, None, "t", "INFO", None),
        (4, 130, "event", None, None, None, "t", "WARN", "alone"),
        (5, 140, "close", "1", None, None, "t", "INFO", None),
        (6, 150, "new", "3", "1", "open", "t", "INFO", None),
    ]
    records = spark.createDataFrame([(*r, {"of": str(r[0])}) for r in rows], schema)
    spans = SP.build_spans(records)
    got = {r.id: (r.trace_id, r.duration_ms, r.status, r.span_type, r.span_path) for r in spans.collect()}
    assert got == {
        "1": ("1", 40.0, "SUCCESS", "span", "outer"),
        "2": ("1", 10.0, "FAILURE", "span", "outer > inner"),
        "event-4": ("event-4", 0.0, "FAILURE", "event", "alone"),
    }
    nested = {r.id: r.event_list for r in SP.nested(spans, SP.span_events(records)).collect()}
    assert [e.name for e in nested["2"]] == ["boom"] and nested["1"] is None


def test_log_sinks(spark, tmp_path):
    e = parsed(
        spark,
        json.dumps({**CORE, "fields": {"log_type": "low_freq", "n": 1, "message": "inner"}}),
        json.dumps({**CORE, "fields": {"log_type": "beacon"}}),
        json.dumps({**CORE, "level": "TRACE", "target": "log"}),
    ).withColumn("route", F.try_variant_get(F.try_element_at("fields", F.lit("log_type")), "$", "string"))
    out.write_routes(e, str(tmp_path / "routes"))
    back = spark.read.text(str(tmp_path / "routes")).collect()
    flat = {r.route: json.loads(r.value) for r in back}
    assert set(flat) == {"low_freq", "beacon"}
    assert flat["low_freq"]["message"] == "test message" and flat["low_freq"]["n"] == 1
    assert len(out.target_lines(e).collect()) == 2
