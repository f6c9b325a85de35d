"""Spans from their start, event and close records, and paths from root to leaf.

Input records: ``seq, ts_ms, kind (new, event, close), span_id, parent_id, name, target,
level, message, attributes``; events outside any span have no ``span_id``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.session import parts, shared_dir, stored

SEPARATOR = " > "

#: Rows of a partition. Paths repeat each other and take few bytes in a shuffle but many in memory, so
#: partitions are counted by rows.
PART_ROWS = 100_000


def resolve(spans: DataFrame, with_paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Paths of spans (``span_id, root_id, span_path``: names from root to leaf), and the
    ``span_id`` of those whose parents form a loop, which have none. Without ``with_paths``, no
    ``span_path``.

    Every round joins each unfinished row with the row it points at, which doubles the part
    of the path that is known. A round in which none is finished leaves loops and what hangs on
    them: a longer chain would have had one of every shorter length. Rows whose parent is not
    there count as roots. The rows point at unique span ids, so a parent with very many
    children only skews the unfinished side, which adaptive execution splits. A round writes the
    rows it moved to a table of its own, and finished ones stay where they are.
    """
    spark, root = spans.sparkSession, f"{shared_dir(spans.sparkSession)}/tables/paths-{uuid.uuid4().hex}"
    path = [F.col("name").cast("string").alias("_path")] if with_paths else []
    first = spans.select("span_id", F.col("parent_id").alias("_up"), F.col("span_id").alias("root_id"), *path)
    first.write.parquet(f"{root}/0")
    schema = spark.read.parquet(f"{root}/0").schema
    table = lambda n: spark.read.schema(schema).parquet(f"{root}/{n}")
    is_open = F.col("_up").isNotNull()
    done, now = [], table(0)
    rows, open_rows, n = now.count(), now.filter(is_open).count(), 0
    while open_rows:
        state = reduce(DataFrame.unionByName, [*done, now])
        above = state.select(
            F.col("span_id").alias("_up"),
            F.col("_up").alias("_next"),
            F.col("root_id").alias("_root"),
            *([F.col("_path").alias("_above")] if with_paths else []),
        )
        moved = now.filter(is_open).join(above.hint("merge"), "_up", "left").select(
            "span_id",
            F.col("_next").alias("_up"),
            F.coalesce("_root", "root_id").alias("root_id"),
            *([_joined(F.col("_above"), F.col("_path")).alias("_path")] if with_paths else []),
        )
        with parts(spark, -(-rows // PART_ROWS)):
            moved.write.parquet(f"{root}/{n + 1}")
        done.append(now.filter(~is_open))
        n, now = n + 1, table(n + 1)
        before, open_rows = open_rows, now.filter(is_open).count()
        if open_rows == before:
            break
    done.append(now.filter(~is_open))
    found = [F.coalesce("_path", F.lit("")).alias("span_path")] if with_paths else []
    paths = reduce(DataFrame.unionByName, done).select("span_id", "root_id", *found)
    return paths, now.filter(is_open).select("span_id")


def _joined(above: Column, below: Column) -> Column:
    """Two parts of a path; a span without a name adds nothing."""
    return F.when(above.isNull(), below).when(below.isNull(), above).otherwise(F.concat(above, F.lit(SEPARATOR), below))


def ancestry(spans: DataFrame) -> DataFrame:
    """``root_id`` and ``span_path`` of ``span_id, parent_id, name``, without those in loops."""
    return resolve(spans)[0]


def parent_loops(spans: DataFrame) -> DataFrame:
    """``span_id`` of spans that have no root, as their parents form a loop."""
    return resolve(spans, with_paths=False)[1]


def build_spans(records: DataFrame) -> DataFrame:
    """Closed spans and, as spans of no length, the events outside any span.

    A span takes the trace of its root, its length is close minus start, and it failed if it
    holds an ERROR event. A lone event failed at WARN or worse. Events stay in rows of their
    own (:func:`span_events`), since one span may hold very many. ``attributes`` are those of
    the start record, or of a lone event. Spans in a loop of parents are left out
    (:func:`parent_loops` names them).
    """
    inside = records.filter(F.col("span_id").isNotNull())
    new = F.col("kind") == "new"
    event = F.col("kind") == "event"
    spans = (
        inside.groupBy("span_id")
        .agg(
            *(F.max(F.when(new, F.col(c))).alias(c) for c in ("parent_id", "name", "target", "level")),
            F.max_by("attributes", F.when(new, F.col("seq"))).alias("attributes"),
            F.max(F.when(new, F.col("ts_ms"))).alias("start_ms"),
            F.max(F.when(F.col("kind") == "close", F.col("ts_ms"))).alias("end_ms"),
            F.count_if(event).alias("events"),
            F.count_if(event & (F.col("level") == "ERROR")).alias("_errors"),
        )
        .filter(F.col("start_ms").isNotNull())
    )
    spans = stored(spans)
    n = -(-spans.count() // PART_ROWS) or 1
    roots = ancestry(spans.select("span_id", "parent_id", "name"))
    closed = (
        spans.filter(F.col("end_ms").isNotNull())
        .repartition(n, "span_id")
        .join(roots.repartition(n, "span_id").hint("merge"), "span_id")
        .select(
            F.col("span_id").alias("id"),
            F.col("root_id").alias("trace_id"),
            "parent_id",
            "name",
            "target",
            "level",
            "attributes",
            "start_ms",
            F.col("end_ms").alias("timestamp_ms"),
            (F.col("end_ms") - F.col("start_ms")).cast("double").alias("duration_ms"),
            "events",
            F.when(F.col("_errors") > 0, "FAILURE").otherwise("SUCCESS").alias("status"),
            F.lit("span").alias("span_type"),
            "span_path",
        )
    )
    alone = records.filter(F.col("span_id").isNull() & event)
    pseudo = F.concat(F.lit("event-"), F.col("seq").cast("string"))
    lone = alone.select(
        pseudo.alias("id"),
        pseudo.alias("trace_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("message").alias("name"),
        "target",
        "level",
        "attributes",
        F.col("ts_ms").alias("start_ms"),
        F.col("ts_ms").alias("timestamp_ms"),
        F.lit(0.0).alias("duration_ms"),
        F.lit(0).cast("bigint").alias("events"),
        F.when(F.col("level").isin("WARN", "ERROR"), "FAILURE").otherwise("SUCCESS").alias("status"),
        F.lit("event").alias("span_type"),
        F.col("message").alias("span_path"),
    )
    return closed.unionByName(lone)


def span_events(records: DataFrame) -> DataFrame:
    """Events inside spans, one row each."""
    return records.filter(F.col("span_id").isNotNull() & (F.col("kind") == "event")).select(
        "span_id", "seq", "ts_ms", F.col("message").alias("name"), "level"
    )


def nested(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Spans with their events as an array. Meant for an answer about chosen traces: filter
    ``spans`` first, so that the arrays stay as small as the answer."""
    event = F.struct("seq", "ts_ms", "name", "level")
    held = (
        events.join(spans.select(F.col("id").alias("span_id")), "span_id", "left_semi")
        .groupBy("span_id")
        .agg(F.sort_array(F.collect_list(event)).alias("event_list"))
    )
    return spans.join(held, spans["id"] == held["span_id"], "left").drop("span_id")
