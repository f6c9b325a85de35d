"""Log entries routed to files by type, and the flat and nested line shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTES = ("low_freq", "beacon")


def routed(entries: DataFrame, route: str) -> DataFrame:
    """Entries marked for one of the routes (by their ``route`` column)."""
    return entries.filter(F.col("route") == route)


def flat_lines(entries: DataFrame) -> DataFrame:
    """One flat JSON object per entry: the fields with the entry's own keys laid over them."""
    own = F.create_map(
        F.lit("timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").cast("variant"),
        F.lit("level"), F.col("level").cast("variant"),
        F.lit("target"), F.col("target").cast("variant"),
        F.lit("message"), F.col("message").cast("variant"),
    )
    rest = F.map_filter("fields", lambda k, _: ~k.isin("timestamp", "level", "target", "message"))
    keep = [c for c in ("seq", "route") if c in entries.columns]
    return entries.select(*keep, F.to_json(F.map_concat(rest, own)).alias("value"))


def target_lines(entries: DataFrame) -> DataFrame:
    """Nested shape: metadata, the span path if there is one, and the fields under ``fields``
    if there are any. TRACE rows of the target ``log`` are left out."""
    shown = entries.filter(~((F.col("level") == "TRACE") & (F.col("target") == "log")))
    path = F.array_join(F.col("span.hierarchy"), " > ")
    keep = [c for c in ("seq",) if c in entries.columns]
    return shown.select(
        *keep,
        F.to_json(
            F.struct(
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                "level",
                "target",
                "message",
                path.alias("span_path"),
                F.when(F.size("fields") > 0, F.col("fields")).alias("fields"),
            )
        ).alias("value"),
    )


def write_routes(entries: DataFrame, path: str) -> None:
    """Flat lines of both routes, one folder each."""
    marked = entries.filter(F.col("route").isin(*ROUTES))
    flat_lines(marked).select("route", "value").write.mode("overwrite").partitionBy("route").text(path)
