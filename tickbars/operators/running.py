"""Running aggregates in arrival order that do not need one task per key.

A plain window ``partition by symbol order by seq`` sends a whole symbol to one task.
Here the order column is cut at its quantiles into chunks of about ``chunk_rows`` rows:

1. one partial aggregate per (keys, chunk), combined before the shuffle;
2. a prefix over the chunks of a key, which sees one row per chunk, not per input row;
3. a local window inside (keys, chunk), joined with the prefix of the chunk.

However sparse or dense ``order`` is, no task sorts more than a chunk of a key, whatever
share of the table that key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000

# Borders that are looked for at once; chunks grow beyond chunk_rows when more would be needed.
MAX_CHUNKS = 100_000

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.greatest(a, b)  # skips nulls
    if kind == "min":
        return F.least(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def chunk_of(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """The chunk of a row, which grows with ``order``: about ``chunk_rows`` rows share one.

    One aggregate counts the rows, a second one finds the borders at quantiles. A row looks its
    chunk up by bisection, so the borders cost log2 of their number.
    """
    found = _chunks(df, order, chunk_rows)
    return F.lit(0).cast("bigint") if found is None else found


def _chunks(df: DataFrame, order: str, chunk_rows: int) -> Column | None:
    """As :func:`chunk_of`, or None if all rows share one chunk."""
    rows = df.select(F.count(order)).first()[0]
    n = min(MAX_CHUNKS, -(-rows // chunk_rows))
    if n <= 1:
        return None
    shares = [i / n for i in range(1, n)]
    borders = sorted(set(df.select(F.percentile_approx(order, shares, max(10_000, 4 * n))).first()[0]))
    held = F.array(*(F.lit(b) for b in borders))
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]

    def bisect(at: Column, step: Column) -> Column:
        inside = (at + step <= len(borders)) & (F.try_element_at(held, at + step) < F.col(order))
        return F.when(inside, at + step).otherwise(at)

    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), bisect).cast("bigint")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, tuple[str, str]],
    *,
    inclusive: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running aggregates over the rows before (or up to) each row.

    ``outputs`` maps a new column to ``(kind, source column)`` with kind ``max``, ``min`` or
    ``sum``. A max or min with no earlier value is null, a sum is 0. ``keys`` may be empty.
    Key values must not be null.
    """
    upto = Window.currentRow if inclusive else -1
    chunk = _chunks(df, order, chunk_rows)
    if chunk is None:  # few rows: a plain window is the same
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
        at_once = {
            out: F.coalesce(_AGG[kind](src).over(whole), F.lit(0)) if kind == "sum" else _AGG[kind](src).over(whole)
            for out, (kind, src) in outputs.items()
        }
        return df.select(*(F.col(c) for c in df.columns), *(c.alias(out) for out, c in at_once.items()))
    chunked = df.select("*", chunk.alias("_chunk"))
    on = [*keys, "_chunk"]

    totals = chunked.groupBy(*on).agg(
        *(_AGG[kind](src).alias(f"_t_{out}") for out, (kind, src) in outputs.items())
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *on,
        *(_AGG[kind](f"_t_{out}").over(before).alias(f"_p_{out}") for out, (kind, _) in outputs.items()),
    )

    local = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    return (
        chunked.join(prefix, on, "inner")
        .select(
            *(F.col(c) for c in df.columns),
            *(
                _merge(kind, F.col(f"_p_{out}"), _AGG[kind](src).over(local)).alias(out)
                for out, (kind, src) in outputs.items()
            ),
        )
    )


def previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the value of the row just before in arrival order, with the same chunking."""
    chunk = _chunks(df, order, chunk_rows)
    if chunk is None:
        return df.select("*", F.lag(value).over(Window.partitionBy(*keys).orderBy(order)).alias(out))
    on = [*keys, "_chunk"]
    chunked = df.select("*", chunk.alias("_chunk"))
    last = chunked.groupBy(*on).agg(F.max_by(value, order).alias("_last"))
    carry = last.select(*on, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    local = Window.partitionBy(*on).orderBy(order)
    return chunked.join(carry, on, "inner").select(
        *(F.col(c) for c in df.columns),
        F.when(F.row_number().over(local) == 1, F.col("_carry")).otherwise(F.lag(value).over(local)).alias(out),
    )


def numbered(
    df: DataFrame,
    order: list[str],
    chunk: Column,
    out: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """Number all rows from 1 in the given order without sorting them in one task.

    ``chunk`` must grow with the order (a day, a range of offsets): rows are counted per
    chunk, the counts are summed over the chunks, and only a chunk is sorted at a time.
    """
    chunked = df.select("*", chunk.alias("_chunk"))
    sort = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    counts = chunked.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy(sort("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_chunk").orderBy(*(sort(c) for c in order))
    return chunked.join(offsets, "_chunk", "inner").select(
        *(F.col(c) for c in df.columns), (F.col("_offset") + F.row_number().over(within)).alias(out)
    )
