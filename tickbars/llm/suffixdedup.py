"""Removal of byte strings that occur more than once, by prefix doubling over runs of positions.

A position is to go if the string of ``threshold`` bytes that starts there starts anywhere else
too. Plain prefix doubling ranks every position by its first bytes, then sorts pairs of ranks at
growing offsets, until a position is unique or the compared prefix is past the threshold. That
takes a row per byte. Here a row stands for a run of neighbouring positions, and runs that are
unique at some length drop out before longer prefixes are compared:

* Every string of ``threshold`` bytes has an anchor, the least of its ANCHOR-byte strings by hash,
  the leftmost of equals. It depends on the string alone, so equal strings have equal anchors at equal
  distances, and neighbouring positions share theirs. These are the runs; the anchor is the rank
  at the first length. A run with an anchor of its own is unique and drops out.
* Of runs with equal anchors, those that agree over all their bytes are settled: each of their
  positions starts a string that starts elsewhere. Of equal ones a single run goes on, to be met.
* What remains is cut into shorter runs at fixed distances from the anchor, and the prefix that
  all positions of a run share grows with each cut (WIDTHS): it is the rank that is compared next. Runs
  with a unique one drop out, runs that agree are settled, the rest are cut again. A run of one
  position shares the whole string: past the threshold, nothing remains.

Ranks are 128-bit names of the compared bytes, so no rank is sent back to where it is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import HEAVY_SHARE, scratch

THRESHOLD = 400
ANCHOR = 128

#: Positions in a run after each cut; the last must be 1.
WIDTHS = (64, 16, 4, 1)

#: Positions taken at a time, so that a long text takes no more memory than a short one.
_STRETCH = 1 << 20

_RUNS = "row long, i0 int, i1 int, anchor int, rank long, name binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE_NAMES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)


def _anchors(data: np.ndarray, threshold: int, anchor: int) -> np.ndarray:
    """For each position that starts a string, where the anchor of that string is.

    Names of 1, 2, 4 ... bytes are joined to names twice as long; then the least name within a
    string is found over windows of 1, 2, 4 ... names. The name's lowest bits give way to the position.
    """
    names, width = _BYTE_NAMES[data], 1
    while width < anchor:
        step = min(width, anchor - width)
        longer = names[: len(names) - step] * _MIX
        longer += names[step:]
        longer ^= longer >> np.uint64(29)
        names, width = longer, width + step
    names *= _MIX
    low = np.uint64((1 << 24) - 1)
    least = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    window, count = 1, threshold - anchor + 1
    while window < count:
        step = min(window, count - window)
        least, window = np.minimum(least[: len(least) - step], least[step:]), window + step
    return (least & low).astype(np.int64)


def _runs_of(row: int, data: bytes, threshold: int, anchor: int) -> Iterator[tuple]:
    """The runs of a text: row, first and last position, anchor, its rank, and the name of all the run's bytes."""
    import xxhash

    last = len(data) - threshold
    for base in range(0, last + 1, _STRETCH):
        part = data[base : min(base + _STRETCH, last + 1) + threshold - 1]
        at = _anchors(np.frombuffer(part, np.uint8), threshold, anchor)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        lasts = np.concatenate([firsts[1:] - 1, [len(at) - 1]])
        for i0, i1, a in zip(firsts.tolist(), lasts.tolist(), at[firsts].tolist(), strict=True):
            rank = xxhash.xxh3_64_intdigest(part[a : a + anchor])
            shape = (a - i0) << 32 | (i1 - i0)
            yield row, base + i0, base + i1, base + a, rank - (1 << 63), xxhash.xxh3_128_digest(part[i0 : i1 + threshold], shape)


def find_runs(stored: DataFrame, threshold: int, anchor: int) -> DataFrame:
    """Runs of all positions of texts (row, data)."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["row", "i0", "i1", "anchor", "rank", "name"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.extend(_runs_of(row, data.as_py(), threshold, anchor))
                if len(held) > 50_000:
                    yield _batch(held, types, names)
                    held = []
            if held:
                yield _batch(held, types, names)

    return stored.select("row", "data").mapInArrow(runs, _RUNS)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _semi(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """Rows whose class (key, n) is among ``classes``.

    Classes with one in HEAVY_SHARE of the ``total`` rows that n counts are broadcast, HEAVY_SHARE at most.
    """
    heavy = F.broadcast(classes.filter(F.col("n") * HEAVY_SHARE >= total).select(key))
    ordinary = rows.join(heavy, key, "left_anti").join(classes.select(key).hint("merge"), key, "left_semi")
    return rows.join(heavy, key, "left_semi").unionByName(ordinary)


def repeated_positions(stored: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Runs (row, i0, i1) of positions whose string of ``threshold`` bytes starts elsewhere too.

    ``stored`` holds texts as row, a unique number, and data, their bytes.
    """
    runs = scratch(find_runs(stored, threshold, anchor), "runs")
    shared = runs.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = scratch(_semi(runs, scratch(shared, "ranks"), "rank", runs.count()), "live-runs")
    classes = live.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "i0", "i1", "anchor", "rank")).alias("r")
    )
    classes = scratch(classes.select("name", "n", "r.*"), "run-classes")
    settled = [_semi(live, classes.filter("n > 1"), "name", live.count()).select("row", "i0", "i1")]

    open_ranks = classes.groupBy("rank").agg(F.count(F.lit(1)).alias("_c"), F.min("n").alias("_least")).filter("_c > 1 and _least = 1")
    going = classes.join(open_ranks.select("rank"), "rank", "left_semi")
    lists = going.groupBy("row").agg(F.collect_list(F.struct("i0", "i1", "anchor", "rank", (F.col("n") == 1).alias("mine"))).alias("runs"))
    cut = F.transform(
        "runs",
        lambda r: F.struct(
            F.col("row").alias("row"),
            r["i0"].alias("i0"),
            r["anchor"].alias("anchor"),
            r["rank"].alias("rank"),
            r["mine"].alias("mine"),
            (r["anchor"] - r["i1"]).alias("lo"),
            (r["anchor"] - r["i0"]).alias("hi"),
            F.substring("data", r["i0"] + 1, r["i1"] - r["i0"] + threshold).alias("bytes"),
        ),
    )
    parts = scratch(stored.join(lists, "row").select(F.inline(cut)), "run-bytes")
    windows = parts.select("row", "i0", "anchor", "rank", F.col("hi").alias("far"), "bytes")
    turn = parts.select("row", "i0", "mine", "lo", "hi")
    for width in widths:
        named = scratch(_named(turn, windows, width, threshold), "named-runs")
        found = named.groupBy("name").agg(
            F.count(F.lit(1)).alias("n"), F.max("mine").alias("mine"), F.min(F.struct("row", "i0", "lo", "hi", "rank")).alias("r")
        )
        found = scratch(found.select("name", "n", "mine", "r.*"), "named-classes")
        done = _semi(named.filter("mine"), found.filter("n > 1 and mine"), "name", named.count())
        settled.append(done.select("row", (F.col("anchor") - F.col("hi")).alias("i0"), (F.col("anchor") - F.col("lo")).alias("i1")))
        alone = F.col("mine") & (F.col("n") == 1)
        ranks = found.groupBy("rank").agg(F.count(F.lit(1)).alias("_c"), F.max(alone).alias("_open")).filter("_c > 1 and _open")
        turn = found.join(ranks.select("rank"), "rank", "left_semi").select("row", "i0", alone.alias("mine"), "lo", "hi")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _named(turn: DataFrame, windows: DataFrame, width: int, threshold: int) -> DataFrame:
    """Cut runs at multiples of ``width`` from the anchor; rank: of the prefix they share, name: of all their bytes."""
    blocks = F.sequence(F.floor(F.col("lo") / width).cast("int"), F.floor(F.col("hi") / width).cast("int"))
    short = turn.withColumn("block", F.explode(blocks)).withColumns({
        "lo": F.greatest("lo", F.col("block") * width),
        "hi": F.least("hi", F.col("block") * width + width - 1),
    })
    shared = F.substring("bytes", F.col("far") - F.col("block") * width + 1, F.lit(threshold - width + 1))
    whole = F.substring("bytes", F.col("far") - F.col("hi") + 1, F.col("hi") - F.col("lo") + threshold)
    name = F.unhex(F.md5(F.concat(whole, F.encode(F.concat_ws(":", F.lit(""), "lo", "hi"), "UTF-8"))))
    return short.join(windows, ["row", "i0"]).select(
        "row", "i0", "anchor", "mine", "lo", "hi", F.xxhash64("rank", "block", shared).alias("rank"), name.alias("name")
    )


def stored_bytes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their bytes, each with a number of its own: d, data, row. Null texts are empty."""
    names = [c for c in docs.columns if c != text_col]
    data = F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")
    kept = F.struct(*[docs[c] for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return scratch(docs.select(kept.alias("d"), data.alias("data"), F.monotonically_increasing_id().alias("row")), "documents")


def removed_spans(runs: list[tuple[int, int]], threshold: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) that the strings starting in the runs cover."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + threshold))
        else:
            out.append((first, last + threshold))
    return out


def without_repeats(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD, **options) -> DataFrame:
    """Documents (d, all columns but the text), with their bytes, spans to remove and what a digest of the rest is.

    Columns: d, row, data, spans (array of start, end), n_bytes, n_removed, n_spans, kept_sha256.
    Texts below the threshold have no spans. No documents give no rows. Repeated rows count as
    documents of their own: each makes the other's strings repeat.
    """
    stored = stored_bytes(docs, text_col)
    runs = repeated_positions(stored, threshold, **options)
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("i0", "i1")).alias("runs"))

    @F.pandas_udf("spans array<struct<start:int,end:int>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def judged(data: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(data, runs, strict=True):
            spans = removed_spans([(r["i0"], r["i1"]) for r in found] if found is not None else [], threshold)
            rows.append((
                [{"start": s, "end": e} for s, e in spans],
                len(text),
                sum(e - s for s, e in spans),
                len(spans),
                hashlib.sha256(kept_bytes(text, spans)).hexdigest(),
            ))
        return pd.DataFrame(rows, columns=["spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = stored.join(lists.hint("merge"), "row", "left")
    return joined.withColumn("j", judged("data", "runs")).select("d", "row", "data", "j.*")


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for span in spans for x in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
