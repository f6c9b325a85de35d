"""Stored bars that a running job can compact, retire and delete from.

Bars are written once, below ``data``, in folders by run, period and month, and never changed. A *generation* is a small
list of such folders in ``manifest``: one file, so it is there as a whole or not at all. A reader takes the newest generation
and stays with it. Appending a batch, compacting and deleting each commit one more generation; what no kept generation
lists is removed by ``retire``.

Deleted symbols are a list beside the bars (symbol and the last batch it covers), applied on reading. Their rows go when a partition is
rewritten: compaction rewrites partitions that got new batches, and with ``purge`` those that hold deleted rows as well.

There is one writer, as for any streaming sink.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tickbars.operators.sizing import small_side
from tickbars.sinks import store as S

_BARS = (
    "symbol string, open_time bigint, open double, high double, low double, close double, volume double, turnover double, "
    "trade_count bigint, taker_buy_volume double, taker_buy_turnover double, is_final boolean, batch_id bigint"
)
_STORED = f"{_BARS}, run string, period string, month date"
#: kind: base (compacted), batch, or deleted (a list of symbols).
_MANIFEST = "kind string, run string, period string, month date, batch_id bigint"


class Generations:
    """Bars below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    # --- generations --------------------------------------------------------------------

    def _files(self):
        """The shared folder's file system."""
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._root)
        return path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Generations that can be read, oldest first."""
        files, path = self._files()
        found = files.globStatus(path(f"{self._root}/manifest/*/part-*"))
        return sorted({int(f.getPath().getParent().getName()) for f in found or []})

    def manifest(self, version: int | None = None) -> list[Row]:
        """What a generation lists: a row per folder, so a few per period and month."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return []
        return self._spark.read.schema(_MANIFEST).parquet(f"{self._root}/manifest/{version}").collect()

    def _commit(self, rows: list[Row]) -> int:
        version = max(self.versions(), default=-1) + 1
        frame = self._spark.createDataFrame([tuple(r) for r in rows], _MANIFEST)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self._root}/manifest/{version}")
        return version

    # --- reading ------------------------------------------------------------------------

    def _folder(self, row: Row) -> str:
        return f"{self._root}/data/run={row.run}/period={row.period}/month={row.month}"

    def _versions_of_bars(self, rows: list[Row]) -> DataFrame:
        """Every stored version of the bars in some folders, without deleted symbols."""
        folders = [self._folder(r) for r in rows if r.kind != "deleted"]
        if not folders:
            return self._spark.createDataFrame([], _STORED)
        bars = self._spark.read.schema(_STORED).option("basePath", f"{self._root}/data").parquet(*folders)
        return self._without_deleted(bars, rows)

    def _deleted(self, rows: list[Row]) -> DataFrame | None:
        lists = [f"{self._root}/deleted/{r.run}" for r in rows if r.kind == "deleted"]
        if not lists:
            return None
        listed = self._spark.read.schema("symbol string, upto bigint").parquet(*lists)
        return listed.groupBy("symbol").agg(F.max("upto").alias("_upto"))

    def _without_deleted(self, bars: DataFrame, rows: list[Row]) -> DataFrame:
        deleted = self._deleted(rows)
        if deleted is None:
            return bars
        met = bars.join(small_side(deleted), "symbol", "left")
        return met.filter(F.col("_upto").isNull() | (F.col("batch_id") > F.col("_upto"))).drop("_upto")

    def _best(self, rows: list[Row]) -> DataFrame:
        """The best version of every bar in some folders.

        A key lies in one period and month, and a compacted folder holds it once. So only the bars of
        partitions with batches are ranked; what is left of the others is as it stands.
        """
        lists = [r for r in rows if r.kind == "deleted"]
        open_parts = {(r.period, r.month) for r in rows if r.kind == "batch"}
        mixed = [r for r in rows if r.kind != "deleted" and (r.period, r.month) in open_parts]
        folded = [r for r in rows if r.kind == "base" and (r.period, r.month) not in open_parts]
        if not folded:
            return S.merge_bars(self._versions_of_bars(mixed + lists), "batch_id")
        best = self._versions_of_bars(folded + lists)
        return best.unionByName(S.merge_bars(self._versions_of_bars(mixed + lists), "batch_id")) if mixed else best

    def read(self, version: int | None = None) -> DataFrame:
        """The best version of every bar in a generation, the newest by default. The result stays with that generation."""
        return self._best(self.manifest(version)).drop("batch_id", "run")

    # --- writing ------------------------------------------------------------------------

    def _write(self, bars: DataFrame, run: str, kind: str, batch_id: int) -> list[Row]:
        """Write a run and list its folders."""
        path = f"{self._root}/data/run={run}"
        (
            bars.hint("rebalance", F.col("period"), F.col("month"))
            .sortWithinPartitions("period", "month", "symbol", "open_time")
            .write.mode("overwrite")
            .partitionBy("period", "month")
            .parquet(path)
        )
        files, hadoop_path = self._files()
        found = files.globStatus(hadoop_path(f"{path}/period=*/month=*")) or []
        names = sorted((f.getPath().getParent().getName(), f.getPath().getName()) for f in found)
        parts = [(p.partition("=")[2], m.partition("=")[2]) for p, m in names]
        return [Row(kind=kind, run=run, period=p, month=date.fromisoformat(m), batch_id=batch_id) for p, m in parts]

    def append(self, bars: DataFrame, batch_id: int) -> None:
        """Store one batch. A batch that was stored before is left as it is, so that it can be repeated after a failure."""
        rows = self.manifest()
        if any(r.kind != "deleted" and r.batch_id >= batch_id for r in rows):
            return
        columns = [c.split()[0] for c in _BARS.split(", ")]
        batch = S.with_month(bars).withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(*columns, "period", "month")
        written = self._write(batch, f"batch-{batch_id}-{uuid.uuid4().hex[:8]}", "batch", batch_id)
        if written:
            self._commit(rows + written)

    def delete(self, symbols: DataFrame) -> None:
        """Remove all bars stored so far of some symbols (column ``symbol``). Bars of later batches count again."""
        rows = self.manifest()
        upto = max((r.batch_id for r in rows), default=-1)
        run = uuid.uuid4().hex
        listed = symbols.select("symbol").distinct().withColumn("upto", F.lit(upto).cast("bigint"))
        listed.write.parquet(f"{self._root}/deleted/{run}")
        self._commit(rows + [Row(kind="deleted", run=run, period=None, month=None, batch_id=upto)])

    def compact(self, purge: bool = False) -> list[tuple]:
        """Fold batches into the partitions they touch, and return those. Other partitions keep their files. With ``purge``,
        partitions with rows of deleted symbols are rewritten too, and the lists of deleted symbols end."""
        rows = self.manifest()
        touched = {(r.period, r.month) for r in rows if r.kind == "batch"}
        deleted = self._deleted(rows) if purge else None
        if deleted is not None:
            folders = [self._folder(r) for r in rows if r.kind != "deleted"]
            held = self._spark.read.schema(_STORED).option("basePath", f"{self._root}/data").parquet(*folders)
            gone = held.join(small_side(deleted), "symbol").filter(F.col("batch_id") <= F.col("_upto"))
            touched |= {(r.period, r.month) for r in gone.select("period", "month").distinct().collect()}
        if not touched and deleted is None:
            return []
        ended = deleted is not None
        rewritten = [r for r in rows if (r.period, r.month) in touched]
        lists = [r for r in rows if r.kind == "deleted"]
        kept = [r for r in rows if r not in rewritten and not (ended and r.kind == "deleted")]
        if rewritten:
            best = self._best(rewritten + lists).drop("run")
            newest = max(r.batch_id for r in rewritten)
            kept += self._write(best, f"base-{uuid.uuid4().hex[:12]}", "base", newest)
        self._commit(kept)
        return sorted(touched)

    def retire(self, keep: int = 2) -> None:
        """Remove generations but the newest ``keep``, and files that only they listed. Readers of a kept one go on."""
        versions = self.versions()
        kept = versions[-keep:]
        rows = [r for v in kept for r in self.manifest(v)]
        files, path = self._files()
        folders = {self._folder(r).rpartition("/data/")[2] for r in rows if r.kind != "deleted"}
        runs = {r.run for r in rows}
        for version in versions[:-keep]:
            files.delete(path(f"{self._root}/manifest/{version}"), True)
        for pattern in ("data/run=*/period=*/month=*", "data/run=*", "deleted/*"):
            for found in files.globStatus(path(f"{self._root}/{pattern}")) or []:
                parts = found.getPath().toString().rpartition(f"/{pattern.partition('/')[0]}/")[2]
                run = parts.split("/")[0].removeprefix("run=")
                if parts not in folders if parts.count("/") == 2 else run not in runs:
                    files.delete(found.getPath(), True)
