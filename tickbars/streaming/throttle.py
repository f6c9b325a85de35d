"""Changes gathered between batches and written at second 30 of each minute.

Each change is due at the first second 30 after it came. What is due by the time of the newest change is written, one row per
key and due time, the newest; the rest waits in a table that the next batch takes over. Two such tables alternate, so a batch that is
repeated after a failure reads the same one and replaces what it wrote. When the stream has ended, ``drain`` writes what still waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickbars.functions.periods import MINUTE_MS
from tickbars.functions.timefns import floor_ms
from tickbars.sinks.store import best_per_key

#: Fixed value: the second of the minute at which changes are written.
AT_MS = 30_000


def due_ms(at_ms: Column, second_ms: int = AT_MS) -> Column:
    """The first write time after a moment; a change that comes at a write time waits for the next."""
    return floor_ms(at_ms + (MINUTE_MS - second_ms), MINUTE_MS) + F.lit(second_ms)


def _waiting(root: str, batch_id: int) -> str:
    return f"{root}/waiting/{batch_id % 2}"


def newest(changes: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    return best_per_key(changes, (*keys, "due_ms"), [F.col(version).desc()])


def start(changes: DataFrame, root: str, keys: tuple[str, ...], *, at: str = "at_ms", version: str = "seq", **trigger) -> StreamingQuery:
    """Write a stream of changes below ``root`` as described; ``at`` tells when each came, ``version`` which is newer."""
    schema = changes.withColumn("due_ms", due_ms(F.col(at))).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = batch.withColumn("due_ms", due_ms(F.col(at)))
        if batch_id:
            waiting = waiting.unionByName(spark.read.schema(schema).parquet(_waiting(root, batch_id - 1)))
        # one row per key and write time is all that can be written, so no more than that waits
        waiting = newest(waiting, keys, version).persist()
        try:
            now = waiting.select(F.max(at).alias("n")).scalar()
            due = waiting.filter(F.col("due_ms") <= now)
            due.write.mode("overwrite").parquet(f"{root}/written/batch_id={batch_id}")
            waiting.filter(F.col("due_ms") > now).write.mode("overwrite").parquet(_waiting(root, batch_id))
        finally:
            waiting.unpersist()

    return (
        changes.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def drain(spark: SparkSession, root: str) -> None:
    """Write what waits once the stream has ended. Doing so again replaces it by the same."""
    done = spark.read.text(f"{root}/checkpoint/commits", pathGlobFilter="[0-9]*")
    last = done.select(F.max(F.element_at(F.split("_metadata.file_name", "[.]"), 1).cast("bigint"))).first()[0]
    if last is not None:
        waiting = spark.read.parquet(_waiting(root, int(last)))
        waiting.write.mode("overwrite").parquet(f"{root}/written/batch_id={int(last) + 1}")


def written(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/written").drop("batch_id")
