"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC and adaptive execution for this session; cluster sizing is left alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


#: Rows, and bytes, that a Python function gets at once where texts are its input.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what Python functions of this session get at once, by rows and by bytes.

    A batch of texts lies in the JVM's memory beyond its heap and in the worker, there several times. The setting stays,
    as lazy results are computed later; fewer rows that the session asks for are kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-tickbars-")
    return _local_dirs[app]


def use_checkpoints(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the shared folder."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder + "/rdd")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def parts(spark: SparkSession, n: int) -> Iterator[None]:
    """What is written meanwhile is shuffled to ``n`` partitions that are not put together again, and skewed ones still split."""
    wanted = {"spark.sql.shuffle.partitions": str(max(1, n)), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
