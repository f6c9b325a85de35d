"""What several of the corpus operators need: texts, scratch tables, hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickbars.session import shared_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with a share of at least one in HEAVY_SHARE of all rows is heavy, so that there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 2000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same where all characters are ASCII, and is faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage.

    The files outlive lost executors. They are left for the owner of the folder to remove,
    since a lazy result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_to_unique(rows: DataFrame, unique: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Inner join of rows to one row per key where few keys may hold most rows.

    ``heavy`` holds the rows of ``unique`` whose keys are heavy, at most HEAVY_SHARE of them,
    and is broadcast; all other rows meet theirs in a sort-merge join.
    """
    few = F.broadcast(heavy)
    ordinary = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(ordinary.join(unique.hint("merge"), key))


def text_keys(id_col: Column, text: Column) -> dict[str, Column]:
    """Columns that are never null and are equal for rows of equal id and text only."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "key_id": F.coalesce(id_col.cast("long"), F.lit(0)),
        "key_none": id_col.isNull(),
        "key_a": F.xxhash64(whole),
        "key_b": F.xxhash64(F.lit(1), whole),
    }


def one_of_each(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of the wanted keys, with all columns.

    Rows that share a key count as repeated. Join and numbering share one shuffle.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), *[k.alias(name) for name, k in keys.items()])
    met = packed.join(wanted.select(*keys).hint("merge"), list(keys), "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(next(iter(keys))))
    return met.withColumn("nth", first).filter("nth = 1").select("d.*")
