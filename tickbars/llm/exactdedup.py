"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest
before anything else, the digests that the index lacks are found by a sort-merge anti-join,
and only those are appended. Texts are never shuffled: a row takes its id and digest along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.llm.common import HEAVY_SHARE, ascii_lower, join_to_unique, one_of_each, scratch
from tickbars.session import shared_dir

BUCKETS = 32


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


class DigestIndex:
    """Digests seen so far, with the id of the row that stays.

    ``path`` names the folder of an index that later sessions open again; without one the
    index lives in the shared folder. ``buckets`` must be the same each time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/tables/digest-index-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str, text_col: str, batch: str | None = None) -> DataFrame:
        """Append the new digests of a batch; per row of the batch: digest, keep_id, group_size, kept, row.

        Of equal texts within a batch the row with the largest id stays, null ids losing to any
        other; of rows that tie, one stays. A text of an earlier batch keeps the row it has.
        ``group_size`` counts the rows of this batch. Adding the batch again under the same
        name changes nothing, so a job that died may be run once more. An empty batch gives no rows.
        """
        batch = batch or uuid.uuid4().hex
        picked = docs.select(docs[id_col].cast("long").alias("id"), text_digest(docs[text_col]).alias("digest"))
        return self.add_digests(scratch(picked.withColumn("row", F.monotonically_increasing_id()), "digests"), batch)

    def add_digests(self, rows: DataFrame, batch: str) -> DataFrame:
        """As ``add``, for stored rows of id, digest and row (unique within the batch)."""
        groups = (
            rows.groupBy("digest")
            .agg(F.max(F.struct("id", "row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("_keep.id").alias("keep_id"), F.col("_keep.row").alias("keep_row"), "group_size")
        )
        groups = scratch(groups, "digest-groups")
        known = self.table().hint("merge")
        fresh = groups.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        (
            fresh.select("digest", "keep_id", "keep_row", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.name)
        )
        held = scratch(groups.select("digest", "group_size").join(self.table().hint("merge"), "digest"), "digest-kept")
        total = rows.count()
        heavy = held.filter(F.col("group_size") * HEAVY_SHARE >= total).filter(F.col("group_size") > 1)
        return join_to_unique(rows, held, "digest", heavy).select(
            "id",
            "row",
            "digest",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ids may be null or repeat."""
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = {
        "key_id": F.coalesce(docs[id_col].cast("long"), F.lit(0)),
        "key_none": docs[id_col].isNull(),
        "key_digest": text_digest(text),
    }
    rows = DigestIndex(docs.sparkSession).add(docs, id_col, text_col, batch="documents").filter("kept")
    wanted = rows.select(F.coalesce("id", F.lit(0)).alias("key_id"), F.col("id").isNull().alias("key_none"), F.col("digest").alias("key_digest"))
    return one_of_each(docs, keys, wanted)
