"""Exact dedup against a persistent digest index, with DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import UPPER, stage


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased (only those); null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), 256))


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, that outlives the session's frames.

    ``add`` compares a batch with the index by a sort-merge anti-join, which reads the index without
    a shuffle, and appends the digests that are new. A row is kept if its digest is new and its
    doc_id is the largest of its group in the batch.

    Null texts equal the empty text. A null doc_id loses to any other; in a group with no other,
    keep_id is null and every row is kept. Repeated rows with the winning doc_id are the same
    document and are all kept. An empty batch gives an empty result. Columns other than doc_id and
    text are not looked at.

    A batch that is added again under the ``batch`` name it had, as after a driver was lost before the
    answer was stored, gets the answer of the first time, and only what is missing of it is appended.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, group_size bigint, batch string")
            self._append(empty)

    def _append(self, groups: DataFrame) -> None:
        (
            groups.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.table)
        )

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Returns doc_id, keep_id, group_size, kept, known (in the index before), text_sha256.

        ``batch`` names the rows; without a name they are a batch of their own each time."""
        batch = uuid.uuid4().hex if batch is None else batch
        keyed = stage(docs.select("doc_id", text_digest(docs["text"]).alias("digest")), "digests")
        groups = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        index = self.spark.table(self.table)
        fresh = groups.join(index.select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.withColumn("batch", F.lit(batch)))
        self.spark.catalog.refreshTable(self.table)
        older = self.spark.table(self.table).filter(F.col("batch") != batch)
        older = older.select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("known"))
        merged = groups.join(older.hint("merge"), "digest", "left").select(
            "digest",
            F.when(F.col("known"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            "group_size",
            F.coalesce("known", F.lit(False)).alias("known"),
        )
        # both sides are exchanged here, so that adaptive execution can split a group with many rows
        merged = merged.repartition("digest")
        return keyed.join(merged, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
            "known",
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def against_new_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What ``DigestIndex.add`` says of one batch against an empty index, whose table goes afterwards."""
    table = f"digests_{uuid.uuid4().hex}"
    try:
        return stage(DigestIndex(spark, table).add(docs).drop("known"), "kept")
    finally:
        spark.sql(f"drop table if exists {table}")


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of rows with equal texts those with the largest doc_id, with all their columns.

    Null and empty texts are equal. A null doc_id stays only where no other has its text; repeated rows
    with the doc_id that stays all stay. An empty table gives an empty result.
    """
    kept = against_new_index(spark, docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (text_digest(docs["text"]) == kept["_digest"])
    return docs.join(kept, same, "left_semi")
