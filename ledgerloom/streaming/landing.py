"""Streams of statement rows into the books (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import row_hash

ROWS = "line_id long, bank_account int, ts timestamp, amount long, description string, balance long"


def statement_rows(spark: SparkSession, folder: str, delay: str = "7 days") -> DataFrame:
    """Rows of Parquet files as they arrive, each once: a repeat of a row within the watermark goes."""
    rows = spark.readStream.schema(ROWS).parquet(folder)
    rows = rows.withColumn("hash", row_hash(F.to_date("ts"), "amount", "description", "balance"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["bank_account", "hash"])


def daily_movements(rows: DataFrame) -> DataFrame:
    """Money in and out by account and day of arrival."""
    window = F.window("ts", "1 day")
    return rows.groupBy(window, "bank_account").agg(
        F.sum(F.greatest("amount", F.lit(0))).alias("money_in"), F.sum(F.greatest(-F.col("amount"), F.lit(0))).alias("money_out"), F.count("*").alias("n")
    )


def append_new(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's rows that the table doesn't have; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if spark.catalog.tableExists(table):
            batch = batch.join(spark.table(table).select("bank_account", "hash"), ["bank_account", "hash"], "left_anti")
        batch.write.mode("append").saveAsTable(table)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
