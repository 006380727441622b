"""What several operators of this subpackage need: staged tables and running totals."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Settings of a table's execution: its shuffle files go when it ends, and Arrow batches stay small,
#: so that a Python worker holds a few megabytes of rows.
WHILE_STAGED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
WORD = r"[^\x20\x09-\x0D]+"
_held: dict[Hashable, Any] = {}


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, kept in a Python worker for its next tasks until another key is
    asked for: a worker that serves one operator after another holds the tables of the last alone."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder of
    its own; on a cluster there is no safe default, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, so a lost executor
    costs a read and no recomputation, and values such as partition numbers are fixed. The shuffle
    files behind the table, which nothing needs any more, go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in WHILE_STAGED}
    for k, v in WHILE_STAGED.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; call it once the results are stored."""
    delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def running_total(df: DataFrame, order: list[str], value: str, total: str) -> DataFrame:
    """Adds ``total``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are range-partitioned, each range sums on its own, and only one row per range meets in a
    window without a partition. Rows that tie in ``order`` follow each other in any order.
    """
    kept = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    bases = (
        kept.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of the shuffle above, so the broadcast is bounded by the number of partitions
    return (
        kept.join(F.broadcast(bases), "_part")
        .withColumn(total, F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_base")
    )
