"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage where a contract does not say otherwise.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side may have to be broadcast; its size is counted first.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset, as in local tests, is a
    temporary folder made; with executors on other machines that would lose data, so it is
    refused there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="glosswork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder.

    Spark deletes the files when they are no longer used only where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints; else they stay until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files (and checkpoints) of plans that are done.

    It does so once the driver's garbage is collected, which a driver with little to do puts off
    while the files of a long job pile up. Called where the plans before have been cut.
    """
    gc.collect()
    spark._jvm.System.gc()


def store_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write as Parquet below the shared folder (or to ``path``) and read it back."""
    spark = df.sparkSession
    path = path or store_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if a count proves the side small; otherwise the side unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def root_buckets(rows: int) -> int:
    """About the square root: as many buckets as rows in each, so neither outgrows a task."""
    return max(1, math.ceil(math.sqrt(max(1, rows))))


def hash_bucket(hex_key: Column, buckets: int) -> Column:
    """The bucket of a uniform lowercase hex key; buckets are ranges of the key's order."""
    head = F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long")
    return F.shiftright(head * F.lit(buckets).cast("long"), 32)


def bucket_prefix(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one, per ``keys``.

    Rows come in the order of (bucket, *order). A task sorts one bucket of one key, and the
    offsets of buckets are prefix sums of pre-aggregated totals: a key with most of all rows
    is still spread over its buckets. ``keys`` and ``bucket`` must not be null. ``total`` names a
    column for the sum over all rows of the key.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    every = Window.partitionBy(*keys)
    before = every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")]
    sums += [F.sum("_total").over(every).alias(total)] if total else []
    offsets = totals.select(*keys, bucket, *sums)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(offsets, [*keys, bucket]).withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")
