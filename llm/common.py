"""Helpers the operators share: shared work folder, written intermediate tables, hash-range chunk ranks."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts: space and the control characters 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows survives a lost executor and reads it once per use."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    # what only this write needed is garbage now; collecting it lets Spark remove its shuffle files
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by their bytes: ten thousand very long texts at once would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_rank_in(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str,
                  work: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within ``keys``, for keys of any size.

    ``chunk`` (an integer, the leading part of the order) splits a key over many tasks: rows are numbered inside
    (keys, chunk), and pre-aggregated counts of the earlier chunks are added.  ``df`` is read twice; pass a written
    table or a plain scan.
    """
    part = [*keys, "_chunk"]
    df = df.withColumn("_chunk", chunk)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), work)
    inner = Window.partitionBy(*part).orderBy(*order)
    numbered = df.repartition(*part).withColumn("_at", F.row_number().over(inner) - 1)
    return (numbered.join(offsets, part)
            .withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_chunk"))
