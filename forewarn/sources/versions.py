"""Tables kept in numbered versions that count only once their manifest is written.

A commit first writes its tables, each into a folder of its own, and the one-row manifest last.  Readers go by the
manifests, so a run killed in between leaves the former version readable, and its folders are written anew by the next
commit.  A commit that names its source batch is made only once, however often that batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from forewarn.sources.io import path_exists

col = F.col
_MANIFEST = "version long, source long, mark long, since map<string,long>"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per commit: its version, the batch it came from, its mark and the first version to read of each table."""
    if not path_exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{root}/commits")


def newest(spark: SparkSession, root: str) -> Row | None:
    return commits(spark, root).orderBy(col("version").desc()).limit(1).first()


def is_committed(spark: SparkSession, root: str, source: int) -> bool:
    return not commits(spark, root).where(col("source") == source).isEmpty()


def stage(df: DataFrame, root: str, name: str, version: int) -> DataFrame:
    """Writes a table of a version that is not committed yet, and reads it back."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def commit(spark: SparkSession, root: str, version: int, since: dict[str, int], source: int | None = None,
           mark: int | None = None) -> None:
    """Makes the staged tables of ``version`` visible.  ``since``: first version to read, by table."""
    spark.createDataFrame([(version, source, mark, since)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/commits/version={version}")


def read(spark: SparkSession, root: str, name: str, whole: bool = False) -> DataFrame | None:
    """The committed rows of a table with their ``version``: from its ``since`` on, or all of them.  None before the first."""
    last = newest(spark, root)
    if last is None or name not in last.since:
        return None
    first = 0 if whole else last.since[name]
    rows = commits(spark, root).where((col("version") >= first) & F.map_contains_key("since", name)).select("version").collect()
    return spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/version={r.version}" for r in rows]).withColumn(
        "version", col("version").cast("long"))
