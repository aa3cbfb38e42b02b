"""Top-k that no single hot group or task has to sort alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] = (), salt_key: str | None = None,
          rank: str = "rank") -> DataFrame:
    """First k rows per group by ``order``, exact.

    Step one ranks inside (group, salt), so a group of any size is spread over
    many tasks; the rank filter is also applied before that shuffle
    (``WindowGroupLimit``).  Step two ranks at most ``k * SALTS`` rows per group.
    ``order`` must be a total order.
    """
    by = list(by)
    if salt_key is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_key)), F.lit(SALTS)))
        inner = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k).drop("_rn", "_salt")
        if by:
            # an explicit exchange: grouping by ``by`` must not reuse a coarser one upstream
            df = df.repartition(*[F.col(c) for c in by])
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def leading_chunks(df: DataFrame, k: int, chunk: Column, descending: bool = False) -> DataFrame:
    """Rows of the first chunks that together hold at least k rows; all rows if there are fewer.

    For large k: one pre-aggregated count per chunk finds the boundary, so only
    about k rows and not k per task move on to the exact ranking.  ``chunk``
    must follow the ranking's leading order.
    """
    sign = -1 if descending else 1
    counts = df.groupBy(chunk.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.asc("_c") if sign > 0 else F.desc("_c")).rowsBetween(
        Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where(F.col("_before") < k)
    edge = needed.agg((F.max("_c") if sign > 0 else F.min("_c")).alias("e")).scalar()
    return df.where(chunk <= edge if sign > 0 else chunk >= edge)
