"""Connected components by alternating large and small stars; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import released, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours move to the smallest one; small star: the smaller ones and the node itself do."""
    around = edges.union(edges.select("b", "a")) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = around.join(least, "a")
    if large:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, work: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id connected with it."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), work)
    last = None
    while True:
        before, edges = edges, saved(_star(_star(edges, True), False), work)
        released(before)
        # both stars keep components; when each id points at one smaller id and none of those points on, it is done
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    own = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = saved(own.union(roots), work)
    released(edges)
    return out
