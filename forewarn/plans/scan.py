"""Running values per key for keys of any size.

A plain window over a key puts all rows of that key into one task.  Here the
caller names a *chunk* expression that never decreases along the order (an
hour, a day, a score range).  Rows are windowed inside (key, chunk); one summary
row per chunk, pre-aggregated before its shuffle, carries the running state from
chunk to chunk.  Rows are shuffled once, and the per-key window only sees
summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with_chunk(df: DataFrame, chunk: Column) -> DataFrame:
    """``_chunk`` without nulls: a missing one becomes the lowest value, as nulls come first in the order."""
    out = df.withColumn("_chunk", chunk)
    kind = out.schema["_chunk"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        lowest = F.lit("0001-01-01 00:00:00").cast(kind)
    elif isinstance(kind, T.StringType):
        lowest = F.lit("")
    else:
        lowest = F.lit(-(1 << 31)).cast(kind)
    return out.withColumn("_chunk", F.coalesce("_chunk", lowest))


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, *,
            sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            firsts: dict[str, Column] | None = None,
            since: dict[str, tuple[Column, Column]] | None = None,
            peers: bool = False) -> DataFrame:
    """Adds running columns to ``df``.

    sums    running total up to and including the row
    lasts   last non-null value so far
    firsts  first non-null value of the key so far
    since   (count, reset): running total of ``count`` since the last row where
            ``reset`` holds; such a row itself gives 0 plus its own count
    peers   rows equal on ``order`` share one result (range frame); not with ``since``

    ``keys`` may be empty (one global order).  Every row is kept; rows without a
    key are not carried across chunks.
    """
    sums, lasts, firsts, since = sums or {}, lasts or {}, firsts or {}, since or {}
    part = [*keys, "_chunk"]
    inner = Window.partitionBy(*part).orderBy(*order)
    frame = (inner.rangeBetween if peers and len(order) == 1 else inner.rowsBetween)(
        Window.unboundedPreceding, Window.currentRow)

    # an explicit exchange on (keys, chunk): one on the keys alone would also
    # satisfy the window and put a hot key back into a single task
    base = _with_chunk(df, chunk)
    local = base.repartition(*part).withColumns({
        **{f"_s_{n}": F.sum(c).over(frame) for n, c in sums.items()},
        **{f"_l_{n}": F.last(c, ignorenulls=True).over(frame) for n, c in lasts.items()},
        **{f"_f_{n}": F.first(c, ignorenulls=True).over(frame) for n, c in firsts.items()},
        **{f"_c_{n}": F.sum(c).over(frame) for n, (c, _) in since.items()},
    })
    if since:
        local = local.withColumns({
            f"_r_{n}": F.last(F.when(reset, F.col(f"_c_{n}") - c), ignorenulls=True).over(frame)
            for n, (c, reset) in since.items()})

    at = F.struct(*order)

    def when_set(c: Column) -> Column:
        return F.when(c.isNotNull(), at)

    summary = (local if since else base).groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, when_set(c)).alias(f"_l_{n}") for n, c in lasts.items()],
        *[F.min_by(c, when_set(c)).alias(f"_f_{n}") for n, c in firsts.items()],
        *[F.sum(c).alias(f"_c_{n}") for n, (c, _) in since.items()],
        *[F.max(f"_r_{n}").alias(f"_r_{n}") for n in since],
    )
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumns({
        **{f"_bs_{n}": F.sum(f"_s_{n}").over(before) for n in sums},
        **{f"_bl_{n}": F.last(f"_l_{n}", ignorenulls=True).over(before) for n in lasts},
        **{f"_bf_{n}": F.first(f"_f_{n}", ignorenulls=True).over(before) for n in firsts},
        **{f"_bc_{n}": F.sum(f"_c_{n}").over(before) for n in since},
    })
    if since:
        # count so far at the last reset of this or any earlier chunk
        carry = carry.withColumns({
            f"_mark_{n}": F.coalesce(F.col(f"_bc_{n}"), F.lit(0)) + F.col(f"_r_{n}") for n in since
        }).withColumns({f"_br_{n}": F.last(f"_mark_{n}", ignorenulls=True).over(before) for n in since})
    carry = carry.select(*part, *[c for c in carry.columns if c.startswith(("_bs_", "_bl_", "_bf_", "_bc_", "_br_"))])

    def plus_carry(own: str, carried: str) -> Column:
        return F.coalesce(F.col(own) + F.col(carried), F.col(own), F.col(carried))

    def since_reset(n: str) -> Column:
        in_chunk = F.col(f"_c_{n}") - F.col(f"_r_{n}")
        carried = F.coalesce(F.col(f"_bc_{n}"), F.lit(0)) - F.coalesce(F.col(f"_br_{n}"), F.lit(0))
        return F.coalesce(in_chunk, F.col(f"_c_{n}") + carried)

    out = local.join(carry, part, "left")
    return out.select(
        *df.columns,
        *[plus_carry(f"_s_{n}", f"_bs_{n}").alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_bl_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"_bf_{n}", f"_f_{n}").alias(n) for n in firsts],
        *[since_reset(n).alias(n) for n in since],
    )
