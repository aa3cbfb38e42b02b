"""The online store kept up to date: change batches are appended, merged when read, and compacted now and then.

Every batch is one commit of ``sources.versions``, so a repeated batch changes nothing and a killed one is not seen.
Compaction keeps every row behind the horizon (the newest time less ``history``) and, per entity, the newest row up to it;
features past their time to live at the horizon are blanked, since no later reading may show them.  A reading at any time
from the horizon on equals ``history.online_latest`` over all rows ever published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.operators.history import online_latest
from forewarn.sources import versions

col = F.col
#: Batches that are merged when read before they are compacted into one.
COMPACT_EVERY = 16


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def publish(rows: DataFrame, source: int, root: str, entity: str, ts: str, features: list[str], ttl_hours: float, tiebreak: str,
            history: float = 30 * 86_400, every: int = COMPACT_EVERY) -> None:
    """Adds a batch of view rows, in any order of time.  Rows without a time are left out, as in a reading.

    ``history``: seconds before the newest time for which readings stay possible.
    """
    spark = rows.sparkSession
    if versions.is_committed(spark, root, source):
        return
    last = versions.newest(spark, root)
    version = last.version + 1 if last else 0
    since, horizon = (last.since["rows"], last.mark) if last else (0, None)
    own = list(dict.fromkeys([entity, ts, tiebreak, *features]))
    new = versions.stage(rows.where(col(ts).isNotNull()).select(*own), root, "rows", version)
    if version - since >= every:
        live = versions.read(spark, root, "rows").select(*own).unionByName(new)
        top = live.agg(F.max(_micros(ts))).first()[0]
        if top is not None:
            bound = top - int(history * 1e6)
            horizon = bound if horizon is None else max(horizon, bound)
            # into a folder of its own first: what is read must not be overwritten
            kept = versions.stage(_compacted(live, entity, ts, features, ttl_hours, tiebreak, horizon), root, "compacted", version)
            versions.stage(kept, root, "rows", version)
            since = version
    versions.commit(spark, root, version, {"rows": since}, source, horizon)


def _compacted(rows: DataFrame, entity: str, ts: str, features: list[str], ttl_hours: float, tiebreak: str, horizon: int) -> DataFrame:
    own = rows.columns
    up_to = _micros(ts) <= horizon
    newest = rows.where(up_to).groupBy(entity).agg(
        F.max_by(F.struct(*[c for c in own if c != entity]), F.struct(ts, tiebreak)).alias("v")).select(entity, "v.*")
    alive = _micros(ts) > horizon - int(ttl_hours * 3_600_000_000)
    blank = {c: F.when(alive, col(c)) for c in features if c not in (entity, ts, tiebreak)}
    return newest.withColumns(blank).select(*own).unionByName(rows.where(~up_to))


def latest(spark: SparkSession, root: str, entity: str, ts: str, features: list[str], ttl_hours: float, as_of: Column,
           tiebreak: str) -> DataFrame:
    """``history.online_latest`` at ``as_of`` from the published batches; an error before the horizon of the compaction."""
    rows = versions.read(spark, root, "rows")
    if rows is None:
        raise ValueError(f"nothing is published in {root}")
    horizon = versions.newest(spark, root).mark
    if horizon is not None and spark.range(1).select(_micros(as_of)).first()[0] < horizon:
        raise ValueError("as_of lies before the horizon that compaction keeps")
    return online_latest(rows, entity, ts, features, ttl_hours, as_of, tiebreak)
