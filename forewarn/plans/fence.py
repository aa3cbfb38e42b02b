"""A place in the plan that filters do not move below."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, name: str) -> DataFrame:
    """Marks the end of a long chain of computed columns.

    The optimizer moves a filter on a computed column below the projection by
    copying the column's expression into the filter, once per mention.  Through
    several layers of formulas the copy grows past what can be compiled.  Filters
    stay above an observed row count; columns are still pruned through it, and the
    count is there for a query listener.
    """
    return df.observe(f"{name}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))
