"""Column helpers that keep the missing-value and rounding rules of the formulas.

Missing values are nulls (``null_nan`` turns NaN into null at ingest), so a
``when`` chain falls through on them.  Spark's ``greatest``/``least`` skip
nulls; the helpers below keep a missing input missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)


def null_nan(df: DataFrame) -> DataFrame:
    """NaN -> null on every float and double column."""
    fixes = {
        f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
        for f in df.schema.fields if isinstance(f.dataType, _FLOATS)
    }
    return df.withColumns(fixes) if fixes else df


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip(c: Column, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; a missing value stays missing."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def npmax(c: Column, floor) -> Column:
    """Element-wise maximum with a constant; a missing value stays missing."""
    return clip(c, lo=floor)


def npmin(c: Column, ceiling) -> Column:
    return clip(c, hi=ceiling)


def pymax0(c: Column) -> Column:
    """``max(0, x)`` where a missing x gives 0."""
    return F.greatest(F.lit(0.0), c)


def npround(c: Column, digits: int = 0) -> Column:
    """Round half to even on ``x * 10^digits``."""
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def cut(c: Column, edges, labels) -> Column:
    """Right-closed bins ``(lo, hi]``; out of range or missing -> null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs one more edge than labels")
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = (c > float(lo)) & (c <= float(hi))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def first_match(*rules, otherwise=None) -> Column:
    """``first_match((cond, value), ..., otherwise=x)`` as one when-chain."""
    (cond, value), *rest = rules
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def or_default(c: Column, default) -> Column:
    """``x or default``: 0 becomes the default, a missing value stays missing."""
    return F.when(c == 0, default).otherwise(c)


def map_values(c: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup as a when-chain (no join, no shuffle)."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default) if default is not None else out


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def opt(df: DataFrame, name: str, default=None, fill: bool = False) -> Column:
    """The column, or ``default`` when the frame has no such column.

    With ``fill=True`` nulls of a present column get the default as well.
    """
    if not has(df, name):
        return F.lit(default)
    c = F.col(f"`{name}`")
    return F.coalesce(c, F.lit(default)) if fill else c


def select_cols(df: DataFrame, prefix=None, suffix=None, dtypes=None) -> list[str]:
    """Column names by prefix, suffix or data type, decided at plan time."""
    return [
        f.name for f in df.schema.fields
        if (prefix is None or f.name.startswith(prefix))
        and (suffix is None or f.name.endswith(suffix))
        and (dtypes is None or isinstance(f.dataType, tuple(dtypes)))
    ]


def row_sum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_std(cols) -> Column:
    """Sample standard deviation across columns of one row (plain arithmetic)."""
    cols = list(cols)
    if len(cols) < 2:
        return F.lit(None).cast("double")
    mean = row_sum(cols) / float(len(cols))
    return F.sqrt(row_sum([(c - mean) * (c - mean) for c in cols]) / float(len(cols) - 1))


def number_text(c: Column, fmt: str) -> Column:
    """Numbers as text: ``[₹][,].<d>f[suffix]`` or ``.<d>%``; half-even digits."""
    money, body = fmt.startswith("₹"), fmt.lstrip("₹")
    grouped, body = body.startswith(","), body.lstrip(",")
    digits, rest = int(body[1]), body[2:]
    if rest.startswith("%"):
        text, suffix = F.format_number(c.cast("double") * 100, digits), "%"
    else:
        text, suffix = F.format_number(c.cast("double"), digits), rest[1:]
    if not grouped:
        text = F.replace(text, F.lit(","), F.lit(""))
    parts = ([F.lit("₹")] if money else []) + [text] + ([F.lit(suffix)] if suffix else [])
    return F.concat(*parts) if len(parts) > 1 else text


def safe_divide(a: Column, b: Column, floor=1) -> Column:
    """``a / max(b, floor)``: never divides by zero for floor > 0."""
    return a / npmax(b, floor)
