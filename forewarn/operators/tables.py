"""Table-level helpers: alignment, defaults, deduplication, encoding, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import has
from forewarn.plans.scan import running
from forewarn.plans.topk import leading_chunks, top_k

col = F.col
HASH_SPACE = 1 << 30
HASH_CHUNKS = 4096
#: Values sampled for the borders of ``label_codes``.
LABEL_SAMPLE = 1024


def drop_present(df: DataFrame, names) -> DataFrame:
    return df.drop(*[n for n in names if has(df, n)])


def align(df: DataFrame, features: list[str], fill=0.0, keep=()) -> DataFrame:
    """Exactly the model's features in its order; absent columns become ``fill``."""
    return df.select(*keep, *[col(f"`{f}`") if has(df, f) else F.lit(fill).alias(f) for f in features])


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [f for f in features if not has(df, f)]


def probability_or_fallback(df: DataFrame, features: list[str], score, out: str = "ensemble_probability") -> DataFrame:
    """``score(df)`` when the frame has every model feature, else the constant 0.5."""
    if missing_features(df, features):
        return df.withColumn(out, F.lit(rules.FALLBACK_PROBABILITY))
    return score(df)


def apply_defaults(df: DataFrame, key: str = "LoanID") -> DataFrame:
    """Request rows with typed columns, defaults for absent or missing fields."""
    out = [col(key).cast("string").alias(key)]
    for name, (kind, default) in rules.REQUEST_DEFAULTS.items():
        value = F.lit(default).cast(kind)
        out.append((F.coalesce(col(name).cast(kind), value) if has(df, name) else value).alias(name))
    return df.select(*out)


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key.

    The rank filter also runs before the shuffle, so each task sends at most one
    row per key, however often a key repeats.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where(col("_rn") == 1).drop("_rn")


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """Distinct values with their position in sorted order.

    A bounded sample of the values gives the boundaries of the ranges that are numbered apart, so values with a common
    beginning spread over all of them.
    """
    distinct = df.select(name).where(col(name).isNotNull()).distinct()
    sample = sorted(r[0] for r in distinct.orderBy(F.xxhash64(name), name).limit(LABEL_SAMPLE).collect())
    borders = sample[LABEL_SAMPLE // 64::LABEL_SAMPLE // 64]
    chunk = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= col(name))) if borders else F.lit(0)
    ranked = running(distinct, [], [name], chunk, sums={"_n": F.lit(1)})
    return ranked.select(name, (col("_n") - 1).cast("int").alias(f"{name}_code"))


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """Adds ``<name>_code``: sorted position, -1 for missing.  No side is hinted."""
    return df.join(label_codes(df, name), name, "left").withColumn(
        f"{name}_code", F.coalesce(f"{name}_code", F.lit(-1)))


def stable_hash(key: Column) -> Column:
    """Uniform repeatable 0 .. 2^30-1."""
    return F.pmod(F.xxhash64(key), F.lit(HASH_SPACE))


def random_subsample(df: DataFrame, n: int, key: str, order: Column | None = None, space: int = HASH_SPACE) -> DataFrame:
    """n rows in hash order of the key, the same rows on every run.

    ``order`` replaces the hash; its values lie in ``0 .. space - 1``.
    """
    hashed = df.withColumn("_h", stable_hash(col(key)) if order is None else order)
    first = leading_chunks(hashed, n, F.floor(col("_h") * HASH_CHUNKS / space))
    return top_k(first, n, [F.asc("_h"), F.asc(key)], salt_key=key, rank="_rank").drop("_rank", "_h")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, order: Column | None = None,
                     space: int = HASH_SPACE) -> DataFrame:
    """Adds ``is_train``: exactly ``floor(share * n)`` rows per class, chosen in hash order.

    Only (label, hash, key) is shuffled, to find each class's last training row
    with a chunked running count; the wide rows are then compared with that one
    row per class where they are.
    """
    h = (stable_hash(col(key)) if order is None else order).cast("long")
    narrow = df.select(col(label).alias("_label"), h.alias("_h"), col(key).alias("_k"))
    ranked = running(narrow, ["_label"], ["_h", "_k"], F.floor(col("_h") * HASH_CHUNKS / space), sums={"_rank": F.lit(1)})
    sizes = narrow.groupBy("_label").agg(F.floor(F.count(F.lit(1)) * share).alias("_cut"))
    last = (ranked.join(F.broadcast(sizes), "_label").where(col("_rank") == col("_cut"))
            .select("_label", F.struct("_h", "_k").alias("_last")))
    # one row per class
    out = df.join(F.broadcast(last), df[label] == last["_label"], "left")
    is_train = F.coalesce(F.struct(h.alias("_h"), col(key).alias("_k")) <= col("_last"), F.lit(False))
    return out.withColumn("is_train", is_train.cast("int")).drop("_label", "_last")


def first_rows(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    return df.orderBy(key).limit(n)
