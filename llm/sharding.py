"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

1. Rows fall into source blocks by a hash of their content; one small aggregate gives the block sizes.
2. How many rows of each block go to each shard is drawn exactly: row by row a multivariate hypergeometric draw from what
   the shards still have free.  This matrix of blocks x shards counts is all the driver holds.
3. Each block is permuted by a keyed hash and cut at its row of the matrix; rows travel to their shards.
4. Each shard is permuted again by a second keyed hash.  Hash ranges split the shard over many tasks; counts of the
   earlier ranges make the slots gapless.

Every assignment of rows to slots is as likely as any other, as far as the keyed hash is random, and the same key gives
the same result.  Native: only DataFrame functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import saved

#: Rows of a source block and of a slot range, on average; both are small enough for one task.
BLOCK_ROWS = 1 << 18
#: Blocks at least, so that small tables take the same way as large ones.
LEAST_BLOCKS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn from good + bad are good, by inversion; populations of any size, n as small as a block.

    The probabilities of all outcomes within 12 standard deviations come from the ratio of neighbouring ones; what lies
    outside has a probability below 10^-30.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    share = good / (good + bad)
    mean, wide = n * share, 12 * (n * share * (1 - share)) ** 0.5 + 12
    first, last = max(lo, int(mean - wide)), min(hi, int(mean + wide) + 1)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Exact counts, blocks x shards: row sums are the block sizes, column sums the shard sizes."""
    free, rng = np.asarray(shard_sizes, dtype=np.int64), np.random.default_rng(seed)
    out = np.zeros((len(block_sizes), len(shard_sizes)), dtype=np.int64)
    for b, n in enumerate(block_sizes):
        # one conditional hypergeometric draw after the other
        left, rest = int(n), int(free.sum())
        for s, room in enumerate(free):
            rest -= int(room)
            take = left if rest == 0 else hypergeometric(rng, int(room), rest, left)
            out[b, s] = take
            left -= take
        free = free - out[b]
    return out


def equal_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, id_col: str, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (0, 1, 2 ... within the shard).

    All columns and all rows stay, null and repeated ids too: rows of one id are told apart by their other columns; rows
    equal in everything lie in one block and are interchangeable.  With fewer rows than shards some shards stay empty; an
    empty table gives an empty result.  ``df`` must give the same rows whenever it is read: it is read once for the sizes
    of the blocks and once, as hashes, for the sizes of the slot ranges; whole rows cross two exchanges, to their block and
    to their shard.
    """
    if clash := {"shard", "slot"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    own = F.col(f"`{id_col}`")
    content = [own, *[F.col(f"`{f.name}`") for f in df.schema.fields if f.name != id_col and "map" not in f.dataType.simpleString()]]
    rows = df.count()
    blocks = max(LEAST_BLOCKS, -(-rows // block_rows))
    ranges = max(4, -(-rows // (shards * block_rows)))
    marked = df.withColumns({
        "_block": F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(blocks)).cast("int"),
        "_first": F.xxhash64(F.lit(seed + 1), *content), "_again": F.xxhash64(F.lit(seed + 2), *content)})
    sizes = [0] * blocks
    for r in marked.groupBy("_block").count().collect():  # a number for each block
        sizes[r["_block"]] = r["count"]
    ends = communication_matrix(sizes, equal_sizes(rows, shards), seed).cumsum(axis=1)
    cuts = df.sparkSession.createDataFrame([(b, [int(x) for x in e]) for b, e in enumerate(ends)], "_block int, _ends array<bigint>")
    # the upper bits of the last hash: ranges of about equal size, in order
    chunk = F.floor((F.col("_again").cast("double") / 2.0**64 + 0.5) * ranges).cast("int")

    def sent(rows: DataFrame) -> DataFrame:
        """Each block permuted and cut at its row of the matrix."""
        block = Window.partitionBy("_block").orderBy("_first", "_again", own.asc_nulls_first())
        local = rows.withColumn("_nth", F.row_number().over(block) - 1).join(cuts, "_block")
        shard = F.size(F.filter("_ends", lambda end: end <= F.col("_nth"))).cast("int")
        return local.withColumns({"shard": shard, "_chunk": chunk}).drop("_ends", "_nth", "_block", "_first")

    counts = sent(marked.select(own, "_block", "_first", "_again")).groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "shards-ranges")
    inner = Window.partitionBy("shard", "_chunk").orderBy("_again", own.asc_nulls_first())
    numbered = sent(marked).withColumn("_at", F.row_number().over(inner) - 1)
    return (numbered.join(offsets, ["shard", "_chunk"])
            .withColumn("slot", (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_chunk", "_again")
            .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot"))
