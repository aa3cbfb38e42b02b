"""Hard negatives from Hilbert-curve-ordered candidate blocks with zone maps.

Candidates are range-partitioned and sorted by their place on a Hilbert curve over the dimensions of greatest variance, and
written as Parquet blocks of neighbouring vectors.  A block's zone map is the smallest and largest component in each
dimension, with the labels it holds.  The inner product of an anchor with any vector of a block lies between two sums that
interval arithmetic takes from the zone map, so a block is read for an anchor only if that interval, the labels, and the
best found so far allow a row of it to be among the answers.

Each search has two steps: the block in which the anchor itself lies gives a first k-th best score; then the zone maps choose
the blocks that may hold something as good.  Anchors travel in chunks of curve neighbours, a pair of chunk and block at a
time, so no task holds more than a few such pairs, and the results are exact whether or not the zone maps exclude anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.plans.topk import top_k
from llm.common import released, saved

#: Vectors of a candidate block, anchors of a chunk, and zone maps that a task compares with a chunk at once.
BLOCK, CHUNK, ZONE = 2048, 1024, 512
#: The curve runs over at most so many dimensions, of at most so many bits together.
CURVE_DIMENSIONS, CURVE_BITS = 8, 56
_INT = np.iinfo(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``cells`` (whole numbers below 2^bits), by Skilling's transpose form."""
    x = cells.T.astype(np.int64)
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations and reflections of the sub-cubes, coarsest first
        low = bit - 1
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[i] >> b & 1)
    return place


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(kind.to_pandas_dtype()), kind))


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """id, label, q (whole numbers, floor(scale * x)) of the rows that take part, and the number of dimensions.

    Left out: null ids, labels and vectors, null or non-finite components, vectors whose length is not the most frequent one
    (of equally frequent ones the longest), and components so large that an inner product could leave 64 bits.
    """
    sound = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                        F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    sound = sound.where("id is not null and label is not null and size(v) > 0").where(finite)
    common = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 1
    limit = min(int((2.0 ** 62 / dims) ** 0.5), (1 << 31) - 1)
    fit = sound.where(F.size("v") == dims).where(F.forall("v", lambda x: F.abs(x * scale) < limit - 1))
    return fit.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q")), dims


def _packed(rows: DataFrame, size: int, dims: int, name: str) -> DataFrame:
    """Consecutive rows of the sorted partitions of ``rows`` (id, label, q, own) as one row for every ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                rest = pa.Table.from_batches(held).combine_chunks()
                yield block(rest.slice(0, size), number)
                number += 1
                held = rest.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held), number)

    def block(part: pa.Table, number: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, labels, own = (part[c].to_numpy() for c in ("id", "label", "own"))
        q = _matrix(part["q"].combine_chunks(), dims).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), _lists([ids], pa.int64()), _lists([labels], pa.int64()), _lists([own], pa.int64()),
             _lists([np.unique(labels)], pa.int64()), _lists([q.min(axis=0)], pa.int32()), _lists([q.max(axis=0)], pa.int32()),
             pa.array([q.tobytes()], pa.binary())], [name, "ids", "labels", "own", "kinds", "low", "high", "q"])

    return rows.select("id", "label", "own", "q").mapInArrow(
        run, f"{name} long, ids array<long>, labels array<long>, own array<long>, kinds array<long>, low array<int>, high array<int>, q binary")


def blocks_of(rows: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """The candidate blocks: ``rows`` (id, label, q) in the order of the curve, written, one row for each block."""
    parts = Summarizer.metrics("min", "max", "variance").summary(array_to_vector(F.col("q").cast("array<double>"))).alias("s")
    found = rows.groupBy(F.lit("all")).agg(parts).select("s").first()  # no row if there is none to summarise
    low, high, spread = (np.array(found["s"][k].toArray() if found else [0.0] * dims) for k in ("min", "max", "variance"))
    axes = np.argsort(-spread, kind="stable")[:CURVE_DIMENSIONS]
    bits = CURVE_BITS // len(axes)
    width = np.maximum(high - low, 1)[axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (_matrix(batch["q"], dims)[:, axes] - low[axes]) / width * ((1 << bits) - 1)
            place = hilbert(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    placed = rows.mapInArrow(run, "id long, label long, q array<int>, place long")
    # equal vectors have one place; the id behind it lets any number of them be divided over ranges
    laid = placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").withColumn("own", F.lit(0).cast("long"))
    return saved(_packed(laid, size, dims, "block"), "negatives-blocks")


def _anchors(blocks: DataFrame, dims: int, anchors: Column) -> DataFrame:
    """Chunks of the anchors, neighbours on the curve; ``own`` is the block in which each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, labels, q in zip(*(batch[c] for c in ("block", "ids", "labels", "q"))):
                ids = ids.values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), block.as_py())), pa.array(ids), labels.values,
                     pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims), pa.array(np.frombuffer(q.as_py(), np.int32)))],
                    ["own", "id", "label", "q"])

    rows = blocks.select("block", "ids", "labels", "q").mapInArrow(run, "own long, id long, label long, q array<int>")
    # each task of this exchange has whole neighbouring blocks, of which a fiftieth or so are anchors
    laid = rows.where(anchors).repartitionByRange("own", "id").sortWithinPartitions("own", "id")
    return saved(_packed(laid, CHUNK, dims, "chunk"), "negatives-anchors")


_WINDOW = "a int, w int, lo long, hi long, t long"
_FIELDS = [("a", pa.int32()), ("w", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("t", pa.int64())]


def _windows(item) -> tuple[np.ndarray, ...]:
    """Columns of one chunk's windows: anchor's place in the chunk, number, least and greatest score, k-th best so far."""
    return tuple(item.values.flatten()[n].to_numpy(zero_copy_only=False) for n in range(len(_FIELDS)))


def _requests(chunks: list[int], blocks: list[int], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
    values = [pa.array(np.concatenate([np.empty(0, np.int64), *[f[n] for f in found]]).astype(kind.to_pandas_dtype()), kind)
              for n, (_, kind) in enumerate(_FIELDS)]
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, [n for n, _ in _FIELDS]))
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blocks, pa.int64()), lists], ["chunk", "block", "windows"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where no sum can leave its whole numbers, else in 64-bit whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _own_requests(state: DataFrame) -> DataFrame:
    """Each window asks for the block of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, windows in zip(batch["chunk"], batch["own"], batch["windows"]):
                wins, own = _windows(windows), own.values.to_numpy()
                for block in np.unique(own[wins[0]]):
                    mine = own[wins[0]] == block
                    yield _requests([chunk.as_py()], [int(block)], [tuple(w[mine] for w in wins)])

    return state.select("chunk", "own", "windows").mapInArrow(run, f"chunk long, block long, windows array<struct<{_WINDOW}>>")


def _chosen_requests(state: DataFrame, zones: DataFrame, dims: int, same: bool) -> DataFrame:
    """Each window asks for the blocks, other than its anchor's, whose zone map allows one of its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c] for c in ("chunk", "labels", "own", "q", "windows", "zones"))
            for chunk, labels, own, q, windows, zone in zip(*columns):
                wins, labels, own = _windows(windows), labels.values.to_numpy(), own.values.to_numpy()
                a = np.frombuffer(q.as_py(), np.int32).reshape(-1, dims)
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                number, kinds, low, high = (zone.values.flatten()[n] for n in range(4))
                low, high = _matrix(low, dims), _matrix(high, dims)
                most = _product(up, high) + _product(down, low)
                least = _product(up, low) + _product(down, high)
                at, _, lo, hi, t = wins
                for n, block in enumerate(number.to_pylist()):
                    held = kinds[n].values.to_numpy()
                    if same:
                        right = np.isin(labels, held)[at]
                    else:
                        right = np.ones(len(at), bool) if len(held) > 1 else labels[at] != held[0]
                    want = right & (most[at, n] >= np.maximum(lo, t)) & (least[at, n] <= hi) & (own[at] != block)
                    if want.any():
                        yield _requests([chunk.as_py()], [block], [tuple(w[want] for w in wins)])

    count = zones.agg(F.max("zone")).first()[0]
    each = state.select("chunk", "labels", "own", "q", "windows", F.explode(F.sequence(F.lit(0), F.lit(count or 0))).alias("zone"))
    return each.join(zones, "zone").select("chunk", "labels", "own", "q", "windows", "zones").mapInArrow(
        run, f"chunk long, block long, windows array<struct<{_WINDOW}>>")


def _answered(requests: DataFrame, chunks: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(chunk, a, w, id, score): for each asked window and block the k best rows of the block, if they reach what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c] for c in ("chunk", "windows", "ids", "labels", "q", "b_ids", "b_labels", "b_q"))
            for chunk, windows, ids, labels, q, b_ids, b_labels, b_q in zip(*columns):
                at, number, lo, hi, t = _windows(windows)
                ids, labels, b_ids, b_labels = (x.values.to_numpy() for x in (ids, labels, b_ids, b_labels))
                asked, place = np.unique(at, return_inverse=True)
                scores = _product(np.frombuffer(q.as_py(), np.int32).reshape(-1, dims)[asked], np.frombuffer(b_q.as_py(), np.int32).reshape(-1, dims))
                out = [[] for _ in range(4)]
                for i in range(len(at)):
                    row, anchor = scores[place[i]], at[i]
                    fits = (row >= max(lo[i], t[i])) & (row <= hi[i]) & (b_ids != ids[anchor])
                    fits &= (b_labels == labels[anchor]) if same else (b_labels != labels[anchor])
                    best = np.flatnonzero(fits)
                    if len(best) > k:
                        best = best[row[best] >= np.partition(row[best], len(best) - k)[len(best) - k]]
                    best = best[np.lexsort((b_ids[best], -row[best]))][:k]
                    for to, x in zip(out, (np.full(len(best), anchor), np.full(len(best), number[i]), b_ids[best], row[best])):
                        to.append(x)
                a, w, found, score = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), chunk.as_py(), np.int64)), pa.array(a.astype(np.int32)),
                                                  pa.array(w.astype(np.int32)), pa.array(found), pa.array(score)], ["chunk", "a", "w", "id", "score"])

    anchors = chunks.select("chunk", "ids", "labels", "q")
    held = blocks.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("q").alias("b_q"))
    pairs = requests.join(anchors, "chunk").join(held, "block")
    return pairs.select("chunk", "windows", "ids", "labels", "q", "b_ids", "b_labels", "b_q").mapInArrow(
        run, "chunk long, a int, w int, id long, score long")


def search(windows: DataFrame, chunks: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(chunk, a, w, rank, id, score): of each window (chunk, a, w, lo, hi) the k highest-scoring rows of the anchor's label
    (``same``) or of another one, score from lo to hi, ties by smaller id; rows that carry the anchor's id are the anchor."""
    part = ["chunk", "a", "w"]
    zone = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // ZONE)))).cast("int")
    zones = saved(blocks.groupBy(zone.alias("zone")).agg(
        F.collect_list(F.struct("block", "kinds", "low", "high")).alias("zones")), "negatives-zones")

    def with_state(table: DataFrame) -> DataFrame:
        packed = table.groupBy("chunk").agg(F.collect_list(F.struct("a", "w", "lo", "hi", "t")).alias("windows"))
        return chunks.join(packed, "chunk")

    start = with_state(windows.withColumn("t", F.lit(int(_INT.min))))
    order = [F.desc("score"), F.asc("id")]
    first = saved(_answered(_own_requests(start), chunks, blocks, dims, same, k), "negatives-first")
    reached = first.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    state = windows.join(reached, part, "left").withColumn("t", F.coalesce("least", F.lit(int(_INT.min))))
    asked = saved(_chosen_requests(with_state(state.select(*part, "lo", "hi", "t")), zones, dims, same), "negatives-asked")
    more = _answered(asked, chunks, blocks, dims, same, k)
    # a task's answers are cut before the exchange; those of one window number k for each block that it had to read
    out = saved(top_k(first.unionByName(more), k, order, part), "negatives-found")
    released(zones, first, asked)
    return out


def mined(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
          positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the whole number ``id``.  A score is the whole-number inner product of floor(scale * x);
    higher ones come first, ties by smaller id.  An anchor's positives are its ``positives`` first other rows of the same
    label; for each the ``negatives`` first rows of another label with ``lowest * positive_score <= 100 * score <= highest *
    positive_score`` are returned, all if there are fewer.  Labels and ids are whole numbers.  ``quantised`` says which rows
    take no part.  Rows that repeat an id are candidates each, and anchors each; none is a positive or negative of a row with
    its own id.  An empty table, or no anchor, gives an empty result; other columns do not matter.
    """
    sound, dims = quantised(rows, id_col, label_col, vector_col, scale)
    sound = saved(sound, "negatives-rows")
    blocks = blocks_of(sound, dims)
    chunks = _anchors(blocks, dims, anchors)
    whole = [F.lit(int(x)).cast("long") for x in (_INT.min, _INT.max)]
    everything = chunks.select("chunk", F.posexplode("ids").alias("a", "anchor_id"))
    near = search(everything.select("chunk", "a", F.lit(0).alias("w"), whole[0].alias("lo"), whole[1].alias("hi")), chunks, blocks, dims, True, positives)
    near = near.select("chunk", "a", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score").cast("decimal(24,0)")
    spans = near.select("chunk", "a", "w", F.ceil(p * lowest / 100).cast("long").alias("lo"), F.floor(p * highest / 100).cast("long").alias("hi"))
    hard = search(spans.where("lo <= hi"), chunks, blocks, dims, False, negatives)
    out = hard.select("chunk", "a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = out.join(near, ["chunk", "a", "w"]).join(everything, ["chunk", "a"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
