"""Best-fit packing by minimum bin slack.

Sequences are planned on the histogram of piece lengths, which has at most ``capacity`` entries whatever the size of the
corpus.  For each bin a bitset dynamic programme over the available lengths finds the fullest reachable total; the bin's
longest remaining piece is always part of it.  The combination is then removed as often as all its lengths last.  The
plan says which ranks of each length go to which sequences; the pieces get their rank within their length on Spark and
are joined to the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import dense_rank_in, saved
from llm.tokens import encoder, from_halves, halved

#: Rows of one length and range of ids that one task numbers, on average.
RANGE_ROWS = 1 << 17


def fullest(counts: list[int], first: int, capacity: int) -> list[int]:
    """Lengths of a fullest bin that holds ``first`` and pieces no longer than it, from counts[length].

    Bit t of ``reach`` says that total t can be made.  Each length comes in binary portions of its count, and the sets
    before each portion allow the way back.
    """
    room = capacity - first
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(first, room), 0, -1):
        left = min(counts[length] - (length == first), room // length)
        portion = 1
        while left > 0:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            left -= take
            portion *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, [first]
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            chosen += [length] * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces of it in a sequence, first offset).

    Rank r of the row with q = r - first rank goes to sequence first sequence + q div pieces, at offset first offset +
    (q mod pieces) * length.  Whole bins of equal make are one row for each of their lengths, so the plan has a few
    thousand rows at most.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            chosen = fullest(counts, longest, capacity)
            need = {x: chosen.count(x) for x in set(chosen)}
            times = min(counts[x] // n for x, n in need.items())
            offset = 0
            for length in sorted(need, reverse=True):
                n = need[length]
                rows.append((length, used[length], n * times, sequence, n, offset))
                used[length] += n * times
                counts[length] -= n * times
                offset += n * length
            sequence += times
    return rows


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids; the first may be shorter when it has to be cut."""
    if ids <= capacity:
        return [(0, ids)] if ids else []
    first = ids % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, ids, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id",
                 text_col: str = "text", ranks: str | None = None, pattern: str | None = None,
                 with_ids: bool = False, in_halves: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit little-endian).

    ``in_halves``: ids are laid out by ``tokens.halved``; ``pack`` undoes it.
    Null texts are empty and consist of the end id alone.  Texts of any length are read whole.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, ranks, pattern)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = tool.packed(text or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + length)]
                    for to, x in zip(out, (doc, n, start, length, zlib.crc32(part), halved(part) if in_halves else part)):
                        to.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
         in_halves: str | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Every row with a length from 1 to ``capacity`` is placed once; offsets within a sequence are gapless from 0.  Other
    lengths are an error.  Rows that repeat are placed as often as they come.  An empty table gives an empty result.
    ``pieces`` is written once to the shared folder.  ``in_halves``: a column of ids laid out by ``tokens.halved``, which the
    result has as they were.
    """
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    kept = saved(pieces, "packing-pieces")
    lengths = {r[0]: r[1] for r in kept.groupBy(length_col).count().collect()}  # at most ``capacity`` numbers
    if wrong := [x for x in lengths if x is None or not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {wrong[:5]}")
    rows = plan(lengths, capacity)
    by_length: dict[int, list] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(rest)
    ranges = max(1, -(-max(lengths.values(), default=0) // RANGE_ROWS))
    chunk = F.pmod(F.xxhash64(*order), F.lit(max(4, ranges))).cast("int")
    ranked = dense_rank_in(kept, [length_col], [F.col(c).asc_nulls_first() for c in order], chunk, "_rank", "packing-ranks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {length: [r[0] for r in found] for length, found in by_length.items()}
        for batch in batches:
            ids, offsets = [], []
            for length, rank in zip(batch[length_col].to_pylist(), batch["_rank"].to_pylist()):
                first, _, sequence, n, offset = by_length[length][bisect_right(firsts[length], rank) - 1]
                ids.append(sequence + (rank - first) // n)
                offsets.append(offset + (rank - first) % n * length)
            own = [pa.array(map(from_halves, batch[c].to_pylist()), pa.binary()) if c == in_halves else batch[c]
                   for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                                             [*[c for c in batch.schema.names if c != "_rank"], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed pieces with their ids put together in order of their offsets."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.concat(F.lit(b""), F.aggregate(
        "_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))).alias("ids"))
