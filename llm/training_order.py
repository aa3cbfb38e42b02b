"""Token ids in training order, as binary shards of fixed-stride records.

Every sequence gets a dense index and, by a keyed Feistel permutation with cycle-walking, a global slot.  Slots are cut
into shards of equal numbers of records; the table is range-partitioned by shard and sorted by slot, and each task writes
its shards front to back.  A record is ``stride`` unsigned 32-bit little-endian ids, filled up with a padding id, so slot s
lies at byte (s mod records) * stride * 4 of shard s div records: reading is sequential and resumes at any slot.

A shard is written under another name and then moved, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import saved
from llm.feistel import permuted
from llm.packing import cut
from llm.tokens import encoder

#: Ranges of hashes that are numbered apart.
RANGES = 4096


def token_sequences(df: DataFrame, keys: list[str], text_col: str, stride: int, end_id: int, vocabulary: str,
                    ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """keys, piece, length, ids (binary): the token ids of each row's whole text and an end id, in pieces of ``stride`` at most."""
    names = [*keys, "piece", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(vocabulary, ranks, pattern), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, out = [], [[], [], []]
            for i, text in enumerate(batch["_text"].to_pylist()):
                ids = tool.packed(text or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, stride)):
                    rows.append(i)
                    for to, x in zip(out, (n, length, ids[4 * start: 4 * (start + length)])):
                        to.append(x)
            own = [batch[k].take(pa.array(rows, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.binary()))]], names)

    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, piece int, length long, ids binary")


def ordered(sequences: DataFrame, keys: list[str], key: str) -> DataFrame:
    """``sequences`` with ``slot``: a keyed permutation of 0 to N - 1.  Rows equal in ``keys`` are numbered in any order.

    Each row moves to its range of hashes and is numbered there; that is written, once, and the ranges' offsets are added
    as it is read.
    """
    inner = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    ranged = sequences.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(RANGES)).cast("int"))
    kept = saved(ranged.repartition("_range").withColumn("_at", F.row_number().over(inner) - 1), "order-sequences")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "order-ranges")  # at most ``RANGES`` rows
    n = counts.agg(F.sum("_n")).first()[0] or 0
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    index = (F.col("_at") + F.col("_before")).cast("long")
    return kept.join(F.broadcast(offsets), "_range").withColumn("slot", permuted(index, n, key, "slot")).drop("_range", "_at", "_before")


def write_shards(sequences: DataFrame, path: str, stride: int, records: int, padding: int = 0) -> DataFrame:
    """Writes the shards when it is evaluated.  One row per sequence: all columns but ids, with shard, position (of its first
    byte) and ids_crc32 (of its ids as written, without padding).

    ``path``: a folder that all executors reach, with or without a scheme; pyarrow's file systems open it.
    """
    kept = [f for f in sequences.schema.fields if f.name != "ids"]
    width = stride * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        place.create_dir(root, recursive=True)
        stream, current, hidden = None, None, None
        fill = int(padding).to_bytes(4, "little")

        def finish():
            if stream is not None:
                stream.close()
                place.move(hidden, f"{root}/shard-{current:08d}.bin")

        for batch in batches:
            crcs = []
            for shard, slot, ids in zip(batch["shard"].to_pylist(), batch["slot"].to_pylist(), batch["ids"].to_pylist()):
                if shard != current:
                    finish()
                    current, hidden = shard, f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
                    stream = place.open_output_stream(hidden, buffer_size=1 << 20)
                stream.write(ids + fill * ((width - len(ids)) // 4))
                crcs.append(zlib.crc32(ids))
            own = [batch[f.name] for f in kept]
            at = pa.array((batch["slot"].to_numpy() % records) * width)
            yield pa.RecordBatch.from_arrays([*own, batch["shard"], at, pa.array(crcs, pa.int64())],
                                             [*[f.name for f in kept], "shard", "position", "ids_crc32"])
        finish()

    placed = sequences.withColumn("shard", F.call_function("div", F.col("slot"), F.lit(records)))
    laid = placed.repartitionByRange(F.col("shard")).sortWithinPartitions("slot")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return laid.mapInArrow(run, f"{schema}, shard long, position long, ids_crc32 long")


def read_slots(path: str, stride: int, records: int, first: int, many: int) -> Iterator[np.ndarray]:
    """The records of slots first, first + 1, ... (``many`` at most), read in order from the shards."""
    place, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    width, slot = stride * 4, first
    while slot < first + many:
        name = f"{root}/shard-{slot // records:08d}.bin"
        if place.get_file_info(name).type != fs.FileType.File:
            return
        with place.open_input_file(name) as file:
            file.seek(slot % records * width)
            while slot < first + many and (data := file.read(width)):
                yield np.frombuffer(data, "<u4")
                slot += 1
                if slot % records == 0:
                    break
            else:
                return
