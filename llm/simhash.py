"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant: one that is reached from either by flipping
at most half of the differing bits.  So every distinct fingerprint emits all variants within half the radius (65 for a
radius of 2), the variants are shuffled, and fingerprints that collide in a variant are linked.  All that collide are
within the radius of one another, so each is paired with the smallest of them only: that keeps every component, and a
variant of any number of fingerprints (65 at most for a radius of 2) makes one pair for each.  Pairs are deduplicated and
their bits counted.  Equal fingerprints form one class beforehand, however many texts share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from llm.common import released, saved
from llm.components import components

BITS = 64
#: A ball of radius 2 has 2,081 variants; wider ones are refused.
WIDEST = 4
#: Bytes of a text that are cut into words at a time: bounds a worker's memory whatever the length of a text.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in blocks that end between words; bytes.split knows just the white space meant here."""
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        to = gap.start() if gap else len(data)
        yield data[at:to].lower().split()
        at = to


def fingerprint(data: bytes, width: int, seed: int) -> int:
    """Of one text, as an unsigned number; bits are set where more than half of the shingles' hashes have them, repeats counted."""
    ones, n, carried = np.zeros(BITS, np.int64), 0, []
    for words in _word_blocks(data):
        words = carried + words
        hashes = np.array([xxh64_intdigest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))], np.uint64)
        for block in np.array_split(hashes, len(hashes) // 4096 + 1):
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carried = words[max(0, len(words) - width + 1):]
    if not n:  # fewer words than a shingle: the whole sequence, if there is a word
        return xxh64_intdigest(b" ".join(carried), seed) if carried else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id, fingerprint (the 64 bits as a long) of every row's whole text; null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found)], ["id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def _masks(flips: int) -> list[int]:
    """All numbers of 64 bits with at most ``flips`` ones, as signed longs, fewest ones first."""
    found = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def near_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """a < b: verified pairs of the distinct longs in ``prints.fingerprint`` that connect all within ``radius`` bits.

    Every pair differs in at most ``radius`` bits, and two fingerprints within the radius are in one component of the
    pairs.  Of an odd radius one side of a pair flips a bit more than the other, and the smallest of those that flip fewer
    is what a variant's fingerprints are paired with.
    """
    if not 0 <= radius <= WIDEST:
        raise ValueError(f"radius {radius} is not from 0 to {WIDEST}")
    inner, outer = _masks(radius // 2), _masks(radius - radius // 2)
    fp = F.col("fingerprint")
    balls = prints.select(fp, F.posexplode(F.array(*map(F.lit, outer))).alias("at", "mask")).select(
        fp, fp.bitwiseXOR(F.col("mask")).alias("variant"), (F.col("at") < len(inner)).alias("inner"))
    least = F.min(F.when(F.col("inner"), fp)).over(Window.partitionBy("variant"))
    met = balls.withColumn("least", least).where(fp != F.col("least"))
    pairs = met.select(F.least(fp, "least").alias("a"), F.greatest(fp, "least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2,
           seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 lowercase hex digits), component_id.

    Texts link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest id reachable over
    links, the row's own included.  Null, empty and blank texts have fingerprint zero and link like any other.  Rows that
    repeat an id or a text each get a row.  Null ids take part in linking but name no component; a component of null ids
    alone has component_id null.  Ids may be of any type with an order.  An empty table gives an empty result; other
    columns do not matter.
    """
    prints = saved(fingerprints(docs, id_col, text_col, width, seed), "simhash-prints")
    classes = saved(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "simhash-classes")
    links = saved(near_pairs(classes, radius), "simhash-links")
    found = components(links, "simhash-components").withColumnRenamed("id", "fingerprint")
    placed = saved(classes.join(found, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")), "simhash-placed")
    released(links, classes)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(placed.select("fingerprint", "component").join(smallest, "component").drop("component"), "simhash-named")
    released(placed)
    return prints.join(named, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
