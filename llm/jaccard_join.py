"""Grouped prefix join for the Jaccard similarity of word-shingle sets.

1.  Texts with the same set form a class; only classes are compared.
2.  A set of n shingles with a partner of at least the threshold shares at least ``need(n)`` shingles with it.  The
    ``span(n)`` lowest hashes of two partners have at least ``lead`` of them in common, so a class of whose span too few
    occur in any other span has no partner and leaves.
3.  What remains of a span, rarest first, is cut to the prefix that must meet the prefix of every partner.  Classes with
    identical prefix and size collapse into one group.
4.  Groups that meet in a prefix shingle are compared with that shingle's hub, the group with the fewest lone shingles
    first and another one in each further round, as long as rounds add links, and the members of a group with its first one.  Pairs that a 512-bit parity sketch proves too different are left
    out; the others are expanded to members and verified on the whole sets.
5.  What the links so far do not connect is compared in full: members that meet in a prefix shingle and lie in different
    components, again with the sketches first.  Pairs within a component cannot change a component.

Steps 2, 3 and 5 lose no link between different components, so the components are exact.  Hot shingles, groups and classes
are joined by sort-merge joins that Spark splits, and aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import shingles
from llm.common import released, saved
from llm.components import components

SKETCH = [f"s{i}" for i in range(8)]
#: Ids whose texts are fetched for verification are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Rounds of comparisons with one hub for each shingle, while any of them adds links; what they leave apart is compared in full.
STAR_ROUNDS = 5


class Bounds:
    """Integer bounds for ``den * intersection >= num * union``, on numbers and on columns."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold lies between 0 and 1")
        self.num, self.den = num, den

    def need(self, n):
        """Shingles that a set of n shares with any partner, at least."""
        return self._div(self.num * n + self.den - 1)

    def _div(self, x):
        return F.floor(x / self.den).cast("long") if isinstance(x, Column) else x // self.den

    def lead(self, n):
        half = (n - self.need(n)) / 2
        return F.floor(half).cast("long") + 1 if isinstance(n, Column) else int(half) + 1

    def span(self, n):
        return n - self.need(n) + self.lead(n)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def sketches_fit(self, na: Column, a: list[Column], nb: Column, b: list[Column]) -> Column:
        apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
        return apart * (self.num + self.den) <= (na + nb) * (self.den - self.num)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bounds: Bounds) -> DataFrame:
    """id, n, f1, f2 (fingerprint of the set), s0 to s7 (parity sketch), span (lowest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketch, spans = [], [], [], []
            for found in shingles.text_sets(batch["text"], width):
                n = len(found)
                sizes.append(n)
                scrambled = shingles.mixed(found)
                prints.append((int(scrambled.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(scrambled, initial=0).view(np.int64))))
                sketch.append(shingles.parity(found))
                spans.append(found[: bounds.span(n)].view(np.int64) if n else np.empty(0, np.int64))
            columns = np.stack(sketch) if sketch else np.empty((0, 8), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*spans, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), *[pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)],
                 *[pa.array(columns[:, i]) for i in range(8)], lists], ["id", "n", "f1", "f2", *SKETCH, "span"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in SKETCH) + ", span array<long>")


def _verified(docs: DataFrame, id_col: str, text_col: str, width: int, bounds: Bounds, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: ids of classes; b is the one that many share) that link, on the whole sets."""
    pairs = saved(pairs, "jaccard-pairs")
    held = saved(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "jaccard-ids")
    ids = F.broadcast(held) if held.count() <= BROADCAST_IDS else held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingles.text_sets(batch["text"], width)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "found"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = texts.join(ids, "id").mapInArrow(run, "id long, found binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and bounds.den * both >= bounds.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the narrow side meets the shared ids first; then a travels once with b's set
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").select("a", "b", "x", "y")
    out = saved(both.mapInArrow(check, "a long, b long"), "jaccard-verified")
    released(pairs, held)
    return out


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90,
           den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Two texts link when ``den * |intersection| >= num * |union|`` of their sets of ``width``-word shingles; a text of fewer
    words has its whole word sequence as its only shingle, a blank or null one has none and links with nothing.
    component_id is the smallest id reachable over links, the row's own included.  Rows that repeat an id count as one
    document with that id; ids that are null take part, but name no component while another id does.
    """
    bounds = Bounds(num, den)
    signs = saved(signatures(docs, id_col, text_col, width, bounds), "jaccard-signatures")
    same = ["f1", "f2", "n"]
    full = signs.where("n > 0 and id is not null")
    classes = saved(full.groupBy(*same).agg(F.min_by(F.struct(*SKETCH, "span"), "id").alias("v"), F.min("id").alias("id"))
                    .select("id", *same, "v.*"), "jaccard-classes")

    # 2: shingles of the spans that occur in more than one
    posts = classes.select("id", F.explode("span").alias("h"))
    often = posts.groupBy("h").count().where("count > 1")
    shared = posts.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("shared"))
    least = bounds.lead(bounds.need(F.col("n")))  # with the smallest partner that the size allows
    cut = F.slice("shared", F.lit(1), (F.size("shared") - least + 1).cast("int"))
    candidates = classes.select("id", "n", *SKETCH).join(shared, "id").where(F.size("shared") >= least).select(
        "id", "n", *SKETCH, F.size("shared").alias("many"), F.transform(cut, lambda p: p["h"]).alias("prefix"))
    # 3: the key of a group is the digest of its prefix and size
    key = F.md5(F.concat_ws(",", F.col("n").cast("string"), F.transform("prefix", lambda h: h.cast("string"))))
    members = saved(candidates.withColumn("g", key), "jaccard-members")
    groups = saved(members.groupBy("g").agg(
        F.min_by(F.struct("n", "many", "prefix", *SKETCH), "id").alias("v"), F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
        .select("g", "first", "size", "v.*"), "jaccard-groups")

    # 4: stars; hubs are first the groups with the fewest lone shingles, then others for what is still apart
    c = F.col
    args = docs, id_col, text_col, width, bounds
    sketch = [c(s) for s in SKETCH]
    marks = groups.select("g", "first", "n", "size", (bounds.span(c("n")) - c("many")).alias("lone"), *SKETCH, F.explode("prefix").alias("h"))
    first = groups.where("size > 1").select("g", c("first").alias("b"), *[c(s).alias(f"b{s}") for s in SKETCH])
    pairs = members.join(first, "g").where((c("id") != c("b")) & bounds.sketches_fit(
        c("n"), sketch, c("n"), [c(f"b{s}") for s in SKETCH])).select(c("id").alias("a"), "b")
    links, found, left, spread, placed = None, None, marks.withColumn("own", c("first")), None, None
    for turn in range(STAR_ROUNDS):
        rank = c("lone") if turn == 0 else F.xxhash64(F.lit(turn), "h", "first")
        hubs = left.groupBy("h").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct(
            rank.alias("rank"), c("first").alias("b"), c("n").alias("nb"), c("own").alias("of"), *SKETCH)).alias("hub")).where("groups > 1")
        fits = bounds.sizes_fit(c("n"), c("hub.nb")) & bounds.sketches_fit(c("n"), sketch, c("hub.nb"), [c(f"hub.{s}") for s in SKETCH])
        stars = left.select("h", "first", "n", "own", *SKETCH).join(hubs, "h").where((c("own") != c("hub.of")) & fits).select(
            c("first").alias("a"), c("hub.b").alias("b"))
        more = _verified(*args, (stars if links is not None else stars.union(pairs)).distinct())
        if links is not None and more.isEmpty():
            break
        old = [x for x in (links, found, placed, spread) if x is not None]
        links = saved(more if links is None else links.union(more), "jaccard-links")
        found = components(links)
        released(more, *old)
        placed = saved(members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-placed")
        spread = saved(placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                               F.min_by("component", "id").alias("own")), "jaccard-spread")
        open_marks = marks.join(spread, "g")
        mixed = open_marks.groupBy("h").agg(F.min("low").alias("_l"), F.max("high").alias("_h")).where("_l <> _h").select("h")
        old, left = left, saved(open_marks.join(mixed, "h"), "jaccard-open")
        if turn:
            released(old)
        if left.isEmpty():
            break

    # 5: what is left between components, member by member; sketches are compared inside the join, and of all shingles that
    # two prefixes share only the smallest makes the pair
    side = left.select("g", "h").join(placed.select("g", "id", "n", "component", "prefix", *SKETCH), "g")
    x, y = side.alias("x"), side.alias("y")
    rest = x.join(y, (c("x.h") == c("y.h")) & (c("x.id") < c("y.id")) & (c("x.component") != c("y.component"))
                  & bounds.sizes_fit(c("x.n"), c("y.n")) & bounds.sketches_fit(
                      c("x.n"), [c(f"x.{k}") for k in SKETCH], c("y.n"), [c(f"y.{k}") for k in SKETCH])
                  & (F.array_min(F.array_intersect("x.prefix", "y.prefix")) == c("x.h"))).select(c("x.id").alias("a"), c("y.id").alias("b")).distinct()
    rest = saved(rest, "jaccard-rest")
    if not rest.isEmpty():
        found = components(links.union(_verified(*args, rest)))

    named = classes.select("id", *same).join(found, "id", "left").select(
        *same, F.coalesce("component", "id").alias("component"))
    named = saved(named, "jaccard-named")
    return signs.select("id", *same).join(named, same, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80,
              den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay, null ids too."""
    out = linked(docs, id_col, text_col, width, num, den)
    gone = out.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    gone = saved(gone, "jaccard-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
