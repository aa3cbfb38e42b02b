"""Trie of conversation prefixes with subtree figures by the Euler-tour technique.

Every distinct sequence of first turns is a node.  A node has an enter and an exit arc; the successor of each arc follows
from first children and next siblings, which makes one list through all arcs.  The list is ranked by random-mate
contraction: arcs that draw 0 absorb a successor that draws 1, a quarter of the list in each round, until a fixed small
number is left; the rounds are then undone in reverse.  The rank is the arc's position in the tour.  Prefix sums over the
positions, at the exit arc less those before the enter arc, are the sums over a node's subtree.

Conversations, turns, nodes and arcs are spread by ranges or hashes of fine keys, so one conversation with a third of all
turns, one first turn that a third of all conversations share, or one node with a third of all nodes as children takes no
single task.  Turns travel as digests of 128 bits and word counts, not as texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.plans.scan import running
from llm.common import SPACES, released, saved

#: The contracted list is walked in one task once it has at most so many arcs.
REMAINDER = 1 << 14
#: Arcs summed by one task.
STRETCH = 1 << 14
#: Conversations whose ids are joined into one string before a node's digest is taken.
SEGMENT = 1 << 12
#: Characters of role and text that order turns of one number; beyond them their digests do.
LEADING = 16
NODE = ["depth", "x", "y"]


def digested(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, the beginnings of role and text, two 64-bit digests of (role, text), and words of the text.

    Rows without a conversation id are left out; null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("long")
    return turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.substring(role, 1, LEADING).alias("r"), F.substring(text, 1, LEADING).alias("t"),
        F.xxhash64(F.lit(1), role, text).alias("h"), F.xxhash64(F.lit(2), text, role).alias("g"), words.alias("words"))


def _ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``part``, the number of a row's range; ranges follow one another."""
    return saved(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _before(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, part) with ``sums`` over the earlier parts of the same keys; ``parts`` has a row for each key and part."""
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "part", *[F.coalesce(c.over(earlier), F.lit(0).cast("long")).alias(n) for n, c in sums.items()])


def numbered(rows: DataFrame) -> DataFrame:
    """``digested`` rows as (conv, part, rank, h, g, words): rank 0, 1, 2 ... in the order of turns, nulls first, turns of one
    number by role and text.  ``part`` never falls along a conversation and divides long ones."""
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("r", "t", "h", "g"))]
    laid = _ranged(rows.withColumn("row", F.monotonically_increasing_id()), [F.col("conv"), *order, F.col("row")], "trie-turns")
    counts = saved(laid.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    offsets = _before(counts, ["conv"], {"before": F.sum("n")})
    at = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    placed = laid.repartition("conv", "part").withColumn("at", at).join(offsets, ["conv", "part"])
    out = saved(placed.select("conv", "part", (F.col("at") + F.col("before")).alias("rank"), "h", "g", "words"), "trie-numbered")
    released(laid, counts)
    return out


def branched(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Conversations rebuilt: the first ``shared`` turns (at most ``most``) of conversation ``base``, all if it has fewer and
    none if it is absent, then the own turns behind the first ``shared``.

    ``turns`` is what ``numbered`` gives; ``base`` and ``shared`` are expressions on ``conv``.  (conv, part, rank, h, g,
    words) as before, with one row of a null rank for each conversation that is left without turns.
    """
    spread = saved(turns.groupBy("conv", "part").agg(F.max("rank").alias("last")), "trie-spread")
    convs = spread.select("conv").distinct().withColumns({"base": base, "shared": shared})
    heads = turns.where(F.col("rank") < most).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "h", "g", "words"))).alias("head"))  # at most ``most`` turns
    # a conversation is the base of those that name it only; their number is the caller's, so the join is left to Spark
    plan = saved(convs.join(heads, "base", "left").select("conv", "shared", F.when(
        F.col("shared") > 0, F.slice(F.coalesce("head", F.array()), F.lit(1), F.greatest("shared", F.lit(1)).cast("int"))).otherwise(
            F.array()).alias("head")), "trie-branches")
    first = plan.select("conv", F.lit(-1).alias("part"), F.explode("head").alias("x")).select(
        "conv", "part", "x.rank", "x.h", "x.g", "x.words")
    shift = spread.join(plan.select("conv", "shared", F.size("head").alias("kept")), "conv").select("conv", "part", "shared", "kept")
    own = turns.join(shift, ["conv", "part"]).where(F.col("rank") >= F.col("shared")).select(
        "conv", "part", (F.col("rank") - F.col("shared") + F.col("kept")).alias("rank"), "h", "g", "words")
    length = spread.groupBy("conv").agg((F.max("last") + 1).alias("n"))
    bare = plan.where(F.size("head") == 0).join(length, "conv").where(F.col("n") <= F.col("shared")).select(
        "conv", F.lit(-1).alias("part"), *[F.lit(None).cast("long").alias(c) for c in ("rank", "h", "g", "words")])
    out = saved(first.unionByName(own).unionByName(bare), "trie-rebuilt")
    released(plan, spread)
    return out


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn as (conv, depth, x, y, px, py, words), and every conversation as (conv, depth, x, y) of its last turn.

    (x, y) stands for the sequence up to the turn, (px, py) for the one before: the exclusive or of digests of (position,
    turn) in two lanes, which running values per (conversation, part) and carries from part to part give.
    """
    tagged = turns.where("rank is not null").select("conv", "part", "rank", "words", F.xxhash64(F.lit(3), "rank", "h", "g").alias("x"),
                                                    F.xxhash64(F.lit(4), "rank", "g", "h").alias("y"))
    totals = saved(tagged.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("n")), "trie-totals")
    carried = _before(totals, ["conv"], {"bx": F.bit_xor("x"), "by": F.bit_xor("y")})
    so_far = Window.partitionBy("conv", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.repartition("conv", "part").withColumns({"rx": F.bit_xor("x").over(so_far), "ry": F.bit_xor("y").over(so_far)})
    c = F.col
    rows = local.join(carried, ["conv", "part"]).select(
        "conv", (c("rank") + 1).alias("depth"), c("rx").bitwiseXOR(c("bx")).alias("nx"), c("ry").bitwiseXOR(c("by")).alias("ny"), "x", "y", "words")
    rows = rows.select("conv", "depth", c("nx").alias("x"), c("ny").alias("y"), c("nx").bitwiseXOR(c("x")).alias("px"),
                       c("ny").bitwiseXOR(c("y")).alias("py"), "words")
    ends = totals.groupBy("conv").agg(F.sum("n").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    bare = turns.where("rank is null").select("conv", *[F.lit(0).cast("long").alias(n) for n in NODE])
    return rows, saved(ends.unionByName(bare), "trie-ends")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): SHA-256 of the ids of the conversations that end there, ascending, joined by commas.

    Ids are sorted by ranges and joined to strings of at most ``SEGMENT`` ids; only these are put in order for each node, and
    the digest runs over them as a stream.
    """
    laid = ends.repartitionByRange("conv").sortWithinPartitions("conv")
    numbered_ = saved(laid.withColumn("segment", F.floor(F.monotonically_increasing_id() / SEGMENT).cast("long")), "trie-end-order")
    joined = numbered_.groupBy(*NODE, "segment").agg(F.sort_array(F.collect_list("conv")).alias("ids")).select(
        *NODE, "segment", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch[n].to_pylist() for n in (*NODE, "ids"))):
                if node != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield rows_of(done)
        if key is not None:
            yield rows_of([(*key, digest.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in enumerate(kinds)], [*NODE, "ends_sha256"])

    ordered = joined.repartition(*NODE).sortWithinPartitions(*NODE, "segment").select(*NODE, "ids")
    return ordered.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def list_ranks(arcs: DataFrame, remainder: int = REMAINDER) -> DataFrame:
    """(arc, rank) of the one list that ``arcs`` (arc, next; null at the end) forms: rank 0 for its first arc.

    Every round writes its tables to the shared folder; they shrink by about a quarter each time.
    """
    c = F.col
    left = saved(arcs.select("arc", "next", F.lit(1).cast("long").alias("span")), "tour-left")
    rounds = []
    while left.count() > remainder:
        turn = len(rounds)

        def draw(x: str) -> Column:
            return F.xxhash64(F.lit(turn), x).bitwiseAND(F.lit(1))

        takes = (draw("arc") == 0) & c("next").isNotNull() & (draw("next") == 1)
        taking = left.where(takes).select(c("arc").alias("owner"), c("next").alias("arc"), c("span").alias("gap"))
        met = saved(left.where(draw("arc") == 1).join(taking, "arc", "left"), "tour-met")
        kept = left.where((draw("arc") == 0) & ~F.coalesce(takes, F.lit(False)))
        longer = met.where("owner is not null").select(c("owner").alias("arc"), "next", (c("gap") + c("span")).alias("span"))
        lone = met.where("owner is null").select("arc", "next", "span")
        shorter = saved(kept.unionByName(longer).unionByName(lone), "tour-left")
        rounds.append(saved(met.where("owner is not null").select("arc", "owner", "gap"), "tour-absorbed"))
        released(left, met)
        left = shorter

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = {}
        for batch in batches:
            following.update(zip(batch["arc"].to_pylist(), zip(batch["next"].to_pylist(), batch["span"].to_pylist())))
        arc = next(iter(set(following) - {n for n, _ in following.values()}), None)
        out, rank = ([], []), 0
        while arc is not None:
            out[0].append(arc)
            out[1].append(rank)
            arc, span = following[arc]
            rank += span
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["arc", "rank"])

    ranked = [saved(left.repartition(1).mapInArrow(walk, "arc long, rank long"), "tour-ranks")]
    released(left)
    for absorbed in reversed(rounds):
        so_far = reduce(DataFrame.unionByName, ranked)
        found = absorbed.join(so_far.withColumnRenamed("arc", "owner"), "owner").select("arc", (c("rank") + c("gap")).alias("rank"))
        ranked.append(saved(found, "tour-ranks"))
        released(absorbed)
    return reduce(DataFrame.unionByName, ranked)


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next) for ``nodes`` (node, parent; null for the root): 2 node enters it, 2 node + 1 leaves it, siblings by number.

    Children are laid out by ranges of (parent, node), so that one parent may have any number of them.
    """
    c = F.col
    children = _ranged(nodes.where("parent is not null"), [c("parent"), c("node")], "tour-children")
    firsts = saved(children.groupBy("parent", "part").agg(F.min("node").alias("first")), "tour-firsts")
    behind = firsts.select("parent", "part", F.lead("first").over(Window.partitionBy("parent").orderBy("part")).alias("beyond"))
    within = F.lead("node").over(Window.partitionBy("parent", "part").orderBy("node"))
    sibling = children.repartition("parent", "part").withColumn("sibling", within).join(behind, ["parent", "part"]).select(
        "node", F.coalesce("sibling", "beyond").alias("sibling"))
    child = firsts.groupBy(c("parent").alias("node")).agg(F.min("first").alias("child"))
    around = saved(nodes.select("node", "parent").join(child, "node", "left").join(sibling, "node", "left"), "tour-around")
    enter = around.select((2 * c("node")).alias("arc"), F.coalesce(2 * c("child"), 2 * c("node") + 1).alias("next"))
    leave = around.select((2 * c("node") + 1).alias("arc"), F.coalesce(2 * c("sibling"), 2 * c("parent") + 1).alias("next"))
    return enter.unionByName(leave)


def subtree_sums(nodes: DataFrame, weights: dict[str, Column], remainder: int = REMAINDER) -> DataFrame:
    """(node, one sum over the subtree, top included, for each of ``weights``) for ``nodes`` (node, parent, and more)."""
    c = F.col
    position = saved(list_ranks(tour(nodes), remainder).withColumns({
        "node": F.floor(c("arc") / 2).cast("long"), "enters": c("arc") % 2 == 0}), "tour-positions")
    own = nodes.select("node", *[w.cast("long").alias(f"w_{n}") for n, w in weights.items()])
    weighed = saved(position.join(own, "node").select("node", "enters", "rank", *[
        F.when(c("enters"), c(f"w_{n}")).otherwise(0).alias(f"w_{n}") for n in weights]), "tour-weights")
    summed = running(weighed, [], ["rank"], F.floor(c("rank") / STRETCH).cast("long"), sums={n: c(f"w_{n}") for n in weights})
    # at the exit arc the sum so far, less the sum before the enter arc
    return summed.groupBy("node").agg(*[
        F.sum(F.when(c("enters"), c(f"w_{n}") - c(n)).otherwise(c(n))).alias(n) for n in weights])


def trie(turns: DataFrame, remainder: int = REMAINDER) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is what ``numbered`` or ``branched`` gives.  The first ``depth`` turns of conversation conv_id are the node's
    sequence.  The textless root has depth 0 and no parent; conversations without turns are members of it alone.  n_leaves
    and saved_tokens ((n_convs - 1) times the words of a node's last text) are summed over the node's subtree.  Repeated
    turns are turns.  Without any conversation the result is empty.
    """
    c = F.col
    rows, ends = _prefixes(turns)
    deeper = rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                     F.min("px").alias("px"), F.min("py").alias("py"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(n) for n in NODE], "conv_id", "n_convs", *[zero.alias(n) for n in ("words", "px", "py")])
    # a node is known by its smallest member and its depth; numbers follow them, so the siblings' order is that of conv_id
    laid = _ranged(root.unionByName(deeper), [c("conv_id"), c("depth")], "trie-nodes")
    offsets = _before(laid.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], {"before": F.sum("n")})
    at = F.row_number().over(Window.partitionBy("part").orderBy("conv_id", "depth")) - 1
    nodes = saved(laid.withColumn("at", at).join(offsets, "part").withColumn("node", c("at") + c("before")).drop("at", "before", "part"), "trie-nodes")
    released(laid)
    above = nodes.select((c("depth") + 1).alias("depth"), c("x").alias("px"), c("y").alias("py"), c("node").alias("parent"),
                         c("conv_id").alias("parent_conv_id"))
    nodes = saved(nodes.join(above, ["depth", "px", "py"], "left"), "trie-linked")
    children = nodes.where("parent is not null").groupBy(c("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-figures")
    sums = subtree_sums(nodes, {"n_leaves": F.when(c("n_children") == 0, 1).otherwise(0),
                                "saved_tokens": (c("n_convs") - 1) * c("words")}, remainder)
    out = nodes.join(sums, "node").join(_end_digests(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
