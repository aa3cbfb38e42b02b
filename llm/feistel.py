"""Keyed permutations of number ranges as columns: an alternating Feistel network with modular addition and cycle-walking.

A number below ``a * b`` is the pair (x div b, x mod b).  Each round adds a keyed digest of one half to the other, modulo
the other's size, so every round, and the whole, can be undone.  Where ``a * b`` is larger than the range, the permutation
is repeated until the result is back in it (cycle-walking); both sizes are chosen so that this is rare.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
#: Repeats allowed for; the chance that one is needed is below 1 in the root of the range, so that this many never are.
WALK = 48


def _digest(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    """A number below 2^60 from the key, the kind of value, the round and one half."""
    said = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _div(x: Column, b: Column) -> Column:
    """Whole division of longs, exact beyond the 53 bits of a double."""
    return F.call_function("div", x, b)


def _network(x: Column, key: str, tweak: Column, a: Column, b: Column, back: bool) -> Column:
    start = F.struct(_div(x, b).alias("u"), (x % b).alias("v"))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    if back:
        turns = F.reverse(turns)

    def step(s: Column, i: Column) -> Column:
        # after each round the halves change places, so even rounds change the half of size a and odd ones that of size b
        size = F.when(i % 2 == 0, a).otherwise(b)
        if back:
            return F.struct(F.pmod(s["v"] - _digest(key, tweak, i, s["u"]) % size, size).alias("u"), s["u"].alias("v"))
        return F.struct(s["v"].alias("u"), ((s["u"] + _digest(key, tweak, i, s["v"]) % size) % size).alias("v"))

    return F.aggregate(turns, start, step, lambda s: s["u"] * b + s["v"])


def permuted(x: Column, size: int | Column, key: str, tweak: Column | str = "", back: bool = False,
             halves: tuple[Column, Column] | None = None) -> Column:
    """``x`` from 0 to size - 1 to its image in the same range; ``back`` undoes it.  Null stays null.

    ``size`` up to 2^60.  ``halves``: sizes whose product is exactly ``size``, which then may be a column.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    x = x.cast("long")
    if halves is not None:
        return F.when(x.isNotNull(), _network(x, key, tweak, *halves, back))
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    parts = F.lit(a).cast("long"), F.lit(b).cast("long")
    first = _network(x, key, tweak, *parts, back)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < size, y).otherwise(
        _network(y, key, tweak, *parts, back)))
    return F.when(x.isNotNull(), walked)
