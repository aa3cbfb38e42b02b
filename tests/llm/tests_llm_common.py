"""Texts for the tests of the training-data operators."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "son") for b in ("rin", "dal", "fos", "me", "tu", "")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


#: Texts that every operator on documents has to stand: null, empty, blank, ties, repeats, very long.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (6, "ONE  one"), (None, "one two three four"),
       (None, None), (7, prose(1, 40_000)), (8, prose(1, 40_000)), (9, "ñandú – 日本 \x1c word"), (-3, prose(2, 80))]
