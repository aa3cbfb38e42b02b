"""Katz backoff language model of words, with Good-Turing discounts and exactly normalised backoff weights.

Every word has its own bigrams, as history and as successor, however many words there are.  A token's probability is
looked up recursively: the discounted bigram, else the history's backoff weight times the unigram.  Only where a ``size``
is given, all words but the most frequent ones share one class, inside which a word's share follows its own exact count.

Tables, all in the shared folder and split into buckets: exact counts of every training word, and the bigram counts.  A
bucket belongs to a range of histories; frequent histories are spread over many buckets by their next word.  The ``LOCAL``
most frequent words (whole count levels) have short ids, and their numbers travel in the tasks; this changes no result.
Pairs with any other word, far pairs, are kept by the hashes of both, with the count of a far successor; the numbers of a
far history follow from the pairs of its bucket.

Scoring sends the token pairs of all texts to the buckets of the tables, as packed arrays, and adds up the answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import shingles
from llm.common import partitions, saved

LOCAL = 1 << 18
#: Counts up to this one are discounted.
GOOD_TURING = 5
#: Added to every count of the unigrams.
ADDED = 0.1
#: Histories that make up more than one in so many tokens are spread over ``SPREAD`` buckets.
HOT_SHARE = 2000
SPREAD = 64
#: Tokens handled at a time.
TOKENS = 1 << 20
END = np.uint64(0x5EED0000E0F0E0F1)
#: Set in the codes of far words, which are hashes; the codes of other words are their ids.
FAR = np.uint64(1 << 63)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the words with ids of their own, their counts, and the totals over all training tokens."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    whole: bool

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def start(self) -> int:
        return len(self.words) + 1

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.types + 1)

    def unigrams(self) -> np.ndarray:
        """Probability of each id; the class of rare words, unseen ones included, is the last."""
        rare = self.tokens - int(self.counts.sum()) + ADDED * (self.types - len(self.words) + 1)
        return np.append(self.counts + ADDED, rare) / self.total

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, self.rare)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Token hashes of consecutive texts, each with its end token, their first places, and the number of the first text."""
    hashes, sizes, first, done = [], [], 0, 0
    for words, cuts in shingles.text_words(column):
        hashes.append(np.insert(words, cuts[1:], END))
        sizes.append(np.diff(cuts) + 1)
        done += len(cuts) - 1
        if sum(map(len, hashes)) >= TOKENS:
            n = np.concatenate(sizes)
            yield np.concatenate(hashes), np.cumsum(n) - n, first
            hashes, sizes, first = [], [], done
    if sizes:
        n = np.concatenate(sizes)
        yield np.concatenate(hashes), np.cumsum(n) - n, first


def _pairs(vocabulary: Vocabulary, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the word before and of the word, for each token."""
    ids = vocabulary.ids(hashes)
    codes = ids.astype(np.uint64)
    if vocabulary.whole:
        codes = np.where(ids == vocabulary.rare, hashes | FAR, codes)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[firsts] = vocabulary.start
    return before, codes


def _bucket(vocabulary: Vocabulary, before: np.ndarray, codes: np.ndarray, buckets: int) -> np.ndarray:
    often = np.append(vocabulary.counts, [vocabulary.tokens, vocabulary.tokens]) > vocabulary.tokens / HOT_SHARE
    hot = (before < FAR) & often[np.where(before < FAR, before, 0).astype(np.int64)]
    slot = np.where(hot, shingles.mixed(codes) % np.uint64(SPREAD), np.uint64(0))
    return (shingles.mixed(before * np.uint64(SPREAD) + slot + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _groups(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order by bucket and the range of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, list(zip(heads, np.append(heads[1:], len(bucket))))


def _pack(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


#: Bytes of a packed pair of ids; enough for vocabularies of up to 2^20 words.
PAIR = 5


def _far(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two codes of each of the far pairs."""
    both = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _joint(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return shingles.mixed(shingles.mixed(before) + codes)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """w (hash), c: exact counts of all tokens, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, _, _ in _chunks(batch.column(0)):
                found, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["w", "c"])

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def choose_vocabulary(words: DataFrame, size: int = LOCAL, whole: bool = False) -> Vocabulary:
    """The most frequent words by whole levels of counts, at most ``size`` of them."""
    level = F.floor(F.log2(F.col("c")) * 32).cast("int")
    steps = sorted(words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    chosen, cut = 0, None
    for r in steps:  # a few hundred levels
        if chosen + r["n"] > size:
            break
        chosen, cut = chosen + r["n"], r["l"]
    found = words.where(level >= cut).toArrow() if cut is not None else None
    hashes = found["w"].to_numpy().view(np.uint64) if found is not None else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    counts = found["c"].to_numpy()[order] if found is not None else np.empty(0, np.int64)
    return Vocabulary(hashes[order], counts, sum(r["c"] for r in steps), sum(r["n"] for r in steps), whole)


def bigram_counts(docs: DataFrame, text_col: str, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """bucket, kind, keys, counts, own (six bytes each): rows of distinct pairs.

    Kind 1: packed pairs of ids.  Kind 3: far pairs, the two codes one after the other, and the counts of their second words
    (0 for words with ids).  On their way far second words meet in a bucket of their own, where their counts come from.
    """
    base = np.uint64(vocabulary.start + 1)
    kind = "bucket int, kind int, keys binary, counts binary, own binary"

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                                          ["bucket", "kind", "keys", "counts", "own"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, firsts, _ in _chunks(batch.column(0)):
                before, codes = _pairs(vocabulary, hashes, firsts)
                far, out = (before >= FAR) | (codes >= FAR), []
                keys, n = np.unique(before[~far] * base + codes[~far], return_counts=True)
                order, cuts = _groups(bucket := _bucket(vocabulary, keys // base, keys % base, buckets))
                for a, b in cuts:
                    out.append((bucket[order[a]], 1, _pack(keys[order[a:b]], PAIR), _pack(n[order[a:b]], 6), None))
                both = np.stack([before[far], codes[far]], axis=1)
                _, at, n = np.unique(_joint(both[:, 0], both[:, 1]), return_index=True, return_counts=True)
                both = both[at]
                second = both[:, 1] >= FAR
                bucket = np.where(second, (shingles.mixed(both[:, 1]) % np.uint64(buckets)).astype(np.int64),
                                  _bucket(vocabulary, both[:, 0], both[:, 1], buckets))
                order, cuts = _groups(bucket * 2 + second)
                for a, b in cuts:
                    i = order[a:b]
                    out.append((bucket[i[0]], 2 if second[i[0]] else 3, both[i].tobytes(), _pack(n[i], 6), None))
                yield rows(out)

    def merge(table: pa.Table) -> pa.Table:
        number, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        counts = np.concatenate([_unpack(x, 6) for x in table["counts"].to_pylist()])
        if number == 1:
            found, at = np.unique(np.concatenate([_unpack(x, PAIR) for x in table["keys"].to_pylist()]), return_inverse=True)
            total = np.bincount(at, weights=counts, minlength=len(found))
            return pa.Table.from_batches([rows([(bucket, 1, _pack(found, PAIR), _pack(total, 6), None)])])
        before, codes = _far(table["keys"].to_pylist())
        _, first, at = np.unique(_joint(before, codes), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(first))
        before, codes, own = before[first], codes[first], np.zeros(len(first))
        home = np.full(len(first), bucket)
        if number == 2:
            _, at = np.unique(codes, return_inverse=True)
            own = np.bincount(at, weights=total)[at]
            home = _bucket(vocabulary, before, codes, buckets)
        order, cuts = _groups(home)
        both = np.stack([before, codes], axis=1)
        return pa.Table.from_batches([rows([(home[order[a]], 3, both[order[a:b]].tobytes(), _pack(total[order[a:b]], 6), _pack(own[order[a:b]], 6))
                                            for a, b in cuts])])

    parts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(split, kind)
    return parts.groupBy("bucket", "kind").applyInArrow(merge, kind)


@dataclass(frozen=True)
class Weights:
    """Per count its discount; per history its total and backoff weight (natural numbers, not logarithms)."""

    discounts: np.ndarray
    totals: np.ndarray
    backoff: np.ndarray
    scale: np.ndarray


def good_turing(of_counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1 to ``GOOD_TURING`` from the numbers of types with counts 1, 2, ...; index 0 is unused.

    Where these numbers give no valid discounts (small corpora), 0.5 is taken off every such count instead.
    """
    k, out = GOOD_TURING, np.ones(GOOD_TURING + 1)
    n = np.asarray(of_counts, dtype=float)
    r = np.arange(1, k + 1)
    fallback = (r - 0.5) / r
    if (n[1: k + 2] > 0).all():
        common = (k + 1) * n[k + 1] / n[1]
        got = ((r + 1) * n[2: k + 2] / n[1: k + 1] / r - common) / (1 - common) if common < 1 else fallback
        out[1:] = got if ((got > 0) & (got < 1)).all() else fallback
    else:
        out[1:] = fallback
    return out


def _sums(before: np.ndarray, counts: np.ndarray, uni: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The histories, and for each how many pairs have the counts 1, 2, ..., all its occurrences, and what its successors' unigrams add up to."""
    h, at = np.unique(before, return_inverse=True)
    add = lambda values: np.bincount(at, weights=values, minlength=len(h))
    return h, np.stack([add(counts == r) for r in range(1, GOOD_TURING + 2)]), add(counts), add(uni)


def _numbers(n: np.ndarray, total: np.ndarray, seen: np.ndarray, discounts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total, backoff weight and scale of histories from their sums."""
    r = np.arange(1, GOOD_TURING + 1)[:, None]
    freed = (n[:-1] * r * (1 - discounts[1:, None])).sum(axis=0)
    total = np.where(freed > 0, total, total + 1)  # with no small count one more occurrence is set aside
    left = np.where(freed > 0, freed, 1) / total
    free = 1 - seen
    full = free < 1e-9  # every word was seen after this history: nothing to back off to
    return total, np.where(full, 1, left / np.where(full, 1, free)), np.where(full, 1 / (1 - left), 1)


def _far_unigrams(codes: np.ndarray, own: np.ndarray, vocabulary: Vocabulary, uni: np.ndarray) -> np.ndarray:
    near = codes < FAR
    return np.where(near, uni[np.where(near, codes, 0).astype(np.int64)], (own + ADDED) / vocabulary.total)


def weights(bigrams: DataFrame, vocabulary: Vocabulary) -> Weights:
    """Discounts and one row of numbers per history with an id, from the stored bigram counts."""
    base, uni = np.uint64(vocabulary.start + 1), vocabulary.unigrams()
    levels = [f"n{r}" for r in range(1, GOOD_TURING + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, counts, own in zip(*[batch[c].to_pylist() for c in ("kind", "keys", "counts", "own")]):
                counts = _unpack(counts, 6).astype(np.int64)
                if number == 1:
                    keys = _unpack(keys, PAIR)
                    before, share = keys // base, uni[(keys % base).astype(np.int64)]
                else:
                    before, codes = _far([keys])
                    share = _far_unigrams(codes, _unpack(own, 6), vocabulary, uni)
                # far histories in one row: only their counts of counts are needed here
                h, n, total, seen = _sums(np.where(before < FAR, before, FAR), counts, share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(h < FAR, h, 0).astype(np.int64) - (h >= FAR)), *[pa.array(x.astype(np.int64)) for x in (*n, total)], pa.array(seen)],
                    ["h", *levels, "total", "seen"])

    parts = bigrams.select("kind", "keys", "counts", "own").mapInArrow(run, "h long, " + ", ".join(f"{x} long" for x in levels) + ", total long, seen double")
    rows = parts.groupBy("h").agg(*[F.sum(x).alias(x) for x in [*levels, "total", "seen"]]).toArrow()  # a row for each id
    size = vocabulary.start + 1
    totals, backoff, scale = np.ones(size), np.ones(size), np.ones(size)
    n = np.stack([rows[x].to_numpy() for x in levels]) if rows.num_rows else np.zeros((len(levels), 0))
    discounts = good_turing(np.concatenate([[0], n.sum(axis=1)]))
    if rows.num_rows:
        h, total, seen = rows["h"].to_numpy(), rows["total"].to_numpy().astype(float), rows["seen"].to_numpy()
        near = h >= 0
        h = h[near]
        totals[h], backoff[h], scale[h] = _numbers(n[:, near], total[near], seen[near], discounts)
    return Weights(discounts, totals, backoff, scale)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    weights: Weights
    words: DataFrame
    rare: DataFrame
    bigrams: DataFrame
    buckets: int


def fit(docs: DataFrame, text_col: str = "text", size: int | None = None, local: int = LOCAL) -> Model:
    """Counts over all ``docs``; null texts are empty and consist of the end token.

    ``size``: None for bigrams of all words; else all but so many words are one class in the bigrams.  ``local``: how many
    words' numbers travel in the tasks where ``size`` is None; it changes no result.
    """
    buckets = 2 * partitions(docs.sparkSession)
    words = saved(word_counts(docs, text_col), "katz-words")
    vocabulary = choose_vocabulary(words, local if size is None else size, size is None)
    bigrams = saved(bigram_counts(docs, text_col, vocabulary, buckets), "katz-bigrams")
    least = int(vocabulary.counts.min()) if len(vocabulary.counts) else None
    rare = words.where(F.col("c") < least) if least is not None else words  # whole levels, so counts tell them apart
    return Model(vocabulary, weights(bigrams, vocabulary), words, rare, bigrams, buckets)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``, repeated ids one by one.

    ``score`` is the log10 probability of the text's tokens; ``base_score`` that of the smoothed unigrams.
    """
    vocabulary, tables, buckets = model.vocabulary, model.weights, model.buckets
    base, uni = np.uint64(vocabulary.start + 1), vocabulary.unigrams()
    # what the rare words and the unseen one share; without a class a far word's unigram counts, and pairs add the rest
    of_class = np.log10(vocabulary.total if vocabulary.whole else uni[vocabulary.rare] * vocabulary.total)
    kind = "bucket int, kind int, keys binary, docs binary, runs binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, named = batch["row"].to_numpy(), batch["id"]
            for hashes, firsts, first in _chunks(batch["text"]):
                before, codes = _pairs(vocabulary, hashes, firsts)
                ids = vocabulary.ids(hashes)
                sizes = np.diff(np.append(firsts, len(hashes)))
                doc = np.repeat(np.arange(len(firsts)), sizes)
                known = ids < vocabulary.rare
                own = rows[first: first + len(firsts)]
                local = np.stack([sizes, np.bincount(doc, weights=known, minlength=len(sizes)),
                                  np.bincount(doc, weights=np.where(known, np.log10(uni[ids]), 0), minlength=len(sizes))], axis=1)
                given = named[first: first + len(firsts)]
                local = np.column_stack([local, given.is_valid().to_numpy(zero_copy_only=False),
                                         given.fill_null(0).to_numpy().view(np.float64)])  # the id's bits, not its value
                out = [(int(own[0] % buckets), 0, local.tobytes(), own.tobytes(), b"")]
                rare = np.flatnonzero(~known)
                far = (before >= FAR) | (codes >= FAR)
                bucket = _bucket(vocabulary, before, codes, buckets)
                for number, keys, owner, bucket, width in (
                        (1, before[~far] * base + codes[~far], doc[~far], bucket[~far], PAIR),
                        (2, hashes[rare], doc[rare], hashes[rare].view(np.int64) % buckets, 8),
                        (3, np.stack([before[far], codes[far]], axis=1), doc[far], bucket[far], 8)):
                    order, cuts = _groups(bucket)
                    keys, owner, bucket = keys[order], owner[order], bucket[order]
                    for a, b in cuts:
                        runs = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                        lengths = np.diff(np.append(runs, b - a))
                        out.append((int(bucket[a]), number, _pack(keys[a:b], width),
                                    np.diff(own[owner[a:b][runs]], prepend=0).tobytes(), lengths.astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                 ["bucket", "kind", "keys", "docs", "runs"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        stored = {}
        for k in (1, 2):
            some = right.filter(pc.equal(right["kind"], k))
            if k == 1:
                keys = np.concatenate([np.empty(0, np.uint64), *[_unpack(x, PAIR) for x in some["keys"].to_pylist()]])
                counts = np.concatenate([np.empty(0, np.uint64), *[_unpack(x, 6) for x in some["counts"].to_pylist()]])
            else:
                keys, counts = some["w"].to_numpy().astype(np.int64).view(np.uint64), some["c"].to_numpy().astype(np.uint64)
            order = np.argsort(keys)
            stored[k] = keys[order], counts[order].astype(float)
        some = right.filter(pc.equal(right["kind"], 3))
        before, codes = _far(some["keys"].to_pylist())
        counts, own = (np.concatenate([np.empty(0, np.uint64), *[_unpack(x, 6) for x in some[c].to_pylist()]]).astype(float) for c in ("counts", "own"))
        far = before >= FAR  # all pairs of a far history are here
        histories, *sums = _sums(before[far], counts[far], _far_unigrams(codes[far], own[far], vocabulary, uni))
        far_numbers = _numbers(*sums, tables.discounts)
        keys = _joint(before, codes)
        order = np.argsort(keys)
        stored[3] = keys[order], counts[order]
        own = own[order]
        found = {0: [], 1: [], 2: [], 3: []}  # row and its numbers, by kind
        for number, keys, docs_, runs in zip(*[left[c].to_pylist() for c in ("kind", "keys", "docs", "runs")]):
            who = np.frombuffer(docs_, np.int64)
            if number == 0:
                found[0].append((who, np.frombuffer(keys).reshape(-1, 5)))
                continue
            who = np.cumsum(who)
            lengths = np.frombuffer(runs, np.uint32).astype(np.int64)
            if number == 3:
                before, codes = _far([keys])
                keys = _joint(before, codes)
            else:
                keys = _unpack(keys, PAIR if number == 1 else 8)
            table, counts = stored[number]
            c = np.zeros(len(keys))
            if len(table):
                at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                c = np.where(table[at] == keys, counts[at], 0)
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            if number == 1:
                h, w = (keys // base).astype(np.int64), (keys % base).astype(np.int64)
                d = tables.discounts[np.minimum(c, GOOD_TURING).astype(np.int64)]
                seen = np.where(c > GOOD_TURING, 1, d) * c / tables.totals[h] * tables.scale[h]
                add = np.add.reduceat(np.log10(np.where(c > 0, seen, tables.backoff[h] * uni[w])), starts)[:, None]
            elif number == 3:  # relative to the unigram for far words, whose unigrams are added where their counts are
                near, far_word = before < FAR, codes >= FAR
                h = np.where(near, before, 0).astype(np.int64)
                total, backoff, scale = tables.totals[h], tables.backoff[h], tables.scale[h]
                place = np.minimum(np.searchsorted(histories, before), max(len(histories) - 1, 0))
                known = ~near & (histories[place] == before) if len(histories) else np.zeros(len(keys), bool)
                total, backoff, scale = (np.where(near, x, 1.0) for x in (total, backoff, scale))  # unseen histories: 1
                for x, of in zip((total, backoff, scale), far_numbers):
                    x[known] = of[place[known]]
                share = uni[np.where(far_word, 0, codes).astype(np.int64)]
                if len(table):
                    share = np.where(far_word, (own[at] + ADDED) / vocabulary.total, share)
                d = tables.discounts[np.minimum(c, GOOD_TURING).astype(np.int64)]
                seen = np.where(c > GOOD_TURING, 1, d) * c / total * scale
                add = np.add.reduceat(np.log10(np.where(c > 0, seen, backoff * share)) - np.where(far_word, np.log10(share), 0), starts)[:, None]
            else:
                share = np.log10(c + ADDED)
                add = np.stack([np.add.reduceat(x, starts) for x in (
                    (c > 0).astype(float), share - np.log10(vocabulary.total), share - of_class)], axis=1)
            found[number].append((who, add))
        out = []
        for number, some in found.items():
            if not some:
                continue
            who, values = np.concatenate([r for r, _ in some]), np.concatenate([v for _, v in some])
            if number:  # one sum for each text
                who, at = np.unique(who, return_inverse=True)
                values = np.stack([np.bincount(at, weights=v, minlength=len(who)) for v in values.T], axis=1)
            home = (shingles.mixed((who >> 12).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            who, values, home = who[order], np.ascontiguousarray(values[order]), home[order]
            heads = np.flatnonzero(np.diff(home, prepend=-1))
            out += [(int(home[i]), number, np.diff(who[i:j], prepend=0).tobytes(), values[i:j].tobytes())
                    for i, j in zip(heads, np.append(heads[1:], len(home)))]
        columns = zip(*out) if out else ([], [], [], [])
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["home", "kind", "rows", "sums"])

    def together(table: pa.Table) -> pa.Table:
        """The sums of the texts of one home; each has one row of kind 0."""
        got = {0: [], 1: [], 2: [], 3: []}
        for number, rows, sums in zip(*[table[c].to_pylist() for c in ("kind", "rows", "sums")]):
            got[number].append((np.cumsum(np.frombuffer(rows, np.int64)), np.frombuffer(sums).reshape(-1, {0: 5, 1: 1, 2: 3, 3: 1}[number])))
        row, local = (np.concatenate([x[i] for x in got[0]]) for i in (0, 1))
        order = np.argsort(row)
        row, local = row[order], np.ascontiguousarray(local[order])
        total = np.column_stack([local[:, 1:3], np.zeros(len(row))])  # n_known, base_score, score
        for number in (1, 2, 3):
            for rows, sums in got[number]:
                np.add.at(total[:, 3 - sums.shape[1]:], np.searchsorted(row, rows), sums)
        ids = pa.array(np.ascontiguousarray(local[:, 4]).view(np.int64), mask=local[:, 3] == 0)
        return pa.table({"id": ids, "n_tokens": pa.array(local[:, 0]), "n_known": pa.array(total[:, 0]),
                         "base_score": pa.array(total[:, 1]), "score": pa.array(total[:, 2])})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{id_col}`").cast("long").alias("id"))
    sent = rows.mapInArrow(split, kind)
    none = F.lit(None)
    pairs = model.bigrams.select("bucket", "kind", "keys", "counts", "own", none.cast("long").alias("w"), none.cast("long").alias("c"))
    rare = model.rare.select(F.pmod("w", F.lit(buckets)).cast("int").alias("bucket"), F.lit(2).alias("kind"),
                             none.cast("binary").alias("keys"), none.cast("binary").alias("counts"), none.cast("binary").alias("own"), "w", "c")
    answers = sent.groupBy("bucket").cogroup(pairs.union(rare).groupBy("bucket")).applyInArrow(
        answer, "home int, kind int, rows binary, sums binary")
    sums = answers.groupBy("home").applyInArrow(together, "id long, n_tokens double, n_known double, base_score double, score double")
    return sums.select(
        F.col("id").alias(id_col), F.round("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
