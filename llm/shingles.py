"""Word-shingle sets of whole texts as sorted 64-bit hashes, vectorised over Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 text, A to Z lower-cased.  A word's hash is a
polynomial over its bytes modulo 2^64, taken from running sums of the whole buffer; shingles mix the hashes of neighbouring
words.  Two different shingles share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEFFICIENTS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time: bounds the memory of a worker whatever the length of a text.
BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 2 * BLOCK), _powers(_INVERSE, 2 * BLOCK)


def _hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of ``data``; at ``begins`` a word ends in any case.  At most 2 * BLOCK bytes."""
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[begins[begins < len(data)]] = word[begins[begins < len(data)]]
    first = np.flatnonzero(start)
    if not len(first):
        return np.empty(0, np.uint64), first
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(word, _VALUES[data] * _UP[: len(data)], np.uint64(0)), dtype=np.uint64)])
    # spaces add nothing, so a word reaches as far as the next one's start
    end = np.append(first[1:], len(data))
    return mixed((total[end] - total[first]) * _DOWN[first]), first


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text longer than a block, block by block, cut at white space."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        if to < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # a word longer than a block: hash its pieces and go on behind it
                beyond = to
                while beyond < len(data) and not _SPACE[data[beyond]]:
                    beyond += 1
                parts = [_hashes(data[i: min(i + BLOCK, beyond)], np.zeros(1, np.int64))[0] for i in range(at, beyond, BLOCK)]
                lead = np.concatenate(parts)
                out.append(mixed(np.array([np.sum(lead * _UP[: len(lead)], dtype=np.uint64)])) if len(lead) > 1 else lead)
                at = beyond
                continue
        out.append(_hashes(data[at:to], np.zeros(1, np.int64))[0])
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of one text's words, as they come."""
    if len(words) >= width:
        return mixed(sum(words[i: len(words) - width + 1 + i] * _COEFFICIENTS[i] for i in range(width)))
    if not len(words):
        return words
    return mixed(np.array([np.sum(words * _COEFFICIENTS[: len(words)], dtype=np.uint64) + np.uint64(len(words))]))


def text_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of texts in order: hashes of all their words, and where each text's words begin, with the end as last."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    # a null takes no bytes, as Arrow writes it; its words are none in any case
    null = column.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(column):
            j = i + 1
            while j < len(column) and ends[j + 1] - ends[i] <= BLOCK and not null[j] and not null[j - 1]:
                j += 1
            if null[i]:
                yield np.empty(0, np.uint64), np.zeros(2, np.int64)
            elif ends[j] - ends[i] > BLOCK:  # one long text
                words = _long_words(data[ends[i]: ends[j]])
                yield words, np.array([0, len(words)])
            else:
                begins = ends[i:j] - ends[i]
                words, places = _hashes(data[ends[i]: ends[j]], begins)
                yield words, np.append(np.searchsorted(places, begins), len(words))
            i = j


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text of an Arrow string column its set of shingle hashes, sorted; nulls and blank texts give none."""
    for words, cuts in text_words(column):
        with np.errstate(over="ignore"):
            whole = _shingled(words, width) if len(words) >= width else words[:0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield np.unique(whole[a: b - width + 1]) if b - a >= width else _shingled(words[a:b], width)


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the set's hashes that fall on it: sets differ in at least as many elements as bits."""
    bits = np.bincount((found >> np.uint64(7)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)
