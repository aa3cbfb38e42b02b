"""Token ids of whole texts by a public byte-level BPE, fast enough for whole corpora.

Texts of Latin letters are encoded whole by the faster of two encoders.  Others are cut at single spaces between words, where
this vocabulary's pattern always ends a token, and the ids of the words are remembered; the result is that of encoding the
whole text at once.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words remembered by each of a worker's two tables, about 14 MB; when full a table starts again, so memory is bounded.
REMEMBERED = 60_000
#: A space inside or at the end of white space: there a token may reach over it.
_JOINED = re.compile(r"\s (?:\s|\Z)")
#: What is not a Latin letter or below.
_BEYOND = re.compile("[\u0250-\U0010ffff]")
#: Longer texts are encoded in parts of about so many characters, so the numbers of one part are in memory.
PART = 1 << 16
_ASCII_JOINED = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f ")


class _Words(dict):
    """Word to its ids as unsigned 32-bit bytes."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.encode(self.lead + word)).tobytes()
        return ids


class Encoder:
    """``vocabulary``: a tokenizers JSON file.  ``ranks``: the same vocabulary as a tiktoken file, used for words and texts of
    Latin letters, where both give the same ids and it is three times as fast; None: never."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.first, self.later = _Words(self._word, ""), _Words(self._word, " ")

    def _exact(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        return self.quick.encode_ordinary(word) if self._latin(word) else self._exact(word)

    def _latin(self, text: str) -> bool:
        return self.quick is not None and (text.isascii() or _BEYOND.search(text) is None)

    def _parts(self, text: str) -> Iterator[bytes]:
        """The ids of a Latin text whose spaces are all single ones, cut before spaces."""
        at = 0
        while at < len(text):
            to = text.find(" ", at + PART)
            to = len(text) if to < 0 else to
            yield array("I", self.quick.encode_ordinary(text[at:to])).tobytes()
            at = to

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each, in the machine's byte order (little-endian on all common machines)."""
        if not text:
            return b""
        if text.isascii():
            joined = text[-1] == " " or any(x in text for x in _ASCII_JOINED)
        else:
            joined = _JOINED.search(text) is not None
        if joined or any(x in text for x in self.special):
            return array("I", self._exact(text)).tobytes()
        if self._latin(text):
            return b"".join(self._parts(text))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest)) if head else b"".join(
            map(self.later.__getitem__, rest))


def halved(ids: bytes) -> bytes:
    """The lower halves of all 32-bit ids, then the upper ones: those are mostly zero, and runs of zeros shrink to nothing
    where tables and exchanges are compressed."""
    return np.frombuffer(ids, np.uint16).reshape(-1, 2).T.tobytes()


def from_halves(data: bytes) -> bytes:
    """The ids that ``halved`` was given."""
    return np.frombuffer(data, np.uint16).reshape(2, -1).T.tobytes()


_LOADED: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per worker process."""
    key = (vocabulary, ranks, pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]
