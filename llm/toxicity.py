"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: the ordinary one on windows of ordinary documents, the toxic one
on the passages of toxic documents that are typical of them.  A passage is a run of words in which each word, or the pair
it makes with the next, is found in clearly more passages of toxic than of ordinary documents.  Passages are cut where the
text itself says so (at words of some hashes), so those of copied documents are the same, at any place, and count once.
Open: where copies differ in what surrounds them, their outer passages differ too and count like a phrase that recurs.
The toxic dictionary carries the ordinary one in front, so all else in a window costs the same with both.

Every window of a document is compressed with both; what the toxic dictionary saves is the window's evidence.  Calibrated
thresholds: a logistic fit turns the largest saving, the sum of the clear ones and the number of windows into a
probability; the evidence it learns from comes from toxic dictionaries of the other folds, and so does the choice of how
many standard errors "clearly more" means.

The fit reads at most ``SAMPLE`` labelled documents of each class, those with the smallest keyed hashes of their ids;
scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import released, saved

SAMPLE = 5000
WINDOW = 12
STRIDE = 6
#: Bytes of each dictionary and windows or passages it is trained on; a window of more than ``PIECE`` bytes comes in pieces.
DICTIONARY = 16384
TRAINING_WINDOWS = 20_000
PIECE = 1000
#: Passages are cut at one word in ``CUT`` and after ``LONGEST`` words.
CUT = 12
LONGEST = 64
#: The least log-odds of what is typical, so many standard errors below the estimate; which of them, the folds decide.
LEAST_ODDS = 1.5
ERRORS = (0.5, 1.0, 2.0, 3.0)
#: Toxic passages that a typical word, and a typical pair, is found in at least.
FEWEST = (3, 6)
#: A saving of so many bytes is clear.
CLEAR = 2
BLOCK = 1 << 20
FOLDS = 3
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else max(b, 32) for b in range(256))


@dataclass(frozen=True)
class Model:
    """What scoring needs: a few ten kilobytes.  ``weights`` is None where the labels have one class only."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None
    constant: float


def _parts(text: str | None) -> list[bytes]:
    """The folded text, in parts of a block at most, cut at spaces."""
    data = (text or "").encode().translate(_FOLDED)
    out = []
    while len(data) > BLOCK:
        to = data.rfind(b" ", 0, BLOCK) + 1 or BLOCK
        out.append(data[:to])
        data = data[to:]
    return [*out, data]


def _blocks(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Buffers of about a block with the number of the text that each part belongs to, parts parted by spaces."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts(text):
            if size and size + len(part) > BLOCK:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part)
    if parts:
        yield parts, owners


def windows(parts: list[bytes], window: int = WINDOW, stride: int = STRIDE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, and for each window the number of its part, offset and length; the last windows of a part are shorter."""
    data = b" " + b" ".join(parts) + b" "
    space = np.frombuffer(data, np.uint8) == 32
    at = np.flatnonzero(space[:-1] & ~space[1:])  # the space before each word
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
    first = np.searchsorted(at, begins)
    part = np.repeat(np.arange(len(parts)), np.diff(first))
    place, size = np.arange(len(at)) - first[part], np.diff(first)[part]
    head = np.flatnonzero((place % stride == 0) & ((place == 0) | (place + window - stride < size)))
    stop = np.minimum(head + window, first[part[head] + 1])
    ends = np.append(at, len(data) - 1)[stop] + 1
    ends = np.minimum(ends, begins[part[head] + 1] + 1)
    return data, part[head], at[head], ends - at[head]


class Distance:
    """Compressed lengths of windows with both dictionaries."""

    def __init__(self, model: Model):
        self.tools = [self._tool(d) for d in (model.ordinary, model.toxic)]

    @staticmethod
    def _tool(dictionary: bytes) -> zstandard.ZstdCompressor:
        # binary trees over all of either dictionary: what one has in front is found as well as what the other has alone
        parameters = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=16, search_log=4, min_match=4, target_length=12, strategy=zstandard.STRATEGY_BTLAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=parameters)

    def savings(self, data: bytes, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        segments = np.stack([offsets, lengths], axis=1).astype(np.uint64).tobytes()
        sizes = []
        for tool in self.tools:
            done = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=0)
            sizes.append(np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(done)))
        return sizes[0] - sizes[1]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text: largest saving, sum of the clear savings above the border, number of windows."""
        out = np.zeros((len(texts), 3))
        for parts, owners in _blocks(texts):
            data, part, offsets, lengths = windows(parts)
            if not len(part):
                continue
            saving, owner = self.savings(data, offsets, lengths), np.asarray(owners)[part]
            np.maximum.at(out[:, 0], owner, saving)
            np.add.at(out[:, 1], owner, np.maximum(0, saving - CLEAR + 1))
            np.add.at(out[:, 2], owner, 1)
        return out


def _design(evidence: np.ndarray) -> np.ndarray:
    most, total, n = evidence.T
    return np.stack([np.ones(len(most)), most, np.log1p(total), np.log1p(n)], axis=1)


def probability(evidence: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(evidence) @ np.asarray(weights), -30, 30)))


def calibrated(evidence: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x, w = _design(evidence), np.zeros(4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
        step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """``labels``: rows that may be learnt from.  Null labels and ids are left out; of an id's labels the largest counts."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    hashed = known.withColumn("k", F.xxhash64(F.lit(5), "id"))
    chosen = [hashed.where(F.col("y") == y).orderBy("k", "id").limit(sample) for y in (0, 1)]  # bounded, so broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = saved(rows.join(F.broadcast(chosen[0].union(chosen[1])), "id").dropDuplicates(["id"])
                  .withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(FOLDS)).cast("int")), "toxic-sample")
    sizes = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(b"", b"", None, float(max(sizes, default=0)))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, fold) for text, y, fold in zip(*[batch[c].to_pylist() for c in ("text", "y", "fold")])
                    for x in dict.fromkeys(_passages(text))]
            if rows:
                kinds = [pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["passage", "y", "fold"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words and pairs of each passage with the words they cover, as (first word, number of words), and whether the term
        comes for the first time in it."""
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        for batch in batches:
            rows = []
            for number, passage, y, fold in zip(*[batch[c].to_pylist() for c in ("number", "passage", "y", "fold")]):
                words = passage.split()
                many = [(i, n, b" ".join(words[i: i + n])) for n in (1, 2) for i in range(len(words) - n + 1)]
                first = {}
                for m in many:
                    first.setdefault(m[2], m)
                # of ordinary passages the terms are only counted
                rows += [(number, fold, *m, first[m[2]] is m) for m in (many if y else first.values())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                                 ["number", "fold", "at", "n", "term", "first"])

    seen = saved(texts.select("text", "y", "fold").mapInArrow(passages, "passage binary, y int, fold int")
                 .groupBy("passage", "y").agg(F.min("fold").alias("fold"))
                 .withColumn("number", F.monotonically_increasing_id()), "toxic-passages")
    sizes = {(r["y"], r["fold"]): r["count"] for r in seen.groupBy("y", "fold").count().collect()}
    found = [seen.where(F.col("y") == y).mapInArrow(terms, "number long, fold int, at int, n int, term binary, first boolean") for y in (0, 1)]
    # terms travel with the numbers of their passages, whose texts would come once a term
    toxic = saved(found[1], "toxic-terms")
    # a word repeated in a passage counts once; what too few toxic passages have needs no count of ordinary ones
    often = toxic.where("first").groupBy("term", "n").agg(*[F.count_if(F.col("fold") == f).alias(f"n1_{f}") for f in range(FOLDS)])
    few = F.when(F.col("n") == 1, FEWEST[0]).otherwise(FEWEST[1])
    often = often.where(sum((F.col(f"n1_{f}") for f in range(FOLDS)), F.lit(0)) >= few)
    plain = found[0].join(often.select("term"), "term", "left_semi").groupBy("term").agg(
        *[F.count_if(F.col("fold") == f).alias(f"n0_{f}") for f in range(FOLDS)])
    counts = often.join(plain, "term", "left").na.fill(0)
    parts = [tuple(f for f in range(FOLDS) if f != out) for out in range(FOLDS)] + [tuple(range(FOLDS))]

    def odds(folds: tuple[int, ...]) -> Column:
        """By how many standard errors the log-odds of a term exceed ``LEAST_ODDS``; null where it is too rare."""
        n0, n1 = [sum((F.col(f"n{y}_{f}") for f in folds), F.lit(0)) for y in (0, 1)]
        all0, all1 = [float(sum(sizes.get((y, f), 0) for f in folds)) for y in (0, 1)]
        a, b = n1 + 0.5, n0 + 0.5
        more = F.log(a / (F.lit(all1 + 1) - a)) - F.log(b / (F.lit(all0 + 1) - b)) - LEAST_ODDS
        return F.when(n1 >= few, more / F.sqrt(1 / a + 1 / b))

    marks = counts.select("term", F.array(*[odds(p) for p in parts]).alias("z")).where(
        F.array_max("z") > min(ERRORS))
    typical = toxic.select("number", "at", "n", "term").join(marks, "term").groupBy("number").agg(
        F.collect_list(F.struct("at", "n", "z")).alias("marks"))  # bounded by a passage's words
    typical = typical.join(seen.where("y = 1").select("number", "passage", "fold"), "number")
    # of each fold as many passages as a dictionary is trained on at most
    typical = saved(typical, "toxic-typical")
    chosen = [typical.where(F.col("fold") == f).orderBy(F.xxhash64("passage"), "passage").limit(TRAINING_WINDOWS // FOLDS) for f in range(FOLDS)]
    rows = [r for part in chosen for r in part.collect()]
    released(toxic, seen, typical)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].to_pylist():
                data, _, offsets, lengths = windows(_parts(text), stride=WINDOW)
                out = [data[at: min(at + PIECE, o + n)] for o, n in zip(offsets.tolist(), lengths.tolist()) for at in range(o, o + n, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["window"])

    ordinary = texts.where("y = 0").select("text").mapInArrow(pieces, "window binary").distinct()
    base = trained([bytes(r[0]) for r in ordinary.orderBy(F.xxhash64("window"), "window").limit(TRAINING_WINDOWS).collect()])

    def toxic_one(part: int, errors: float) -> bytes:
        runs = (run for r in rows if r["fold"] in parts[part] for run in _marked(r, part, errors))
        return base + trained(list(dict.fromkeys(runs)))

    found = {errors: [] for errors in ERRORS}
    for fold in range(FOLDS):  # a few numbers a document of the sample
        models = [Model(base, toxic_one(fold, errors), None, 0.0) for errors in ERRORS]
        for r in _evidence(texts.where(F.col("fold") == fold), models, "y").collect():
            for i, errors in enumerate(ERRORS):
                found[errors].append((r["y"], *r["e"][3 * i: 3 * i + 3]))
    fits = []
    for errors, got in found.items():
        got = np.array(got, dtype=float).reshape(-1, 4)
        weights = calibrated(got[:, 1:], got[:, 0])
        p = np.clip(probability(got[:, 1:], weights), 1e-9, 1 - 1e-9)
        fits.append((-np.log(np.where(got[:, 0] == 1, p, 1 - p)).mean(), errors, weights))
    _, errors, weights = min(fits)
    return Model(base, toxic_one(FOLDS, errors), weights, 0.0)


def _passages(text: str | None) -> Iterator[bytes]:
    """The folded words of ``text`` in runs that start at words of some hashes, of ``LONGEST`` words at most."""
    run = []
    for word in (text or "").encode().translate(_FOLDED).split():
        if run and (len(run) == LONGEST or zlib.crc32(word) % CUT == 0):
            yield b" ".join(run)
            run = []
        run.append(word)
    if run:
        yield b" ".join(run)


def _marked(row, part: int, errors: float) -> list[bytes]:
    """The runs of typical words in a passage, each with a space before and behind."""
    words, on = bytes(row["passage"]).split(), set()
    for m in row["marks"]:
        if m["z"][part] is not None and m["z"][part] > errors:
            on.update(range(m["at"], m["at"] + m["n"]))
    out = b" ".join(w if i in on else b"" for i, w in enumerate(words))
    return [b" " + run.strip() + b" " for run in out.split(b"  ") if run.strip()]


def trained(samples: list[bytes]) -> bytes:
    """A dictionary trained on ``samples``; where that is too little text to train on, the different samples themselves."""
    samples = [x[at: at + PIECE] for x in samples if x.strip() for at in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, d=6, k=48).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-DICTIONARY:] or b" " * 8


def _evidence(texts: DataFrame, models: list[Model], keep: str) -> DataFrame:
    """``keep`` and e (array of three numbers a model) for each row's ``text``."""
    width = 3 * len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [Distance(model) for model in models]
        for batch in batches:
            got = np.concatenate([tool.evidence(batch["text"].to_pylist()) for tool in tools], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * width), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch[keep], lists], [keep, "e"])

    kind = texts.schema[keep].dataType.simpleString()
    return texts.select(keep, "text").mapInArrow(run, f"{keep} {kind}, e array<double>")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= threshold, else 0): one row per row of ``docs``.

    Null and empty texts have no window and get the score of no evidence.  Without toxic or without ordinary labels all
    scores are the label that there is, 0 without labels.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model.weights is None:
        out = rows.select("id", F.lit(model.constant).alias("score"))
    else:
        w = [F.lit(v) for v in model.weights]
        e = F.col("e")
        line = w[0] + w[1] * e[0] + w[2] * F.log1p(e[1]) + w[3] * F.log1p(e[2])
        out = _evidence(rows, [model], "id").select("id", (1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), line))))).alias("score"))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; all columns stay."""
    if model.weights is None:
        return docs if model.constant < threshold else docs.limit(0)

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Distance(model)
        for batch in batches:
            keep = probability(tool.evidence(batch.column(place).to_pylist()), model.weights) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
