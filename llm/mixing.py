"""Soft-membership mixing: document rates whose expected domain totals match target weights.

A classifier trained on a labelled table gives each document a posterior over the domains.  Distributed projected gradient
finds rates r >= ``least`` that minimise the squared relative errors of the domain totals, sum over k of ((sum over documents
d of r_d n_d p_dk) - T_k)^2 / T_k.  All rates start at 1; each step moves a rate by the product of the document's posterior
and a vector with a number for each domain, and keeps it at ``least``.  A step needs the domain totals under the current
rates, one aggregate, which also gives the length of the next step (Barzilai and Borwein's); the rates themselves are never
stored, they are a function of the text and the steps.  Where a few documents hold most tokens and ``least`` binds the
others, gradient steps creep; what ``GRADIENT_STEPS`` of them leave open is finished by Newton steps on the dual problem, whose
solution is r_d = max(least, 1 + p_d . v) for one vector v.

The classifier is a softmax regression on which words a text has (hashed to ``BUCKETS``) and shares of byte classes and lengths,
fitted on two thirds of at most ``SAMPLE`` labelled documents of each domain, those with the smallest keyed hashes of their
ids; the other third calibrates its posteriors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import saved
from llm.regression import LogisticRegression

SAMPLE = 5000
#: Hashed words that the classifier tells apart, a power of two, and its penalty.
BUCKETS = 1 << 18
PENALTY = 1e-3
ROUNDS = 60
#: Held-out documents that posteriors are calibrated on at least.
CALIBRATED = 50
GRADIENT_STEPS = 60
#: Steps end when the totals solve the problem to ``CLOSE``, relatively; ``STEPS`` aggregates in all are far more than that takes.
STEPS = 200
CLOSE = 1e-6
RIDGE = 1e-7
_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "mark", "high"]
_BYTE_CLASS = np.full(256, 6)
_BYTE_CLASS[97:123], _BYTE_CLASS[65:91], _BYTE_CLASS[48:58], _BYTE_CLASS[[9, 11, 12, 13, 32]] = 0, 1, 2, 3
_BYTE_CLASS[10], _BYTE_CLASS[[33, 44, 46, 58, 59, 63]], _BYTE_CLASS[128:] = 4, 5, 7
FEATURES = len(_CLASSES) + 6
#: Bytes that count as odd at the end of a word, and those between words.
_ODD, _GAP = (np.isin(np.arange(256), list(x)) for x in (b"%*&$#!|@^~", b" \t\n\r\x0b\x0c"))


def _read(text: str | bytes | None) -> tuple[int, list[float], np.ndarray]:
    """Tokens (words), features and the different hashed words of one whole text; null counts as empty."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    words, codes = data.split(), np.frombuffer(data, np.uint8)
    n, size, found = len(words), max(1, len(data)), set(words)
    share = np.bincount(_BYTE_CLASS, np.bincount(codes, minlength=256), len(_CLASSES)) / size
    lines = data.split(b"\n")
    marks = np.flatnonzero(_ODD[codes])
    odd = np.count_nonzero(_GAP[codes[marks[marks < len(data) - 1] + 1]]) + int(len(marks) and marks[-1] == len(data) - 1)
    x = [*share.tolist(), np.log1p(n) / 10, size / max(1, n) / 10, odd / max(1, n),
         len(found) / max(1, n), len(set(lines)) / max(1, len(lines)), 1.0]
    hashed = np.fromiter(map(zlib.crc32, map(bytes.lower, found)), np.int64, len(found))
    return n, x, np.unique(hashed & (BUCKETS - 1))


def features(text: str | bytes | None) -> tuple[int, list[float]]:
    """Tokens (words) and features of one whole text; null counts as empty."""
    return _read(text)[:2]


def buckets(text: str | bytes | None) -> np.ndarray:
    """The different hashed words of a text, A-Z in lower case, in order."""
    return _read(text)[2]


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (tokens), x (shares and lengths), words (hashed): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(t) for t in batch["text"].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["id", "n", "x", "words"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, x array<double>, words array<int>")


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features and weights (features x classes), by accelerated gradient steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean, scale = np.where(scale > 1e-12, mean, 0), np.where(scale > 1e-12, scale, 1)
    z, target = (x - mean) / scale, np.eye(classes)[y]
    step = 1 / (0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + ridge)
    w = ahead = np.zeros((x.shape[1], classes))
    for i in range(rounds):
        p = np.exp(z @ ahead - (z @ ahead).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (z.T @ (p - target) / len(z) + ridge * ahead)
        w, ahead = new, new + i / (i + 3) * (new - w)
    return mean, scale, w


@dataclass(frozen=True)
class Classifier:
    """Weights of a class: ``BUCKETS`` for the words, then the features; ``calibration`` maps raw scores to log-odds."""

    domains: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        out = (x - self.mean) / self.scale @ self.weights[BUCKETS:]
        for i, w in enumerate(words):
            out[i] += self.weights[w].sum(axis=0)
        return out

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        if self.calibration is not None:
            mean, scale, weights = self.calibration
            raw = (np.hstack([raw, np.ones((len(raw), 1))]) - mean) / scale @ weights
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str | bytes | None]) -> tuple[list[int], np.ndarray]:
        """Tokens and posteriors of whole texts."""
        if not texts:
            return [], np.empty((0, len(self.domains)))
        rows = [_read(t) for t in texts]
        return [r[0] for r in rows], self.calibrated(self.raw(np.array([r[1] for r in rows]), [r[2] for r in rows]))


def fit(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Classifier:
    """``domain``: name of a label row's domain; rows of no listed domain are left out, and of an id's domains the first counts.

    Domains without labelled documents get the posterior 0 (with no labels at all: all the same posterior).
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), domain.alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("domain").alias("domain")).withColumn("k", F.xxhash64(F.lit(4), "id"))
    chosen = None
    for name in domains:
        part = known.where(F.col("domain") == name).orderBy("k", "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.withColumn("id", F.col(f"`{id_col}`")).select("id", F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` ids a domain
    held = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)) == 0
    found = saved(described(rows, "id", "text").join(F.broadcast(chosen), "id").withColumn("held", held), "mixing-sample")
    size = len(domains)
    moments = found.where("not held").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col("x")[i] ** k).alias(f"m{k}_{i}") for i in range(FEATURES) for k, f in ((1, F.sum), (2, F.sum))]).collect()
    total = sum(r["n"] for r in moments)
    present = [domains.index(r["domain"]) for r in moments]
    absent = np.setdiff1d(np.arange(size), [domains.index(r["domain"]) for r in found.select("domain").distinct().collect()])
    weights = np.zeros((BUCKETS + FEATURES, size))
    if len(present) < 2:  # nothing to tell apart
        known_domains = np.setdiff1d(np.arange(size), absent)
        if len(known_domains):
            weights[-1, np.setdiff1d(np.arange(size), known_domains)] = -1e3
        return Classifier(domains, np.zeros(FEATURES), np.ones(FEATURES), weights)
    mean = np.array([sum(r[f"m1_{i}"] for r in moments) / total for i in range(FEATURES)])
    scale = np.sqrt(np.maximum(0, np.array([sum(r[f"m2_{i}"] for r in moments) / total for i in range(FEATURES)]) - mean**2))
    mean[-1], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)  # the last feature is the constant

    # columns of words that no row of the fit has keep the weight 0: without them the driver holds a fraction of the numbers
    seen = np.sort(found.where("not held").select(F.explode("words").alias("w")).distinct().toArrow()["w"].to_numpy())
    column = np.full(BUCKETS, -1, np.int32)
    column[seen] = np.arange(len(seen))
    wide = len(seen) + FEATURES

    def vector(x, words):
        z = (np.array(x) - mean) / scale
        at = column[np.array(words, np.int64)]
        at = at[at >= 0].tolist()
        return Vectors.sparse(wide, [*at, *range(wide - FEATURES, wide)], [1.0] * len(at) + z.tolist())

    place = F.array_position(F.array(*[F.lit(d) for d in sorted(domains[k] for k in present)]), F.col("domain")) - 1
    ready = found.select("domain", "held", place.cast("double").alias("label"), F.udf(vector, VectorUDT())("x", "words").alias("features"))
    fitted = LogisticRegression(PENALTY, ROUNDS).fit(ready.where("not held"))
    order = [domains.index(d) for d in sorted(domains[k] for k in present)]
    weights[np.ix_([*seen, *range(BUCKETS, BUCKETS + FEATURES)], order)] = fitted
    weights[-1, np.setdiff1d(np.arange(size), order)] -= 1e3
    raw = _raw(found.where(F.col("held") & F.col("domain").isin([domains[k] for k in order])), Classifier(domains, mean, scale, weights))
    calibration = None
    y = np.array([domains.index(r["domain"]) for r in raw], dtype=int)
    if len(y) >= CALIBRATED and set(y) == set(order) == set(range(size)):
        z = np.zeros((len(y), size + 1))
        z[:, order], z[:, -1] = np.array([r["raw"] for r in raw])[:, order], 1
        m, s, w = softmax_fit(z, y, size, ridge=1e-4)
        calibration = (np.append(m[:-1], 0.0), np.append(s[:-1], 1.0), w)
    return Classifier(domains, mean, scale, weights, calibration)


def _raw(rows: DataFrame, classifier: Classifier) -> list:
    """domain and raw scores of described rows, at most ``SAMPLE`` a domain."""
    shared = rows.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                raw = shared.value.raw(np.array(batch["x"].to_pylist()), [np.array(w, np.int64) for w in batch["words"].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch["domain"], pa.array(raw.tolist(), pa.list_(pa.float64()))], ["domain", "raw"])

    return rows.select("domain", "x", "words").mapInArrow(run, "domain string, raw array<double>").collect()


def with_posteriors(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (tokens) and p, the posteriors in the order of the domains: one row per row of ``docs``."""
    size = len(classifier.domains)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # some megabytes: ``BUCKETS`` numbers a domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = shared.value.posteriors(batch["text"].cast(pa.large_binary()).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * size), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), lists], ["id", "n", "p"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, p array<double>")


def _rate(steps: list[list[float]], least: float) -> Column:
    """The rate after these steps: from 1, each moves by the posterior times the step's numbers and is kept at ``least``."""
    p = F.col("p")
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps]) if steps else None
    if moves is None:
        return F.lit(1.0)

    def move(rate: Column, s: Column) -> Column:
        by = F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(float(least)), rate + by)

    return F.aggregate(moves, F.lit(1.0), move)


def rates(rows: DataFrame, targets: list[float], budget: float | None = None, least: float = 0.0,
          steps: int = STEPS, close: float = CLOSE) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` (id, n, p) with ``rate``, and the steps made.

    ``targets``: weights of the domains.  ``budget``: tokens the mixture shall have; None: as few as let every domain keep
    its present total, or all tokens where a domain without tokens shall have some.  ``rows`` is read at most ``steps`` times: pass a written table.
    Ends when the totals are within ``close`` of the targets or, where ``least`` does not allow that, of the solution; it is an
    error if more than ``GRADIENT_STEPS`` steps are allowed and do not reach it.
    """
    size = len(targets)
    goal = np.asarray(targets, dtype=float) / sum(targets)
    weight = [F.col("n") * F.col("p")[k] for k in range(size)]
    first = rows.agg(*[F.sum(weight[k]).alias(f"t{k}") for k in range(size)]).first()
    now = np.array([first[f"t{k}"] or 0.0 for k in range(size)])
    if not now.sum():
        return rows.withColumn("rate", F.lit(1.0)), []
    if budget is None:
        budget = float(max((now / np.maximum(goal, 1e-12)).max(), now.sum())) if (goal > 0).all() else float(now.sum())
    want = goal * budget
    unit = np.maximum(want, 1e-9 * budget)
    found, totals = _gradient(rows, weight, want, unit, now, least, min(steps, GRADIENT_STEPS), close)
    # the solution keeps some distance from the targets where ``least`` allows no other: only Newton's steps can tell
    if (np.abs(totals - want) > close * unit).any() and steps > GRADIENT_STEPS:
        found = [_newton(rows, weight, want, unit, least, steps - GRADIENT_STEPS, close).tolist()]
    return rows.withColumn("rate", _rate(found, least)), found


def _gradient(rows: DataFrame, weight: list[Column], want: np.ndarray, unit: np.ndarray, now: np.ndarray, least: float, steps: int,
              close: float) -> tuple[list[list[float]], np.ndarray]:
    """Projected gradient: the steps made and the totals they lead to.

    A step is as long as the last one was for its change of the totals; it is a third of that again and again while the error
    would exceed the largest of the last four.
    """
    size, made, totals = len(want), [], now
    tokens = F.col("n") * 1.0
    error = lambda t: float(((t - want) ** 2 / unit).sum())
    shortest = float(1 / (now / unit).max())  # p sums to 1, so no curvature exceeds this one's
    length, errors, tried = shortest, [error(now)], 0
    while tried < steps and (np.abs(totals - want) > close * unit).any():
        step = (-length * (totals - want) / unit).tolist()
        before, after = _rate(made, least), _rate([*made, step], least)
        row = rows.agg(*[F.sum(after * weight[k]).alias(f"t{k}") for k in range(size)],
                       F.sum((after - before) * (after - before) * tokens).alias("moved")).first()
        tried += 1
        new = np.array([row[f"t{k}"] for k in range(size)])
        if error(new) > max(errors[-4:]) * (1 + 1e-12):
            length /= 3
            continue
        change = float(((new - totals) ** 2 / unit).sum())
        made.append(step)
        errors.append(error(new))
        totals = new
        if not row["moved"] or not change:
            break
        length = min(max(row["moved"] / change, shortest), 1e6 * shortest)
    return made, totals


def _newton(rows: DataFrame, weight: list[Column], want: np.ndarray, unit: np.ndarray, least: float, steps: int, close: float) -> np.ndarray:
    """v of the solution, from Newton steps with a line search; an error where ``steps`` aggregates do not reach it."""
    size = len(want)
    pairs = [(j, k) for j in range(size) for k in range(j, size)]

    def at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the totals are from the solution, in units of the targets' roots, and the derivatives of that."""
        move = F.lit(1.0) + sum((F.col("p")[k] * F.lit(float(v[k])) for k in range(size)), F.lit(0.0))
        rate, free = _rate([v.tolist()], least), (move > least).cast("double")
        row = rows.agg(*[F.sum(rate * weight[k]).alias(f"t{k}") for k in range(size)],
                       *[F.sum(free * weight[j] * F.col("p")[k]).alias(f"g{j}_{k}") for j, k in pairs]).first()
        g = np.zeros((size, size))
        for j, k in pairs:
            g[j, k] = g[k, j] = row[f"g{j}_{k}"]
        return np.array([row[f"t{k}"] for k in range(size)]) - want + RIDGE * unit * v, g + np.diag(RIDGE * unit)

    v, made = np.zeros(size), 1
    off, slope = at(v)
    while made < steps and (np.abs(off) > close * unit).any():
        root = np.sqrt(unit)
        d = np.linalg.solve(slope / root[:, None] / root[None], -off / root) / root
        down, a, low, high = float(off @ d), 1.0, 0.0, np.inf
        while True:  # the derivative along d grows from ``down``, below 0: bracket its zero
            new_off, new_slope = at(v + a * d)
            made += 1
            there = float(new_off @ d)
            if abs(there) <= 0.5 * abs(down) or made >= steps or (np.abs(new_off) <= close * unit).all():
                break
            low, high = (low, a) if there > 0 else (a, high)
            a = (low + high) / 2 if high < np.inf else 2 * a
        v, off, slope = v + a * d, new_off, new_slope
    if (np.abs(off) > close * unit).any():
        raise RuntimeError(f"mixing: totals are {np.abs(off / unit).max():.2g} of the targets away from the solution")
    return v


def copies(rate: Column, key: Column) -> Column:
    """How often a document comes: the whole part of its rate, and once more with the probability of the rest, by a hash."""
    chance = (F.xxhash64(F.lit(44), key).cast("double") / 2.0**64) + 0.5
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


@dataclass(frozen=True)
class Mixture:
    """All that the rate of a document depends on besides its text: some megabytes, whatever the size of the corpus."""

    classifier: Classifier
    steps: list[list[float]]
    least: float


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id",
          text_col: str = "text", budget: float | None = None, least: float = 0.0) -> tuple[DataFrame, Mixture]:
    """One row per row of ``docs``: id, n_tokens, posteriors (p_ and the domain's name), rate, copies; and the mixture.

    Null and empty texts have no tokens, so their rate is not bound to any target; it follows from their posterior like any
    other.  Rows that repeat an id are rated one by one.  An empty table gives an empty result.
    """
    names = list(targets)
    classifier = fit(docs, labels, domain, names, id_col, text_col)
    rated, steps = rates(saved(with_posteriors(docs, classifier, id_col, text_col), "mixing-posteriors"), list(targets.values()), budget, least)
    out = rated.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"),
                       *[F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(names)], "rate",
                       copies(F.col("rate"), F.col("id")).alias("copies"))
    return out, Mixture(classifier, steps, least)


def resampled(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, each row as often as its rate says (0: dropped); all columns stay and nothing is shuffled."""
    place, model = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(mixture.classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pa.array(model.value.posteriors(batch.column(place).cast(pa.large_binary()).to_pylist())[1].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)), p], ["row", "p"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("p", T.ArrayType(T.DoubleType()))])
    often = copies(_rate(mixture.steps, mixture.least), F.col(f"row.`{id_col}`"))
    out = docs.mapInArrow(run, schema).withColumn("often", often).where("often > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "often"))).select("row.*")
