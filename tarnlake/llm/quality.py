"""Quality classification from positive and unlabelled texts.

Trusted positives and unlabelled web text are all that is learned from. With
class prior p, the risk of a classifier g is estimated without negatives as

    p R+(g) + max(0, Ru-(g) - p R-(g))

where R+ and R- are mean losses of the positives taken as positive and as
negative, and Ru- that of the unlabelled taken as negative. The maximum keeps
the negatives' share from going below zero; where it would, a step goes back on
it (non-negative PU learning). The prior is estimated from the same two kinds
of texts. The loss is logistic, so that g's sigmoid is a
probability. Features are the square roots of the shares of byte pairs and a
few measures of shape.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import fold, pieces, stage, texts_of

THRESHOLD = 0.3
#: The classifier is fitted on this many rows of either kind, chosen by a hash of the id.
FITTED = 6000
EPOCHS, PRIOR_EPOCHS = 60, 20
#: Of the margin that is added to the shares from which the prior is estimated.
CONFIDENCE = 0.1
BATCH = 512
RATE = 0.01
DECAY = 1e-4
SEED = 7
_PAIRS = 1 << 16
_CLASS = np.zeros(256, np.int64)
for _lo, _hi, _kind in ((0x30, 0x3A, 1), (0x41, 0x5B, 2), (0x61, 0x7B, 3), (0x80, 0x100, 4)):
    _CLASS[_lo:_hi] = _kind
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5
_KINDS = 6
MEASURES = _KINDS + 10
N_FEATURES = _PAIRS + MEASURES
_CHUNK = 4 << 20


def pairs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs that occur and the square roots of their shares; letters a-z are not told from A-Z."""
    if len(text) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    low = np.frombuffer(text.lower(), np.uint8)
    counts = np.zeros(_PAIRS, np.int64)
    if len(low) < 20_000:
        keys = np.sort(low[:-1].astype(np.uint16) << 8 | low[1:])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first].astype(np.int64), np.sqrt(np.diff(np.append(first, len(keys))) / len(keys))
    for at in range(0, len(low) - 1, _CHUNK):
        part = low[at : at + _CHUNK + 1].astype(np.int64)
        counts += np.bincount(part[:-1] << 8 | part[1:], minlength=_PAIRS)
    found = np.flatnonzero(counts)
    return found, np.sqrt(counts[found] / (len(low) - 1))


def measures(text: bytes) -> np.ndarray:
    """Shares of byte kinds, and of repeated words and lines and words said twice; lengths; all finite, for the empty text too."""
    codes = np.frombuffer(text, np.uint8)
    kinds = sum((np.bincount(_CLASS[codes[i : i + _CHUNK]], minlength=_KINDS) for i in range(0, len(codes), _CHUNK)), np.zeros(_KINDS))
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, k, letters = max(1, len(text)), max(1, len(words)), max(1.0, kinds[2] + kinds[3] + kinds[4])
    return np.concatenate(
        (
            kinds / n,
            [
                kinds[2] / letters, len(set(words)) / k, len(set(lines)) / max(1, len(lines)), min(40.0, len(text) / k) / 10, np.log1p(len(words)) / 5,
                np.log1p(len(words) / max(1, len(lines))) / 5, sum(w.isalpha() for w in words) / k, sum(w.isupper() for w in words) / k, sum(map(eq, words, words[1:])) / k, float(not words),
            ],
        )
    )


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def margin(self, text: bytes) -> float:
        at, value = pairs(text)
        shape = (measures(text) - self.mean) / self.scale
        return float(self.weights[at] @ value + self.weights[_PAIRS:] @ shape + self.bias)

    def score(self, text: bytes) -> float:
        return float(0.5 * (1 + np.tanh(self.margin(text) / 2)))


def _featured(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Features of a bounded number of rows, brought to the driver."""

    def run(batches):
        for batch in pieces(batches):
            out: list[list] = [[], [], []]
            for text in texts_of(batch, "text"):
                at, value = pairs(text)
                for to, x in zip(out, (at.astype("<u2"), value.astype("<f4"), measures(text)), strict=True):
                    to.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), *(pa.array(x, pa.binary()) for x in out)], ["kind", "at", "value", "shape"])

    found = rows.select("kind", "text").mapInArrow(run, "kind int, at binary, value binary, shape binary").collect()
    return [(k, np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float), np.frombuffer(s)) for k, a, v, s in found]


def _order(row: tuple) -> tuple:
    """Kinds apart, the rest as if shuffled, but by nothing but the features."""
    kind, *features = row
    data = b"".join(x.tobytes() for x in features)
    return kind, zlib.crc32(data), data


def _chosen(ids: DataFrame, n: int, salt: int) -> DataFrame:
    """The n ids with the smallest hash: the same ones however the rows are spread."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)


@dataclass
class Rows:
    """Sparse features of some rows: ``value`` of pair ``at`` in ``row``; scaled measures of each row."""

    at: np.ndarray
    value: np.ndarray
    row: np.ndarray
    shape: np.ndarray

    @classmethod
    def of(cls, rows: list, mean: np.ndarray, scale: np.ndarray) -> Rows:
        size = [len(at) for at, *_ in rows]
        return cls(np.concatenate([at for at, *_ in rows]), np.concatenate([x for _, x, _ in rows]), np.repeat(np.arange(len(rows)), size), (np.array([s for *_, s in rows]) - mean) / scale)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, minlength=len(self.shape)) + self.shape @ w[_PAIRS:N_FEATURES] + w[-1]

    def gradient(self, by: np.ndarray) -> np.ndarray:
        out = np.zeros(N_FEATURES + 1)
        out[:_PAIRS] = np.bincount(self.at, self.value * by[self.row], minlength=_PAIRS)
        out[_PAIRS:N_FEATURES], out[-1] = by @ self.shape, by.sum()
        return out


def nn_pu_step(w: np.ndarray, p: Rows, u: Rows, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk or, where the negatives' share of it is below zero, of what raises that share."""
    gp, gu = p.margins(w), u.margins(w)
    sp, su = 0.5 * (1 + np.tanh(gp / 2)), 0.5 * (1 + np.tanh(gu / 2))
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    minus = u.gradient(su / len(gu)) - prior * p.gradient(sp / len(gp))
    return prior * p.gradient((sp - 1) / len(gp)) + minus if negative >= 0 else -minus


def pu_step(w: np.ndarray, p: Rows, u: Rows) -> np.ndarray:
    """The gradient of the logistic loss of telling positives from unlabelled rows."""
    gp, gu = p.margins(w), u.margins(w)
    return p.gradient((0.5 * (1 + np.tanh(gp / 2)) - 1) / len(gp)) + u.gradient(0.5 * (1 + np.tanh(gu / 2)) / len(gu))


def _descend(positive: list, unlabelled: list, step_of, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by Adam over mini-batches, and the mean and scale of the measures."""
    shapes = np.array([x[-1] for x in [*positive, *unlabelled]]).reshape(-1, MEASURES)
    mean, scale = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-3)
    rng = np.random.default_rng(SEED)
    w, m, v = (np.zeros(N_FEATURES + 1) for _ in range(3))
    step = 0
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        parts = max(1, len(unlabelled) // BATCH)
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for pick_p, pick_u in zip(np.array_split(order_p, parts), np.array_split(order_u, parts), strict=True):
            if not len(pick_p) or not len(pick_u):
                continue
            g = step_of(w, Rows.of([positive[i] for i in pick_p], mean, scale), Rows.of([unlabelled[i] for i in pick_u], mean, scale)) + DECAY * w
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, mean, scale


def nn_pu_fit(positive: list, unlabelled: list, prior: float, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative unbiased risk of a linear model."""
    w, mean, scale = _descend(positive, unlabelled, lambda w, p, u: nn_pu_step(w, p, u, prior), epochs)
    return Model(w[:-1], float(w[-1]), mean, scale, prior)


def estimate_prior(positive: list, unlabelled: list, epochs: int = PRIOR_EPOCHS) -> float:
    """The share of positives among the unlabelled rows, from these two alone.

    A classifier tells half of the positives from half of the unlabelled. On
    the other halves, the share of the unlabelled above a threshold over that of
    the positives is at least the prior, and comes close to it where hardly
    anything but positives is above: the ratio is taken where it is least with
    its margin of confidence added.
    """
    w, mean, scale = _descend(positive[::2], unlabelled[::2], pu_step, epochs)
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    p, u = (np.sort(Rows.of(x[1::2], mean, scale).margins(w)) for x in (positive, unlabelled))
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    margin = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = ((above_u + margin) / above_p).argmin()
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 0, fitted: int = FITTED) -> Model | None:
    """Fit on documents outside the fold ``held_out``; None if they have no positives.

    Trusted positives are documents of label 1, the unlabelled are documents
    whatever their label; of each the ``fitted`` whose id has the smallest hash.
    The prior is estimated from these, so that label 0 plays no part. Labels
    other than 1 count as missing; a doc_id labelled twice has its larger label.
    """
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = train.where((fold(F.col("doc_id")) != held_out) & F.col("doc_id").isNotNull())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where((fold(F.col("doc_id")) != held_out) & F.col("doc_id").isNotNull() & (F.col("quality") == 1))
    kinds = {1: _chosen(known, fitted, 1), 0: _chosen(train, fitted, 2)}
    # at most ``fitted`` ids are broadcast, so their texts are found in one scan
    chosen = reduce(DataFrame.unionByName, (ids.withColumn("kind", F.lit(kind)) for kind, ids in kinds.items()))
    rows = sorted(_featured(train.join(F.broadcast(stage(chosen, "chosen")), "doc_id")), key=_order)
    positive, unlabelled = ([x[1:] for x in rows if x[0] == kind] for kind in (1, 0))
    return nn_pu_fit(positive, unlabelled, estimate_prior(positive, unlabelled)) if positive and unlabelled else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` of whole texts, a row per row of ``docs``; null is empty. Without a model all score 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        fitted = shared.value
        for batch in pieces(batches):
            found = [0.5 if fitted is None else fitted.score(x) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows without doc_id are scored and not learned from."""
    scored = score(docs, learn(docs, labels, held_out))
    return scored.select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        fitted = shared.value
        for batch in pieces(batches):
            yield batch.filter(pa.array([fitted is None or fitted.score(x) >= threshold for x in texts_of(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
