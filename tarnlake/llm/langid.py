"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams. A
document ranks its own n-grams; the out-of-place distance to a profile sums how
far each of them is from its place there, a missing one counting as the whole
length of the profile. The nearest profile names the language.

N-grams are of one to three letters, words being padded by a blank on either
side, all lower-case. They are packed into integers of 16 bits a letter, so
that counting a batch of documents is one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import fold, pieces, runs, stage

PROFILE = 300
UNKNOWN = "und"
#: Languages that a model may have: the rank is cut there, by the number of n-grams learned.
MOST_LANGUAGES = 1000
_CHUNK = 1 << 20


def letters(text: str) -> np.ndarray:
    """16-bit codes of the lower-cased letters, other characters 0; folded beyond the basic plane."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    kinds, where = _letter_table(), points < 0x10000
    is_letter = np.zeros(len(points), bool)
    is_letter[where] = kinds[points[where]]
    for i in np.flatnonzero(~where).tolist():
        is_letter[i] = chr(points[i]).isalpha()
    codes = np.where(where, points, (points & 0xFFFF) | 0x8000)
    return np.where(is_letter, codes, 0).astype(np.uint64)


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    return _TABLE[0]


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams of a padded code array, as integers; blanks stand at the ends only."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    two, three = b << np.uint64(16) | a, c << np.uint64(32) | b << np.uint64(16) | a
    return np.concatenate((a[a > 0] | np.uint64(1 << 48), two[(a > 0) | (b > 0)] | np.uint64(2 << 48), three[b > 0] | np.uint64(3 << 48)))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts; long texts go in chunks that overlap."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    codes = np.concatenate((np.zeros(1, np.uint64), letters(text), np.zeros(3, np.uint64)))
    for at in range(0, max(1, len(codes) - 2), _CHUNK):
        found = np.sort(grams(codes[at : at + _CHUNK + 2]))
        first = runs(found)
        held.append((found[first], np.diff(np.append(first, len(found)))))
    return held[0] if len(held) == 1 else _summed(held)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by count and then by code."""
    return keys[np.lexsort((keys, -counts))[:most]]


def learn(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the values of ``docs.lang`` over all rows that have a text and a lang.

    Tasks sum n-grams per language before they are shuffled. Ties go to the
    smaller code, so the result does not depend on the partitioning.
    """

    def run(batches):
        for part in _by_language(batches):
            rows = [(lang, *_summed(held)) for lang, held in part.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([x for x, *_ in rows], object), [len(k) for _, k, _ in rows])).cast(pa.string()),
                    pa.array(np.concatenate([k for _, k, _ in rows]).astype(np.int64)),
                    pa.array(np.concatenate([n for *_, n in rows]).astype(np.int64)),
                ],
                ["lang", "gram", "n"],
            )

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = stage(sums.withColumn("rank", rank).where(F.col("rank") <= most), "profiles")
    if top.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    found: dict[str, list] = {}
    for lang, gram, _, rank in sorted(tuple(r) for r in top.collect()):
        found.setdefault(lang, []).append((rank, gram))
    return {lang: np.array([g for _, g in sorted(x)], np.uint64) for lang, x in found.items()}


def _by_language(batches) -> Iterator[dict[str, list]]:
    for batch in pieces(batches):
        part: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            part.setdefault(lang, []).append(counted(text))
        yield part


class Profiles:
    """Distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE) -> None:
        self.names, self.most = sorted(profiles), most
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.places = np.full((len(self.names), len(self.keys) + 1), -1)
        for i, name in enumerate(self.names):
            self.places[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distances of a document's ranking; a missing n-gram costs the profile's length."""
        at = np.searchsorted(self.keys, grams)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == grams[known]
        places = self.places[:, np.where(known, at, len(self.keys))]
        return np.where(places < 0, self.most, np.abs(places - np.arange(len(grams)))).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language, and one less its distance as a share of the largest possible one."""
        found = ranked(*counted(text), self.most) if text else np.zeros(0, np.uint64)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        far = self.distances(found)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.most * len(found)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """``(doc_id, lang_pred, score)``, a row per row of ``docs``.

    A null text, or one without letters, is ``und`` with score 0, as is any
    text if no profile was learned. Ties go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # a few hundred integers a language

    def run(batches):
        model = Profiles(shared.value, most)
        for batch in pieces(batches):
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, held_out: int = 0) -> DataFrame:
    """Learn from the folds other than ``held_out`` and predict all: ``(doc_id, held_out, lang_pred, score)``.

    A row without doc_id belongs to no fold: it is predicted and not learned from.
    """
    learned = learn(docs.where((fold(F.col("doc_id")) != held_out) & (fold(F.col("doc_id")) >= 0)))
    return identify(docs, learned).select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "lang_pred", "score")
