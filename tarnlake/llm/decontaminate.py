"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document, as a large search engine's is: a row of it
holds, for a few thousand documents, the ascending word positions of each term.
Terms are those that the benchmark uses; other words only advance the position.
A search goes shard by shard. Windows with a term that the shard lacks are out
at once; each other one fetches the postings of its rarest term in that shard,
which are intersected, shifted by the terms' offsets, with the next rarer ones,
for all windows together. Work is spread as the documents are, without a
shuffle, whatever terms are frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import pieces, stage, texts_of

WINDOW = 10
#: Words of benchmark items that one pass over the index looks for.
BLOCK_WORDS = 500_000
#: Candidates that are compared at once.
AT_ONCE = 1 << 21
#: Positions left free between documents, so that no match runs across.
APART = 64
_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(i if i in _WORD else 0x20 for i in range(256))

INDEX = "rows binary, doc_ids binary, n_words binary, begins binary, terms binary, offsets binary, positions binary"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased: digits, a-z and all beyond ASCII."""
    return text.lower().translate(_TABLE).split()


def benchmark_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as ``(item_id, words)``, in blocks whose size is bounded; items without id or words are left out."""
    block, held = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item_id, text in rows.toLocalIterator():
        if found := words(text.encode()):
            block.append((item_id, found))
            held += len(found)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per shard of ``docs(row, doc_id, text)``: postings of the terms in ``vocabulary``.

    ``rows`` (int64, a key of each document row), ``doc_ids`` (int64), ``n_words`` and ``begins`` (first position of each
    document) run in parallel, as do ``terms`` and ``offsets``, which point into
    ``positions`` (int32, differences within a term).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        look = shared.value.get
        for batch in pieces(batches, most_bytes=32 << 20):
            ids, counts, terms = batch.column("doc_id"), [], []
            for text in texts_of(batch, "text"):
                found = words(text)
                counts.append(len(found))
                terms.append(np.fromiter((look(w, -1) for w in found), np.int32, len(found)))
            counts = np.array(counts, np.int64)
            begins = np.cumsum(counts + APART) - counts - APART
            flat = np.concatenate(terms)
            places = np.arange(len(flat)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
            known = flat >= 0
            flat, places = flat[known], places[known]
            order = np.argsort(flat, kind="stable")
            flat, places = flat[order], places[order]
            at = np.flatnonzero(np.diff(flat, prepend=-1))
            steps = np.diff(places, prepend=0)
            steps[at] = places[at]
            yield pa.RecordBatch.from_pydict(
                {
                    "rows": [batch.column("row").to_numpy().tobytes()], "doc_ids": [_with_nulls(ids).tobytes()], "n_words": [counts.tobytes()], "begins": [begins.tobytes()],
                    "terms": [flat[at].astype(np.int32).tobytes()], "offsets": [np.append(at, len(flat)).astype(np.int64).tobytes()], "positions": [steps.astype(np.int32).tobytes()],
                }
            )

    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


NO_ID = np.iinfo(np.int64).min


def _with_nulls(ids: pa.Array) -> np.ndarray:
    return pc.fill_null(ids, int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Windows:
    """Distinct windows: ``terms`` (a row each, -1 behind shorter ones), and the items of each."""

    terms: np.ndarray
    item_begins: np.ndarray
    items: np.ndarray
    n_terms: int

    def sizes(self) -> np.ndarray:
        return (self.terms >= 0).sum(axis=1)


def windows_of(block: list[tuple[int, list[bytes]]], window: int = WINDOW) -> tuple[dict[bytes, int], Windows]:
    """The vocabulary of a block and its windows; a shorter item is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for item_id, text in block:
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in text]
        for i in range(max(1, len(terms) - window + 1)):
            found.setdefault(tuple(terms[i : i + window]), set()).add(item_id)
    terms = np.full((len(found), window), -1, np.int32)
    for row, phrase in zip(terms, found, strict=True):
        row[: len(phrase)] = phrase
    begins = np.cumsum([0, *map(len, found.values())])
    return vocabulary, Windows(terms, begins, np.array([x for items in found.values() for x in sorted(items)], np.int64), len(vocabulary))


class Shard:
    """A row of the index, opened."""

    def __init__(self, row: dict) -> None:
        read = np.frombuffer
        self.rows, self.doc_ids, self.n_words, self.begins = (read(row[k], np.int64) for k in ("rows", "doc_ids", "n_words", "begins"))
        self.terms, self.offsets, steps = read(row["terms"], np.int32), read(row["offsets"], np.int64), read(row["positions"], np.int32)
        sums = np.cumsum(steps, dtype=np.int64)
        if len(self.terms):
            before = np.where(self.offsets[:-1] > 0, sums[self.offsets[:-1] - 1], 0)
            sums -= np.repeat(before, np.diff(self.offsets))
        self.positions = sums
        #: All postings by term and position, as one integer.
        self.keys = np.repeat(self.terms.astype(np.int64), np.diff(self.offsets)) << 40 | sums

    def find(self, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: the window, where it begins, and the place of its rarest term.

        Each term is within ``slop`` words of its place in the window; with 0 the matches are exact.
        """
        begin, count = np.zeros(windows.n_terms + 1, np.int64), np.zeros(windows.n_terms + 1, np.int64)
        begin[self.terms], count[self.terms] = self.offsets[:-1], np.diff(self.offsets)
        count[-1] = np.iinfo(np.int64).max  # of the places behind short windows
        lists = count[windows.terms]
        which = np.flatnonzero(lists.min(axis=1) > 0) if len(lists) else np.zeros(0, np.int64)
        order = np.argsort(lists[which], axis=1, kind="stable")
        rarest = np.take_along_axis(windows.terms[which], order, axis=1)
        ends = np.cumsum(count[rarest[:, 0]]) if len(which) else which
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for at in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            posting = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
            w = np.searchsorted(ends, posting, side="right")
            place = self.positions[begin[rarest[w, 0]] + posting - (ends - count[rarest[:, 0]])[w]]
            start = place - order[w, 0]
            for k in range(1, windows.terms.shape[1]):
                term = rarest[w, k].astype(np.int64)
                wanted = (term << 40) + start + order[w, k]
                near = np.searchsorted(self.keys, wanted - slop)
                held = (term < 0) | (self.keys[np.minimum(near, len(self.keys) - 1)] <= wanted + slop) & (near < len(self.keys))
                w, start, place = w[held], start[held], place[held]
            for to, x in zip(out, (which[w], start, place), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) for x in out)


HITS = "row long, doc_id long, n_words long, begins array<int>, ends array<int>, items array<long>"


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """A row per document: its words, the word ranges that windows cover (merged), and their items."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # a block of the benchmark

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                yield _per_document(shard, *shard.find(shared.value, slop), shared.value)

    return index.mapInArrow(run, HITS)


def _per_document(shard: Shard, which, starts, places, windows: Windows) -> pa.RecordBatch:
    n = len(shard.doc_ids)
    doc = np.searchsorted(shard.begins, places, side="right") - 1
    sizes = windows.sizes()[which]
    begins, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
    for i in np.lexsort((sizes, starts)).tolist():
        d = int(doc[i])
        a = int(starts[i] - shard.begins[d])
        a, b = max(0, a), min(int(a + sizes[i]), int(shard.n_words[d]))
        if begins[d] and a <= ends[d][-1]:
            ends[d][-1] = max(ends[d][-1], b)
        else:
            begins[d].append(a)
            ends[d].append(b)
        w = which[i]
        items[d].update(windows.items[windows.item_begins[w] : windows.item_begins[w + 1]].tolist())
    ids = pa.array([None if x == NO_ID else int(x) for x in shard.doc_ids], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.rows), ids, pa.array(shard.n_words), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
        ["row", "doc_id", "n_words", "begins", "ends", "items"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Word ranges of ``docs`` inside occurrences of the items' windows.

    One row per row of ``docs``, as ``HITS`` without ``row``: ``begins`` and ``ends`` are merged
    half-open word ranges, ``items`` the ids whose windows occur. Null texts have
    no words; items without id or words match nothing; repeated items count
    once; repeated documents stay. Of a benchmark of any size, ``block_words``
    words are held at a time: each block is a pass of its own, and the passes
    are put together by a key of each row.
    """
    return _hits(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), items, window, slop, block_words).drop("row")


def _hits(keyed: DataFrame, items: DataFrame, window: int, slop: int, block_words: int) -> DataFrame:
    passes = []
    for block in benchmark_blocks(items, block_words):
        if not passes and sum(len(x) for _, x in block) >= block_words:
            keyed = stage(keyed, "keyed")  # there may be more passes, in which rows must have the same keys
        vocabulary, windows = windows_of(block, window)
        passes.append(search(stage(build_index(keyed, vocabulary), "index"), windows, slop))
    if not passes:
        vocabulary, windows = windows_of([], window)
        return search(build_index(keyed, vocabulary), windows, slop)
    return passes[0] if len(passes) == 1 else _merged(reduce(DataFrame.unionByName, passes))


def _merged(found: DataFrame) -> DataFrame:
    """The ranges and items of one row from several passes, put together."""

    def run(key, table):
        spans = sorted((a, b) for x, y in zip(table["begins"].to_pylist(), table["ends"].to_pylist(), strict=True) for a, b in zip(x, y, strict=True))
        begins, ends = [], []
        for a, b in spans:
            if begins and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        items = sorted({x for row in table["items"].to_pylist() for x in row})
        first = table.slice(0, 1)
        return pa.table({"row": first["row"], "doc_id": first["doc_id"], "n_words": first["n_words"], "begins": pa.array([begins], pa.list_(pa.int32())), "ends": pa.array([ends], pa.list_(pa.int32())), "items": pa.array([items], pa.list_(pa.int64()))})

    return found.groupBy("row").applyInArrow(run, HITS)


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _n_hit() -> Column:
    return F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def summary(hits: DataFrame) -> DataFrame:
    """Counts and digests of ``contamination``'s rows."""
    n_hit = _n_hit()
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def excise(docs: DataFrame, items: DataFrame, most_hit: float = 0.0, window: int = WINDOW) -> DataFrame:
    """``docs`` without documents that have over ``most_hit`` of their words in benchmark windows.

    Columns stay as they are. A document without words is kept. Each row is
    judged by its own text, whether it has a doc_id, shares one or has none.
    """
    keyed = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "keyed")
    hits = _hits(keyed.select("doc.doc_id", "doc.text", "row"), items, window, 0, BLOCK_WORDS)
    gone = hits.where(_n_hit() > most_hit * F.col("n_words")).select("row")
    return keyed.join(gone, "row", "left_anti").select("doc.*")
