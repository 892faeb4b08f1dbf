"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit SimHashes of word shingles. Two of them within three
bits differ in at most one bit in one of their 32-bit halves. Each distinct
fingerprint is stored in a table under both halves; each then enumerates the
ball of radius one around either half (only by setting bits, as one of any two
halves that differ in a single bit lacks it), fetches the table's matches and
keeps those whose whole distance is small enough. Keys of 32 bits stay
selective over billions of fingerprints, and copies never meet: they share one
fingerprint.

Near copies by the similarity of whole shingle sets differ in more bits than
such balls reach. ``near_duplicates`` finds them by wider SimHashes, which are
stored under many short segments.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import components, pieces, stage, texts_of

SEED = 42
MOST_BITS = 3
AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, size: int):
    """XXH64 of the word shingles, in arrays of bounded length. A-Z are lower-cased."""
    flat = b" ".join(text.lower().split())
    if not flat:
        return
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    begins, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(flat)]))
    n = max(1, len(begins) - size + 1)
    last = ends[min(size, len(ends)) - 1 :]
    of = xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        spans = zip(begins[at : min(at + AT_ONCE, n)].tolist(), last[at : at + AT_ONCE].tolist(), strict=True)
        yield np.array([of(flat[i:j], SEED) for i, j in spans], np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the hashes; no words give 0."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; a null text counts as empty."""

    def run(batches):
        for batch in pieces(batches):
            fps = [fingerprint(x, size) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(fp: Column) -> Column:
    halves = (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array(*(F.struct(F.lit(i).alias("seg"), x.alias("key")) for i, x in enumerate(halves)))


def fingerprint_links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges ``(u, v)`` between the ``rep`` of distinct fingerprints ``(fp, rep)`` within ``most_bits``.

    ``most_bits`` may be 0 to 3: with two segments, balls of radius one reach no further.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("most_bits must be 0 to 3")
    table = distinct.select("fp", "rep", F.inline(_segments(F.col("fp"))))
    ball = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        lambda k: k != F.col("key"),
    )
    probe = table.select(
        F.col("seg").alias("seg_a"), F.col("fp").alias("fp_a"), F.col("rep").alias("u"), F.col("key").alias("own"), F.explode(F.concat(F.array("key"), ball)).alias("key_a")
    )
    held = table.select(F.col("seg").alias("seg_b"), F.col("key").alias("key_b"), F.col("fp").alias("fp_b"), F.col("rep").alias("v"))
    met = (F.col("seg_a") == F.col("seg_b")) & (F.col("key_a") == F.col("key_b"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= most_bits
    once = (F.col("own") != F.col("key_a")) | (F.col("fp_a") < F.col("fp_b"))
    return probe.join(held, met & near & once).select("u", "v")


def simhash_groups(docs: DataFrame, size: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach. Texts without
    words have fingerprint zero and link like any other. A row without doc_id
    gets its fingerprint and the id of that fingerprint's group, and links nothing
    itself: where only such rows share a fingerprint, component_id is null.
    Repeated rows are kept; an empty table gives an empty one.
    """
    prints = stage(fingerprints(docs, size), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    named = distinct.where("rep is not null")
    found = components(fingerprint_links(named, most_bits))
    of = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of near_duplicates: words in a shingle, least similarity.
SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: At most this share of SimHash bits differs between two sets with a similarity of 0.8: 0.1515, the angle over pi, in large ones, 0.164 in ones of 4 and 5.
FLIPS = 0.165
#: How often two such sets may share no segment, and the mean number of texts that share one, by which segments are cut.
MISSED, SHARED = 1e-6, 2048
#: The words of a fingerprint that are compared as a whole, and how many of their 192 bits may differ. At 0.8 more differ with a
#: probability of 5e-7 (3e-6 in sets of 4 and 5), at 0.44 half of the pairs pass, of unrelated pairs 4e-9. The last is of the first two words.
SKETCH, MOST_APART, MOST_IN_TWO = ["s0", "s1", "s2"], 56, 48
#: Texts of a bucket that one task compares with each other (four times as many at first, and of those outside its largest tree), nearest ones of a text that are verified at a time, and how often at most.
HOT, NEAREST, ROUNDS = 1024, 4, 3
#: Bits of a parity bitmap.
PARITY = 1024
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX
    return x ^ x >> np.uint64(29)


def tables(texts: int) -> tuple[int, int]:
    """The width of a segment in bits and the number of segments, each of which has a table, for so many texts."""
    width = max(5, math.ceil(math.log2(max(1, texts) / SHARED)))
    return width, math.ceil(math.log(MISSED) / math.log1p(-((1 - FLIPS) ** width)))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``64 * words`` bits of a set of hashes. Each votes -3, -1, 1 or 3 on a bit, so that few votes seldom tie; no hashes give 0."""
    ones, salt = np.zeros(128 * words, np.int64), np.arange(1, 2 * words + 1, dtype=np.uint64) * _STEP
    for at in range(0, len(shingles), 255):
        x = _mix(shingles[at : at + 255, None] + salt) * _MIX_2
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    votes = 2 * ones[: 64 * words] + ones[64 * words :]
    return np.packbits(2 * votes > 3 * len(shingles), bitorder="little").view(np.uint64)


def segments(fingerprint: np.ndarray, width: int, count: int) -> np.ndarray:
    """A key of each segment of a wide fingerprint: its number, then its bits."""
    bits = np.unpackbits(fingerprint.view(np.uint8), bitorder="little")[: width * count].reshape(count, width)
    return (np.arange(count) << width) + bits @ (1 << np.arange(width))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """All distinct shingle hashes."""
    found = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole shingle sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` hash values, whether an odd number of the shingles has it. No more bits of two sets differ than elements do."""
    counts = np.bincount((_mix(shingles) >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


class _Rows:
    """Rows of buckets as arrays: ``key`` and ``cell`` of the bucket, the words of ``SKETCH`` of a text, and more."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.columns = columns

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def take(self, at) -> _Rows:
        return _Rows({k: x[at] for k, x in self.columns.items()})

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        return _Rows({k: np.concatenate([p.columns[k] for p in parts]) for k in parts[0].columns})

    @staticmethod
    def of(batch: pa.RecordBatch, names: list[str]) -> _Rows:
        columns = {x: batch.column(x).to_numpy() for x in names if x != "bits"}
        columns |= {x: columns[x].view(np.uint64) for x in SKETCH}
        if "bits" in names:
            columns["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        return _Rows(columns)

    def apart(self, i, j, words: list[str] = SKETCH) -> np.ndarray:
        """How many bits of some words of the fingerprints differ."""
        return sum(np.bitwise_count(self.columns[x][i] ^ self.columns[x][j]) for x in words)

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the matrix of ``i``, a column, and ``j``, a row, two fingerprints are close."""
        x, y = np.nonzero(self.apart(i, j, SKETCH[:2]) <= MOST_IN_TWO)
        near = self.apart(i[x, 0], j[0, y]) <= MOST_APART
        return x[near], y[near]

    def allowed(self, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of some pairs, whether their bitmaps allow for a similarity of ``least``, and by how much in 10,000 their sets differ at least."""
        differ = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            differ[part] = np.bitwise_count(self.bits[i[part]] ^ self.bits[j[part]]).sum(axis=1)
        both = self.size[i] + self.size[j]
        return differ * (1 + least) <= (1 - least) * both + 1e-6, 10_000 * differ // np.maximum(both, 1)


def _buckets(batches, names: list[str]):
    """Rows of whole buckets, some at a time, from rows sorted by key and cell."""
    held: list[_Rows] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _Rows.of(batch, names)
        if held and (held[-1].key[-1], held[-1].cell[-1]) != (part.key[0], part.cell[0]):
            yield _Rows.joined(held)
            held = []
        others = np.flatnonzero((part.key != part.key[-1]) | (part.cell != part.cell[-1]))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:  # what is left may go on in the next batch
            yield _Rows.joined([*held, part.take(slice(0, cut))])
            held = []
        held.append(part.take(slice(cut, None)))
    if held:
        yield _Rows.joined(held)


def _compared(rows: _Rows):
    """Bounds of the buckets of two in ``rows``, then a row of each with all of a larger bucket, some rows at a time."""
    first = np.flatnonzero(np.concatenate(([True], (rows.key[1:] != rows.key[:-1]) | (rows.cell[1:] != rows.cell[:-1]))))
    size = np.diff(np.append(first, len(rows.key)))
    two = first[size == 2]
    yield two, two + 1
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        for at in range(a, a + n, 128):
            yield np.arange(at, min(at + 128, a + n))[:, None], np.arange(a, a + n)[None, :]


NEAR = ["key", "cell", *SKETCH, "rep", "blocks"]
TREES = ["tree", "size", "bits"]
_FAR = 1 << 20


def _first_pairs(batches):
    """From each text to all that are close to it in a bucket, ``(u, v, apart)``.

    Where these are more than ``NEAREST``, only to its nearest one and the
    nearest with a smaller id, and to itself, ``apart`` being -1, as it is if
    other blocks may hold more.
    """
    for rows in _buckets(batches, NEAR):
        some = rows.rep[rows.blocks > 1]
        us, vs, ds = [some], [some], [np.full(len(some), -1)]

        def add(i, j, apart):
            us.append(rows.rep[i])  # noqa: B023
            vs.append(rows.rep[j])  # noqa: B023
            ds.append(apart)  # noqa: B023

        for i, j in _compared(rows):
            if i.ndim == 1:
                far = rows.apart(i, j).astype(np.int64)
                i, j, far = (x[far <= MOST_APART] for x in (i, j, far))
                add(i, j, far)
                add(j, i, far)
                continue
            x, y = rows.close(i, j)
            other = i[x, 0] != j[0, y]
            x, y = x[other], y[other]
            if not len(x):
                continue
            many = np.bincount(x, minlength=len(i)) > NEAREST
            few = ~many[x]
            a, b = i[x[few], 0], j[0, y[few]]
            add(a, b, rows.apart(a, b).astype(np.int64))
            if many.any():
                mine = i[many]
                far = rows.apart(mine, j).astype(np.int64)
                far[(mine == j) | (far > MOST_APART)] = _FAR
                add(mine[:, 0], mine[:, 0], np.full(len(mine), -1))
                for d in (far, np.where(rows.rep[j] < rows.rep[mine], far, _FAR)):
                    near = d.argmin(axis=1)
                    there = d[np.arange(len(near)), near] < _FAR
                    add(mine[there, 0], j[0, near[there]], d[there, near[there]])
        u, v, d = (np.concatenate(x) for x in (us, vs, ds))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int32())], ["u", "v", "apart"])


def _nearest_pairs(least: float):
    """From each text to all in a cell that the bitmaps allow and that are in other trees, ``(u, v, apart)``, by the bitmaps.

    Where these are more than ``NEAREST``, or other cells may hold more, as in ``_first_pairs``.
    """

    def distances(rows, i, j):
        far = rows.apart(i, j).astype(np.int64)
        good = (far <= MOST_APART) & (rows.tree[i] != rows.tree[j])
        at = np.nonzero(good)
        a, b = (i[at], j[at]) if i.ndim == 1 else (i[at[0], 0], j[0, at[1]])
        good[at], far[at] = rows.allowed(a, b, least)
        return np.where(good, far, _FAR)

    def run(batches):
        for rows in _buckets(batches, [*NEAR, *TREES]):
            some = rows.rep[rows.blocks > 1]
            us, vs, ds = [some], [some], [np.full(len(some), -1)]
            for i, j in _compared(rows):
                far = distances(rows, i, j)
                if i.ndim == 1:
                    us += [rows.rep[i], rows.rep[j]]
                    vs += [rows.rep[j], rows.rep[i]]
                    ds += [far, far]
                    continue
                mine, many = rows.rep[i[:, 0]], (far < _FAR).sum(axis=1) > NEAREST
                x, y = np.nonzero((far < _FAR) & ~many[:, None])
                us += [mine[x], mine[many]]
                vs += [rows.rep[j[0, y]], mine[many]]
                ds += [far[x, y], np.full(int(many.sum()), -1)]
                mine, far = mine[many], far[many]
                if not len(mine):
                    continue
                for d in (far, np.where(rows.rep[j] < mine[:, None], far, _FAR)):
                    near = d.argmin(axis=1)
                    us.append(mine)
                    vs.append(rows.rep[j[0, near]])
                    ds.append(d[np.arange(len(near)), near])
            u, v, d = (np.concatenate(x) for x in (us, vs, ds))
            kept = d < _FAR
            yield pa.RecordBatch.from_arrays([pa.array(u[kept], pa.int64()), pa.array(v[kept], pa.int64()), pa.array(d[kept], pa.int32())], ["u", "v", "apart"])

    return run


def _other_pairs(least: float):
    """All pairs of different trees that sketches and bitmaps allow, ``(u, v)``."""

    def run(batches):
        for rows in _buckets(batches, [*NEAR, *TREES, "block"]):
            for i, j in _compared(rows):
                if i.ndim == 1:
                    near = rows.apart(i, j) <= MOST_APART
                    a, b = i[near], j[near]
                else:
                    x, y = rows.close(i, j)
                    a, b = i[x, 0], j[0, y]
                    once = rows.rep[b] < rows.rep[a]
                    a, b = a[once], b[once]
                met = rows.tree[a] != rows.tree[b]
                # where cells share rows, those of the same block meet in one of them
                met &= (rows.block[a] != rows.block[b]) | (rows.cell[a] // rows.blocks[a] == rows.cell[a] % rows.blocks[a])
                a, b = a[met], b[met]
                kept = rows.allowed(a, b, least)[0]
                u, v = rows.rep[a[kept]], rows.rep[b[kept]]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], ["u", "v"])

    return run


def _dealt(texts: DataFrame, pairs: bool = False) -> DataFrame:
    """``texts``, which have ``keys``, by bucket, in cells of about ``HOT`` texts.

    With trees, those of a bucket's largest tree are dealt over its cells, and
    all others of the bucket are in each of these, so that whatever is to be
    compared meets. Only where these others are many is all the bucket dealt in
    blocks; with ``pairs`` each pair of blocks meets in a cell.
    """
    buckets = texts.select("*", F.explode("keys").alias("key")).drop("keys")
    shared = F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))
    if "tree" not in texts.columns:
        many = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (4 * HOT)).alias("blocks")).where("blocks > 1").select(F.col("key").alias("hot"), "blocks")
        buckets = buckets.join(stage(many, "hot"), F.col("key") == F.col("hot"), "left").drop("hot").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        return buckets.withColumn("cell", shared)
    counts = texts.select("tree", F.explode("keys").alias("key")).groupBy("key", "tree").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "tree")).alias("most"), F.sum("n").alias("n")).withColumn("others", F.col("n") - F.col("most.n"))
    blocks = F.when(F.col("others") <= 4 * HOT, F.lit(1).cast("long")).otherwise(F.ceil(F.col("n") / HOT))
    # what is in one tree is not compared any more
    mixed = mixed.where("others > 0").select("key", F.col("most.tree").alias("largest"), F.ceil(F.col("most.n") / HOT).alias("around"), blocks.alias("blocks"))
    buckets = buckets.join(stage(mixed, "mixed"), "key")
    whole, inside = F.col("blocks") == 1, F.col("tree") == F.col("largest")
    buckets = buckets.withColumn("block", F.when(whole, inside.cast("long")).otherwise(shared))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    apart = F.transform(to("blocks"), lambda j: F.least("block", j) * F.col("blocks") + F.greatest("block", j)) if pairs else F.array("block")
    cells = F.when(whole & inside, F.array(F.pmod(F.xxhash64("rep", "key"), F.col("around")))).when(whole, to("around")).otherwise(apart)
    return buckets.withColumn("cell", F.explode(cells))


def _nearest_of(texts: DataFrame, least: float) -> DataFrame:
    """``(u, v)``: what any bucket has for each text, but of a text that has more than that only the nearest ones and ``(u, u)``.

    With trees, only what is in other trees and allowed. As trees only grow, a
    text without ``(u, u)`` will then have no others.
    """
    trees = "tree" in texts.columns
    rows = _in_buckets(_dealt(texts).select(*NEAR, *(TREES if trees else [])))
    near = rows.mapInArrow(_nearest_pairs(least) if trees else _first_pairs, "u long, v long, apart int")
    near = near.groupBy("u").agg(F.array_sort(F.collect_set(F.struct("apart", "v"))).alias("near"))
    nearest = F.slice("near", 1, NEAREST + 1)
    near = near.select("u", F.when(F.col("near")[0]["apart"] < 0, nearest).otherwise(F.col("near")).alias("near"))
    near = near.select(F.col("u").alias("a"), F.explode("near.v").alias("b"))
    return near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell")


def near_duplicates(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """``(doc_id, kept_id)``: the smallest id of the group of each document that has one, exact and near copies.

    Each text has a wide SimHash of its five-word shingles, cut in segments of
    a few bits. Texts meet in a bucket of a segment's table if they have its
    bits in common, and are candidates if few bits of the first 192 differ.
    Of texts with a similarity of 0.8, whatever their lengths and wherever they
    differ, less than a pair in a million is missed, and four in a million where
    the sets have four and five shingles. Candidates are compared on their
    whole sets of shingles, and those that are similar enough are linked to
    trees. Of a text with many candidates, the nearest ones are compared first,
    then its nearest ones in other trees, a few times, of those that the bitmaps
    of their sets' parities allow, which bound the similarity from above. Only
    texts with many of these go on, as the others are compared with all of
    theirs. At last all pairs of what is left between trees are compared that
    the bitmaps allow.
    Equal texts are one row before that. Null texts count as empty; empty texts
    are copies of each other. Rows without doc_id are left out; a doc_id with
    several texts is one node, linked if any of them is.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width, count = tables(rows.count())
    words = max(len(SKETCH), -(-width * count // 64))

    def describe(batches):
        for batch in pieces(batches):
            found = texts_of(batch, "text")
            prints = [wide_fingerprint(shingle_set(x), words) for x in found]
            sketch = np.array([x[: len(SKETCH)] for x in prints]).view(np.int64)
            columns = [
                pa.array([sha256(x).digest() for x in found], pa.binary()), *(pa.array(x.copy()) for x in sketch.T),
                pa.array([segments(x, width, count) for x in prints], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "same", *SKETCH, "keys"])

    longs = ", ".join(f"{x} long" for x in SKETCH)
    described = stage(rows.mapInArrow(describe, f"doc_id long, same binary, {longs}, keys array<long>"), "described")
    reps = stage(described.groupBy("same", *SKETCH, "keys").agg(F.min("doc_id").alias("rep")), "reps")

    def whole(batches):
        for batch in pieces(batches):
            sets = [shingle_set(x) for x in texts_of(batch, "text")]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            bits = pa.array([parity_bits(x).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), bits, lists], ["id", "size", "bits", "shingles"])

    def verify(batches):
        for batch in batches:
            a, b = ([x.values.to_numpy().view(np.uint64) for x in batch.column(k)] for k in ("shingles_u", "shingles_v"))
            yield batch.select(["u", "v"]).filter(pa.array([similarity(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_()))

    edges = stage(_nearest_of(reps.select("rep", *SKETCH, "keys"), least), "candidates")
    ids = stage(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    # whole shingle sets of the texts that may have partners
    sets = rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(whole, "id long, size long, bits binary, shingles array<long>")
    sets = stage(sets.repartition("id").distinct(), "sets")
    of = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"shingles_{k}"))
    linked = lambda edges: edges.join(of("u"), "u").join(of("v"), "v").mapInArrow(verify, "u long, v long")
    compared = edges.where("u <> v")
    groups = components(linked(compared))
    many = edges.where("u = v").select("u")  # texts with more candidates than these
    named = lambda groups: reps.join(groups, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("kept_id"))
    kept = lambda found: described.select("doc_id", "same").join(found, "same").groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))
    if many.isEmpty():
        return kept(named(groups))
    texts = reps.drop("same").join(many, F.col("rep") == F.col("u"), "left_semi")
    texts = stage(texts.join(sets.drop("shingles"), F.col("rep") == F.col("id")).drop("id"), "texts")

    def in_trees(groups):
        found = texts.join(groups, F.col("rep") == F.col("node"), "left")
        return stage(found.select(*texts.columns, F.coalesce("component", "rep").alias("tree")), "trees")

    def joined(groups, more):
        return components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    for _ in range(ROUNDS - 1):
        near = stage(_nearest_of(in_trees(groups), least), "nearest")
        texts = texts.join(near.where("u = v").select("u"), F.col("rep") == F.col("u"), "left_semi")  # the others are settled
        fresh = stage(near.where("u <> v").join(compared, ["u", "v"], "left_anti"), "candidates")
        more = stage(linked(fresh), "links")
        compared = compared.union(fresh)
        if more.isEmpty():
            break
        groups = joined(groups, more)
    others = _in_buckets(_dealt(in_trees(groups), pairs=True)).select(*NEAR, *TREES, "block").mapInArrow(_other_pairs(least), "u long, v long")
    others = stage(others.distinct().join(compared, ["u", "v"], "left_anti"), "candidates")
    more = stage(linked(others), "links")
    if not more.isEmpty():
        groups = joined(groups, more)
    return kept(named(groups))


def drop_near_duplicates(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """One row of each group of near copies, all columns: the one with the smallest doc_id.

    Rows that share a doc_id stay or go together; rows without doc_id stay.
    """
    gone = near_duplicates(docs, least).where("doc_id <> kept_id").select(F.col("doc_id").alias("gone"))
    return docs.select(F.struct("*").alias("doc")).join(gone, F.col("doc.doc_id") == F.col("gone"), "left_anti").select("doc.*")
