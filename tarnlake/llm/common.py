"""What the corpus operators share: staging tables, byte columns, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    all executors are threads of this machine, as in tests, a temporary folder
    is set in its place.
    """
    place = spark.conf.get(CHECKPOINT_DIR, None)
    if not place:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set(CHECKPOINT_DIR, place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, path: str | None = None) -> None:
    """Delete a staged table or, by default, all that this application has staged. What is still to be read from them is lost."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


def fold_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(batches, most_rows: int = 2000, most_bytes: int = 16 << 20, column: str = "text"):
    """Cut record batches so that a piece holds few rows and, but for one long text, few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (held + n > most_bytes or i - begin >= most_rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.where(SPACE, 0, np.random.default_rng(20).integers(1, 1 << 63, 256) * 2 + 1).astype(_U)
_STEP = 0x9E3779B97F4A7C15
_MIX = _U(0xBF58476D1CE4E5B9)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _MIX
    return x ^ x >> _U(29)


#: Longer spans are hashed one by one.
_LONG_SPAN = 1 << 16


def span_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes that ascend and have nothing but white space between them."""
    if not len(begins):
        return np.zeros(0, _U)
    if (long := sizes > _LONG_SPAN).any():
        out, kept, dropped = np.empty(len(begins), _U), np.ones(len(data), bool), np.cumsum(np.where(long, sizes, 0))
        for i in np.flatnonzero(long).tolist():
            span = slice(begins[i], begins[i] + sizes[i])
            out[i], kept[span] = xxhash.xxh64_intdigest(data[span].tobytes()), False
        out[~long] = span_hashes(data[kept], (begins - dropped)[~long], sizes[~long])
        return out
    if not _POWERS or len(_POWERS[0]) < len(data):
        inverse = pow(_STEP, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.append(_U(1), np.full(max(len(data), 1 << 20) - 1, s, _U))) for s in (_STEP, inverse)]
    step, back = _POWERS
    return mix(np.add.reduceat(_BYTE[data] * step[: len(data)], begins) * back[begins] + sizes.astype(_U))


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def strips(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """``(first, parts)``: consecutive texts, or parts of a long one cut at white space, of about ``most`` bytes together."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            cut = _BREAK.search(text, at + most)
            if cut is None:
                break
            if held:
                yield first, held
                held, size = [], 0
            yield i, [text[at : cut.end()]]
            at = cut.end()
        if not held:
            first = i
        held.append(text[at:] if at else text)
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size = [], 0
    if held:
        yield first, held


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large and small stars.

    Returns ``(node, component)`` for the nodes of edges, ``component`` being
    the smallest node that is reachable. Each round is aggregations, which
    combine a hub before it is shuffled, and equi joins, for which hubs are
    broadcast; the edges of a round go to a table in the shared folder, and
    those of the round before are deleted. Edges with a null end are ignored.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    now = stage(both.where("u is not null and v is not null and u <> v").distinct(), path=path)
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(around, mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_least(large, mark[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        old, path = path, new_path(spark, "edges")
        now = stage(small.where("u <> v").distinct(), path=path)
        clear(spark, old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


#: A node with more edges is a hub; there are so many of them at most, as fewer edges make none where there are many.
HUB, MOST_HUBS = 1 << 16, 100_000


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """``rows(u, v)`` with the smallest ``v`` of their ``u`` as ``m``, so that no task holds all rows of a hub."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(HUB, 2 * edges // MOST_HUBS)
    if edges <= limit:
        return rows.join(least.drop("n"), "u")
    hubs = F.broadcast(stage(least.where(F.col("n") > limit).drop("n"), "hubs"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.drop("n"), "u"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
